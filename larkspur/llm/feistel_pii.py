"""Personal data replaced by format-preserving pseudonyms.

Found are e-mail addresses, IPv4 addresses, calendar dates, IBANs (mod 97), payment card numbers (Luhn), social
security numbers, phone numbers, access keys and values named password, token and the like. What is found is put
through a keyed Feistel network on its letters and digits: the positions that may change are cut into two halves, and
in each of ``ROUNDS`` rounds one half is shifted, place by place and modulo the place's radix (10 for a digit, 26 for
a letter, 6 for a hexadecimal letter), by a key stream hashed from the other half. That is a permutation of all values
of one format: digits stay digits, letters stay letters of the same case, separators stay, equal values get equal
pseudonyms in every document, different values different ones, and ``restore`` undoes it with the key. Card numbers
and IBANs get valid check digits again; dates are permuted as day numbers, addresses as 32 bits.

Everything is DataFrame functions; texts without a digit or @ are passed on at once. No pattern repeats a group of
varying length without a bound, so that no text, however long, deepens the stack of the pattern matcher.

Each kind is sought in a pass of its own (card numbers in two: those grouped as on cards come before phone numbers), over what the passes before it have left open. A match that fails its check
becomes part of the open text again, together with what stands on both sides, and so does whatever lies before or behind
the value inside a match: no failed or longer match can hide another kind. A run of digit groups may hold a card number
beside other digits, and an IBAN may be followed by more groups. Where the whole run fails its check, shorter readings
are tried at group borders: for cards from the leftmost group on the longest valid one of 13 to 19 digits, then once more
behind it; for IBANs the longest valid one from the start. Runs of more than 37 digits are read in pieces of that many.

A date with slashes is read as month/day, or as day/month where only that is a date; either reading is permuted within
the dates that are read so and written the same way, so that different dates stay different.

The key is an argument; the query takes it from the session's ``spark.larkspur.pii.key`` and only without one uses the
demonstration key.

Defined results: null stays null with zero counts; empty texts stay; numbers that fail their check in all readings are
left alone; dates outside 1900-01-01 to 2099-12-30 are left alone, others are written with leading zeros; where kinds
overlap the one that comes first in PASSES wins, within a kind the longest reading at the leftmost place, and of a run
with several valid readings ``restore`` may choose another one; repeated rows give equal results; a column named like a result is replaced by it, other extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import let, table

ROUNDS = 10
DEMONSTRATION_KEY = "larkspur-demonstration-key"
KINDS = ("secret", "key", "email", "ip", "date", "iban", "ssn", "phone", "card")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "secret": r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s?[=:]\s?[\"']?(?=[A-Za-z_/+-]*\d)[A-Za-z0-9_/+-]{8,}[\"']?)",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-](?:(?!\.\.)[A-Za-z0-9.-])*\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<![\d./])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d|[./]\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<!\d)(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,36}(?!\d|-\d)",
}
#: A card number grouped as cards are, which no phone number before it may take a group from, or two of them in a row.
GROUPED = (
    r"(?<![\d.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|3\d{3}([ -])\d{6}\2\d{5}|\d{13,19})"
    r"(?:[ -](?:\d{4}([ -])\d{4}\3\d{4}\3\d{4}|3\d{3}([ -])\d{6}\4\d{5}|\d{13,19}))?(?!\d|-\d)"
)
#: The passes, in their order: a kind and what it is found by. What was found as one IBAN may hold another behind it.
PASSES = [(k, PATTERNS[k]) for k in ("secret", "key", "email", "ip", "date", "iban", "iban")] + [("card", GROUPED)] + [(k, PATTERNS[k]) for k in ("ssn", "phone", "card")]
#: What a text must hold to be read for a kind at all.
SIGNS = {"secret": "[=:]", "key": "AKIA|ASIA", "email": "@", "ip": r"\d\.\d", "date": r"\d[-./]\d", "iban": r"[A-Z]{2}\d\d", "phone": r"\d{3}", "ssn": r"\d-\d", "card": r"\d[ -]?\d"}

_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Days from 1900-01-01; 184 * 397 of them are permuted.
_DAY_A, _DAY_B = 184, 397


def _stream(key: str, tag: str, r: Column, half: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{tag}|"), r.cast("string"), F.lit("|"), F.array_join(F.transform(half, lambda x: x.cast("string")), ",")), 512)


def _network(left: Column, right: Column, left_base: Column, right_base: Column, key: str, tag: str, back: bool = False) -> Column:
    """The halves after all rounds, as one array; arguments are arrays of int of the same lengths as their radices."""
    sign = -1 if back else 1

    def shifted(half: Column, base: Column, other: Column, r: Column) -> Column:
        return let(
            _stream(key, tag, r, other),
            lambda ks: F.transform(half, lambda x, i: F.pmod(x + sign * F.conv(F.substring(ks, 1 + 4 * (i % 32), F.lit(4)), 16, 10).cast("int"), F.get(base, i)).cast("int")),
        )

    def turn(acc: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(shifted(acc["l"], left_base, acc["r"], r).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), shifted(acc["r"], right_base, acc["l"], r).alias("r"))
        )

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    done = F.aggregate(order, F.struct(left.alias("l"), right.alias("r")), turn)
    return let(done, lambda d: F.concat(d["l"], d["r"]))


def permuted(value: Column, first: Column, tag: str, key: str, hexed: Column, back: bool = False) -> Column:
    """value with the letters and digits from place ``first`` (0-based) on permuted."""

    def places(chars: Column) -> Column:
        def letters(c: Column, i: Column) -> Column:
            return (i >= first) & c.rlike("[A-Za-z0-9]")

        active = F.filter(chars, letters)
        digit = lambda c: c.between("0", "9")
        index = F.transform(active, lambda c: (F.when(digit(c), F.position(c, F.lit(_DIGITS))).otherwise(F.position(F.lower(c), F.lit(_LETTERS))) - 1).cast("int"))
        base = F.transform(active, lambda c: F.when(digit(c), 10).when(hexed, 6).otherwise(26))

        def split_up(ib: Column) -> Column:
            h = F.floor(F.size(ib["i"]) / 2).cast("int")
            rest = F.size(ib["i"]) - h
            return _network(F.slice(ib["i"], F.lit(1), h), F.slice(ib["i"], h + 1, rest), F.slice(ib["b"], F.lit(1), h), F.slice(ib["b"], h + 1, rest), key, tag, back)

        def put_back(new: Column) -> Column:
            def at(c: Column, i: Column) -> Column:
                rank = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), letters)) - 1
                v = F.get(new, rank)
                made = F.when(digit(c), v.cast("string")).otherwise(F.substring(F.lit(_LETTERS), v + 1, F.lit(1)))
                return F.when(letters(c, i), F.when(c.between("A", "Z"), F.upper(made)).otherwise(made)).otherwise(c)

            return F.array_join(F.transform(chars, at), "")

        return let(let(F.struct(index.alias("i"), base.alias("b")), split_up), put_back)

    return let(F.filter(F.split(value, ""), lambda c: c != ""), places)


def _luhn(digits: Column, last_counts: bool) -> Column:
    """The sum modulo 10 of an array of digits, with its last one as check digit or as the digit before it."""
    n = F.size(digits)
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    odd = 1 if last_counts else 0
    return F.aggregate(F.transform(digits, lambda x, i: F.when((n - 1 - i) % 2 == odd, double(x)).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(text, r"\D", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters (A is 10) and digits read as one number."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.transform(chars, lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)


def _valid_iban(m: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    return F.length(bare).between(15, 34) & (_mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)


def _parted(m: Column, place: Column) -> Column:
    """m cut around place, a struct (s, n) of 0-based start and length, null where nothing is valid."""
    cut = F.struct(F.substring(m, F.lit(1), place["s"]).alias("before"), F.substring(m, place["s"] + 1, place["n"]).alias("value"), F.substring(m, place["s"] + place["n"] + 1, F.length(m)).alias("after"))
    return F.when(place.isNotNull(), cut)


def _iban_in(m: Column) -> Column:
    """The longest valid IBAN at the first place in m where one begins, at group borders, as (before, value, after)."""
    spots = F.sequence(F.lit(1), F.length(m) - 14)
    starts = F.filter(F.when(F.length(m) >= 15, spots), lambda i: ((i == 1) | (F.substring(m, i - 1, F.lit(1)) == " ")) & F.substring(m, i, F.lit(4)).rlike("^[A-Z]{2}[0-9]{2}$"))
    ends = lambda a: F.filter(F.sequence(F.length(m), a + 14, F.lit(-1)), lambda e: (e == F.length(m)) | (F.substring(m, e + 1, F.lit(1)) == " "))
    places = F.flatten(F.transform(starts, lambda a: F.transform(ends(a), lambda e: F.struct((a - 1).alias("s"), (e - a + 1).alias("n")))))
    valid = F.filter(places, lambda p: _valid_iban(F.substring(m, p["s"] + 1, p["n"])))
    return let(F.get(valid, F.lit(0)), lambda p: _parted(m, p))


def _card_in(m: Column) -> Column:
    """The first valid card number in a run of digit groups, at group borders, as (before, value, after)."""

    def places(chars: Column) -> Column:
        digit = lambda i: F.get(chars, i).between("0", "9")
        spots = F.sequence(F.lit(0), F.size(chars) - 1)
        starts = F.filter(spots, lambda i: digit(i) & ((i == 0) | ~F.coalesce(digit(i - 1), F.lit(False))))
        ends = F.filter(spots, lambda i: digit(i) & ((i == F.size(chars) - 1) | ~F.coalesce(digit(i + 1), F.lit(False))))
        # the longest of one start first; 13 to 19 digits with single separators are 37 characters at most
        pairs = F.flatten(F.transform(starts, lambda a: F.transform(F.reverse(F.filter(ends, lambda b: (b - a).between(12, 36))), lambda b: F.struct(a.alias("s"), (b - a + 1).alias("n")))))

        def valid(p: Column) -> Column:
            return let(_numbers(F.substring(m, p["s"] + 1, p["n"])), lambda d: F.size(d).between(13, 19) & (_luhn(d, True) == 0))

        return F.get(F.filter(pairs, valid), F.lit(0))

    return let(let(F.filter(F.split(m, ""), lambda c: c != ""), places), lambda p: _parted(m, p))


def _within(found: Column, made) -> Column:
    """The parts of found joined again, its value replaced."""
    return F.concat(found["before"], made(found["value"]), found["after"])


def _number_of(day: Column) -> Column:
    number = F.datediff(F.to_date(day), F.lit("1900-01-01").cast("date"))
    return F.when((number >= 0) & (number < _DAY_A * _DAY_B), number)


def _day(m: Column) -> Column:
    """The number of a date's day, null where it is none."""
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))
    dotted = F.try_to_timestamp(m, F.lit("d.M.yyyy"))
    slashed = F.try_to_timestamp(m, F.lit("M/d/yyyy"))
    other = F.try_to_timestamp(m, F.lit("d/M/yyyy"))
    return _number_of(F.when(m.contains("-"), iso).when(m.contains("."), dotted).otherwise(F.coalesce(slashed, other)))


def _day_first(m: Column) -> Column:
    """Whether a date with slashes has its day first: its first number is no month."""
    return m.contains("/") & (F.substring_index(m, "/", 1).cast("int") > 12)


def _card(m: Column, key: str, back: bool) -> Column:
    """All but the first and the last digit permuted, the last made valid."""
    body = permuted(F.substring(m, F.lit(1), F.length(m) - 1), F.lit(1), "card", key, F.lit(False), back)
    return let(body, lambda b: F.concat(b, ((10 - let(_numbers(b), lambda d: _luhn(d, False))) % 10).cast("int").cast("string")))


def _iban(m: Column, key: str, back: bool) -> Column:
    made = permuted(m, F.lit(4), "iban", key, F.lit(False), back)

    def checked(b: Column) -> Column:
        bare = F.regexp_replace(b, " ", "")
        check = 98 - _mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 2), F.lit("00")))
        return F.concat(F.substring(b, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(b, F.lit(5), F.length(b)))

    return let(made, checked)


def _ip(m: Column, key: str, back: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    base = F.array(F.lit(256), F.lit(256))
    return let(o, lambda x: F.array_join(F.transform(_network(F.slice(x, 1, 2), F.slice(x, 3, 2), base, base, key, "ip", back), lambda v: v.cast("string")), "."))


#: Turns within which a walk ends, but for one date in 10^26: two days in five are no turn's end.
_WALK = 64


def _date(m: Column, key: str, back: bool) -> Column:
    day = lambda n: F.date_add(F.lit("1900-01-01").cast("date"), n)

    def turned(n: Column) -> Column:
        parts = _network(F.array(F.floor(n / _DAY_B).cast("int")), F.array((n % _DAY_B).cast("int")), F.array(F.lit(_DAY_A)), F.array(F.lit(_DAY_B)), key, "date", back)
        return let(parts, lambda p: F.get(p, F.lit(0)) * _DAY_B + F.get(p, F.lit(1)))

    def walked(n: Column) -> Column:
        """Turned again until the day of the month is no month's number: a permutation of those dates."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), turned(n), lambda at, _: F.when(F.dayofmonth(day(at)) > 12, at).otherwise(turned(at)))

    def written(n: Column) -> Column:
        return F.when(m.contains("-"), F.date_format(day(n), "yyyy-MM-dd")).when(m.contains("."), F.date_format(day(n), "dd.MM.yyyy")).when(_day_first(m), F.date_format(day(n), "dd/MM/yyyy")).otherwise(F.date_format(day(n), "MM/dd/yyyy"))

    return let(let(_day(m), lambda n: F.when(_day_first(m), walked(n)).otherwise(turned(n))), written)


_SSN = (898, 99, 9999)


def _ssn(m: Column, key: str, back: bool) -> Column:
    """Area without 000 and 666, group and serial without zero."""
    area = F.substring(m, 1, 3).cast("int") - 1
    area = F.when(area > 665, area - 1).otherwise(area)
    left, right = F.array(area, F.substring(m, 5, 2).cast("int") - 1), F.array(F.substring(m, 8, 4).cast("int") - 1)
    new = _network(left, right, F.array(F.lit(_SSN[0]), F.lit(_SSN[1])), F.array(F.lit(_SSN[2])), key, "ssn", back)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def written(v: Column) -> Column:
        a = F.get(v, F.lit(0))
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat_ws("-", pad(a, 3), pad(F.get(v, F.lit(1)) + 1, 2), pad(F.get(v, F.lit(2)) + 1, 4))

    return let(new, written)


def _located(kind: str, m: Column) -> Column:
    """The value within a match, as (before, value, after); null where the match holds none."""
    whole = F.struct(F.lit("").alias("before"), m.alias("value"), F.lit("").alias("after"))
    if kind == "iban":
        return _iban_in(m)
    if kind == "date":
        return F.when(_day(m).isNotNull(), whole)
    if kind != "card":
        return whole

    def both(f: Column) -> Column:
        longer = lambda r: F.struct(f["before"].alias("before"), F.concat(f["value"], r["before"], r["value"]).alias("value"), r["after"].alias("after"))
        return F.when(f.isNotNull(), let(_card_in(f["after"]), lambda r: F.when(r.isNotNull(), longer(r)).otherwise(f)))

    return let(_card_in(m), both)


def _part(t: Column, kind: str | None) -> Column:
    return F.struct(t.alias("t"), F.lit(kind).cast("string").alias("kind"))


def _cut(t: Column, kind: str, pattern: str) -> Column:
    """An open text as parts (t, kind): the values of a kind, and what is open between them."""

    def parts(at: Column) -> Column:
        found, rest, place = at["found"], at["rest"], at["place"]
        good = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.get(place, i).isNotNull())
        # texts between matches and the matches in turn; an open part is what lies between two values
        turn = F.flatten(F.transform(rest, lambda x, i: F.array(x, F.coalesce(F.get(found, i), F.lit("")))))

        def between(marks: Column) -> Column:
            def one(j: Column) -> Column:
                a, b = F.get(marks, j), F.get(marks, j + 1)
                own = F.array_join(F.slice(turn, 2 * a + 3, 2 * (b - a) - 1), "")
                open_ = F.concat(F.coalesce(F.get(place, a)["after"], F.lit("")), own, F.coalesce(F.get(place, b)["before"], F.lit("")))
                return F.array(_part(open_, None), _part(F.coalesce(F.get(place, b)["value"], F.lit("")), kind))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks) - 2), one))

        marks = F.concat(F.array(F.lit(-1)), good, F.array(F.size(found)))
        return F.when(F.size(good) > 0, let(marks, between)).otherwise(F.array(_part(t, None)))

    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    held = let(found, lambda f: F.when(F.size(f) > 0, F.struct(f.alias("found"), F.split(t, pattern, -1).alias("rest"), F.transform(f, lambda m: _located(kind, m)).alias("place"))))
    return let(held, lambda h: F.when(h.isNull(), F.array(_part(t, None))).otherwise(parts(h)))


def _pass(parts: Column, kind: str, pattern: str) -> Column:
    """parts with the values of a kind cut out of what is open."""
    return F.flatten(F.transform(parts, lambda s: F.when(s["kind"].isNull() & s["t"].rlike(SIGNS[kind]), _cut(s["t"], kind, pattern)).otherwise(F.array(s))))


def sought(docs: DataFrame) -> DataFrame:
    """docs with their text as __parts (t, kind), kind null for what is none: kinds are sought one after another in what is
    open. Texts without a digit or @ have none. Each array of parts is made once, behind a Generate."""
    start = F.when(F.col("text").rlike("[0-9@]"), F.array(_part(F.col("text"), None)))
    out = docs.withColumn("__parts", F.explode(F.array(start)))
    for kind, pattern in PASSES:
        out = out.withColumn("__parts", F.explode(F.array(_pass(F.col("__parts"), kind, pattern))))
    return out.withColumn("__parts", F.filter("__parts", lambda s: s["t"] != ""))


def _cards(m: Column, key: str, back: bool) -> Column:
    """Both card numbers that a run may hold."""
    one = lambda v: _card(v, key, back)
    rest = lambda t: let(_card_in(t), lambda r: F.coalesce(_within(r, one), t))
    return let(_card_in(m), lambda f: F.coalesce(F.concat(f["before"], one(f["value"]), rest(f["after"])), m))


def pseudonym(m: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a value of a kind; what is of none as it is."""
    no = F.lit(False)
    value = F.length(F.regexp_extract(m, r"^[^=:]*[=:]\s?[\"']?", 0))
    secret = permuted(m, value, "secret", key, ~F.lower(F.substring(m, value + 1, F.length(m))).rlike("[g-z]"), back)
    code = F.length(F.regexp_extract(m, r"^\+(?:1(?!\d)|\d{1,3})", 0))
    tld = F.length(F.regexp_extract(m, r"\.[A-Za-z]+$", 0))
    email = F.concat(permuted(F.substring(m, F.lit(1), F.length(m) - tld), F.lit(0), "email", key, no, back), F.right(m, tld))
    made = {
        "email": email, "ip": _ip(m, key, back), "date": _date(m, key, back), "iban": _iban(m, key, back), "ssn": _ssn(m, key, back),
        "phone": permuted(m, code, "phone", key, no, back), "card": _cards(m, key, back), "key": permuted(m, F.lit(4), "key", key, no, back), "secret": secret,
    }
    out = F.when(kind.isNull(), m)
    for name, c in made.items():
        out = out.when(kind == name, c)
    return out


def pseudonymize(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """docs with text replaced, and a count n_<kind> of what was replaced."""
    names = [c for c in docs.columns if c != "text" and c not in {f"n_{k}" for k in KINDS}]
    text = F.col("text")
    done = sought(docs.select(*names, "text"))
    whole = F.array_join(F.transform("__parts", lambda s: pseudonym(s["t"], s["kind"], key, back)), "")
    kinds = F.transform("__parts", lambda s: F.coalesce(s["kind"], F.lit("")))
    counts = [F.coalesce(F.size(kinds) - F.size(F.array_remove(kinds, k)), F.lit(0)).alias(f"n_{k}") for k in sorted(KINDS)]
    return done.select(*names, F.when(F.col("__parts").isNull(), text).otherwise(whole).alias("text"), *counts)


def restore(docs: DataFrame, key: str) -> DataFrame:
    """The inverse of pseudonymize."""
    return pseudonymize(docs, key, back=True)


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get("spark.larkspur.pii.key", DEMONSTRATION_KEY))

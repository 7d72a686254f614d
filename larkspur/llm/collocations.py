"""Collocations: phrases whose words stand together far more often than apart, a language at a time.

Texts are split into pieces, and identical pieces of a language become one row with a multiplicity, so that copied
passages are read once. N-grams are counted level by level, each occurrence weighted by its piece's multiplicity: in each
task duckdb sums what the task's pieces hold, sums are dealt by a hash of the n-gram, and duckdb adds them up a hash
bucket. It keeps to ``DUCKDB_MB`` of memory and moves what exceeds it to the task's scratch folder, which goes with the
task and which nothing else reads. As no n-gram is more frequent than its parts, a longer n-gram need only be counted if
both of its parts one word shorter reach ``min_count``: a bitmap of theirs, ``BITS_A_KEY`` places each and 2^28 at most
(32 MB), is sent to the tasks. Where it lets a rare part through, the n-gram is counted in vain; none is lost.

Scores need the counts of both sides of every cut. They are lookup requests: (language, part) is shuffled to where the
part's count is, joined, and the answers are shuffled back to the phrase.

Defined results: null texts are empty; a null lang counts as ``und``, together with documents that say so; empty texts,
blank pieces and repeated separators give nothing; repeated rows count each; phrases that tie in score and count come in
UTF-8 byte order, and a cut that ties in score gives way to one after fewer words; n-grams never cross pieces; an empty
table gives an empty result; other columns play no part. A text is held whole by one task, so memory grows with the longest.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.llm.common import stash, table, unstash, utf8_rows

MIN_COUNT, TOP, SHADOW, MAX_WORDS = 10, 2000, 50, 3
DUCKDB_MB = 256
BITS_A_KEY, MOST_BITS = 8, 28
#: Bytes of text that are worked on at a time.
TOGETHER = 2_000_000
BLANK, CUT = 0x20, 0x0A


def _forms() -> np.ndarray:
    """For every byte what it counts as: capitals as small letters, what ends a piece as CUT, a tab as a blank."""
    form = np.arange(256, dtype=np.uint8)
    form[ord("A") : ord("Z") + 1] += 32
    form[[ord(c) for c in ".,;:!?\n\v\f\r"]] = CUT
    form[ord("\t")] = BLANK
    return form


FORMS = _forms()


def _spans(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about TOGETHER bytes, one row at least."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + TOGETHER, side="right")) - 1)
        yield begin, end
        begin = end


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of the given sizes that lie end to end in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, piece, words): each piece's words between single blanks, and their number."""
    for batch in batches:
        data, offsets = utf8_rows(batch.column(1))
        for i, j in _spans(offsets):
            begin = offsets[i:j] - offsets[i]
            text = np.append(np.insert(FORMS[data[offsets[i] : offsets[j]]], begin, CUT), np.uint8(CUT))
            apart = (text == BLANK) | (text == CUT)
            turn = np.flatnonzero(apart[1:] != apart[:-1]) + 1
            start, stop = turn[::2], turn[1::2]
            if not len(start):
                continue
            # a word begins a piece if a cut lies before it that does not lie before the last word
            cuts = np.searchsorted(np.flatnonzero(text == CUT), start)
            first = np.flatnonzero(np.diff(cuts, prepend=-1))
            last = np.append(first[1:], len(start)) - 1
            keep = ~apart
            keep[stop] = True
            keep[stop[last]] = False
            text[stop] = BLANK
            many = last - first + 1
            sizes = np.add.reduceat(stop - start, first) + many - 1
            row = i + np.searchsorted(begin + np.arange(len(begin)), start[first], side="right") - 1
            yield pa.record_batch([batch.column(0).take(pa.array(row)), _strings(text[keep], sizes), pa.array(many)], names=["lang", "piece", "words"])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, words, n) of docs (lang, text): every distinct piece of a language, its words, its occurrences."""
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    cut = given.mapInArrow(_cut, "lang string, piece string, words long")
    return cut.groupBy("lang", "piece", "words").agg(F.count(F.lit(1)).alias("n"))


# -- counting

_SUM = "select lang, gram, sum(n)::bigint n from grams group by lang, gram"
_GRAM = "lang string, gram string, n long"


def _summed(grams: Iterator[pa.RecordBatch], having: str = "") -> Iterator[pa.RecordBatch]:
    """Equal (lang, gram) of one task added up by duckdb, in bounded memory."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    with tempfile.TemporaryDirectory(prefix="grams-", dir=SparkFiles.getRootDirectory()) as scratch:
        with duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": scratch, "preserve_insertion_order": False}) as con:
            con.register("grams", pa.RecordBatchReader.from_batches(schema, grams))
            yield from con.sql(f"{_SUM} {having}").to_arrow_reader(50_000)


class _Words:
    """The words of rows of pieces, and a hash of each n-gram that begins at them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> None:
        blank = np.flatnonzero(data == BLANK)
        begin, end = offsets[:-1], offsets[1:]
        self.start, self.stop = np.sort(np.concatenate([begin, blank + 1])), np.sort(np.concatenate([blank, end]))
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.seeds, self.data = seeds, data

    def word_hashes(self) -> np.ndarray:
        """A polynomial in the bytes, modulo 2^64: of the sum up to the word's end less that up to its start."""
        n, base = len(self.data), np.uint64(0x2545F4914F6CDD1D)
        power, back = np.full(n + 1, base), np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)))
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data + np.uint64(1)) * power[:n])])
        return (sums[self.stop] - sums[self.start]) * back[self.start]

    def inside(self, size: int) -> np.ndarray:
        """The words at which an n-gram of this size begins."""
        at = np.arange(max(len(self.start) - size + 1, 0))
        return at[self.row[at] == self.row[at + size - 1]]

    def hashes(self, words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        h = self.seeds[self.row[at]]
        for k in range(size):
            h = (h ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def grams(self, at: np.ndarray, size: int) -> pa.Array:
        start, stop = self.start[at], self.stop[at + size - 1]
        sizes = stop - start
        skip = np.cumsum(sizes) - sizes
        return _strings(self.data[np.repeat(start - skip, sizes) + np.arange(sizes.sum())], sizes)


def _seeds(lang: pa.Array) -> np.ndarray:
    """A number for each row's language."""
    coded = lang.dictionary_encode()
    names = [int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") ^ len(x) << 56 for x in coded.dictionary.to_pylist()]
    return np.array(names, dtype=np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


def _counter(size: int, sieve) -> Callable:
    """(lang, piece, n) to the sums of n-grams whose parts one word shorter the sieve lets through."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column(1))
            seeds = _seeds(batch.column(0))
            for i, j in _spans(offsets):
                words = _Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], seeds[i:j])
                at = words.inside(size)
                if sieve is not None and len(at):
                    bits = sieve.value
                    place = _places(words.hashes(words.word_hashes(), words.inside(size - 1), size - 1), bits)
                    held = np.zeros(len(words.start), dtype=bool)
                    held[words.inside(size - 1)] = bits[place >> 3] >> (place & 7) & 1
                    at = at[held[at] & held[at + 1]]
                row = pa.array(i + words.row[at])
                yield pa.record_batch([batch.column(0).take(row), words.grams(at, size), batch.column(2).take(row)], names=["lang", "gram", "n"])

    return lambda batches: _summed(grams(batches))


def _places(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)


def _sieve(frequent: DataFrame, size: int):
    """The broadcast bitmap of frequent n-grams, as bytes: one array of 2^28 places at most, gathered as at most 2^22 words."""
    n = frequent.count()
    bits = min(max((BITS_A_KEY * n).bit_length(), 10), MOST_BITS)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits - 3, dtype=np.uint8)
        for batch in batches:
            data, offsets = utf8_rows(batch.column(1))
            words = _Words(data[offsets[0] : offsets[-1]], offsets - offsets[0], _seeds(batch.column(0)))
            place = _places(words.hashes(words.word_hashes(), words.inside(size), size), own)
            np.bitwise_or.at(own, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        long = own.view("<i8")
        at = np.flatnonzero(long)
        yield pa.record_batch([pa.array(at), pa.array(long[at])], names=["at", "bits"])

    each = frequent.select("lang", "gram").mapInArrow(marked, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(1 << bits - 6, dtype=np.int64)
    whole[each.column("at").to_numpy()] = each.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(whole.view(np.uint8))


def frequent_grams(distinct: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> list[DataFrame]:
    """For each size from one word on, (lang, gram, n) of the n-grams in pieces (lang, piece, n) that occur min_count times."""
    found: list[DataFrame] = []
    for size in range(1, max_words + 1):
        sieve = _sieve(found[-1], size - 1) if found else None
        sums = distinct.select("lang", "piece", "n").mapInArrow(_counter(size, sieve), _GRAM)
        having = f"having sum(n) >= {int(min_count)}"
        whole = sums.repartition("lang", "gram").mapInArrow(lambda batches, h=having: _summed(batches, h), _GRAM)
        found.append(stash(whole, f"grams-{size}"))
    return found


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, shadow: int = SHADOW) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs (lang, text): each language's first phrases of 2 to max_words words."""
    distinct = stash(pieces(docs), "pieces")
    totals = distinct.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n"))
    levels = frequent_grams(distinct, max_words, min_count)
    counts = levels[0].withColumn("size", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        counts = counts.union(level.withColumn("size", F.lit(k)))
    phrases = counts.where("size > 1").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "size", F.split("gram", " ").alias("w"))

    # lookup requests: both sides of each cut, sent to where their counts are
    cuts = phrases.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda begin, n, right: F.struct(F.array_join(F.slice("w", begin, n), " ").alias("gram"), F.lit(right).alias("right"))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(part(F.lit(1), F.col("k"), False), part(F.col("k") + 1, F.col("size") - F.col("k"), True))).alias("p"))
    told = asked.select("lang", "phrase", "a", "k", "p.*").join(counts.select("lang", "gram", F.col("n").alias("f")), ["lang", "gram"])
    sides = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(~F.col("right"), F.col("f"))).alias("l"), F.max(F.when(F.col("right"), F.col("f"))).alias("r"))
    # 38 digits hold a squared count and the product of two; the quotient is whole
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    scored = sides.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))

    # what mostly occurs inside one longer phrase goes
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda s: F.array_join(F.slice("w", s, n), " "))))
    longer = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < shadow * F.col("a")))

    flat = kept.select("lang", "phrase", "a", "least.l", "least.r", "least.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # each of 64 shares of a language sends its first ones only
    share = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = flat.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = stash(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    unstash(distinct, *levels)
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
with p as (select rid, lang, unnest(ps) p, generate_subscripts(ps, 1) i from (
    select row_number() over () rid, coalesce(lang, 'und') lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') ps from documents)),
w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w from p),
g as materialized (select lang, size, array_to_string(w[s : s + size - 1], ' ') g, count(*) f from (
    select lang, w, size, unnest(range(1, len(w) - size + 2)) s from w, (select unnest(range(1, {MAX_WORDS + 1})) size) where len(w) >= size) group by all),
tot as (select lang, sum(f)::bigint n from g where size = 1 group by 1),
c as (select lang, size, g phrase, f a, string_split(g, ' ') w from g where size > 1 and f >= {MIN_COUNT}),
cuts as (select c.*, k, array_to_string(w[1 : k], ' ') lg, array_to_string(w[k + 1 :], ' ') rg from c, (select unnest(range(1, {MAX_WORDS})) k) where k < size),
scored as (select cuts.*, x.f l, y.f r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint score,
    row_number() over (partition by cuts.lang, phrase order by (1000000::hugeint * a * a) // (x.f::hugeint * y.f), k) o
    from cuts join g x on x.lang = cuts.lang and x.g = lg and x.size = k join g y on y.lang = cuts.lang and y.g = rg and y.size = cuts.size - k),
inner_ as (select lang, array_to_string(w[s : s + n - 1], ' ') phrase, max(a) f from (select *, unnest(range(1, size - n + 2)) s from c, (select unnest(range(2, {MAX_WORDS})) n) where n < size) group by 1, 2),
kept as (select lang, phrase, a, l, r, score from scored left join inner_ using (lang, phrase) where o = 1 and (inner_.f is null or 100 * inner_.f < {SHADOW} * a))
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n, score from kept join tot using (lang)) where rank <= {TOP}"""

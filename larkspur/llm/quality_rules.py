"""Quality rules whose cutoffs are proven on labelled rows.

A rule rejects a text when one of its measures exceeds a cutoff. For each stratum (language), rule and cutoff of a
fixed grid, the labelled good texts give n trials and k false rejections. The exact binomial probability of k or
fewer when the true rate is ``alpha`` is compared with ``delta`` divided by the number of all tests (Bonferroni); a
cutoff that passes rejects more than ``alpha`` of good texts with probability below ``delta`` over all tests at
once. Among a rule's proven cutoffs the one with the best margin of bad over good rejections is used, the laxest of
equals. ``alpha`` is divided by the number of rules, so the bound holds for their union.

Defined results: a null text counts as empty and fails the base rules; a null stratum is the stratum ''; a stratum
without a proven cutoff has no rule beyond the base; repeated doc_ids are judged row by row, and a doc_id labelled
twice counts as good if any label says so; labels of no document are ignored; extra columns are ignored by
``judge`` and passed on by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.llm.common import SPACES, let, stash, table, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
MIN_WORDS = 20
#: The rules' measures, and for each the grid of cutoffs, laxest first.
GRIDS: dict[str, list[float]] = {
    "symbol_density": [1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "capital_ratio": [0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "shout_density": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_ratio": [0.28, 0.25, 0.2, 0.15, 0.1],
    "dup_line_ratio": [0.8, 0.6, 0.5, 0.4, 0.3],
}
ALPHA = 0.05
DELTA = 0.05
#: Good texts that a bad text rejected may cost when cutoffs are compared.
PENALTY = 10


def _repeat_words(found: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more, from the array of words."""

    def windows(h: Column) -> Column:
        n = F.size(h) - (WINDOW - 1)
        return F.transform(F.arrays_zip(*[F.slice(h, F.lit(i + 1), n) for i in range(WINDOW)]), lambda w: F.xxhash64(w))

    def covered(h: Column) -> Column:
        # sorted by hash, a window is repeated if a neighbour is equal; sorted by place, each covers up to the next one
        marked = let(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])), lambda x: x["i"]
                )
            ),
        )
        steps = let(marked, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.get(p, j + 1) - x)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(found, lambda w: F.xxhash64(w))
    whole = let(let(hashes, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(found) <= WINDOW, 0).otherwise(whole)


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, then the base counts and the rules' measures of every row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(
        *keep,
        text.alias("__text"),
        words(text).alias("__words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("__lines"),
    ).select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
        (F.length("__text") - F.length(F.translate("__text", CAPITALS, ""))).alias("__capitals"),
        (F.length("__text") - F.length(F.translate("__text", "!", ""))).alias("__shouts"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        *keep,
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbol_density"),
        (F.col("__capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capital_ratio"),
        (F.col("__shouts") / n).alias("shout_density"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("dup_line_ratio"),
    )


SPAN = 4096


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), summed term by term in logarithms, SPAN terms at a time; 1 where k is at or
    over the mean."""
    import math

    odds = math.log(rate / (1 - rate))
    start = F.struct((n * math.log(1 - rate)).alias("t"), (n * math.log(1 - rate)).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (F.greatest(t, acc["s"]) + F.log1p(F.exp(-F.abs(t - acc["s"])))).alias("s"))

    spans = F.when(k > 0, F.sequence(F.lit(0).cast("long"), F.floor((k - 1) / SPAN))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(spans, start, lambda acc, s: F.aggregate(F.sequence(s * SPAN + 1, F.least(s * SPAN + SPAN, k)), acc, add))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(total["s"]))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, k_good, k_bad, p_value): the proven cutoff of each stratum and rule."""
    truth = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("__good"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value"), F.array(*map(F.lit, g)).alias("grid")) for r, g in GRIDS.items()]))
    held = measured.where("not base_failed").join(truth, "doc_id").select(F.coalesce("lang", F.lit("")).alias("stratum"), "__good", rules.alias("r"))
    # how many cutoffs of the grid, which falls, the value exceeds; counts by that place, then running sums
    place = F.size(F.filter("r.grid", lambda c: F.col("r.value") > c))
    counts = held.groupBy("stratum", F.col("r.rule").alias("rule"), (F.size("r.grid") - place).alias("first")).agg(
        F.sum(F.when(F.col("__good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("__good") == 1, 0).otherwise(1)).alias("bad")
    )
    by = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("first", "good", "bad")).alias("hist"))
    grid = F.create_map(*[x for r, g in GRIDS.items() for x in (F.lit(r), F.array(*map(F.lit, g)))])
    tests = by.select("stratum", "rule", "n_good", "hist", F.posexplode(grid[F.col("rule")]).alias("at", "cutoff"))

    def exceeding(name: str) -> Column:
        return F.aggregate(F.filter("hist", lambda x: x["first"] <= F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x[name])

    m = sum(map(len, GRIDS.values()))
    strata = by.select(F.count_distinct("stratum").alias("n_strata"))
    tests = tests.withColumns({"k_good": exceeding("good"), "k_bad": exceeding("bad")}).crossJoin(F.broadcast(strata))
    tests = tests.withColumn("p_value", binomial_tail(F.col("k_good"), F.col("n_good"), alpha / len(GRIDS)))
    proven = tests.where(F.col("p_value") <= delta / (F.col("n_strata") * m)).where(F.col("k_bad") > PENALTY * F.col("k_good"))
    best = W.partitionBy("stratum", "rule").orderBy(F.desc(F.col("k_bad") - PENALTY * F.col("k_good")), "at")
    return proven.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("stratum", "rule", "cutoff", "n_good", "k_good", "k_bad", "p_value")


def _table(found: DataFrame) -> DataFrame:
    """One row a stratum; the table has as many rows as strata, so its size is bounded by their number."""
    return found.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__cut_{r}") for r in GRIDS])


def judge(measured: DataFrame, found: DataFrame) -> DataFrame:
    """measured with kept."""
    joined = measured.join(stash(_table(found), "cutoffs"), F.coalesce(measured["lang"], F.lit("")) == F.col("stratum"), "left")
    beyond = F.lit(False)
    for r in GRIDS:
        beyond = beyond | F.coalesce(F.col(r) > F.col(f"__cut_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("stratum", *[f"__cut_{r}" for r in GRIDS])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base and the proven rules keep, with docs' own columns. Measured once: the measures
    are written beside the rows."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", "lang")
    measured = stash(measures(whole, ["__row", "doc_id", "lang"]), "measures")
    found = stash(cutoffs(measured.drop("__row"), labels), "rules")
    return judge(measured, found).where("kept").select("__row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stash(measures(table(spark, sf_dir, "documents"), ["doc_id", "lang"]), "measures")
    found = stash(cutoffs(measured, table(spark, sf_dir, "labels")), "rules")
    return judge(measured, found).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    grid = " union all ".join(f"select '{r}' rule, unnest(range(0, {len(g)})) pos, unnest({g}::double[]) cutoff" for r, g in GRIDS.items())
    value = "case rule " + " ".join(f"when '{r}' then {r}" for r in GRIDS) + " end"
    rate, m = ALPHA / len(GRIDS), sum(map(len, GRIDS.values()))
    win = ", ".join(f"w[i + {j}]" for j in range(WINDOW))
    return rf"""
with t as (select row_number() over () rid, doc_id, coalesce(lang, '') stratum, coalesce(text, '') x from documents),
w as (select rid, doc_id, stratum, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') w,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l from t),
win as (select rid, unnest(range(1, len(w) - {WINDOW - 2})) i, w from w where len(w) > {WINDOW}),
win2 as (select rid, i, [{win}] g from win),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) c from win2) where c > 1),
cov as (select rid, sum(least({WINDOW}, coalesce(lead_i - i, {WINDOW})))::bigint n from (select rid, i, lead(i) over (partition by rid order by i) lead_i from rep) group by rid),
m as (select w.rid, doc_id, stratum, len(w)::bigint n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
        (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
        (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, len(l) n_lines,
        length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) capitals, length(x) - length(replace(x, '!', '')) shouts
      from w left join cov on w.rid = cov.rid),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words base_failed, n_symbols / greatest(n_words, 1) symbol_density,
        capitals / greatest(word_chars, 1) capital_ratio, shouts / greatest(n_words, 1) shout_density,
        n_repeat_words / greatest(n_words, 1) repeat_ratio, n_dup_lines / greatest(n_lines, 1) dup_line_ratio from m),
g as ({grid}),
truth as (select doc_id, max(quality) good from labels where quality is not null and doc_id is not null group by 1),
tests as (select stratum, rule, pos, cutoff, count(*) filter (where good = 1) n, count(*) filter (where good = 1 and {value} > cutoff) k,
        count(*) filter (where good <> 1 and {value} > cutoff) bad
      from f join truth using (doc_id), g where not base_failed group by all),
pv as (select *, case when k >= n * {rate} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) end p,
        (select count(distinct stratum) from tests) strata from tests),
best as (select stratum, rule, cutoff, row_number() over (partition by stratum, rule order by bad - {PENALTY} * k desc, pos) r
      from pv where p <= {DELTA} / (strata * {m}) and bad > {PENALTY} * k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from best where r = 1 and best.stratum = f.stratum and {value} > cutoff) kept
from f"""


ORACLE = _sql()

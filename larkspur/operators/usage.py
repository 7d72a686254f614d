"""Usage priors: decayed, capped hit counters and the orientation scores built on them. The streaming form of the
counters is in larkspur.streaming.hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The counters' law.
HALF_LIFE = 7 * 86_400.0
INCREMENT, CAP, FLOOR = 1.0, 10.0, 1e-6
BOOST, MAX_KEYS = 0.05, 256


def decayed(counter: Column, seconds: Column, half_life: float = HALF_LIFE) -> Column:
    return counter * F.pow(F.lit(0.5), F.greatest(seconds, F.lit(0.0)) / half_life)


#: Seconds of the spans that hits are folded over, one after another; the last fold is over all of a key's spans.
SPANS = (1, 3600)


def counters(hits: DataFrame, half_life: float = HALF_LIFE) -> DataFrame:
    """(page_key, counter, last_hit): each key's hits in order of time: decay, add, cap. A late hit counts at the
    record's own time. What a run of hits makes of a counter x is min(c, a * x + b), and so is what two runs make one
    after the other. So hits at one time are counted, and folded over seconds, then hours, then all: no array holds
    more than a key's hits of one second, or 3,600 spans, or a key's hours."""
    seconds = F.col("ts").cast("double")
    n = F.count(F.lit(1)).cast("double")
    runs = hits.groupBy("page_key", seconds.alias("t0")).agg(n.alias("b")).select("page_key", "t0", F.col("t0").alias("t1"), F.lit(1.0).alias("a"), "b", F.lit(CAP).alias("c"))

    def after(x: Column, y: Column) -> Column:
        d = y["a"] * F.pow(F.lit(0.5), F.greatest(y["t0"] - x["t1"], F.lit(0.0)) / half_life)
        return F.struct(x["t0"].alias("t0"), F.greatest(x["t1"], y["t1"]).alias("t1"), (d * x["a"]).alias("a"), (d * x["b"] + y["b"]).alias("b"), F.least(y["c"], d * x["c"] + y["b"]).alias("c"))

    for span in (*SPANS, None):
        keys = ["page_key"] if span is None else ["page_key", F.floor(F.col("t0") / span).alias("span")]
        lists = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t0", "t1", "a", "b", "c"))).alias("r"))
        runs = lists.select("page_key", F.aggregate(F.slice("r", F.lit(2), F.size("r")), F.get("r", F.lit(0)), after).alias("f")).select("page_key", "f.*")
    return runs.select("page_key", F.least("b", "c", F.lit(CAP)).alias("counter"), F.col("t1").alias("last_hit"))


def priors(state: DataFrame, now: Column) -> DataFrame:
    """(page_key, counter, boost) at a time, negligible counters gone."""
    at = state.withColumn("counter", F.least(F.lit(CAP), decayed(F.col("counter"), now - F.col("last_hit"))))
    return at.where(F.col("counter") > FLOOR).select("page_key", "counter", (BOOST * F.least("counter", F.lit(CAP)) / CAP).alias("boost"))


def trimmed(state: DataFrame, most: int = MAX_KEYS) -> DataFrame:
    return state.orderBy(F.desc("counter"), F.desc("last_hit"), "page_key").limit(most)


def orientation_scores(pages: DataFrame, degrees: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """(page_id, path, score): pages by links, references, headings, depth and usage. degrees: (id, inbound,
    outbound) of page nodes; boosts: (page_key, boost)."""
    j = pages.join(degrees, F.concat(F.lit("page:"), pages["page_id"]) == degrees["id"], "left")
    if boosts is not None:
        j = j.join(boosts, j["page_id"] == boosts["page_key"], "left")
    depth = F.size(F.split("path", "/")) - 1
    heads = F.size("headings") if "headings" in pages.columns else F.lit(0)
    score = (
        2.0 * F.coalesce("inbound", F.lit(0)) + 0.4 * F.coalesce("outbound", F.lit(0)) + 0.5 * F.least(F.size("source_refs"), F.lit(5))
        + 0.2 * F.least(heads, F.lit(8)) + 1.0 / (1 + depth) + (F.coalesce("boost", F.lit(0.0)) if boosts is not None else F.lit(0.0))
    )
    return j.select("page_id", "path", score.alias("score"))

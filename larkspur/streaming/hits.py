"""Usage counters as streaming state: each hit decays and raises its page's counter; late hits count at the record's
own time and are never dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.usage import CAP, HALF_LIFE, INCREMENT

OUT = "page_key string, counter double, last_hit double, n_hits long"
STATE = "counter double, last_hit double, n_hits long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    counter, at, n = state.get if state.exists else (0.0, None, 0)
    times = sorted(t for b in batches for t in b["seconds"])
    for t in times:
        now = t if at is None else max(at, t)
        counter = min(CAP, (counter * 0.5 ** ((now - at) / HALF_LIFE) if at is not None else 0.0) + INCREMENT)
        at, n = now, n + 1
    state.update((counter, at, n))
    yield pd.DataFrame({"page_key": [key[0]], "counter": [counter], "last_hit": [at], "n_hits": [n]})


def counters(hits: DataFrame) -> DataFrame:
    """The streaming form of usage.counters: hits is a stream of (page_key, ts); each batch emits the counters it
    changed. State holds three numbers a page."""
    seconds = hits.select("page_key", F.col("ts").cast("double").alias("seconds"))
    return seconds.groupBy("page_key").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def write(stream: DataFrame, path: str, checkpoint: str):
    """Upserts by batch: every batch's changed counters become a version under path; ``latest`` reads them back."""
    return (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n:012d}")).start()
    )


def latest(spark, path: str) -> DataFrame:
    """The newest counter of each page."""
    rows = spark.read.parquet(f"{path}/*")
    newest = F.max(F.struct("batch", "counter", "last_hit", "n_hits")).alias("x")
    return rows.groupBy("page_key").agg(newest).select("page_key", "x.counter", "x.last_hit", "x.n_hits")


def windowed(hits: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Hits per page and window, with a watermark for windows that close."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return hits.withWatermark("ts", late).groupBy(w.alias("w"), "page_key").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "page_key", "n")

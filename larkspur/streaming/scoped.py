"""The scoped state of use as one stream: each request decays every counter of its source, raises those of the pages it
found useful, and keeps the most used; another state of the source's contents starts anew.

State is kept by (namespace, source): the scope that it belongs to with its time and generation, and a map from opaque
page keys to counters, 256 at most. A source that nobody has asked for ``IDLE`` seconds, in which every counter falls
below the least that counts, is forgotten by a timer. Requests of a batch are folded in order of time and request; late
ones count at the state's own time, and none is dropped. A batch holds what the stream's source admits at a time
(``maxFilesPerTrigger`` and the like); of it a source's task keeps three values a hit.

Defined results: hits without a page, time or request, of routes that do not count, or of pages that are not visible
change nothing; a page counts once a request; null parts of a scope are empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkspur.operators.managed import ROUTES, page_key_in
from larkspur.operators.usage import CAP, FLOOR, HALF_LIFE, INCREMENT, MAX_KEYS

OUT = "namespace string, source string, scope string, page_key string, counter double, last_hit double, generation long"
#: After so many seconds a counter at its cap is negligible.
IDLE = HALF_LIFE * math.log2(CAP / FLOOR)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def folded(counters: dict[str, float], at: float | None, now: float, keys: set[str]) -> tuple[dict[str, float], float]:
    """The counters after one request, and their time: all decayed, one more for each key, the most used kept."""
    time = now if at is None else max(at, now)
    share = 0.5 ** ((time - at) / HALF_LIFE) if at is not None else 1.0
    new = {k: c * share for k, c in counters.items()}
    for k in keys:
        new[k] = new.get(k, 0.0) + INCREMENT
    kept = {k: round(min(c, CAP), 6) for k, c in new.items() if min(c, CAP) > FLOOR}
    if len(kept) > MAX_KEYS:
        kept = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:MAX_KEYS])
    return kept, time


class ScopedUse(StatefulProcessor):
    """Counters of one (namespace, source)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "scope string, at double, generation long")
        self.counters = handle.getMapState("counters", "page_key string", "counter double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        requests: dict[tuple[float, str, str], set[str]] = {}
        for batch in rows:
            for at, request, scope, page in zip(batch["seconds"], batch["request"], batch["scope"], batch["page_key"], strict=True):
                requests.setdefault((at, request, scope), set()).add(page)
        scope, at, generation = self.about.get() if self.about.exists() else (None, None, 0)
        held = {k[0]: v[0] for k, v in self.counters.iterator()} if scope is not None else {}
        before = set(held)
        for now, _, own in sorted(requests):
            if own != scope:
                held, scope, at, generation = {}, own, None, 0
            held, at = folded(held, at, now, requests[now, _, own])
            generation += 1
        for k in before - set(held):
            self.counters.removeKey((k,))
        for k, c in held.items():
            self.counters.updateValue((k,), (c,))
        self.about.update((scope, at, generation))
        # one timer a source: the idle time begins anew
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + IDLE * 1000))
        yield pd.DataFrame({"namespace": key[0], "source": key[1], "scope": scope, "page_key": list(held), "counter": list(held.values()), "last_hit": at, "generation": generation})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.about.clear()
        self.counters.clear()
        yield from ()

    def close(self) -> None:
        pass


def scope_digest(*parts: Column) -> Column:
    """The digest of (namespace, source, adapter, projection signature, source signature), as managed.Scope has it."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def recorded(hits: DataFrame, pages: DataFrame, secret: str) -> DataFrame:
    """The stream of states after each batch of hits (namespace, source, adapter, projection_signature, source_signature,
    request, ts, route, page_id), all counters of every source that the batch touches; pages are the visible ones."""
    use_rocksdb(hits.sparkSession)
    counted = hits.where(F.col("route").isin(*ROUTES) & F.col("page_id").isNotNull() & F.col("ts").isNotNull() & F.col("request").isNotNull())
    seen = counted.join(pages.select("page_id"), "page_id", "left_semi")
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("namespace", "source")]
    digest = scope_digest(*(F.col(c) for c in ("namespace", "source", "adapter", "projection_signature", "source_signature")))
    told = seen.select(*named, digest.alias("scope"), F.col("ts").cast("double").alias("seconds"), F.col("request").cast("string").alias("request"), "page_id")
    keyed = told.withColumn("page_key", page_key_in(F.col("page_id"), F.col("scope"), secret)).drop("page_id")
    return keyed.groupBy("namespace", "source").transformWithStateInPandas(ScopedUse(), OUT, "Update", "ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Map state and timers need the store that keeps state on disk. Without batches that hold no data a query over what
    there is ends, and timers fire with the next batch; with them, timers of processing time keep it running."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def write(states: DataFrame, path: str, checkpoint: str):
    """Runs the stream over what there is: each batch's states become a version under path."""
    return (
        states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n:012d}")).start()
    )


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Each source's newest state: that of its last batch."""
    rows = spark.read.schema(f"{OUT}, batch long").option("basePath", path).parquet(path)
    newest = rows.groupBy("namespace", "source").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["namespace", "source", "batch"]).drop("batch")

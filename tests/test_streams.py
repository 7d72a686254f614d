"""Streams against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import managed
from larkspur.streaming import scoped

HIT = "namespace string, source string, adapter string, projection_signature string, source_signature string, request string, ts double, route string, page_id string"
SECRET = "s3cret"


def replayed(spark, rows, pages, scope):
    """managed.recorded for each request in order."""
    schema = "scope string, page_key string, counter double, last_hit double, generation long"
    state = spark.createDataFrame([], schema)
    requests = {}
    for r in rows:
        requests.setdefault((r[6], r[5]), []).append((r[8], r[7]))
    for (now, _), hits in sorted(requests.items()):
        made = managed.recorded(state, spark.createDataFrame(hits, "page_id string, route string"), pages, scope, SECRET, now)
        state = spark.createDataFrame(made.select("scope", "page_key", "counter", "last_hit", "generation").collect(), schema)
    return sorted((r["page_key"], round(r["counter"], 5), r["last_hit"], r["generation"]) for r in state.collect())


@pytest.fixture
def visible(spark):
    return spark.createDataFrame([(f"p{k}",) for k in range(12)], "page_id string")


def run(spark, folder, tmp_path, pages):
    hits = spark.readStream.schema(HIT).option("maxFilesPerTrigger", 1).json(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    query = scoped.write(scoped.recorded(hits, pages, SECRET), str(tmp_path / "states"), str(tmp_path / "check"))
    query.awaitTermination()
    assert query.exception() is None


def test_the_stream_equals_the_replay_and_restarts(spark, tmp_path, visible):
    rng = random.Random(4)
    rows = []
    for k in range(14):
        for _ in range(rng.randrange(1, 4)):
            # a request's pages repeat, some are hidden, some routes do not count
            rows.append(("n", "a", "generic-markdown", "p1", "s1", f"r{k:03d}", 1_700_000_000.0 + k * 40_000, rng.choice(["search", "read", "graph"]), f"p{rng.randrange(16)}"))
    rows += [("n", "a", "generic-markdown", "p1", "s1", None, 1.0, "read", "p1"), ("n", "a", "generic-markdown", "p1", "s1", "r", None, "read", "p1"), ("n", "a", "generic-markdown", "p1", "s1", "r", 5.0, "read", None)]
    other = [("n", "b", "x", "p1", "s1", "q1", 1_700_000_500.0, "read", "p3")]
    folder = tmp_path / "hits"
    cut = [rows[:10], rows[10:] + other]
    scope = managed.Scope("n", "a", "generic-markdown", "p1", "s1")
    for k, part in enumerate(cut):
        spark.createDataFrame(part, HIT).coalesce(1).write.mode("append").json(str(folder))
        run(spark, folder, tmp_path, visible)  # the second run restarts from the checkpoint
    good = [r for r in rows if r[5] is not None and r[6] is not None and r[8] is not None]
    found = scoped.latest(spark, str(tmp_path / "states")).collect()
    own = sorted((r["page_key"], round(r["counter"], 5), r["last_hit"], r["generation"]) for r in found if r["source"] == "a")
    assert own == replayed(spark, good, visible, scope)
    assert [(r["counter"], r["generation"]) for r in found if r["source"] == "b"] == [(1.0, 1)]


def test_another_state_of_the_source_starts_anew_and_late_requests_count(spark, tmp_path, visible):
    base = ("n", "a", "x", "p1")
    rows = [(*base, "s1", "r1", 1000.0, "read", "p1"), (*base, "s1", "r2", 2000.0, "read", "p1"), (*base, "s2", "r3", 3000.0, "read", "p2")]
    folder = tmp_path / "hits"
    spark.createDataFrame(rows, HIT).coalesce(1).write.json(str(folder))
    run(spark, folder, tmp_path, visible)
    state = scoped.latest(spark, str(tmp_path / "states")).collect()
    assert [(r["counter"], r["last_hit"], r["generation"]) for r in state] == [(1.0, 3000.0, 1)]
    # late: counts at the state's own time
    spark.createDataFrame([(*base, "s2", "r4", 10.0, "search", "p2"), (*base, "s2", "r5", 20.0, "search", "p3")], HIT).coalesce(1).write.mode("append").json(str(folder))
    run(spark, folder, tmp_path, visible)
    state = sorted((r["counter"], r["last_hit"], r["generation"]) for r in scoped.latest(spark, str(tmp_path / "states")).collect())
    assert state == [(1.0, 3000.0, 3), (2.0, 3000.0, 3)]


def test_the_fold_keeps_the_most_used():
    counters = {f"k{i:04d}": 2.0 for i in range(256)}
    kept, at = scoped.folded(counters, 100.0, 50.0, {"new"})
    assert at == 100.0 and len(kept) == 256 and "new" not in kept
    kept, at = scoped.folded({"a": 10.0, "b": 1e-6}, 0.0, scoped.HALF_LIFE, {"a"})
    assert kept == {"a": 6.0}
    assert scoped.folded({"a": 9.9}, 0.0, 0.0, {"a"})[0] == {"a": 10.0}

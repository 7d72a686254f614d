"""JSON lines: numbers over splits, problems by line, and the loaders' fields."""

import json
import os
import random

from pyspark.sql import functions as F

from larkspur.operators import evaluate
from larkspur.sources import lines


def test_line_numbers_over_splits(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name in ("a.jsonl", "b.jsonl", "empty.jsonl"):
        rows = ["" if rng.random() < 0.2 else "x" * rng.randrange(200) + f"{name}{k}" for k in range(0 if name.startswith("e") else 400)]
        (tmp_path / name).write_text("".join(r + rng.choice(["\n", "\r\n"]) for r in rows))
        want |= {(name, k): r for k, r in enumerate(rows, 1)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {(os.path.basename(r["file"]), r["line"]): r["value"] for r in lines.numbered(spark, str(tmp_path)).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_problems_are_told_by_line(spark, tmp_path):
    good = {"query_id": "q1", "text": "t", "class": "topical", "locale": "en", "expected_behavior": "answerable"}
    rows = [json.dumps(good), "", "{broken", "[1, 2]", '"text"', json.dumps(good | {"text": "  "}), json.dumps({k: v for k, v in good.items() if k != "locale"} | {"extra": 1, "class": 3}), json.dumps(good | {"text": None}), json.dumps(good | {"query_id": "q2", "text": "ü 한"})]
    (tmp_path / "queries.jsonl").write_text("\n".join(rows))
    sound, bad = lines.checked(spark, str(tmp_path / "queries.jsonl"), lines.QUERIES)
    assert {(r["line"], r["query_id"], r["text"]) for r in sound.collect()} == {(1, "q1", "t"), (9, "q2", "ü 한")}
    assert sorted((r["line"], r["problem"]) for r in bad.collect()) == [
        (3, "invalid JSON"), (4, "not an object"), (5, "not an object"), (6, "text: blank"), (7, "class: not string"), (7, "extra: unknown"), (7, "locale: missing"), (8, "text: not string"),
    ]


def test_loaded_tables_feed_the_checks(spark, tmp_path):
    doc = {"doc_id": "d1", "path": "a.md", "title": "A", "adapter": "x", "role": "topic", "approved": True, "sha256": "0" * 64, "source_ref_ids": [], "license": "MIT", "public_source": "p"}
    run = {"run_id": "r", "query_id": "q1", "rank": 1, "doc_id": "d1", "score": 1, "citation_ids": ["c"], "context_tokens": 1, "payload_tokens": 2, "payload_bytes": 3, "latency_ms": 0.5, "surface": "s", "tokenizer_id": "t", "tokenizer_revision": "1"}
    query = {"query_id": "q1", "text": "t", "class": "topical", "locale": "en", "expected_behavior": "answerable"}
    rel = {"query_id": "q1", "doc_id": "d9", "relevance": 2, "support_spans": [{"start": 1}], "citation_required": False}
    tables = {
        "corpus": (lines.CORPUS, [doc, doc | {"doc_id": "d2", "approved": "yes"}, doc | {"doc_id": "d3", "source_ref_ids": [1]}]), "queries": (lines.QUERIES, [query]), "qrels": (lines.QRELS, [rel, rel | {"relevance": 1.5}, rel | {"relevance": True}]),
        "runs": (lines.RUNS, [run, run | {"source_bytes_scanned": 7}, run | {"source_bytes_scanned": None, "latency_ms": "fast"}]),
    }
    loaded, bad = {}, []
    for name, (fields, rows) in tables.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
        loaded[name], problems = lines.checked(spark, str(tmp_path / f"{name}.jsonl"), fields)
        bad += [(name, r["line"], r["problem"]) for r in problems.collect()]
    assert sorted(bad) == [("corpus", 2, "approved: not bool"), ("corpus", 3, "source_ref_ids: not strings"), ("qrels", 2, "relevance: not int"), ("qrels", 3, "relevance: not int"), ("runs", 3, "latency_ms: not float")]
    assert {r["source_bytes_scanned"] for r in loaded["runs"].collect()} == {None, 7}
    assert json.loads(loaded["qrels"].first()["support_spans"]) == [{"start": 1}]
    found = evaluate.bad_tables(loaded["corpus"], loaded["queries"], loaded["qrels"])
    assert {tuple(r) for r in found.collect()} == {("qrels", "d9", "unknown doc_id")}
    assert evaluate.bad_tables(loaded["corpus"], loaded["queries"].withColumn("class", F.lit("native-x")), loaded["qrels"]).where("problem = 'class'").count() == 1
    assert evaluate.bad_tables(loaded["corpus"], loaded["queries"].withColumn("class", F.lit("own")), loaded["qrels"], classes=("own",)).where("problem = 'class'").count() == 0

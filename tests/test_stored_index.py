"""The stored index: after any run of changes it equals a fresh build."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import index, lexical, stored

PAGE = "page_ord long, page_id string, path string, title string, text string, summary string, role string, tags array<string>, source_refs array<string>, approved boolean"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "api.v2-client", "ISSUE-12", "naïve", "한국", "x"]


def page(rng, k):
    text = None if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))
    return (k, f"p{k}", f"notes/{k}.md", rng.choice(WORDS), text, "", rng.choice(["topic", "hot"]), [rng.choice(WORDS)], [], rng.random() < 0.8)


def tables(ix):
    names = ["postings", "doc_stats", "term_stats", "corpus_stats"] + (["compound", "metadata"] if ix.analyzer == "english" else [])
    columns = {"doc_stats": ["page_id", "path", "role", "dl", "approved", "page_ord"], "postings": ["token", "page_id", "tf", "dl", "approved"]}
    return {n: sorted(map(tuple, getattr(ix, n).select(*columns.get(n, ["*"])).collect()), key=repr) for n in names}


@pytest.mark.parametrize("analyzer", ["legacy", "english"])
def test_a_refreshed_index_equals_a_fresh_one(spark, tmp_path, analyzer, monkeypatch):
    monkeypatch.setattr(stored, "SHARE", 10.0)
    rng, at = random.Random(5), str(tmp_path / "ix")
    now = {k: page(rng, k) for k in range(40)}
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "api.v2-client"), (3, "한국 naïve the")], "query_id long, query string")
    assert stored.refresh(spark, at, spark.createDataFrame(list(now.values()), PAGE), analyzer) == {"added": 40, "changed": 0, "removed": 0}
    for step in range(4):
        gone, new = rng.sample(sorted(now), 3), range(100 * step + 100, 100 * step + 103)
        for k in gone:
            del now[k]
        altered = rng.sample(sorted(now), 4)
        # one page comes back as it was, and one only changes what is said of it
        now |= {k: page(rng, k) for k in (*altered, *new)}
        flipped = next(k for k in sorted(now) if k not in altered and k not in new)
        now[flipped] = (*now[flipped][:-1], not now[flipped][-1])
        pages = spark.createDataFrame(list(now.values()), PAGE).withColumn("terms", F.lit("clash"))
        counts = stored.refresh(spark, at, pages, analyzer)
        assert (counts["added"], counts["removed"]) == (3, 3) and 1 <= counts["changed"] <= 5
        segments = stored.state(spark, at)["segments"]
        assert len(segments) == step + 2
        # what has not changed is not tokenized again
        assert spark.read.parquet(f"{at}/{segments[-1]}/pages").count() == counts["added"] + counts["changed"]
        found, fresh = stored.read(spark, at, analyzer), index.build(pages, analyzer)
        assert tables(found) == tables(fresh) and tables(found.visible()) == tables(fresh.visible())
        assert sorted(lexical.search(found, queries).collect()) == sorted(lexical.search(fresh, queries).collect())
    assert stored.refresh(spark, at, pages, analyzer) == {"added": 0, "changed": 0, "removed": 0} and stored.changes(spark, at, pages).isEmpty()
    before = tables(stored.read(spark, at, analyzer))
    stored.compact(spark, at, analyzer)
    assert len(stored.state(spark, at)["segments"]) == 1 and tables(stored.read(spark, at, analyzer)) == before
    assert len(stored.vacuum(spark, at)) == 5 and tables(stored.read(spark, at, analyzer)) == before


def test_deltas_are_merged_when_they_have_grown(spark, tmp_path):
    rng, at = random.Random(6), str(tmp_path / "ix")
    now = [page(rng, k) for k in range(20)]
    stored.refresh(spark, at, spark.createDataFrame(now, PAGE))
    now = [page(rng, k) for k in range(10)] + now[10:]
    pages = spark.createDataFrame(now, PAGE)
    stored.refresh(spark, at, pages)
    assert len(stored.state(spark, at)["segments"]) == 1 and tables(stored.read(spark, at)) == tables(index.build(pages))


def test_readers_keep_what_they_opened(spark, tmp_path):
    rng, at = random.Random(7), str(tmp_path / "ix")
    now = [page(rng, k) for k in range(20)]
    first = spark.createDataFrame(now, PAGE)
    stored.refresh(spark, at, first)
    reader = stored.read(spark, at)
    stored.refresh(spark, at, spark.createDataFrame([page(rng, k) for k in range(5)], PAGE))
    assert tables(reader) == tables(index.build(first))


def test_empty_tables_repeated_and_nameless_pages(spark, tmp_path):
    rng, at = random.Random(8), str(tmp_path / "ix")
    none = spark.createDataFrame([], PAGE)
    stored.refresh(spark, at, none)
    assert tables(stored.read(spark, at))["postings"] == []
    rows = [page(rng, 1), page(rng, 1), page(rng, 2), (3, None, "x.md", "t", "alpha", "", "topic", [], [], True)]
    pages = spark.createDataFrame(rows, PAGE)
    assert stored.refresh(spark, at, pages)["added"] == 3
    assert tables(stored.read(spark, at)) == tables(index.build(pages))
    # one of two rows of a page changes
    rows = [rows[0], (*rows[1][:4], "beta beta", *rows[1][5:]), *rows[2:3]]
    pages = spark.createDataFrame(rows, PAGE)
    assert stored.refresh(spark, at, pages) == {"added": 0, "changed": 1, "removed": 1}
    assert tables(stored.read(spark, at)) == tables(index.build(pages))
    stored.refresh(spark, at, none)
    assert tables(stored.read(spark, at)) == tables(index.build(none))


def test_opened_follows_its_files(spark, tmp_path):
    rng, files = random.Random(9), str(tmp_path / "pages")
    spark.createDataFrame([page(rng, k) for k in range(8)], PAGE).coalesce(1).write.parquet(files)
    read = lambda: spark.read.schema(PAGE).parquet(files)
    assert tables(stored.opened(spark, "t", [files], read())) == tables(index.build(read()))
    spark.createDataFrame([page(rng, k) for k in range(8, 11)], PAGE).coalesce(1).write.mode("append").parquet(files)
    assert tables(stored.opened(spark, "t", [files], read())) == tables(index.build(read()))
    assert stored.opened(spark, "t", [files], none_read(spark)).doc_stats.count() == 11


def none_read(spark):
    """Pages that must not be read, as the files are those of the newest state."""
    return spark.createDataFrame([], PAGE)

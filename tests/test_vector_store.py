"""Chunks to vectors to answers, against numpy."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import chunks, embedding, lexical, vector, vector_store

WORDS = "river stone bridge water cloud forest engine query table column shuffle index vector night morning".split()


def letters():
    """A class of this function, so that workers get it by value: they cannot import the tests."""

    class Letters:
        provider_id, model_id, model_revision, dimension, distance_metric = "letters", "ten", "1", 10, "cosine"

        def embed(self, texts):
            return np.array([[t.count(c) for c in "abcdefghij"] for t in texts], dtype=np.float32).reshape(len(texts), 10)

    return Letters


Letters = letters()


def corpus(spark, n=60):
    rng = random.Random(2)
    rows = [(k, f"p{k}", f"n/{k}.md", "Title", "\n\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 400))) for _ in range(rng.randrange(4))), "hot" if k % 9 == 0 else "topic") for k in range(n)]
    return spark.createDataFrame(rows, "page_ord long, page_id string, path string, title string, text string, role string")


def by_hand(rows, queries, provider, limit):
    """Best chunk of each page, by plain products."""
    made = provider.embed([r["chunk"] for r in rows]).astype(np.float64)
    asked = provider.embed([q for _, q in queries]).astype(np.float64)
    out = []
    for (qid, _), v in zip(queries, asked):
        if not v.any():
            continue
        best = {}
        for r, x in zip(rows, made):
            if x.any():
                s = float(x @ v / (np.sqrt(x @ x) * np.sqrt(v @ v)))
                key = (-round(s, 9), r["ordinal"])
                best[r["page_id"]] = min(best.get(r["page_id"], key), key)
        ranked = sorted((s, 0 if int(p[1:]) % 9 == 0 else 3, f"n/{p[1:]}.md", p, o) for p, (s, o) in best.items())
        out += [(qid, p, o, k) for k, (_, _, _, p, o) in enumerate(ranked[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("make", [embedding.HashedProjection, Letters])
def test_chunks_to_answers(spark, tmp_path, make, monkeypatch):
    monkeypatch.setattr(vector_store, "BLOCK", 7)  # pages that two blocks share
    pages, at, provider = corpus(spark), str(tmp_path / "store"), make()
    cut = chunks.chunks(pages)
    rows = cut.orderBy("page_id", "ordinal").collect()
    about = embedding.identity(provider)
    vector_store.write(embedding.embedded(cut, "chunk", make), at, about, buckets=5)
    asked = [(1, "river stone bridge"), (2, "engine query shuffle table"), (3, "the night"), (4, "")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    made = embedding.embedded(queries, "query", make, out="vector")
    found = vector_store.search(spark, at, about, made, pages, 6)
    assert sorted((r["query_id"], r["page_id"], r["ordinal"], r["rank"]) for r in found.collect()) == by_hand(rows, asked, provider, 6)
    some = [f"p{k}" for k in range(0, 60, 7)]
    within = spark.createDataFrame([(p,) for p in some] + [("p0",), ("none",)], "page_id string")
    found = vector_store.search(spark, at, about, made, pages, 6, within)
    assert sorted((r["query_id"], r["page_id"], r["ordinal"], r["rank"]) for r in found.collect()) == by_hand([r for r in rows if r["page_id"] in some], asked, provider, 6)
    whole = vector_store.gathered(spark, at, about)
    stored = {(r["page_id"], r["ordinal"]): (r["start"], r["end"], r["embedding"]) for r in whole.collect()}
    sound = vector.sound(embedding.embedded(cut, "chunk", make))
    assert stored == {(r["page_id"], r["ordinal"]): (r["start"], r["end"], r["embedding"]) for r in sound.collect()}
    silent = vector_store.answered(vector_store.search(spark, at, about, made, pages, 6), queries, pages.withColumn("approved", F.lit(True)), 3)
    head = [r["page_id"] for r in lexical.overview(pages, 3).orderBy("rank").collect()]
    assert [r["page_id"] for r in silent.where("query_id = 4").orderBy("rank").collect()] == head


def test_candidates_prune_the_files(spark, tmp_path):
    pages, at = corpus(spark), str(tmp_path / "store")
    about = embedding.identity(Letters())
    vector_store.write(embedding.embedded(chunks.chunks(pages), "chunk", Letters), at, about, buckets=16)
    few = spark.createDataFrame([("p3",)], "page_id string")
    one = vector_store.gathered(spark, at, about, few)
    rows = one.collect()
    assert {r["page_id"] for r in rows} <= {"p3"}

    def filters(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan

    assert filters(one) and not filters(vector_store.gathered(spark, at, about))
    # only the folder of the page's bucket is read: without the others the result is the same
    import shutil

    own = one.sparkSession.range(1).select(vector_store.bucket_of(F.lit("p3"), 16)).first()[0]
    for other in glob.glob(f"{at}/blocks/bucket=*"):
        if not other.endswith(f"={own}"):
            shutil.rmtree(other)
    assert vector_store.gathered(spark, at, about, few).collect() == rows


def damage(spark, at, change):
    """Rewrites one block file with its blocks changed."""
    path = sorted(glob.glob(f"{at}/blocks/bucket=*"))[0]
    rows = [r.asDict() for r in spark.read.parquet(path).collect()]
    rows[0] |= change(rows[0])
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema).coalesce(1).write.mode("overwrite").parquet(path)
    return int(path.rsplit("=", 1)[1])


@pytest.mark.parametrize("change", [
    lambda b: {"matrix": bytearray([b["matrix"][0] ^ 1]) + b["matrix"][1:]}, lambda b: {"matrix": b["matrix"][:-4]}, lambda b: {"dimension": 9}, lambda b: {"identity": "other"}, lambda b: {"pages": ["px", *b["pages"][1:]]}, lambda b: {"ends": [b["ends"][0] + 1, *b["ends"][1:]]},
    lambda b: {"ordinals": b["ordinals"][:-1]},
])
def test_a_block_that_does_not_hold_is_a_miss_and_is_mended(spark, tmp_path, change):
    pages, at = corpus(spark, 20), str(tmp_path / "store")
    about, cut = embedding.identity(Letters()), chunks.chunks(pages)
    vector_store.write(embedding.embedded(cut, "chunk", Letters), at, about, buckets=4)
    before = sorted(map(tuple, vector_store.gathered(spark, at, about).collect()))
    assert vector_store.bad_blocks(spark, at, about).count() == 0 and vector_store.repaired(spark, at, cut, about, Letters) == 0
    bucket = damage(spark, at, change)
    bad = vector_store.bad_blocks(spark, at, about).collect()
    assert [r["bucket"] for r in bad] == [bucket]
    after = vector_store.gathered(spark, at, about)
    left = after.count()
    assert 0 < left < len(before) and after.where(vector_store.bucket_of(F.col("page_id"), 4) == bucket).count() == 0
    assert vector_store.repaired(spark, at, cut, about, Letters) == 1
    assert sorted(map(tuple, vector_store.gathered(spark, at, about).collect())) == before


def test_other_identities_and_empty_stores_are_misses(spark, tmp_path):
    pages, at, about = corpus(spark, 5), str(tmp_path / "store"), embedding.identity(Letters())
    assert vector_store.manifest(spark, at, about) is None
    vector_store.write(embedding.embedded(chunks.chunks(pages.where("false")), "chunk", Letters), at, about, buckets=2)
    assert vector_store.manifest(spark, at, about)["vectors"] == 0 and vector_store.gathered(spark, at, about).collect() == []
    assert vector_store.manifest(spark, at, about | {"model_revision": "2"}) is None and vector_store.manifest(spark, at, about | {"dimension": 11}) is None
    with pytest.raises(FileNotFoundError, match="no vectors"):
        vector_store.gathered(spark, at, about | {"dimension": 11})


def test_a_provider_that_gives_wrong_vectors_is_an_error(spark):
    class Short(Letters):
        def embed(self, texts):
            return np.zeros((len(texts), 9), dtype=np.float32)

    with pytest.raises(Exception, match="must give"):
        embedding.embedded(spark.createDataFrame([("a",)], "t string"), "t", Short).collect()
    got = embedding.embedded(spark.createDataFrame([("a",), (None,), ("",)], "t string"), "t", Letters).collect()
    assert sorted(sum(r["embedding"]) for r in got) == [0.0, 0.0, 1.0]


def test_hashed_projection_is_near_for_shared_words():
    p = embedding.HashedProjection()
    a, b, c, d = p.embed(["the river bridge of stone", "stone bridges over rivers", "query engine shuffle", "  The RIVER\nbridge of stone "])
    assert a @ b > 0.3 > a @ c and np.array_equal(a, d) and abs(float(a @ a) - 1) < 1e-5 and not p.embed([""]).any()
    # counts by a plain loop
    text = "abcab abc"
    grams = [f" {text} "[k : k + 4] for k in range(len(text) - 1)]
    assert p.counts([text, "x"]).sum(axis=1).tolist() == [len(grams), 0] and (p.counts([text]) > 0).sum() <= len(set(grams))


def test_few_candidates_go_to_the_blocks(spark, tmp_path, monkeypatch):
    about = {"provider_id": "t", "dimension": 2}
    rows = [(f"p{i}", k, 0, 1, [float(i + 1), float(k - i % 3)]) for i in range(40) for k in range(2)]
    vector_store.write(spark.createDataFrame(rows, "page_id string, ordinal int, start int, end int, embedding array<float>"), str(tmp_path / "v"), about, buckets=4)
    asked = spark.createDataFrame([("p3",), ("p3",), ("p7",), ("none",), (None,)], "page_id string")
    found = vector_store.gathered(spark, str(tmp_path / "v"), about, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = sorted((p, k) for p, k, *_ in rows if p in ("p3", "p7"))
    assert sorted((r["page_id"], r["ordinal"]) for r in found.collect()) == want
    monkeypatch.setattr(vector_store.lexical, "SENT", 1)
    joined = vector_store.gathered(spark, str(tmp_path / "v"), about, asked)
    assert sorted((r["page_id"], r["ordinal"]) for r in joined.collect()) == want

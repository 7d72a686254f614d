"""Steps of searches and evaluations that must not grow beyond their tasks."""

import random

from pyspark.sql import functions as F

from larkspur.operators import catalog, graph, hybrid, index, lexical, stored, vector
from larkspur.sources import corpus

PAGE = "page_id string, path string, title string, text string, summary string, role string, tags array<string>, source_refs array<string>, approved boolean"


def pages(spark):
    rows = [(f"p{i}", f"d/p{i}.md", f"Page {i}", f"alpha beta word{i % 5} " * (i % 7 + 1), "", "topic", ["en"], ["x"], i % 3 > 0) for i in range(60)]
    return spark.createDataFrame(rows, PAGE)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_judgements_by_an_inner_word_are_those_of_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    words = ["aa", "b", "cc.c", "DD", "한글", "  ", "x\ty", "\n"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randrange(1, 14))) for i in range(40)] + [(90, ""), (91, None), (92, "a"), (93, "oneword"), (94, "two words")]
    docs = [(i, rng.choice([say(30), say(5) + items[i % 40][1] + say(3), "x" + items[i % 40][1], items[i % 40][1]])) for i in range(80)] + [(200, None), (201, ""), (202, "is oneword here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus.qrels(spark, str(tmp_path))
    want = sorted((i, str(d), 2 if p in t else 1) for i, p in items if p is not None for d, t in docs if t is not None and p[: len(p) // 2] in t)
    assert sorted(map(tuple, found.collect())) == want
    assert "array_intersect" in physical(found)


def test_scores_are_dealt_to_more_tasks_as_the_index_grows(spark, tmp_path, monkeypatch):
    asked = spark.createDataFrame([(1, "alpha word3"), (2, "beta")], "query_id long, query string")
    out = spark.createDataFrame([("p3",), ("d/p8.md",), (" ",), (None,)], "key string")
    wanted = [sorted(map(tuple, lexical.search(pages(spark), asked, 5, excluded=e).collect())) for e in (None, out)]
    monkeypatch.setattr(stored, "TASK_BYTES", 100)
    stored.refresh(spark, str(tmp_path / "i"), pages(spark))
    built = stored.read(spark, str(tmp_path / "i"))
    assert built.parts > 10 and built.visible().parts == built.parts
    found = [lexical.search(built, asked, 5, excluded=e) for e in (None, out)]
    assert [sorted(map(tuple, f.collect())) for f in found] == wanted
    assert f", {built.parts})" in physical(found[0])


def test_results_go_to_the_pages(spark):
    asked = spark.createDataFrame([(1, "alpha word3")], "query_id long, query string")
    found = lexical.search(pages(spark), asked, 5)
    for made in (lexical.projected(found, pages(spark), asked), catalog.context_pack(found, lexical.overview(pages(spark), 3), pages(spark), asked)):
        assert "SortMergeJoin" not in physical(made) and "BroadcastHashJoin" in physical(made)
        assert made.count() in (1, 5)


def test_an_index_of_the_queries_tokens_finds_what_the_whole_index_finds(spark, monkeypatch):
    texts = ["Alpha alpha BETA_x.1 e.x-y 한글말 a가나 가", "", None, "the beta's running runs e.x-y", "alpha.beta 0-1 ___ -a İK alpha’s", "가나다라 a가나 beta " * 3, "only other words here"]
    rows = [(f"p{i}", f"d/e.x-y{i}.md", f"T {i}", t, "", ("hot", "topic")[i > 0], ["en"], [f"ref-{i}.a"], i % 3 > 0) for i, t in enumerate(texts * 3)]
    told = spark.createDataFrame(rows, PAGE)
    asked = spark.createDataFrame([(1, "alpha 한글말"), (2, "e.x-y"), (3, "running beta a가나 e.x-y"), (4, "0-1 ref-3.a"), (5, ""), (6, "zzz-none"), (7, "가나다라 가")], "query_id long, query string")
    for analyzer in ("legacy", "english"):
        near, whole = lexical.asked(told, asked, analyzer), index.build(told, analyzer)
        assert near.rows is not None
        a, b = (sorted(map(tuple, lexical.search(i, asked, 6).collect())) for i in (near, whole))
        assert a == b and len(a) > 10
        assert sorted(near.doc_stats.select("page_id", "dl").collect()) == sorted(whole.doc_stats.select("page_id", "dl").collect())
    monkeypatch.setattr(lexical, "SCORES", 10)
    many = lexical.asked(told, asked)
    assert many.parts == 15
    # the pages' counts are dealt, not the scores of all queries
    plan = physical(lexical.text_scores(many, asked))
    assert plan.index("Generate explode") < plan.index("hashpartitioning(page_id") and plan.count("hashpartitioning(page_id") == 1
    monkeypatch.setattr(lexical, "ASKED", 2)
    assert lexical.asked(told, asked) is None


def test_a_walk_writes_only_the_edges_it_meets(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + k) % 300}", "to") for i in range(300) for k in (1, 2)] + [("n0", "ghost", "to"), ("ghost", "n5", "to")], "source string, target string, relation string")
    nodes = spark.createDataFrame([(f"n{i}", f"Label {i}", f"d/n{i}.md") for i in range(300)], "id string, label string, path string")
    sizes, whole = [], graph.cut

    def seen(df, name="cut"):
        out = whole(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", seen)
    found, shown = graph.neighbors(nodes, edges, "n0", 1, "both")
    near = {t for s, t, _ in edges.collect() if s == "n0"} | {s for s, t, _ in edges.collect() if t == "n0"}
    assert {r["id"] for r in found.collect()} == near - {"ghost"} | {"n0"}
    around, _ = graph.around(nodes, edges, ["n0", "LABEL 9", "nothing"], 1)
    assert {"n0", "n9"} < {r["id"] for r in around.collect()} and "ghost" not in {r["id"] for r in around.collect()}
    assert max(sizes) < 30


def test_nearest_pages_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    vec = lambda: [rng.choice([-1.0, 0.5, 2.0, 0.1]) for _ in range(3)]
    chunks = spark.createDataFrame([(f"p{i % 70}", i // 70, vec()) for i in range(140)] + [("p1", 7, None), ("p2", 8, [0.0, 0.0, 0.0]), ("lost", 0, [1.0, 1.0, 1.0]), ("p3", 9, [1.0, None, 2.0])], "page_id string, ordinal int, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0, 0.5]), (2, [-1.0, 0.1, 0.1]), (3, [0.0, 0.0, 0.0])], "query_id long, vector array<float>")
    found = vector.nearest(chunks, asked, pages(spark), 4)
    want = vector.top_pages(vector.best_chunks(vector.scores(chunks, asked)), pages(spark), 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 8
    each = list(vector._near([(1, 3, [1.0, 2.0, 0.5])], 4)(iter(chunks.where("embedding is not null and page_id = 'lost' or ordinal < 2").toArrow().to_batches())))
    assert sum(b.num_rows for b in each) < 100  # pairs that cannot be among the first stay in their batch


def test_pools_hold_only_the_pages_among_which_they_are_sought(spark):
    told = pages(spark).withColumn("page_ord", F.monotonically_increasing_id()).withColumn("role", F.when(F.col("page_id") == "p0", "hot").otherwise(F.col("role")))
    seeds = spark.createDataFrame([(1, "p0", "x")], "query_id long, page_id string, evidence string")
    links, asked = spark.createDataFrame([("p0", "p5")], "page_id string, link string"), spark.createDataFrame([(1, "x p5 en")], "query_id long, query string")
    whole = {r["page_id"] for r in hybrid.pools(seeds, told, links, asked).collect()}
    among = spark.createDataFrame([("p5",), ("p9",), ("other",), ("p0",)], "page_id string")
    assert len(whole) == 59 and {r["page_id"] for r in hybrid.pools(seeds, told, links, asked, among=among).collect()} == {"p5", "p9"}

"""Retrieval evaluation and bundle validation over runs (query_id, rank, page_id) and judgements (query_id, page_id,
relevance)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The gates.
MAX_FALSE_POSITIVE, MIN_QUERIES = 0.05, 50
THRESHOLDS = {"recall_at_5": (">=", 0.90), "mrr": (">=", 0.75), "ndcg_at_10": (">=", 0.85), "citation_precision": (">=", 0.95), "citation_recall": (">=", 0.85), "negative_false_positive_rate": ("<=", 0.05)}
CONTEXT_RATIO, MATERIAL_GAIN = 1.20, 0.05
TELEMETRY = ("surface", "payload_tokens", "payload_bytes", "latency_ms", "source_bytes_scanned")
QUERY_CLASSES = ("global-map", "known-item", "topical", "multi-hop", "negative", "korean-numeric", "citation", "plain-markdown")


def judged(run: DataFrame, qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """run with rel (0 unjudged) and hit."""
    joined = run.join(qrels.select("query_id", "page_id", "relevance"), ["query_id", "page_id"], "left")
    return joined.withColumn("rel", F.coalesce("relevance", F.lit(0))).withColumn("hit", (F.col("rel") >= threshold).cast("int"))


def needs(qrels: DataFrame, k: int, threshold: int = 1, linear: bool = False) -> DataFrame:
    """(query_id, n_relevant, idcg): what a perfect run of k would have."""
    gain = F.col("relevance").cast("double") if linear else F.pow(F.lit(2.0), F.col("relevance")) - 1
    w = W.partitionBy("query_id").orderBy(F.desc("relevance"), "page_id")
    best = qrels.withColumn("r", F.row_number().over(w))
    return best.groupBy("query_id").agg(F.count_if(F.col("relevance") >= threshold).alias("n_relevant"), F.sum(F.when(F.col("r") <= k, gain / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("idcg"))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, threshold: int = 1, linear: bool = False, mrr_cut: int | None = None) -> DataFrame:
    """(query_id, ndcg, recall, hit, mrr, precision, map_all, map_k) of every query that has judgements."""
    j = judged(run, qrels, threshold)
    gain = F.col("rel").cast("double") if linear else F.pow(F.lit(2.0), F.col("rel")) - 1
    upto = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    j = j.withColumn("so_far", F.sum("hit").over(upto))
    top = F.col("rank") <= k
    first = F.when(F.col("hit") == 1, F.col("rank"))
    sums = j.groupBy("query_id").agg(
        F.sum(F.when(top, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hits"),
        F.min(first if mrr_cut is None else F.when(F.col("rank") <= mrr_cut, first)).alias("first"),
        F.sum(F.when(top & (F.col("hit") == 1), F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    n, zero = F.col("n_relevant"), F.lit(0.0)
    c = lambda name: F.coalesce(name, F.lit(0))
    return needs(qrels, k, threshold, linear).join(sums, "query_id", "left").select(
        "query_id",
        F.when(F.col("idcg") > 0, c("dcg") / F.col("idcg")).otherwise(zero).alias("ndcg"),
        F.when(n > 0, c("hits") / n).otherwise(zero).alias("recall"),
        (c("hits") > 0).cast("int").alias("hit"),
        F.when(F.col("first").isNotNull(), 1.0 / F.col("first")).otherwise(zero).alias("mrr"),
        (c("hits") / F.lit(k)).alias("precision"),
        F.when(n > 0, c("ap") / n).otherwise(zero).alias("map_all"),
        F.when(n > 0, c("ap") / F.least(n, F.lit(k))).otherwise(zero).alias("map_k"),
    )


def by_class(metrics: DataFrame, classes: DataFrame, names: tuple[str, ...] = ("ndcg", "recall", "hit", "mrr")) -> DataFrame:
    """Means over all queries and per class in one pass; the overall row's class is 'all'."""
    j = metrics.join(classes, "query_id")
    agg = [F.round(F.avg(n), 10).alias(n) for n in names]
    both = j.groupingSets([["class"], []], "class").agg(F.count(F.lit(1)).alias("n_queries"), *agg, F.grouping("class").alias("g"))
    return both.withColumn("class", F.when(F.col("g") == 1, "all").otherwise(F.col("class"))).drop("g")


def citations(run: DataFrame, qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """(citation_precision, citation_recall) over all cited pages, micro-averaged; run has citation_ids."""
    cited = run.select("query_id", F.explode("citation_ids").alias("page_id")).distinct()
    needed = qrels.where(F.col("relevance") >= threshold).select("query_id", "page_id").distinct()
    both = cited.withColumn("c", F.lit(1)).join(needed.withColumn("n", F.lit(1)), ["query_id", "page_id"], "full")
    s = both.agg(F.sum(F.when(F.col("c").isNotNull() & F.col("n").isNotNull(), 1).otherwise(0)).alias("ok"), F.count("c").alias("c"), F.count("n").alias("n"))
    return s.select(F.when(F.col("c") > 0, F.col("ok") / F.col("c")).otherwise(0.0).alias("citation_precision"), F.when(F.col("n") > 0, F.col("ok") / F.col("n")).otherwise(0.0).alias("citation_recall"))


def false_positive_rate(run: DataFrame, negatives: DataFrame) -> DataFrame:
    """(fpr): the share of queries that expect nothing and got something."""
    got = run.select("query_id").distinct().withColumn("got", F.lit(1.0))
    return negatives.join(got, "query_id", "left").agg(F.coalesce(F.avg(F.coalesce("got", F.lit(0.0))), F.lit(0.0)).alias("fpr"))


def percentiles(df: DataFrame, group: list[str], column: str, ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Both laws: the nearest rank (disc_) and linear interpolation (cont_)."""
    out = []
    for p in ps:
        n = int(round(p * 100))
        out += [F.expr(f"percentile_disc({p}) within group (order by {column})").alias(f"disc_{n}"), F.expr(f"percentile_cont({p}) within group (order by {column})").alias(f"cont_{n}")]
    return df.groupBy(*group).agg(*out)


def rank_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, page_id, rank_a, rank_b, delta) of two runs; a page that one run lacks has no delta."""
    x = a.select("query_id", "page_id", F.col("rank").alias("rank_a"))
    y = b.select("query_id", "page_id", F.col("rank").alias("rank_b"))
    return x.join(y, ["query_id", "page_id"], "full").withColumn("delta", F.col("rank_a") - F.col("rank_b"))


def paired_bootstrap(base: DataFrame, candidate: DataFrame, metric: str, samples: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """(delta, low, high, n_queries): the mean difference and its interval over resamples of as many queries as there
    are, drawn with replacement. What a draw takes is a hash of (seed, sample, draw) modulo the number of queries, so
    samples are dealt to tasks at will and the result depends on the seed alone. Both runs must have the same queries.
    The differences are the query set's: they go to every task as one array. Without queries all is null."""
    if samples < 1:
        raise ValueError("samples is at least 1")
    x, y = base.select("query_id", F.col(metric).alias("x")), candidate.select(F.col("query_id").alias("other"), F.col(metric).alias("y"))
    both = x.join(y, x["query_id"].eqNullSafe(y["other"]), "full")
    if not both.where(F.col("x").isNull() | F.col("y").isNull()).isEmpty():
        raise ValueError("both runs need one value for each query of either")
    told = both.agg(F.transform(F.sort_array(F.collect_list(F.struct("query_id", (F.col("y") - F.col("x")).alias("d")))), lambda r: r["d"]).alias("d"), F.avg(F.col("y") - F.col("x")).alias("delta"), F.count(F.lit(1)).alias("n"))
    drawn = base.sparkSession.range(samples).withColumnRenamed("id", "s").join(F.broadcast(told))
    draw = lambda total, k: total + F.get("d", F.pmod(F.xxhash64(F.lit(seed), "s", k), F.col("n")).cast("int"))
    mean = F.when(F.col("n") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int")), F.lit(0.0), draw) / F.col("n"))
    a = (1 - confidence) / 2
    means = drawn.select("delta", "n", mean.alias("m"))
    return means.agg(F.first("delta").alias("delta"), F.expr(f"percentile_cont({a}) within group (order by m)").alias("low"), F.expr(f"percentile_cont({1 - a}) within group (order by m)").alias("high"), F.first("n").alias("n_queries"))


def quality_gates(runs: DataFrame, baseline: str | None = None) -> DataFrame:
    """(run_id, gate, value, threshold, passed): every gate of every run. runs has a row a run: run_id, query_count,
    judged_query_count, the metrics of THRESHOLDS, context_tokens_p95, telemetry_only. A metric that is missing fails;
    a run that is telemetry only has no gates of its own. Query counts are those of the run with the fewest. Tokens
    may exceed the baseline's by CONTEXT_RATIO unless recall or citation recall gain MATERIAL_GAIN."""
    real = runs.where("not telemetry_only")
    counts = real.agg(F.coalesce(F.min("query_count"), F.lit(0)).alias("q"), F.coalesce(F.min("judged_query_count"), F.lit(0)).alias("j"))
    row = lambda gate, value, bar, ok: F.struct(F.lit(gate).alias("gate"), value.cast("double").alias("value"), F.lit(float(bar)).alias("threshold"), F.coalesce(ok, F.lit(False)).alias("passed"))
    own = [row(n, F.col(n), bar, F.col(n) >= bar if op == ">=" else F.col(n) <= bar) for n, (op, bar) in THRESHOLDS.items()]
    common = [row("query_count", F.col("q"), MIN_QUERIES, F.col("q") >= MIN_QUERIES), row("judged_query_count", F.col("j"), MIN_QUERIES, F.col("j") >= MIN_QUERIES)]
    out = real.select("run_id", F.explode(F.array(*own)).alias("g")).union(runs.select("run_id").join(F.broadcast(counts)).select("run_id", F.explode(F.array(*common)).alias("g")))
    if baseline is not None:
        base = real.where(F.col("run_id") == baseline).select(*[F.col(c).alias(f"base_{c}") for c in ("context_tokens_p95", "recall_at_5", "citation_recall")])
        # at most one row: the baseline run's
        j = real.where(F.col("run_id") != baseline).join(F.broadcast(base.limit(1)))
        ratio = F.when(F.col("base_context_tokens_p95") > 0, F.col("context_tokens_p95") / F.col("base_context_tokens_p95"))
        gain = F.coalesce(F.col("recall_at_5") - F.col("base_recall_at_5") >= MATERIAL_GAIN, F.lit(False)) | F.coalesce(F.col("citation_recall") - F.col("base_citation_recall") >= MATERIAL_GAIN, F.lit(False))
        out = out.union(j.select("run_id", row("context_tokens_p95_ratio", ratio, CONTEXT_RATIO, ratio.isNull() | (ratio <= CONTEXT_RATIO) | gain)))
    return out.select("run_id", "g.*")


def varying(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, n): fields that should have one value a group of keys and have n."""
    counts = rows.groupBy(*keys).agg(*[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f) for f in fields])
    each = counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x"))
    return each.select(*keys, "x.field", "x.n").where("n > 1")


def bad_run_groups(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(run_id, query_id, problem): runs of several surfaces, ranks that are not 1 to n, telemetry that differs among a
    query's rows, queries that a run lacks. rows: (run_id, query_id, rank, surface, and those of TELEMETRY)."""
    groups = rows.groupBy("run_id", "query_id").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d"))
    ranks = groups.where("low != 1 or high != n or d != n").select("run_id", "query_id", F.lit("ranks").alias("problem"))
    surfaces = varying(rows, ["run_id"], ["surface"]).select("run_id", F.lit(None).cast(rows.schema["query_id"].dataType).alias("query_id"), F.lit("surface").alias("problem"))
    telemetry = varying(rows, ["run_id", "query_id"], [c for c in TELEMETRY if c in rows.columns]).select("run_id", "query_id", F.col("field").alias("problem"))
    wanted = rows.select("run_id").distinct().join(queries.select("query_id").distinct())  # runs are few: each must answer every query
    missing = wanted.join(groups, ["run_id", "query_id"], "left_anti").select("run_id", "query_id", F.lit("missing").alias("problem"))
    return ranks.union(surfaces).union(telemetry).union(missing)


def bad_tables(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, classes: tuple[str, ...] = QUERY_CLASSES) -> DataFrame:
    """(table, id, problem) of an evaluation bundle: required fields, formats, enumerations, keys, references. The
    classes of queries are a closed list."""
    def told(df: DataFrame, name: str, key: str, checks: dict[str, Column]) -> DataFrame:
        each = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(p)) for p, ok in checks.items()]), lambda x: x.isNotNull())
        return df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"), F.explode(each).alias("problem"))

    filled = lambda *cs: {c: F.trim(F.col(c).cast("string")) != "" for c in cs}
    path = F.col("path")
    safe = (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.contains("://") & ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))
    rows = told(corpus, "corpus", "doc_id", filled("doc_id", "title", "adapter", "role", "license", "public_source") | {"path": safe, "sha256": F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), "approved": F.col("approved")})
    rows = rows.union(told(queries, "queries", "query_id", filled("query_id", "text", "locale") | {"class": F.col("class").isin(*classes), "expected_behavior": F.col("expected_behavior").isin("answerable", "unanswerable")}))
    rows = rows.union(told(qrels, "qrels", "query_id", {"relevance": F.col("relevance").between(0, 3)}))
    again = lambda df, name, keys: duplicates(df, keys).select(F.lit(name), F.col(keys[0]).cast("string"), F.lit("duplicate"))
    rows = rows.union(again(corpus, "corpus", ["doc_id"])).union(again(queries, "queries", ["query_id"])).union(again(qrels, "qrels", ["query_id", "doc_id"]))
    lost = lambda c, known: dangling(qrels, c, known, c).select(F.lit("qrels"), F.col(c).cast("string"), F.lit(f"unknown {c}"))
    return rows.union(lost("query_id", queries)).union(lost("doc_id", corpus))


def canonical_digest(content: Column) -> Column:
    """The SHA-256 of text as it is on any platform: without byte order mark, lines ended by \\n; null where the bytes
    are no UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    bare = F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    return F.sha2(F.replace(F.replace(bare, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), 256)


def _contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    return files.select(F.substring("path", F.locate(base, F.col("path")) + len(base), F.length("path")).alias("path"), "content")


def hash_mismatches(corpus: DataFrame, root: str) -> DataFrame:
    """(doc_id, path, problem): paths that lead out of root, files that are missing, no UTF-8, or whose canonical
    SHA-256 is not the one listed."""
    named = _contents(corpus.sparkSession, root).select("path", F.lit(True).alias("there"), canonical_digest(F.col("content")).alias("found"))
    j = corpus.select("doc_id", "path", F.lower("sha256").alias("told")).join(named, "path", "left")
    out = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    problem = F.when(out, "escapes").when(F.col("there").isNull(), "missing").when(F.col("found").isNull(), "not utf-8").when(F.col("found") != F.col("told"), "changed")
    return j.select("doc_id", "path", problem.alias("problem")).where("problem is not null")


#: Folders that a tree's digest leaves out.
TREE_EXCLUDED = (".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", "__pycache__")


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, digest) of the files below root that count."""
    kept = _contents(spark, root).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, TREE_EXCLUDED))))
    return kept.select("path", F.sha2("content", 256).alias("digest"))


def tree_digests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files (path, digest) every folder's digest (folder, digest), '' being the root, and what they are made of:
    entries (folder, name, digest, is_folder). A folder's digest is that of its entries' names and digests; folders are
    folded from the deepest level up, first by shares of their entries, so that a folder of any size is spread."""
    from larkspur.operators.cut import cut

    parts = F.split("path", "/")
    at = files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), "digest", F.lit(False).alias("is_folder"), (F.size(parts) - 1).alias("depth"))
    entries = cut(at, "tree")
    deepest = entries.agg(F.max("depth").alias("d")).first()["d"]
    folders, made = None, entries
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        own = made.where(F.col("depth") == depth)
        listed = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\0", "name", "digest", F.col("is_folder").cast("string")))), "\n"), 256)
        shares = own.groupBy("folder", F.substring(F.sha2("name", 256), 1, 2).alias("share")).agg(listed.alias("digest"))
        level = cut(shares.groupBy("folder").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("share", "digest"))), "\n"), 256).alias("digest")), "level")
        folders = level if folders is None else folders.union(level)
        up = F.split("folder", "/")
        above = level.where("folder != ''").select(F.array_join(F.slice(up, F.lit(1), F.size(up) - 1), "/").alias("folder"), F.element_at(up, -1).alias("name"), "digest", F.lit(True).alias("is_folder"), F.lit(depth - 1).alias("depth"))
        made = made.union(above)
    none = files.sparkSession.createDataFrame([("", hashlib.sha256(b"").hexdigest())], "folder string, digest string")
    return (none if folders is None else folders), made.drop("depth")


def least_differing(a: DataFrame, b: DataFrame) -> str | None:
    """The deepest folder that holds all differences between two trees of files (path, digest), None where they are
    equal: from the root down for as long as the only entry that differs is a folder of both."""
    x, y = tree_digests(a)[1], tree_digests(b)[1]
    both = x.select("folder", "name", "digest", F.col("is_folder").alias("fx")).join(y.select("folder", "name", F.col("digest").alias("other"), F.col("is_folder").alias("fy")), ["folder", "name"], "full")
    differ = both.where(~F.col("digest").eqNullSafe(F.col("other"))).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.col("fx") & F.col("fy"), F.lit(False))).alias("deeper"))
    ends = differ.where("n > 1 or not deeper")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    row = ends.orderBy(depth, "folder").first()
    return None if row is None else row["folder"]


def corpus_bundle(pages: DataFrame, adapter: str, implementation: str) -> DataFrame:
    """(corpus_id, title, text, metadata) of the approved pages, by path and id. An id is the page's safe id and part of
    its path's digest."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    base = F.coalesce(F.nullif(safe(F.col("page_id")), F.lit("")), safe(F.regexp_replace("path", r"\.[^./]*$", "")))
    kept = pages.where("approved").orderBy("path", "page_id")
    meta = F.struct(F.lit(adapter).alias("adapter"), F.lit(True).alias("approved_for_serving"), F.lit(implementation).alias("implementation"), "role", F.col("path").alias("source_path"))
    return kept.select(F.concat(base, F.lit("-"), F.substring(F.sha2("path", 256), 1, 10)).alias("corpus_id"), "title", "text", meta.alias("metadata"))


def original_ids(results: DataFrame, pages: DataFrame) -> DataFrame:
    """results with corpus_id by path. Two pages of one path, or of one corpus id, are an error."""
    twice = duplicates(pages, ["path"]).limit(1).count() + duplicates(pages, ["corpus_id"]).limit(1).count()
    if twice:
        raise ValueError("paths and corpus ids name one page each")
    return results.join(pages.select("path", "corpus_id"), "path")


def first_seen_fusion(channels: list[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """(query_id, page_id, score, rank): reciprocal ranks summed; of equals the one seen first, by channel and rank."""
    rows = None
    for n, c in enumerate(channels):
        part = c.select("query_id", "page_id", "rank", F.lit(n).alias("channel"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "page_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("channel", "rank")).alias("seen"))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen", "page_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "page_id", "score", "rank")


def score_separation(positive: DataFrame, other: DataFrame) -> DataFrame:
    """One row of differences between percentiles of the scores (score) of relevant results and of the best results of
    queries without any; null where either is empty."""
    law = lambda df, n: df.agg(*[F.expr(f"percentile_cont({p}) within group (order by score)").alias(f"{n}{int(100 * p)}") for p in (0.5, 0.95)])
    both = law(positive, "a").crossJoin(law(other, "b"))
    gap = lambda x, y, n: F.round(F.col(x) - F.col(y), 6).alias(n)
    return both.select(gap("a50", "b50", "p50_minus_p50"), gap("a50", "b95", "p50_minus_p95"), gap("a95", "b95", "p95_minus_p95"), (F.col("a50") - F.col("b50")).isNotNull().alias("available"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """rows whose column names no key of known."""
    return rows.join(known.select(F.col(key).alias(column)), column, "left_anti")


def bad_locators(evidence: DataFrame, corpus: DataFrame) -> DataFrame:
    """Evidence (evidence_id, page_id, start, end) that does not lie within its page's text."""
    j = evidence.join(corpus.select("page_id", F.length("text").alias("n")), "page_id")
    return j.where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("n")))


def cyclic(dependencies: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id) of the rows on or behind a cycle of dependencies (id, needs): what needs nothing left is taken away until
    nothing changes."""
    from larkspur.operators.cut import cut

    rest = cut(dependencies.select("id", "needs").distinct())
    n = rest.count()
    for _ in range(max_rounds):
        rest = cut(rest.join(rest.select(F.col("id").alias("needs")).distinct(), "needs", "left_semi").select("id", "needs"))
        m = rest.count()
        if m == n:
            break
        n = m
    return rest.select("id").distinct()


def eligible(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, answerable, n_positive, eligible): queries count for ranking metrics if answerable and judged."""
    pos = qrels.where("relevance > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_positive"))
    j = queries.join(pos, "query_id", "left").withColumn("n_positive", F.coalesce("n_positive", F.lit(0)))
    return j.select("query_id", "answerable", "n_positive", (F.col("answerable") & (F.col("n_positive") > 0)).alias("eligible"))

"""Ranked lexical retrieval for many queries at once; one query is a table of one row."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import index as I
from larkspur.operators.cut import cut

# Constants of the ranking.
K1, B = 1.2, 0.75
COMPOUND_WEIGHT, METADATA_WEIGHT = 0.85, 0.35
RRF_K = 60
#: Query tokens up to which they are sent to the postings instead of shuffling these.
SENT = 100_000
#: Query tokens up to which pages are read for them alone, without an index of everything else.
ASKED = 20_000
#: Scores of queries over pages that a task sums.
SCORES = 1_000_000
DIGITS = 4


def role_multiplier(role: Column) -> Column:
    return F.when(role == "hot", 1.15).when(role == "index", 1.06).when(role == "overview", 1.03).otherwise(1.0)


def role_rank(role: Column) -> Column:
    return F.when(role == "hot", 0).when(role == "index", 1).when(role == "overview", 2).otherwise(3)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest(dl, F.lit(1)) / avgdl))


def visible(pages: DataFrame, include_drafts: bool = False) -> DataFrame:
    return pages if include_drafts else pages.where("approved")


def without(pages: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """pages without those that excluded (key) names by id or path."""
    if excluded is None:
        return pages
    keys = excluded.select(F.trim("key").alias("key")).where("key != ''")
    return pages.join(keys, pages["page_id"] == keys["key"], "left_anti").join(keys, pages["path"] == keys["key"], "left_anti")


def ranked(scored: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The first rows of each query by rounded score, role and path, with rank. The rank's bound reaches below the
    shuffle, so that every input partition sends limit rows a query at most."""
    w = W.partitionBy("query_id").orderBy(F.desc(score), role_rank(F.col("role")), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def query_tokens(queries: DataFrame, analyzer: str = "legacy") -> DataFrame:
    """(query_id, token, weight): distinct tokens."""
    if analyzer == "english":
        from larkspur.functions.stem import english_tokens

        tokens = english_tokens(F.col("query"))
    else:
        tokens = X.legacy_tokens(F.col("query"))
    return queries.select("query_id", F.explode(F.array_distinct(tokens)).alias("token")).withColumn("weight", X.token_weight(F.col("token")))


def asked(pages: DataFrame, queries: DataFrame, analyzer: str = "legacy") -> I.Index | None:
    """The index of pages as far as the queries (query_id, query) look at it, in one pass over the pages; None for more
    tokens than a task can hold, which are what an index is stored for."""
    names = lambda df: [r["token"] for r in df.select("token").distinct().limit(ASKED + 1).collect()]
    english = analyzer == "english"
    lists = [names(query_tokens(queries, analyzer)), *([names(single_identifiers(queries)), names(identifiers(queries))] if english else [])]
    if max(map(len, lists)) > ASKED:
        return None
    made = I.narrowed(pages, lists[0], analyzer, *lists[1:])
    return replace(made, parts=_tasks(made.doc_stats, queries))


def _tasks(docs: DataFrame, queries: DataFrame) -> int:
    """Tasks for the scores of queries over pages: as many as the session's, more beyond SCORES each."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() * queries.count() // SCORES))


def text_scores(index: I.Index, queries: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, text_score) of every page that holds a query token; statistics are those of the index. more:
    (query_id, page_id, s) that count too."""
    wanted = query_tokens(queries, index.analyzer)
    weighted = wanted.join(I.only(index.term_stats, wanted), "token").crossJoin(F.broadcast(index.corpus_stats))
    score = idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl")) * F.col("weight")
    # dealt by page once, for the sums and for what is joined to them; tasks grow in number with the index, not in size
    dealt = lambda df: df.repartition("page_id") if index.parts is None else df.repartition(index.parts, "page_id")
    if wanted.limit(SENT + 1).count() <= SENT:
        # a row a query's token is sent to the postings, which are dealt before the queries multiply them
        near = I.unrolled(dealt(index.rows)) if index.rows is not None else dealt(I.only(index.postings, wanted))
        scores = near.join(F.broadcast(weighted), "token").select("query_id", "page_id", score.alias("s"))
    else:
        scores = dealt(I.only(index.postings, wanted).join(weighted, "token").select("query_id", "page_id", score.alias("s")))
    if more is not None:
        scores = scores.union(dealt(more.select("query_id", "page_id", "s")))
    return scores.groupBy("query_id", "page_id").agg(F.sum("s").alias("text_score"))


def identifiers(queries: DataFrame) -> DataFrame:
    """(query_id, token): every identifier of several parts in the queries."""
    return queries.select("query_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit(X.COMPOUND), F.lit(0)), lambda t: F.lower(t)))).alias("token"))


def exact_scores(index: I.Index, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of the identifier channels, and for queries that are one identifier the pages that hold it, as
    (query_id, page_id); such queries are listed with a null page where no page does."""
    total = index.corpus_stats.select("n")
    single = single_identifiers(queries)
    every = identifiers(queries)

    def channel(postings: DataFrame, wanted: DataFrame, weight: float) -> DataFrame:
        near = I.only(postings, wanted)
        score = idf(F.col("n"), F.col("df")) * (1 + F.log1p("tf")) * weight
        return near.join(wanted.join(I.frequencies(near), "token"), "token").crossJoin(F.broadcast(total)).select("query_id", "page_id", score.alias("s"))

    scores = channel(index.compound, single, COMPOUND_WEIGHT).union(channel(index.metadata, every, METADATA_WEIGHT))
    held = I.only(index.compound, single).union(I.only(index.metadata, single)).select("token", "page_id").distinct()
    return scores, single.join(held, "token", "left").select("query_id", "page_id")


def single_identifiers(queries: DataFrame) -> DataFrame:
    """(query_id, token) of the queries that are one identifier and marks only."""
    found = queries.select("query_id", F.regexp_extract_all("query", F.lit(X.COMPOUND), F.lit(0)).alias("all"), F.regexp_replace("query", X.COMPOUND, "").alias("rest"))
    bare = F.regexp_replace(F.trim("rest"), r"^[\"'`“”‘’()\[\]{}.,;:!?\s]+|[\"'`“”‘’()\[\]{}.,;:!?\s]+$", "")
    return found.where((F.size("all") == 1) & (bare == "")).select("query_id", F.lower(F.col("all")[0]).alias("token"))


def search(source: DataFrame | I.Index, queries: DataFrame, limit: int = 8, analyzer: str = "legacy", min_score: float | None = None, excluded: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, path, role, score, rank) over an index, or over pages, which are indexed for this search.
    Exclusion, the pages (page_id) allowed within, and the least score come after scoring and change no statistics; the
    least score looks at the score before it is rounded. A query of one identifier finds only pages that hold it."""
    index = source if isinstance(source, I.Index) else I.build(source, analyzer)
    extra, holders = exact_scores(index, queries) if index.analyzer == "english" else (None, None)
    scored = text_scores(index, queries, extra)
    if index.analyzer == "english" and single_identifiers(queries).limit(1).count():
        bound = holders.select("query_id").distinct().withColumn("bound", F.lit(True))
        held = holders.where("page_id is not null").withColumn("holds", F.lit(True))
        scored = scored.join(bound, "query_id", "left").join(held, ["query_id", "page_id"], "left").where("bound is null or holds").select("query_id", "page_id", "text_score")
    # pages are left out of the list of pages, which is shorter than the scores of all queries
    docs = without(index.doc_stats.select("page_id", "path", "role"), excluded)
    if within is not None:
        docs = docs.join(within.select("page_id"), "page_id", "left_semi")
    # a part's pages are held, its scores of all queries pass by
    placed = scored.where("text_score > 0").join(docs.hint("shuffle_hash"), "page_id")
    whole = placed.withColumn("whole", F.col("text_score") * role_multiplier(F.col("role")))
    if min_score is not None:
        whole = whole.where(F.col("whole") >= min_score)
    return ranked(whole.withColumn("score", F.round("whole", DIGITS)), limit).select("query_id", "page_id", "path", "role", "score", "rank")


RESULT = ("query_id", "page_id", "path", "role", "score", "rank")


def answered(source: DataFrame | I.Index, queries: DataFrame, limit: int = 8, analyzer: str = "legacy", min_score: float | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """search, and the overview for queries that say nothing: blank ones, and with the legacy analyzer those without a
    token too. An english query of stop words alone finds nothing."""
    index = source if isinstance(source, I.Index) else I.build(source, analyzer)
    found = search(index, queries, limit, min_score=min_score, excluded=excluded)
    says = F.trim("query") != "" if index.analyzer == "english" else F.size(X.legacy_tokens(F.col("query"))) > 0
    silent = queries.where(~F.coalesce(says, F.lit(False))).select("query_id")
    head = overview(index.doc_stats, limit, excluded)
    if min_score is not None:
        head = head.where(F.col("score") >= min_score)
    # a few rows for each silent query
    return found.union(silent.join(F.broadcast(head)).select(*RESULT))


FIELDS = ("page_id", "path", "title", "role", "score", "snippet", "summary", "tags", "source_refs")


def projected(results: DataFrame, pages: DataFrame, queries: DataFrame, fields: list[str] | None = None, snippet: int = X.SNIPPET_LIMIT) -> DataFrame:
    """results with page fields in FIELDS' order, page_id always among them; the snippet is the window round the first
    query token. Unknown names are an error."""
    wanted = list(FIELDS) if fields is None else [f for f in FIELDS if f in {"page_id", *fields}]
    if fields is not None and not set(fields) <= set(FIELDS):
        raise ValueError(f"fields are {FIELDS}")
    # written, so that their size is known: few results go to the pages, instead of all texts to the results
    own = cut(results.select("query_id", "rank", "page_id", "score"), "results")
    shown = own.join(pages.select("page_id", "path", "title", "role", "text", "summary", "tags", "source_refs"), "page_id").join(F.broadcast(queries.select("query_id", "query")), "query_id")
    window = X.snippet(F.col("text"), F.array_distinct(X.legacy_tokens(F.col("query"))), snippet)
    return shown.withColumn("snippet", window).select("query_id", "rank", *wanted)


def literal(pages: DataFrame, queries: DataFrame, limit: int = 8, min_score: float | None = None) -> DataFrame:
    """(query_id, page_id, path, role, score, rank): pages that hold the query's words as one string, case folded."""
    needles = queries.select("query_id", X.folded(X.clean(F.col("query"))).alias("needle")).where("needle != ''")
    texts = pages.select("page_id", "path", "role", X.folded(F.col("title")).alias("t"), X.folded(F.col("summary")).alias("s"), X.folded(I.literal_text()).alias("x"))
    # the needles are the query set: every page is read once and held against all of them
    found = texts.join(F.broadcast(needles), F.col("x").contains(F.col("needle")))
    n = X.substring_count(F.col("x"), F.col("needle"))
    plain = 1 + F.least(F.lit(3.0), F.log1p(n)) + F.when(F.col("t").contains(F.col("needle")), 1.5).otherwise(0.0) + F.when(F.col("s").contains(F.col("needle")), 0.7).otherwise(0.0)
    scored = found.select("query_id", "page_id", "path", "role", (plain * role_multiplier(F.col("role"))).alias("whole"))
    if min_score is not None:
        scored = scored.where(F.col("whole") >= min_score)
    return ranked(scored.withColumn("score", F.round("whole", DIGITS)), limit).select("query_id", "page_id", "path", "role", "score", "rank")


def orientation_order(pages: DataFrame) -> DataFrame:
    """pages with the place they take in an overview: the first hot, index and overview page by path, then all others by
    role and path. (lead, role rank, path) is the order; no page is numbered in one task."""
    heads = pages.where("role in ('hot', 'index', 'overview')").groupBy("role").agg(F.min("path").alias("path")).withColumn("head", F.lit(True))
    joined = pages.join(F.broadcast(heads), ["role", "path"], "left")
    return joined.withColumn("lead", F.when(F.col("head"), role_rank(F.col("role"))).otherwise(3)).drop("head")


def overview(pages: DataFrame, limit: int = 8, excluded: DataFrame | None = None) -> DataFrame:
    """(page_id, path, role, score, rank) for an empty query; ranks are counted after exclusion."""
    first = without(orientation_order(pages), excluded).orderBy("lead", role_rank(F.col("role")), "path").limit(limit)
    rank = F.row_number().over(W.orderBy("lead", role_rank(F.col("role")), "path"))  # over limit rows
    return first.withColumn("rank", rank).select("page_id", "path", "role", F.round(1.0 - (F.col("rank") - 1) * 0.01, DIGITS).alias("score"), "rank")


def fuse_variants(channels: list[DataFrame], limit: int) -> DataFrame:
    """Reciprocal-rank fusion of a primary channel and its variants, each (query_id, page_id, path, role, rank)."""
    rows = None
    for k, c in enumerate(channels):
        part = c.select("query_id", "page_id", "path", "role", "rank", F.lit(k).alias("channel"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "page_id", "path", "role").agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("fused"),
        F.coalesce(F.min(F.when(F.col("channel") == 0, F.col("rank"))), F.lit(1_000_000)).alias("primary_rank"),
        F.min("rank").alias("best_rank"),
    )
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), "primary_rank", "best_rank", role_rank(F.col("role")), "path")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "page_id", "path", "role", F.round("fused", 6).alias("score"), "rank")


def search_variants(source: DataFrame | I.Index, primary: DataFrame, variants: list[DataFrame], limit: int = 8, analyzer: str = "legacy", min_score: float | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """A query and its variants (query_id, query) fused by reciprocal rank; each channel is searched by itself, limit
    results a query. Where the primary query is one identifier, only pages that hold it count, in the variants too;
    ranks stay those of the channel."""
    index = source if isinstance(source, I.Index) else I.build(source, analyzer)
    channels = [search(index, q, limit, min_score=min_score, excluded=excluded) for q in (primary, *variants)]
    if index.analyzer == "english":
        _, holders = exact_scores(index, primary)
        bound = holders.select("query_id").distinct().withColumn("bound", F.lit(True))
        held = holders.where("page_id is not null").withColumn("holds", F.lit(True))
        channels = [c.join(bound, "query_id", "left").join(held, ["query_id", "page_id"], "left").where("bound is null or holds").select(*c.columns) for c in channels]
    return fuse_variants(channels, limit)


def rerank_in_bands(results: DataFrame, priors: DataFrame, band: float) -> DataFrame:
    """results (query_id, page_id, path, role, score) re-ranked within bands of score: a band starts at its best score
    and ends where scores fall more than ``band`` below it; inside, score plus prior, clamped to the band, decides.
    priors: (page_id, boost). A fold over each query's ranked rows, as a band's start depends on the one before."""
    joined = results.join(priors, "page_id", "left").withColumn("boost", F.least(F.greatest(F.coalesce("boost", F.lit(0.0)), F.lit(0.0)), F.lit(band)))
    row = F.struct((-F.col("score")).alias("neg"), role_rank(F.col("role")).alias("rr"), "path", "page_id", "role", "score", "boost")
    lists = joined.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(float("inf")).alias("top"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["top"] - x["score"] > band
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.when(new, x["score"]).otherwise(acc["top"]).alias("top"), n.alias("n"), F.array_append(acc["out"], n).alias("out"))

    banded = lists.select("query_id", F.explode(F.arrays_zip("rows", F.aggregate("rows", start, step)["out"].alias("band"))).alias("z")).select("query_id", "z.rows.*", F.col("z.band").alias("band"))
    w = W.partitionBy("query_id").orderBy("band", F.desc(F.col("score") + F.col("boost")), F.desc("score"), "rr", "path")
    return banded.withColumn("rank", F.row_number().over(w)).select("query_id", "page_id", "path", "role", "score", "rank")

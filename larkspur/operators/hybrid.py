"""Fusion of lexical, vector, orientation and graph channels by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators.lexical import RRF_K, role_rank, without

# The channels' weights and depths.
WEIGHTS = {"lexical": 1.0, "related": 1.0, "vector": 0.75, "orientation": 0.35, "graph": 0.25}
SEED_DEPTH, SEEDS, RELATED_PER_SEED, RELATED = 24, 3, 16, 64
HUB = "role in ('hot', 'index', 'overview')"


def candidate_depth(limit: int, total: int) -> int:
    """How deep each channel is read before fusion."""
    return min(total, max(limit, min(1024, max(256, 4 * limit))))


def reranked(channel: DataFrame) -> DataFrame:
    """Ranks of a channel closed up after rows were taken out."""
    return channel.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def fuse(channels: dict[str, DataFrame], weights: dict[str, float], limit: int, required: DataFrame | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, path, role, score, rank). Channels are (query_id, page_id, path, role, rank); required and
    suppressed are (query_id, page_id), applied before ranks count; required lists a query without pages with a null
    page, and its pages that the lexical channel holds come first among equals."""
    rows = None
    for name, c in channels.items():
        if required is not None:
            bound = required.select("query_id").distinct().withColumn("bound", F.lit(True))
            held = required.where("page_id is not null").distinct().withColumn("holds", F.lit(True))
            c = c.join(bound, "query_id", "left").join(held, ["query_id", "page_id"], "left").where("bound is null or holds")
        else:
            c = c.withColumn("holds", F.lit(None).cast("boolean"))
        if suppressed is not None:
            c = c.join(suppressed, ["query_id", "page_id"], "left_anti")
        c = reranked(c) if required is not None or suppressed is not None else c
        first = F.coalesce("holds", F.lit(False)) if name == "lexical" else F.lit(False)
        part = c.select("query_id", "page_id", "path", "role", (F.lit(weights[name]) / (RRF_K + F.col("rank"))).alias("s"), first.alias("exact"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "page_id", "path", "role").agg(F.sum("s").alias("fused"), F.max("exact").alias("exact"))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), F.desc("exact"), role_rank(F.col("role")), "path", "page_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "page_id", "path", "role", F.round("fused", 4).alias("score"), "rank")


def plain(lexical: DataFrame, vector: DataFrame, limit: int, **more) -> DataFrame:
    return fuse({"lexical": lexical, "vector": vector}, {"lexical": 1.0, "vector": 1.0}, limit, **more)


def evidence(lexical: DataFrame, vector: DataFrame, pages: DataFrame, queries: DataFrame, snippet: int = X.SNIPPET_LIMIT) -> DataFrame:
    """(query_id, page_id, evidence): what both channels show of the hub pages they found, joined. pages may have the
    best chunk's start and end in vector; without them the page's own start is shown."""
    texts = pages.where(HUB).select("page_id", "text", "summary")
    asked = queries.select("query_id", F.array_distinct(X.legacy_tokens(F.col("query"))).alias("tokens"))
    a = lexical.select("query_id", "page_id").join(F.broadcast(asked), "query_id").join(texts, "page_id").select("query_id", "page_id", X.snippet(F.col("text"), F.col("tokens"), snippet).alias("a"))
    own = chunk_snippet(F.col("text"), F.col("start"), F.col("end"), snippet) if "start" in vector.columns else X.clipped(X.clean(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("summary"))), snippet)
    b = vector.join(texts, "page_id").select("query_id", "page_id", own.alias("b"))
    both = a.join(b, ["query_id", "page_id"], "full")
    said = F.array_join(F.filter(F.array(F.trim("a"), F.trim("b")), lambda x: x.isNotNull() & (x != "")), " ")
    return both.select("query_id", "page_id", said.alias("evidence")).where("evidence != ''")


def chunk_snippet(text: Column, start: Column, end: Column, limit: int) -> Column:
    """The window of a chunk, 80 characters before it on."""
    at = F.greatest(F.lit(0), start - 80)
    sound = (start >= 0) & (start < end) & (end <= F.length(text))
    window = F.when(sound, F.substring(text, at + 1, F.greatest(end, at + limit) - at)).otherwise(text)
    return X.clipped(X.clean(window), limit)


def seeds(lexical: DataFrame, vector: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, path, role, lexical_rank, vector_rank, evidence, rank): hub pages near the top of either
    channel, which rank hub pages alone. shown: what ``evidence`` gives; a hub that shows nothing is no seed."""
    near = F.col("rank") <= SEED_DEPTH
    a = lexical.where(HUB).where(near).select("query_id", "page_id", "path", "role", F.col("rank").alias("lexical_rank"))
    b = vector.where(HUB).where(near).select("query_id", "page_id", F.col("path").alias("p2"), F.col("role").alias("r2"), F.col("rank").alias("vector_rank"))
    both = a.join(b, ["query_id", "page_id"], "full").select("query_id", "page_id", F.coalesce("path", "p2").alias("path"), F.coalesce("role", "r2").alias("role"), "lexical_rank", "vector_rank")
    both = both.join(shown, ["query_id", "page_id"]) if shown is not None else both.withColumn("evidence", F.lit(""))
    last = F.lit(SEED_DEPTH + 1)
    ranks = F.coalesce("lexical_rank", last), F.coalesce("vector_rank", last)
    w = W.partitionBy("query_id").orderBy(F.least(*ranks), *ranks, role_rank(F.col("role")), "path", "page_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SEEDS)


def page_names(pages: DataFrame) -> DataFrame:
    """(key, page_id): every page under the keys of its id, title, path, file name and stem; the first page wins."""
    name = F.element_at(F.split("path", "/"), -1)
    forms = F.array("page_id", "title", "path", name, F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""))
    each = pages.select("page_ord", "page_id", F.explode(F.array_distinct(F.transform(forms, X.relation_key))).alias("key")).where("key != ''")
    return each.groupBy("key").agg(F.min_by("page_id", F.struct("page_ord", "page_id")).alias("page_id"))


def pools(seed_pages: DataFrame, pages: DataFrame, links: DataFrame, queries: DataFrame, excluded: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """(query_id, seed_id, page_id), of the pages among (page_id) if given: the pages that a seed's links lead to, and those that share a source or tag with
    it, as far as the seed's evidence or the query names the label. links: (page_id, link)."""
    hubs = pages.where(HUB)
    labels = links.join(hubs.select("page_id"), "page_id").select("page_id", F.lit("link").alias("kind"), F.col("link").alias("label"))
    for kind, column in (("source", "source_refs"), ("tag", "tags")):
        labels = labels.union(hubs.select("page_id", F.lit(kind), F.explode(column)))
    told = seed_pages.join(queries.select("query_id", "query"), "query_id").join(labels.distinct(), "page_id")
    seen = told.where(X.label_visible(F.col("label"), F.col("evidence")) | X.label_visible(F.col("label"), F.col("query")))
    seen = seen.select("query_id", F.col("page_id").alias("seed_id"), "kind", X.relation_key(F.col("label")).alias("key")).distinct()
    targets = page_names(pages).select(F.lit("link").alias("kind"), "key", "page_id")
    for kind, column in (("source", "source_refs"), ("tag", "tags")):
        targets = targets.union(pages.select(F.lit(kind), F.explode(column).alias("label"), "page_id").select(F.lit(kind), X.relation_key(F.col("label")), "page_id"))
    if among is not None:
        targets = targets.join(among.select("page_id"), "page_id", "left_semi").select("kind", "key", "page_id")
    # few labels are seen: they are broadcast, and the pages are read once
    found = targets.join(seen, ["kind", "key"]).where("page_id != seed_id").select("query_id", "seed_id", "page_id").distinct()
    return without(found.join(pages.select("page_id", "path"), "page_id"), excluded).select("query_id", "seed_id", "page_id")


def related(pools_: DataFrame, best: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages related to each seed, best vectors first: some a seed, then some overall. best: (query_id, page_id,
    score, ordinal)."""
    scored = pools_.join(best, ["query_id", "page_id"]).join(pages.select("page_id", "path", "role"), "page_id")
    order = [F.desc("score"), role_rank(F.col("role")), "path", "page_id"]
    some = scored.withColumn("k", F.row_number().over(W.partitionBy("query_id", "seed_id").orderBy(*order))).where(F.col("k") <= RELATED_PER_SEED)
    once = some.select("query_id", "page_id", "path", "role", "score").distinct()
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= RELATED)


def by_relevance(related_pages: DataFrame, lexical: DataFrame) -> DataFrame:
    """The related pages by vector score, then lexical rank: the order of both the related and the graph channel."""
    ranks = lexical.select("query_id", "page_id", F.col("rank").alias("lr"))
    joined = related_pages.join(ranks, ["query_id", "page_id"], "left")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("lr", F.lit(1_000_000)), role_rank(F.col("role")), "path", "page_id")
    return joined.withColumn("rank", F.row_number().over(w)).select("query_id", "page_id", "path", "role", "rank")


def unnamed_hubs(pages: DataFrame, queries: DataFrame, channels: list[DataFrame]) -> DataFrame:
    """(query_id, page_id) of the hub pages among the channels' rows that a query does not name, and that answers
    therefore leave out. A query names a page by its id, title, path, file name or stem and nothing else."""
    name = F.element_at(F.split("path", "/"), -1)
    forms = F.array("page_id", "title", "path", name, F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""))
    keys = pages.where(HUB).select("page_id", F.explode(F.array_distinct(F.transform(forms, X.relation_key))).alias("key")).where("key != ''")
    named = queries.select("query_id", X.relation_key(F.col("query")).alias("key")).join(keys, "key").select("query_id", "page_id").distinct()
    rows = None
    for c in channels:
        part = c.where(HUB).select("query_id", "page_id")
        rows = part if rows is None else rows.union(part)
    return rows.distinct().join(named, ["query_id", "page_id"], "left_anti")


def answered(lexical: DataFrame, vector: DataFrame, seed_pages: DataFrame, related_pages: DataFrame, pages: DataFrame, queries: DataFrame, limit: int, required: DataFrame | None = None) -> DataFrame:
    """Hybrid results of every query: five channels under WEIGHTS where a query has seeds and related pages, lexical
    and vector alone where it has none. Hubs that a query does not name give orientation but are no answers."""
    rich = seed_pages.select("query_id").distinct().join(related_pages.select("query_id").distinct(), "query_id", "left_semi")
    hidden = unnamed_hubs(pages, queries, [lexical, vector, seed_pages, related_pages])
    shown = lambda c: c.join(hidden, ["query_id", "page_id"], "left_anti")
    ordered = by_relevance(shown(related_pages), reranked(shown(lexical)))
    channels = {"lexical": lexical, "related": ordered, "vector": vector, "orientation": seed_pages.select("query_id", "page_id", "path", "role", "rank"), "graph": ordered}
    seeded = fuse({k: c.join(rich, "query_id", "left_semi") for k, c in channels.items()}, WEIGHTS, limit, required, hidden)
    rest = [c.join(rich, "query_id", "left_anti") for c in (lexical, vector)]
    return seeded.union(plain(*rest, limit, required=required, suppressed=hidden))

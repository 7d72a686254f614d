"""Catalog queries: manifest, source references, reads, context packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators.cut import cut

GRAPH_NODES = 120


def manifest(pages: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """One row of counts and the first hub pages in page order."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("path")), F.when(F.col("role") == role, F.col("page_ord"))).alias(f"{role}_path")
    row = pages.agg(F.count(F.lit(1)).alias("page_count"), F.count_if("approved").alias("approved_count"), *map(first, ("hot", "index", "overview")))
    if nodes is not None and edges is not None:
        row = row.crossJoin(nodes.agg(F.count(F.lit(1)).alias("node_count"))).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count")))
    return row


def wiki_title(pages: DataFrame) -> DataFrame:
    """(title): the first index page's, else the first overview page's."""
    hubs = pages.where("role in ('index', 'overview')")
    return hubs.agg(F.min_by("title", F.struct(F.when(F.col("role") == "index", 0).otherwise(1), "page_ord")).alias("title"))


def source_refs(pages: DataFrame) -> DataFrame:
    """(id, label, linked_pages, linked_page_ids, n_pages): references in order of id, pages in page order. Labels whose
    slugs meet keep the slug for the first seen; the others get part of their digest, and a number where that is taken."""
    each = pages.select("page_ord", "page_id", "path", F.posexplode("source_refs").alias("k", "label"))
    grouped = each.groupBy("label").agg(F.min(F.struct("page_ord", "k")).alias("seen"), F.sort_array(F.collect_set(F.struct("page_ord", "path", "page_id"))).alias("p"))
    w = W.partitionBy("base").orderBy("seen")
    named = grouped.withColumn("base", F.lower(X.slug(F.col("label")))).withColumn("r", F.row_number().over(w))
    ref = F.when(F.col("r") == 1, F.col("base")).otherwise(F.concat(F.col("base"), F.lit("-"), F.substring(F.sha2(F.col("label"), 256), 1, 8)))
    again = W.partitionBy("ref").orderBy("r", "seen")
    numbered = named.withColumn("ref", ref).withColumn("again", F.row_number().over(again))
    ref = F.when(F.col("again") == 1, F.col("ref")).otherwise(F.concat_ws("-", "ref", F.col("again").cast("string")))
    return numbered.select(ref.alias("id"), "label", F.transform("p", lambda x: x["path"]).alias("linked_pages"), F.transform("p", lambda x: x["page_id"]).alias("linked_page_ids"), F.size("p").cast("long").alias("n_pages"))


def read(pages: DataFrame, page: str, include_drafts: bool = False) -> DataFrame:
    """The first page with this id or path; its filter reaches the scan."""
    found = pages.where((F.col("page_id") == page) | (F.col("path") == page))
    return (found if include_drafts else found.where("approved")).orderBy("page_ord").limit(1)


def content_signature(pages: DataFrame) -> DataFrame:
    """(signature): one digest over every page's path and text digest, the same wherever the corpus lies. Digests are
    combined by buckets first, so that no task sees all pages."""
    each = pages.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
    parts = each.groupBy(F.substring(F.sha2("path", 256), 1, 4).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", "path", "d"))), "\n"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", "b", "d"))), "\n"), 256).alias("signature"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): pages added, removed or changed between two listings."""
    digest = lambda df, n: df.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias(n))
    both = digest(before, "a").join(digest(after, "b"), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def context_pack(evidence: DataFrame, orientation: DataFrame, pages: DataFrame, queries: DataFrame | None = None, limit: int = X.SNIPPET_LIMIT) -> DataFrame:
    """(query_id, evidence, orientation, n_evidence): one row a query, its results as ordered arrays of structs, each
    with the window of its text round the first token of its query (query_id, query), or the start of its text."""
    asked = evidence.select("query_id").distinct() if queries is None else queries.select("query_id", "query")
    words = F.array().cast("array<string>") if queries is None else F.array_distinct(X.legacy_tokens(F.col("query")))
    asked = asked.select("query_id", words.alias("tokens"))
    # written, so that their size is known: few results go to the pages, instead of all texts to the results
    shown = cut(evidence, "evidence").join(pages.select("page_id", "title", "text", "source_refs"), "page_id").join(F.broadcast(asked), "query_id")
    rows = shown.select("query_id", F.struct("rank", "page_id", "path", "score", "title", X.snippet(F.col("text"), F.col("tokens"), limit).alias("snippet"), "source_refs").alias("e"))
    packs = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("e")).alias("evidence"))
    head = orientation.agg(F.sort_array(F.collect_list(F.struct("rank", "page_id", "path", "score"))).alias("orientation"))
    return packs.crossJoin(F.broadcast(head)).withColumn("n_evidence", F.size("evidence").cast("long"))


def whole_pack(
    queries: DataFrame, evidence: DataFrame, orientation: DataFrame, pages: DataFrame, graph: tuple[DataFrame, DataFrame], about: dict[str, str], include_drafts: bool = False, limit: int = X.SNIPPET_LIMIT
) -> DataFrame:
    """One row a query (query_id, query), also of those without evidence: what the wiki is (about: title, description,
    adapter, implementation), its counts, whether the query is answerable, orientation and evidence as context_pack has
    them, what limits the answer, and the first nodes of the shown graph with the edges among them. pages are all
    pages; evidence, orientation and graph are those that may be shown."""
    packs = context_pack(evidence, orientation.limit(0), pages, queries, limit).select("query_id", "evidence")
    counts = pages.agg(F.count(F.lit(1)).alias("page_count"), F.count_if("approved").alias("approved_page_count"))
    head = orientation.agg(F.sort_array(F.collect_list(F.struct("rank", "page_id", "path", "score"))).alias("orientation"))
    shown, among = graph_part(*graph)
    # one row each: the counts, three orientation pages, at most GRAPH_NODES nodes and edges
    common = counts.join(F.broadcast(head)).join(F.broadcast(shown)).join(F.broadcast(among))
    each = queries.select("query_id", "query").join(packs, "query_id", "left").join(F.broadcast(common))
    n = F.coalesce(F.size("evidence"), F.lit(0))
    withheld = F.col("page_count") - F.col("approved_page_count")
    said = F.array(F.when(n == 0, "No matching approved page was found."), F.when((withheld > 0) & F.lit(not include_drafts), F.concat(withheld.cast("string"), F.lit(" draft or unapproved page(s) were withheld."))))
    named = [F.lit(about.get(k, "")).alias(k) for k in ("title", "description", "adapter", "implementation")]
    return each.select("query_id", "query", *named, "page_count", "approved_page_count", (n > 0).alias("answerable"), "orientation", F.when(n > 0, F.col("evidence")).alias("evidence"), n.cast("long").alias("n_evidence"), F.array_compact(said).alias("limitations"), "graph_nodes", "graph_edges")


def graph_part(nodes: DataFrame, edges: DataFrame, most: int = GRAPH_NODES) -> tuple[DataFrame, DataFrame]:
    """One row with the ids of the first nodes, and one with the first edges among them."""
    from larkspur.operators import graph as G

    first, among = G.bounded(nodes, edges, most)
    return first.agg(F.sort_array(F.collect_list("id")).alias("graph_nodes")), among.agg(F.sort_array(F.collect_list(F.struct("source", "target", "relation"))).alias("graph_edges"))


def bundle(pages: DataFrame, title: str, adapter: str, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """One row: the source's id and title, its manifest, and its references as an ordered array."""
    refs = source_refs(pages.where("approved")).agg(F.sort_array(F.collect_list(F.struct("id", "label", "n_pages", "linked_pages", "linked_page_ids"))).alias("source_refs"))
    own = F.lower(X.slug(F.lit(title)))
    row = manifest(pages, nodes, edges).crossJoin(F.broadcast(refs))
    return row.select(own.alias("source_id"), F.concat(own, F.lit(":"), F.lit(adapter)).alias("bundle_id"), F.lit(title).alias("title"), F.struct(*[c for c in row.columns if c != "source_refs"]).alias("manifest"), "source_refs")

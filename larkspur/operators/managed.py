"""Managed orientation: for plain sources without hub pages, which pages lead a reader, by links and by what was found
useful, and the scoped state of use behind it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import graph, index, usage
from larkspur.operators.lexical import role_rank

# Limits, names and words without meaning for a query.
ORIENTATION, QUERY_ORIENTATION, SNIPPET_CHARS, MIN_EVIDENCE = 3, 2, 160, 0.2
HUB_NAMES = ("hot.md", "index.md", "overview.md", "quickstart.md")
ROUTES = ("search", "literal", "vector", "hybrid", "read")
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or", "please", "show", "tell", "that", "the", "this", "to", "was", "what",
    "when", "where", "which", "who", "why", "with", "would",
)


@dataclass(frozen=True)
class Scope:
    """What a state of use belongs to; any change of contents is another scope, so counters start anew."""

    namespace: str
    source: str
    adapter: str
    projection_signature: str
    source_signature: str

    def digest(self) -> str:
        return hashlib.sha256("\0".join((self.namespace, self.source, self.adapter, self.projection_signature, self.source_signature)).encode()).hexdigest()


def applies(pages: DataFrame, adapter: str, implementation: str = "generic-markdown") -> bool:
    """For generic sources, read by the generic implementation, without authored hub pages."""
    named = pages.where(F.col("role").isin("hot", "index", "overview") & F.lower(F.element_at(F.split("path", "/"), -1)).isin(*HUB_NAMES))
    return adapter == implementation == "generic-markdown" and named.isEmpty()


def page_key(page_id: Column, scope: Scope, secret: str) -> Column:
    """An opaque key of a page within a scope."""
    return page_key_in(page_id, F.lit(scope.digest()), secret)


def page_key_in(page_id: Column, digest: Column, secret: str) -> Column:
    """The key within the scope of a digest: HMAC-SHA256 over both, as DataFrame functions."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    said = F.concat(digest, F.lit("\0"), page_id).cast("binary")
    return F.concat(F.lit("pk_"), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256))


def sound(state: DataFrame, scope: Scope) -> DataFrame:
    """The rows of a stored state (scope, page_key, counter, last_hit) that belong to the scope and are well formed;
    the 256 most used of them."""
    good = (F.col("scope") == scope.digest()) & F.col("page_key").startswith("pk_") & (F.col("counter") > 0) & (F.abs("counter") < float("inf")) & (F.abs("last_hit") < float("inf"))
    each = state.where(F.coalesce(good, F.lit(False)) & ~F.isnan("counter") & ~F.isnan("last_hit"))
    return usage.trimmed(each.withColumn("counter", F.round(F.least("counter", F.lit(usage.CAP)), 6)))


def recorded(state: DataFrame, hits: DataFrame, pages: DataFrame, scope: Scope, secret: str, now: float) -> DataFrame:
    """The state (scope, page_key, counter, last_hit, generation) after a request's hits (page_id, route): every
    counter decayed to now or to the state's own time if that is later, one more for each different visible page hit,
    capped and rounded, negligible ones dropped, the most used kept. Without such a hit the state stays as it was."""
    seen = hits.where(F.col("route").isin(*ROUTES)).join(pages.select("page_id"), "page_id", "left_semi").select("page_id").distinct()
    keys = seen.select(page_key(F.col("page_id"), scope, secret).alias("page_key"), F.lit(1).alias("hit"))
    old = sound(state, scope)
    if seen.isEmpty():
        return old
    last = old.agg(F.max("last_hit").alias("at"), F.coalesce(F.max("generation"), F.lit(0)).alias("was"))
    both = old.select("page_key", "counter", "last_hit").join(keys, "page_key", "full").crossJoin(F.broadcast(last))
    at = F.greatest(F.lit(float(now)), F.col("at"))
    left = F.coalesce(usage.decayed(F.col("counter"), at - F.col("last_hit")), F.lit(0.0))
    new = F.least(F.lit(usage.CAP), left + F.when(F.col("hit") == 1, usage.INCREMENT).otherwise(0.0))
    rows = both.select(F.lit(scope.digest()).alias("scope"), "page_key", F.round(new, 6).alias("counter"), at.alias("last_hit"), (F.col("was") + 1).alias("generation"))
    return usage.trimmed(rows.where(F.col("counter") > usage.FLOOR))


def matching(pages: DataFrame, edges: DataFrame, queries: DataFrame, evidence: DataFrame, least: float = MIN_EVIDENCE) -> DataFrame:
    """(query_id, page_id): results (query_id, page_id, score) that score enough and hold a telling token of their
    query, and the pages one link away from them."""
    tokens = F.filter(F.array_distinct(X.legacy_tokens(F.col("query"))), lambda t: ~t.isin(*STOPWORDS) & ~((F.length(t) == 1) & t.rlike(r"^\p{L}$")))
    asked = queries.select("query_id", tokens.alias("wanted"))
    heads = F.array_join("headings", " ") if "headings" in pages.columns else F.lit("")
    text = X.legacy_tokens(F.concat_ws(" ", index.literal_text(), heads))
    good = evidence.where(F.col("score") >= least).join(F.broadcast(asked), "query_id").join(pages, "page_id").where(F.arrays_overlap("wanted", text)).select("query_id", "page_id")
    moves = graph.steps(edges.where(F.col("source").startswith("page:") & F.col("target").startswith("page:")), "both")
    near = good.join(moves, graph.page_node(good["page_id"]) == moves["a"]).select("query_id", F.substring("b", 6, 1 << 30).alias("page_id"))
    return good.union(near.join(pages.select("page_id"), "page_id", "left_semi").select("query_id", "page_id")).distinct()


def orientation(pages: DataFrame, edges: DataFrame, boosts: DataFrame | None = None, queries: DataFrame | None = None, evidence: DataFrame | None = None, snippet: int = SNIPPET_CHARS) -> DataFrame:
    """(query_id, page_id, path, role, score, snippet, rank): the pages that lead, by structure and use; with queries
    two for each, among the pages that match it, none where none does. A blank query, and no queries, have the first
    three of all. boosts: (page_key as page id, boost)."""
    scored = usage.orientation_scores(pages, graph.degrees(edges), boosts).withColumnRenamed("score", "lead")
    placed = scored.join(pages.select("page_id", "role", "text"), "page_id")
    order = [F.desc("lead"), role_rank(F.col("role")), "path"]
    first = placed.orderBy(*order).limit(ORIENTATION)
    blank = queries.where(F.trim("query") == "").select("query_id") if queries is not None else None
    rows = first.withColumn("query_id", F.lit(None).cast("long")) if queries is None else blank.join(F.broadcast(first))
    rows = rows.withColumn("most", F.lit(ORIENTATION))
    if queries is not None:
        told = matching(pages, edges, queries.where(F.trim("query") != ""), evidence)
        rows = rows.unionByName(told.join(placed, "page_id").withColumn("most", F.lit(QUERY_ORIENTATION)))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= F.col("most"))
    shown = X.clipped(X.clean(F.col("text")), snippet)
    return ranked.select("query_id", "page_id", "path", "role", F.round(1.0 - (F.col("rank") - 1) * 0.01, 4).alias("score"), shown.alias("snippet"), "rank")

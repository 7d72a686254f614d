"""The property graph: projection of pages, visibility, traversal, paths, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators.cut import cut
from larkspur.sources.corpus import small

MAX_DEPTH, MAX_PATH, MAX_PATHS = 4, 8, 500
DIRECTIONS = ("out", "in", "both")
#: Values up to which a filter takes the place of a join.
FILTERED = 1000


def link_kind(link: Column) -> Column:
    """What an unresolved link names."""
    return F.when(link.rlike("^https?://"), "external_ref").when(link.rlike(r"^(?:#\d+|[A-Z][A-Z0-9]+-\d+|GH-\d+)$"), "external_issue").otherwise("placeholder")


def unresolved_id(link: Column) -> Column:
    return F.concat(F.when(link_kind(link).startswith("external"), F.lit("external:")).otherwise(F.lit("placeholder:")), X.slug(link))


def key(value: Column) -> Column:
    return X.lookup_key(F.regexp_replace(value, r"\.md$", ""))


def page_keys(pages: DataFrame) -> DataFrame:
    """(key, target): by id, title, path and file name; the last page wins a key."""
    names = F.array("page_id", "title", "path", F.element_at(F.split("path", "/"), -1))
    each = pages.select("page_ord", "page_id", F.explode(F.array_distinct(F.transform(names, key))).alias("key"))
    return each.groupBy("key").agg(F.max_by("page_id", "page_ord").alias("target"))


def page_node(page_id: Column) -> Column:
    return F.concat(F.lit("page:"), page_id)


def project(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind, path) and edges (source, target, relation), each once, the first occurrence in page order
    winning. pages may have headings; links is (page_id, link)."""
    own = pages.select("page_ord", page_node(F.col("page_id")).alias("source"), "page_id", "title", "role", "path", "tags", "source_refs", *(["headings"] if "headings" in pages.columns else []))
    linked = links.join(pages.select("page_id", "page_ord", "path"), "page_id").withColumn("key", key(F.col("link")))
    resolved = linked.join(page_keys(pages), "key", "left")
    target = F.coalesce(page_node(F.col("target")), unresolved_id(F.col("link")))
    parts: list[DataFrame] = []
    nodes = [own.select("page_ord", F.lit(0).alias("step"), F.col("source").alias("id"), F.col("title").alias("label"), F.col("role").alias("kind"), "path")]

    def attach(column: str, step: int, node: Column, label: Column, kind: str, relation: str) -> None:
        each = own.select("page_ord", "source", "page_id", "path", F.explode(column).alias("value"))
        nodes.append(each.select("page_ord", F.lit(step).alias("step"), node.alias("id"), label.alias("label"), F.lit(kind).alias("kind"), "path"))
        parts.append(each.select("source", node.alias("target"), F.lit(relation).alias("relation")))

    v = F.col("value")
    if "headings" in own.columns:
        attach("headings", 1, F.concat(F.lit("heading:"), X.slug(F.concat_ws(":", "page_id", v))), v, "heading", "contains")
    attach("source_refs", 2, F.concat(F.lit("source:"), X.slug(v)), v, "source_ref", "cites")
    bare = F.regexp_replace(v, "^#+|#+$", "")
    attach("tags", 3, F.concat(F.lit("tag:"), X.slug(F.lower(bare))), bare, "tag", "tagged")
    parts.append(resolved.select(page_node(F.col("page_id")).alias("source"), target.alias("target"), F.lit("links_to").alias("relation")))
    nodes.append(resolved.where("target is null").select("page_ord", F.lit(4).alias("step"), unresolved_id(F.col("link")).alias("id"), F.col("link").alias("label"), link_kind(F.col("link")).alias("kind"), "path"))
    every, edges = nodes[0], parts[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    for e in parts[1:]:
        edges = edges.unionByName(e)
    # pages come before what they name, then page order; a node's label breaks ties within a page
    first = F.min(F.struct(F.when(F.col("step") == 0, 0).otherwise(1).alias("late"), "page_ord", "step", "label", "kind", "path")).alias("f")
    return every.groupBy("id").agg(first).select("id", "f.label", "f.kind", "f.path"), edges.distinct()


def with_hierarchy(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """edges and child_of edges between pages whose file names nest by dots."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    named = pages.select("page_id", stem.alias("stem"))
    child = named.where(F.col("stem").contains(".")).select("page_id", F.regexp_replace("stem", r"\.[^.]*$", "").alias("parent"))
    found = child.join(named.select(F.col("page_id").alias("up"), F.col("stem").alias("parent")), "parent")
    return edges.union(found.select(page_node(F.col("page_id")), page_node(F.col("up")), F.lit("child_of"))).distinct()


def with_sidecar(edges: DataFrame, sidecar: DataFrame, pages: DataFrame) -> DataFrame:
    """edges and those of a sidecar file (source, target, type, confidence), both ends resolved like links."""
    keys = page_keys(pages)
    ends = sidecar.select("source", "target", X.relation(F.col("type")).alias("relation")).where("source != '' and target != ''")
    a = keys.select(F.col("key").alias("ka"), F.col("target").alias("pa"))
    b = keys.select(F.col("key").alias("kb"), F.col("target").alias("pb"))
    joined = ends.join(a, key(F.col("source")) == F.col("ka"), "left").join(b, key(F.col("target")) == F.col("kb"), "left")
    made = joined.select(F.coalesce(page_node(F.col("pa")), unresolved_id(F.col("source"))), F.coalesce(page_node(F.col("pb")), unresolved_id(F.col("target"))), "relation")
    return edges.union(made).distinct()


def sidecar_facts(sidecar: DataFrame, pages: DataFrame, file: str = "graph/graph.json") -> tuple[DataFrame, DataFrame]:
    """What a sidecar file adds with what it says of it: nodes (id, label, kind, path, metadata) of ends that are no page,
    with the path of the page at the other end, and edges (source, target, relation, metadata) with the file and the
    confidence, where it is a number. merged_metadata brings repeated edges together."""
    names = page_keys(pages).join(pages.select(F.col("page_id").alias("target"), "path"), "target")
    end = lambda n: names.select(F.col("key").alias(f"k{n}"), F.col("target").alias(f"p{n}"), F.col("path").alias(f"path{n}"))
    given = sidecar.where("source != '' and target != ''")
    joined = given.join(end("a"), key(F.col("source")) == F.col("ka"), "left").join(end("b"), key(F.col("target")) == F.col("kb"), "left")
    meta = lambda **kv: F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    number = F.when(F.col("confidence") == F.floor("confidence"), F.floor("confidence").cast("string")).otherwise(F.col("confidence").cast("string"))
    told = meta(source=F.lit("graph.json"), path=F.lit(file), confidence=number)
    edges = joined.select(F.coalesce(page_node(F.col("pa")), unresolved_id(F.col("source"))).alias("source"), F.coalesce(page_node(F.col("pb")), unresolved_id(F.col("target"))).alias("target"), X.relation(F.col("type")).alias("relation"), told.alias("metadata"))
    lost = lambda value, own, other: joined.where(F.col(own).isNull()).select(unresolved_id(F.col(value)).alias("id"), F.col(value).alias("label"), link_kind(F.col(value)).alias("kind"), F.coalesce(other, F.lit("")).alias("path"))
    both = lost("source", "pa", "pathb").union(lost("target", "pb", "patha"))
    nodes = both.groupBy("id").agg(F.min(F.struct("label", "kind", "path")).alias("n")).select("id", "n.*", meta(unresolved=F.lit("true"), source=F.lit("graph.json")).alias("metadata"))
    return nodes, edges


def merged_metadata(edges: DataFrame) -> DataFrame:
    """One row an edge (source, target, relation), its metadata map merged: differing values of a key are listed in the
    order of edge_ord. edges: (source, target, relation, edge_ord, metadata map<string,string>)."""
    each = edges.select("source", "target", "relation", "edge_ord", F.explode_outer("metadata").alias("k", "v"))
    values = each.where("k is not null and v is not null and v != ''").groupBy("source", "target", "relation", "k").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", "v"))), lambda x: x["v"])).alias("vs"))
    maps = values.groupBy("source", "target", "relation").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "vs")))).alias("metadata"))
    return edges.select("source", "target", "relation").distinct().join(maps, ["source", "target", "relation"], "left")


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")


def bounded(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id and the first edges among them."""
    first = nodes.orderBy("id").limit(limit)
    return first, closed(edges, first).orderBy("source", "target", "relation").limit(limit)


def approved(nodes: DataFrame, edges: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What approved pages show: their nodes, nodes on their paths, and other nodes next to them; edges among these."""
    good = pages.where("approved").select(page_node(F.col("page_id")).alias("id"), "path")
    page_ids = good.select("id")
    other = nodes.where(~F.col("id").startswith("page:"))
    on_path = other.join(good.select("path").distinct(), "path", "left_semi").select("id")
    out = edges.join(page_ids, edges["source"] == page_ids["id"], "left_semi").select(F.col("target").alias("id"))
    into = edges.join(page_ids, edges["target"] == page_ids["id"], "left_semi").select(F.col("source").alias("id"))
    near = out.union(into).where(~F.col("id").startswith("page:"))
    keep = page_ids.union(on_path).union(near).distinct()
    shown = nodes.join(keep, "id", "left_semi")
    return shown, closed(edges, shown)


def shown_metadata(nodes: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """nodes (id, path, metadata map<string,string>) as approved pages show them: a node that is no page has the path of
    the first approved page next to it, by the order of edges, and metadata that name a path which is not approved are
    taken out. Which entry holds which path is a search of one string in another, so the entries of nodes that are no
    pages, a small part of a graph, meet every path that is not approved."""
    good = pages.where("approved").select(page_node(F.col("page_id")).alias("p"), F.col("path").alias("near"))
    order = F.struct(*_order(edges))
    out = edges.join(good, edges["source"] == good["p"]).where(~F.col("target").startswith("page:")).select(F.col("target").alias("id"), F.struct(order.alias("o"), F.lit(0).alias("s")).alias("o"), "near")
    into = edges.join(good, edges["target"] == good["p"]).where(~F.col("source").startswith("page:")).select(F.col("source").alias("id"), F.struct(order.alias("o"), F.lit(1).alias("s")).alias("o"), "near")
    first = out.union(into).groupBy("id").agg(F.min_by("near", "o").alias("near"))
    hidden = pages.where("not approved and path != ''").select(F.col("path").alias("hidden")).distinct()
    entries = nodes.select("id", F.explode("metadata").alias("k", "v")).where(~F.col("id").startswith("page:"))
    named = entries.join(hidden, F.col("v").contains(F.col("hidden")), "left_semi").groupBy("id").agg(F.collect_set("k").alias("bad"))
    j = nodes.join(first, "id", "left").join(named, "id", "left")
    page = F.col("id").startswith("page:")
    return j.withColumn("path", F.when(page, F.col("path")).otherwise(F.coalesce("near", "path"))).withColumn("metadata", F.map_filter("metadata", lambda k, v: page | ~F.coalesce(F.array_contains("bad", k), F.lit(False)))).select(*nodes.columns)


def listed(values: DataFrame) -> list | None:
    """The different values of the one column, or None for more than a filter takes."""
    found = [r[0] for r in values.distinct().limit(FILTERED + 1).collect()]
    return found if len(found) <= FILTERED else None


def resolved_seeds(nodes: DataFrame, seeds: DataFrame, most: int = 10) -> DataFrame:
    """(seed, id): by id, by page id, by page slug, else up to ten nodes whose id, label or path has the same key."""
    s = seeds.select("seed", F.array(F.col("seed"), page_node(F.col("seed")), page_node(X.slug(F.col("seed")))).alias("ids"), key(F.col("seed")).alias("k"))
    named = s.select("seed", F.posexplode("ids").alias("p", "id"))
    few = listed(named.select("id"))
    # few names become a filter, which reaches the files that nodes are read from; more are a join
    there = nodes.select("id") if few is None else nodes.select("id").where(F.col("id").isin(few))
    direct = named.join(cut(there, "named") if few is not None else there, "id", "left_semi")
    best = direct.groupBy("seed").agg(F.min_by("id", "p").alias("id"))
    loose = s.join(best, "seed", "left_anti").where("k != ''")
    keys = listed(loose.select("k"))
    if keys == []:
        return best
    held = nodes if keys is None else nodes.where(key(F.col("id")).isin(keys) | key(F.col("label")).isin(keys) | key(F.col("path")).isin(keys))
    n = held.select("id", key(F.col("id")).alias("k1"), key(F.col("label")).alias("k2"), key(F.col("path")).alias("k3"))
    keyed = n.select("id", F.explode(F.array_distinct(F.array("k1", "k2", "k3"))).alias("k"))
    fuzzy = loose.join(keyed, "k").select("seed", "id").distinct().withColumn("r", F.row_number().over(W.partitionBy("seed").orderBy("id"))).where(F.col("r") <= most)
    return best.unionByName(fuzzy.select("seed", "id"))


def steps(edges: DataFrame, direction: str, relations: list[str] | None = None) -> DataFrame:
    """(a, b): the moves an edge allows."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    used = edges if not relations else edges.where(F.col("relation").isin(relations))
    out = used.select(F.col("source").alias("a"), F.col("target").alias("b"))
    into = used.select(F.col("target").alias("a"), F.col("source").alias("b"))
    return out if direction == "out" else into if direction == "in" else out.union(into)


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", relations: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, depth) of the nodes within depth moves of the seeds (id), level by level: each frontier joins the edges and
    leaves out what has been seen."""
    depth = max(0, min(depth, MAX_DEPTH))
    # read at every level, so written once
    moves = cut(steps(edges, direction, relations), "moves")
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen.select("id")
    for level in range(1, depth + 1):
        reached = moves.join(frontier, moves["a"] == frontier["id"], "left_semi").select(F.col("b").alias("id")).distinct()
        new = cut(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        seen, frontier = seen.union(new), new.select("id")
    return seen if limit is None else seen.orderBy("depth", "id").limit(limit)


def require_nodes(nodes: DataFrame, *ids: str) -> None:
    """An error if a node is not known."""
    known = {r["id"] for r in nodes.where(F.col("id").isin(*ids)).select("id").collect()}
    if lost := [i for i in ids if i not in known]:
        raise ValueError(f"unknown node {lost[0]!r}")


def _order(edges: DataFrame) -> list[str]:
    """Edges stand in the order of edge_ord if they have it, else of their own values."""
    return ["edge_ord"] if "edge_ord" in edges.columns else ["source", "target", "relation"]


def _ordered_steps(edges: DataFrame, direction: str, relations: list[str] | None, outgoing_first: bool = False) -> DataFrame:
    """(a, b, key, source, target, relation): moves with the place of their edge, an edge's own direction first; with
    outgoing_first all of a node's outgoing edges before any of its incoming ones."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    used = edges if not relations else edges.where(F.col("relation").isin(relations))
    order = _order(edges)
    side = lambda a, b, n: used.select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct(*([F.lit(n).alias("side"), *order] if outgoing_first else [*order, F.lit(n).alias("side")])).alias("key"), "source", "target", "relation")
    out, into = side("source", "target", 0), side("target", "source", 1)
    return out if direction == "out" else into if direction == "in" else out.union(into)


def neighbors(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, direction: str = "both", relations: list[str] | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Breadth first from a node, in the order in which a queue would meet nodes: by the place of the node they are met
    from, then by the place of the edge. Nodes (id, depth, place), limit at most, and the edges looked at on the way
    that have both ends among them, (place, source, target, relation), in the order they were looked at."""
    require_nodes(nodes, start)
    seen = edges.sparkSession.createDataFrame([(start, 0, 0)], "id string, depth int, place int")
    return _walk(nodes, _ordered_steps(edges, direction, relations), seen, depth, max(1, min(limit, MAX_PATHS)))


def around(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 1, direction: str = "both", relations: list[str] | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The neighbourhood of several seeds, named like resolved_seeds takes them, in their order: a walk as neighbors has
    it, but all of a node's outgoing edges come before its incoming ones; limit nodes and limit edges at most. Seeds that
    name no node count for nothing."""
    spark, limit = edges.sparkSession, max(1, min(limit, MAX_PATHS))
    named = spark.createDataFrame(list(enumerate(seeds)), "at int, seed string")
    found = resolved_seeds(nodes, named.select("seed").distinct()).join(named, "seed").groupBy("id").agg(F.min(F.struct("at", "id")).alias("o"))
    # a few ids a seed
    seen = cut(found.orderBy("o").limit(limit).withColumn("place", F.row_number().over(W.orderBy("o")) - 1).select("id", F.lit(0).alias("depth"), "place"), "seeds")
    shown, looked = _walk(nodes, _ordered_steps(edges, direction, relations, outgoing_first=True), seen, depth, limit)
    return shown, looked.where(F.col("place") <= limit)


def _walk(nodes: DataFrame, ordered: DataFrame, seen: DataFrame, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """From the nodes seen (id, depth, place) along ordered moves, level by level."""
    spark, depth = nodes.sparkSession, max(0, min(depth, MAX_DEPTH))
    looked, count, frontier = None, seen.count(), seen
    for level in range(1, depth + 1 if 0 < count < limit else 1):
        # the frontier has limit rows at most: a filter, which reaches the files that edges are read from
        at = [r["id"] for r in frontier.select("id").collect()]
        met = ordered.where(F.col("a").isin(at)).join(F.broadcast(frontier.select(F.col("id").alias("a"), "place")), "a").select("b", F.struct("place", "key").alias("at"), "source", "target", "relation")
        met = cut(met, "met")
        # which of their ends are nodes: the ends go to the nodes where they are few
        ends = small(cut(met.select("b").distinct(), "ends"))
        known = cut(nodes.select(F.col("id").alias("b")).join(ends, "b", "left_semi"), "known")
        met = met.join(known, "b", "left_semi")
        first = met.join(F.broadcast(seen.select(F.col("id").alias("b"))), "b", "left_anti").groupBy("b").agg(F.min("at").alias("at"))
        new = first.orderBy("at").limit(limit - count).withColumn("place", F.row_number().over(W.orderBy("at")) + (count - 1))  # limit rows
        new = cut(new, "frontier")
        n = new.count()
        # the walk stops at the move that fills the limit
        stop = new.agg(F.max("at").alias("stop")) if count + n >= limit else None
        part = met if stop is None else met.join(F.broadcast(stop)).where("at <= stop").drop("stop")
        part = part.select(F.struct(F.lit(level).alias("level"), "at").alias("at"), "source", "target", "relation")
        looked = part if looked is None else looked.union(part)
        frontier = new.select(F.col("b").alias("id"), F.lit(level).alias("depth"), "place")
        seen = cut(seen.union(frontier), "seen")
        count += n
        if not n or count >= limit:
            break
    if looked is None:
        return seen, spark.createDataFrame([], "place int, source string, target string, relation string")
    once = looked.groupBy("source", "target", "relation").agg(F.min("at").alias("at"))
    ids = seen.select("id")
    shut = once.join(F.broadcast(ids), once["source"] == ids["id"], "left_semi").join(F.broadcast(ids), once["target"] == ids["id"], "left_semi")
    return seen, shut.withColumn("place", F.row_number().over(W.orderBy("at"))).select("place", "source", "target", "relation")  # edges among limit nodes


def paths(edges: DataFrame, start: str, target: str, max_depth: int, limit: int = MAX_PATHS, direction: str = "out", relations: list[str] | None = None, nodes: DataFrame | None = None, detail: bool = False) -> DataFrame:
    """(path, length), in detail with the relations passed as a third column: simple paths from start to target, shortest first, then by the places of their edges,
    as a queue would meet them; parallel edges are different paths, and the target is never passed. Only prefixes that
    can still reach the target in the moves left are extended: distances to it are found first, from its side. nodes,
    if given, must hold both ends, and are the only ones passed."""
    max_depth, limit = max(0, min(max_depth, MAX_PATH)), max(1, min(limit, MAX_PATHS))
    spark = edges.sparkSession
    if nodes is not None:
        require_nodes(nodes, start, target)
    shown = ["path", "length", "relations"] if detail else ["path", "length"]
    schema = "path array<string>, length int, relations array<string>"
    if start == target:
        return spark.createDataFrame([([start], 0, [])], schema).select(*shown)
    moves = _ordered_steps(edges, direction, relations)
    if nodes is not None:
        moves = moves.join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    moves = cut(moves.select("a", "b", "key", "relation").distinct(), "moves")
    # breadth first from the target against the moves
    near = cut(spark.createDataFrame([(target, 0)], "id string, left int"))
    frontier = near
    for level in range(1, max_depth):
        back = moves.join(frontier, moves["b"] == frontier["id"], "left_semi").select(F.col("a").alias("id")).distinct()
        frontier = cut(back.join(near, "id", "left_anti").withColumn("left", F.lit(level)))
        near = near.union(frontier)
    none = f"array<{moves.schema['key'].dataType.simpleString()}>"
    open_ = spark.createDataFrame([([start], start)], "path array<string>, at string").select("path", F.array().cast("array<string>").alias("relations"), F.array().cast(none).alias("keys"), "at")
    done = None
    for level in range(1, max_depth + 1):
        grown = open_.join(moves, F.col("at") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        grown = grown.join(near, F.col("b") == F.col("id")).where(F.col("left") <= max_depth - level)
        grown = cut(grown.select(F.array_append("path", F.col("b")).alias("path"), F.array_append("relations", F.col("relation")).alias("relations"), F.array_append("keys", F.col("key")).alias("keys"), F.col("b").alias("at")))
        hit = grown.where(F.col("at") == target).select("path", "relations", "keys", F.lit(level).alias("length"))
        done = hit if done is None else done.union(hit)
        open_ = grown.where(F.col("at") != target)
    if done is None:
        return spark.createDataFrame([], schema).select(*shown)
    return done.orderBy("length", "keys").limit(limit).select(*shown)


def by_marker(nodes: DataFrame, edges: DataFrame, kind: str, value: str, limit: int | None = None) -> DataFrame:
    """(id) of the pages that cite a source or carry a tag, found by node id, bare id or label; all of them, or the
    first by id."""
    prefix, relation = {"source_ref": ("source:", "cites"), "tag": ("tag:", "tagged")}[kind]
    marks = nodes.where((F.col("kind") == kind) & ((F.col("id") == value) | (F.col("id") == prefix + value) | (F.col("label") == value))).select(F.col("id").alias("target"))
    found = edges.where(F.col("relation") == relation).join(marks, "target", "left_semi").select(F.col("source").alias("id")).distinct().orderBy("id")
    return found if limit is None else found.limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, inbound, outbound) of page nodes."""
    into = edges.where(F.col("target").startswith("page:")).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("inbound"))
    out = edges.where(F.col("source").startswith("page:")).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("outbound"))
    return into.join(out, "id", "full").select("id", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def adjacent_pages(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(id) of the page nodes one move away from pages (page_id)."""
    own = pages.select(page_node(F.col("page_id")).alias("id"))
    both = steps(edges, "both")
    return both.join(own, both["a"] == own["id"], "left_semi").select(F.col("b").alias("id")).where(F.col("id").startswith("page:")).distinct()

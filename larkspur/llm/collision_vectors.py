"""Near-duplicate vectors by collision-counting projections.

Unit vectors of one label are projected on ``DIRECTIONS`` fixed random directions. Along each direction the values
are sorted and every vector opens a window centred on its own value; a pair's count is the number of directions in
whose window it meets. The window's half-width is the ``INSIDE`` quantile of the difference of a pair exactly at the
threshold, so its count is binomial, and the pairs whose count reaches the ``MISSED`` quantile of that law are
verified by cosine in double precision: a pair at the threshold is lost with probability ``MISSED``, a closer one
with less.

Within a tile the projections are whole numbers of a fine grid, a window's ends rounded outwards, so that a block of
pairs is counted by a few operations on short integers a direction.

Exact copies are one class before anything else. Classes of a label are dealt into tiles of at most ``TILE`` by
``TILE`` vectors by a hash, after a cut into cells along one direction, wide enough that only neighbouring cells can
hold links; each tile returns sums per vector and a spanning forest, never its pairs. A label with any share of the
rows is thus spread over many tasks of bounded size. The work grows with the square of a cell's size: in 64 dimensions
a projection tells so little that cells keep most of a label together (see README for figures).

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and vectors with a null
label, link with nothing; vectors of different lengths do not link; copies link with each other; rows with a null
vec_id count as copies, are linked like others and get the component's least vec_id, null if it has none; repeated rows
are copies, rows of one vec_id with different vectors or labels are linked each by its own; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import components, hash_pair, join_hot, stash, table

THRESHOLD = 0.93
DIRECTIONS = 64
INSIDE = 0.9
MISSED = 1e-6
TILE = 2048
#: Steps of the grid in a window's half-width, and rows that are counted at a time.
GRID, ROWS = 512, 256


def directions(dim: int, m: int = DIRECTIONS) -> np.ndarray:
    """Fixed unit directions, one a column."""
    a = np.random.default_rng(20_240_229 + dim).standard_normal((dim, m))
    return a / np.linalg.norm(a, axis=0)


def calibration(dim: int, threshold: float = THRESHOLD, m: int = DIRECTIONS) -> tuple[float, int]:
    """The windows' half-width and the least count."""
    far = math.sqrt(2 - 2 * threshold)
    width = NormalDist().inv_cdf((1 + INSIDE) / 2) * far / math.sqrt(dim)
    tail = 0.0
    for k in range(m + 1):
        tail += math.comb(m, k) * INSIDE**k * (1 - INSIDE) ** (m - k)
        if tail > MISSED:
            return width, k
    return width, m


def _links(left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked pairs between two blocks of unit vectors; within one block each pair once."""
    dim = left.shape[1]
    width, least = calibration(dim, threshold)
    along = directions(dim)
    # both roundings move a value by half a step at most, so windows are a step wider; values wrap round at 2^16
    step = width / GRID
    p, q = (np.rint((x @ along).T / step).astype(np.int64).astype(np.uint16) for x in (left, right))
    counts = np.zeros((len(left), len(right)), dtype=np.uint8)
    gap, meet = np.empty((ROWS, len(right)), dtype=np.uint16), np.empty((ROWS, len(right)), dtype=bool)
    for start in range(0, len(left), ROWS):
        block = counts[start : start + ROWS]
        g, m = gap[: len(block)], meet[: len(block)]
        for k in range(len(p)):
            # q - (p - w), taken modulo 2^16, is at most 2 w inside the window alone
            np.subtract(q[k], (p[k, start : start + ROWS] - np.uint16(GRID + 1))[:, None], out=g)
            np.less_equal(g, np.uint16(2 * GRID + 2), out=m)
            block += m.view(np.uint8)
    a, b = np.nonzero(counts >= least)
    if same:
        a, b = a[a < b], b[a < b]
    if len(a):
        # unit vectors in double precision; the norms were divided out in double precision too
        ok = np.concatenate([np.einsum("ij,ij->i", left[a[s : s + 65536]], right[b[s : s + 65536]]) for s in range(0, len(a), 65536)]) >= threshold
        a, b = a[ok], b[ok]
    return a, b


def _tile(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        raw = np.vstack(rows["embedding"].to_numpy()).astype(np.float64)
        unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
        ids, copies, side = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
        same = bool((side == 2).all())
        li, ri = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        out_n = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))
        if len(li) and len(ri):
            a, b = _links(unit[li], unit[ri], same, threshold)
            a, b = li[a], ri[b]
            np.add.at(out_n, a, copies[b])
            np.add.at(out_n, b, copies[a])
            while len(a):
                # hook every linked pair's larger root to the smaller one until all agree
                ra, rb = root[a], root[b]
                lower = np.minimum(ra, rb)
                np.minimum.at(root, ra, lower)
                np.minimum.at(root, rb, lower)
                root = root[root]
                open_ = root[a] != root[b]
                a, b = a[open_], b[open_]
            while not np.array_equal(root, root[root]):
                root = root[root]
        some = out_n > 0
        return pd.DataFrame({"id": ids[some], "n": out_n[some], "to": ids[root[some]]})

    return run


def _sound(df: DataFrame) -> DataFrame:
    e = F.col("embedding")
    good = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return df.where(F.col("label").isNotNull() & e.isNotNull()).where(good)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    given = vectors.select("vec_id", "embedding", "label", hash_pair("label", "embedding").alias("key"))
    found = _sound(given).groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stash(found.withColumn("id", F.monotonically_increasing_id()), "classes")

    first = F.pandas_udf(_first_cell(math.sqrt(2 - 2 * threshold)), "int")
    dealt = classes.withColumn("dim", F.size("embedding")).withColumn("cell", first("embedding"))
    sizes = stash(dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks")), "cells")
    # a row a label, length and cell; the next cell's number of chunks comes along
    ahead = sizes.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("chunks").alias("next_chunks"))
    behind = sizes.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("chunks").alias("last_chunks"))
    plan = sizes.join(ahead, ["label", "dim", "cell"], "left").join(behind, ["label", "dim", "cell"], "left")
    at = dealt.join(plan, ["label", "dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    def spot(lc, left, rc, right, side):
        return F.struct(lc.alias("lc"), left.cast("int").alias("l"), rc.alias("rc"), right.cast("int").alias("r"), side.cast("int").alias("side"))

    c, ch = F.col("cell"), F.col("chunk")
    own = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: spot(c, F.least(ch, o), c, F.greatest(ch, o), F.when(o == ch, 2).when(ch < o, 0).otherwise(1)))
    none = F.array().cast("array<int>")
    up = F.transform(F.when(F.col("next_chunks").isNotNull(), F.sequence(F.lit(0), F.col("next_chunks") - 1)).otherwise(none), lambda o: spot(c, ch, c + 1, o, F.lit(0)))
    down = F.transform(F.when(F.col("last_chunks").isNotNull(), F.sequence(F.lit(0), F.col("last_chunks") - 1)).otherwise(none), lambda o: spot(c - 1, o, c, ch, F.lit(1)))
    tiles = at.select("label", "dim", "id", "copies", "embedding", F.explode(F.concat(own, up, down)).alias("t")).select("label", "dim", "id", "copies", "embedding", "t.*")
    found = stash(tiles.groupBy("label", "dim", "lc", "l", "rc", "r").applyInPandas(_tile(threshold), "id long, n long, to long"), "links")

    joined = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "id")
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    light = classes.select("key", "id", "rep", "copies").join(sums, "id", "left").join(joined, "id", "left")
    light = stash(light.select("key", "rep", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "id").alias("root")), "linked")
    least = join_hot(light, light.groupBy("root").agg(F.min("rep").alias("least")), "root").select("key", "copies", "links", "least")
    reps = stash(least, "reps")
    # a class of several rows may be a third of all; the others have one row each
    many = reps.where("copies > 1").select("key", F.col("links").alias("many_links"), F.col("least").alias("many_least"), F.lit(True).alias("many"))
    single = reps.where("copies = 1").select("key", "links", "least")
    done = join_hot(given.select("vec_id", "key"), many, "key", salts=16).join(single, "key", "left")
    linked = F.coalesce("many_links", "links", F.lit(0)).cast("long")
    root = F.when(F.coalesce("many", F.lit(False)), F.col("many_least")).otherwise(F.coalesce("least", "vec_id")).cast("long")
    return done.select("vec_id", linked.alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(False)).alias("kept"))


def _first_cell(width: float):
    def cell(batch: pd.Series) -> pd.Series:
        out = np.zeros(len(batch), dtype=np.int32)
        sizes = batch.map(len).to_numpy() if len(batch) else np.zeros(0, int)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            raw = np.vstack(batch.iloc[at].to_numpy()).astype(np.float64)
            line = raw @ directions(int(dim))[:, 0] / np.sqrt(np.einsum("ij,ij->i", raw, raw))
            out[at] = np.floor(line / (width * (1 + 1e-9)))
        return pd.Series(out)

    cell.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return cell


def op7_collision_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as (select vec_id, label, embedding::double[] e from embeddings),
s as (select * from v where label is not null and e is not null and len(e) > 0
      and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id a, b.vec_id b from s a join s b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {THRESHOLD}),
reach(a, b) as (select a, b from p union select reach.a, p.b from reach join p on reach.b = p.a),
k as (select a, min(b) m from reach group by 1),
n as (select a, count(*) n from p group by 1)
select v.vec_id, coalesce(n, 0)::bigint n_links, least(v.vec_id, coalesce(m, v.vec_id)) component_id, v.vec_id <= coalesce(m, v.vec_id) kept
from v left join n on n.a = v.vec_id left join k on k.a = v.vec_id"""

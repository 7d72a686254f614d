"""Vector codes: every vector as the numbers of its parts' nearest codebook entries, found by a ball tree.

Components become whole numbers floor(scale * x), vectors are cut into ``PARTS`` equal parts, and each part position has
a codebook of ``ENTRIES`` entries: at first that part of the vectors with the smallest ids, then, for ``ROUNDS`` rounds,
the componentwise floor of the mean of the parts that an entry is nearest to. Codebooks are at most ENTRIES vectors
together, so they are broadcast; a round is one pass that sends each task's sums an entry.

The nearest entry is sought in a binary ball tree of the position's entries. A ball's radius is rounded up and a part's
distance to its centre down, both to whole numbers, so that their difference never exceeds the distance to any entry
inside; a ball is visited unless the square of that difference is greater than the best squared distance so far (equal
ones are visited, as they may hold the same distance under a lower number), and inside leaves squared distances are
compared as whole numbers, with the entry's number as the last digits. The result is that of a full search, ties included.

Defined results: vectors that are null, or hold null or non-finite components, are left out, as are empty ones, those
whose length PARTS does not divide, and those with a component so large (beyond 46,000 in 64 dimensions)
that a squared distance with an entry's number behind it might not fit a long. Vectors of another length are compressed with codebooks of their own. Of
rows with one vec_id the least vector (by its components in order) starts a codebook, all are coded; a null vec_id starts
none and is coded; with no id at all, codebooks are empty, and codes too: such rows have null code and errors. Fewer ids
than ENTRIES give fewer entries. Null labels are one label; a label's error that exceeds a long is null. Other columns
play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import join_hot, stash, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries in a leaf of the tree.
LEAF = 8


def scaled(e: Column, scale: int = SCALE) -> Column:
    return F.transform(e, lambda x: F.floor(x.cast("double") * scale))


def _sound(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, dim, embedding) of the vectors that can be coded."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = e.isNotNull() & (F.size(e) > 0) & (F.size(e) % parts == 0)
    small = F.forall(e, lambda x: F.abs(x.cast("double") * scale) < F.sqrt(F.lit(2.0**55) / (4 * F.size(e))) - 1)
    return vectors.select("vec_id", "label", F.size(e).alias("dim"), "embedding").where(good).where(finite).where(small)


# -- ball tree


class Ball:
    """A ball of entries: a whole centre, a radius rounded up, and two balls inside or the entries of a leaf."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray) -> None:
        own = entries[numbers]
        self.centre = own.sum(axis=0) // len(own)
        self.radius = int(_root_up(_squares(own, self.centre).max()))
        self.numbers, self.own, self.inside = numbers, own, ()
        if len(numbers) > LEAF:
            # along the line between the entry farthest from the centre and the entry farthest from that one
            a = own[_squares(own, self.centre).argmax()]
            b = own[_squares(own, a).argmax()]
            order = np.argsort(own @ (b - a), kind="stable")
            half = len(order) // 2
            self.inside = (Ball(entries, numbers[order[:half]]), Ball(entries, numbers[order[half:]]))


def _squares(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    gap = points - other
    return np.einsum("ij,ij->i", gap, gap)


def _root_down(squares: np.ndarray) -> np.ndarray:
    """A whole number that is at most the square root, whatever the double's rounding."""
    root = np.sqrt(np.asarray(squares, dtype=np.float64)).astype(np.int64)
    return np.maximum(root - (root * root > squares), 0)


def _root_up(square: int) -> int:
    root = math.isqrt(int(square))
    return root + (root * root < int(square))


def nearest(tree: Ball, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each point's nearest entry; of equal distances the lowest number."""
    best = np.full(len(points), np.iinfo(np.int64).max)  # squared distance * ENTRIES + number, as one whole number
    shift = max(int(tree.numbers.max()).bit_length(), 1)

    def visit(ball: Ball, at: np.ndarray, least: np.ndarray) -> None:
        near = least * least <= best[at] >> shift  # not strict: an equal distance may have a lower number
        at = at[near]
        if not len(at):
            return
        if not ball.inside:
            own = points[at]
            for number, entry in zip(ball.numbers, ball.own):
                best[at] = np.minimum(best[at], _squares(own, entry) << shift | number)
            return
        gaps = [_root_down(_squares(points[at], b.centre)) for b in ball.inside]
        lows = [np.maximum(g - b.radius, 0) for g, b in zip(gaps, ball.inside)]
        first = gaps[0] <= gaps[1]
        for side, order in ((first, (0, 1)), (~first, (1, 0))):
            for k in order:
                visit(ball.inside[k], at[side], lows[k][side])

    visit(tree, np.arange(len(points)), np.zeros(len(points), dtype=np.int64))
    return best & ((1 << shift) - 1), best >> shift


# -- passes over the vectors


def _blocks(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dim)


def _assigned(books: np.ndarray, scale: int):
    """books: part, entry, position. For each batch its whole vectors by part, and the numbers and squared distances."""
    parts, _, width = books.shape
    trees: list[Ball] = []

    def run(batch: pa.RecordBatch):
        if not trees:
            trees.extend(Ball(b, np.arange(len(b))) for b in books)
        cut = _blocks(batch, parts * width, scale).reshape(-1, parts, width)
        found = [nearest(t, cut[:, p]) for p, t in enumerate(trees)]
        return cut, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    return run


def _sums(books: np.ndarray, scale: int) -> Callable:
    """One row for each part and entry that a task's vectors use: their count and the sums of their components."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigned(books, scale)
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cut, numbers, _ = assign(batch)
            for p in range(parts):
                count[p] += np.bincount(numbers[:, p], minlength=entries)
                np.add.at(total[p], numbers[:, p], cut[:, p])
        p, k = np.nonzero(count)
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(count[p, k]), pa.array(list(total[p, k]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return run


def _coded(books: np.ndarray, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigned(books, scale)
        for batch in batches:
            if batch.num_rows:
                _, numbers, squares = assign(batch)
                hexed = numbers.astype(np.uint8).tobytes().hex()
                step = 2 * numbers.shape[1]
                codes = [hexed[i : i + step] for i in range(0, len(hexed), step)]
                yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(squares.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def _first_books(sound: DataFrame, scale: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids."""
    # only ids are shuffled for this, then the few vectors that have one of them
    ids = [r["vec_id"] for r in sound.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    least = sound.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id")
    rows = least.select(scaled(F.col("embedding"), scale).alias("e")).collect() if ids else []
    if not rows:
        return np.zeros((parts, 0, 1), dtype=np.int64)
    return np.array([r["e"] for r in rows], dtype=np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def train(sound: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, position) of sound vectors of one length."""
    books = _first_books(sound, scale, parts, entries)
    for _ in range(rounds if books.size else 0):
        sums = sound.select("embedding").mapInArrow(_sums(books, scale), "part int, entry int, n long, total array<long>")
        each = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
        # as many rows as the codebooks have components
        exact = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = books.copy()
        for r in exact.collect():
            books[r["part"], r["entry"], r["at"]] = int(r["x"]) // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    """Of all entries' whole components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every vector (vec_id, embedding, label) that can be coded."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part, so a codebook holds 256 entries at most")
    sound = _sound(vectors, scale, parts)
    kind = vectors.schema
    out = f"vec_id {kind['vec_id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, code string, error long"
    lengths = [r["dim"] for r in sound.select("dim").distinct().orderBy("dim").collect()]
    done = []
    for dim in lengths:
        own = sound.where(F.col("dim") == dim)
        books = train(own, scale, parts, entries, rounds)
        if books.size:
            coded = own.select("vec_id", "label", "embedding").mapInArrow(_coded(books, scale), out)
        else:
            coded = own.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        done.append(coded.withColumn("codebooks_sha256", F.lit(digest(books))))
    if not done:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    coded = stash(reduce(DataFrame.union, done), "codes").withColumn("__label", F.struct("label"))
    by_label = coded.groupBy("__label").agg(F.try_sum("error").alias("label_error"))
    return join_hot(coded, by_label, "__label").select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The whole vector that a code stands for."""
    return np.concatenate([books[p, k] for p, k in enumerate(bytes.fromhex(code))])


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round_sql(k: int) -> str:
    """The assignment to books{k}, and the books after it."""
    return f"""
near{k} as materialized (
  select rid, part, entry, d from (
    select v.rid, v.part, b.entry, d, row_number() over (partition by v.rid, v.part order by d, b.entry) r
    from v join books{k} b on v.part = b.part, lateral (select list_sum(list_transform(list_zip(v.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d)) where r = 1),
sums{k} as (select n.part, n.entry, u.pos, sum(v.w[u.pos])::hugeint s, count(*) c from near{k} n join v using (rid, part), (select unnest(range(1, {64 // PARTS} + 1)) pos) u group by all),
books{k + 1} as materialized (
  select b.part, b.entry, coalesce(m.w, b.w) w from books{k} b left join (
    select part, entry, list(((s - ((s % c) + c) % c) // c)::bigint order by pos) w from sums{k} group by all) m using (part, entry)),"""


#: For vectors of 64 components, as all in the given tables are.
ORACLE = f"""
with kept as (select row_number() over () rid, vec_id, label, embedding::double[] e from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as materialized (select rid, vec_id, p part, list_transform(e[p * {64 // PARTS} + 1 : (p + 1) * {64 // PARTS}], lambda x: floor({SCALE} * x)::bigint) w from kept, (select unnest(range({PARTS})) p)),
first as (select vec_id, rid, row_number() over (order by vec_id) - 1 entry from (select vec_id, arg_min(rid, e) rid from kept where vec_id is not null group by 1) qualify entry < {ENTRIES}),
books0 as materialized (select v.part, first.entry, v.w from v join first using (rid)),
{_round_sql(0)}{_round_sql(1)}{_round_sql(ROUNDS)}
coded as (select rid, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from near{ROUNDS} group by 1),
digest as (select sha256(string_agg(array_to_string(w, ','), ',' order by part, entry)) s from books{ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, s codebooks_sha256
from kept join coded using (rid), digest"""

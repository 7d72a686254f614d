"""Exact n-gram Jaccard join over whole texts, down to components.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents of equal sets are one class
(size and a 128-bit hash of the set); the rest runs on one representative of each class.

1. Stars: a few keys of a set's minima put likely copies under common keys; every class is paired with the least class
   under each of its keys only, so a group of any size costs as many pairs as members. Sets of up to SMALL shingles
   have keys of three permuted minima each, sets above LARGE keys of four one-permutation minima each; sizes between
   have both, so that linkable sets always share a family of keys. Pairs are verified exactly and joined into parts.
2. Tiles, which make the result complete: two sets of Jaccard >= 0.8 share an element of both prefixes, the first
   n - ceil(0.8 n) + 1 elements in one global order. Classes meet per prefix element, sorted by size; within a size
   band (sizes 4:5 apart at most) and across parts, pairs are bounded from above by the bit counts of their hashed
   bitmap signatures: a parity bitmap differs in no more bits than the sets differ in elements. Elements that only one
   part holds, nearly all, end there.
3. A group of near copies would pass that bound in all its pairs. So the tiles run in rounds: the first two return of
   each tile only a spanning forest of its surviving pairs, which is verified exactly and merges parts; the last one
   returns, of the tiles where a pair was left out, every surviving pair that still joins two parts. The first round
   takes the tiles on the diagonal of large groups alone, whose work is linear; the others take all.

The global order puts elements that are frequent among a sample of documents last, so that passages shared by many
documents rarely are in a prefix. The sample (``ORDER_SAMPLE`` documents, its ``ORDER_KEEP`` most frequent elements)
decides the order alone: any order gives the same result. A group larger than ``TILE`` is dealt into tiles of TILE by
TILE; no task ever holds a whole group.

Defined results: null and blank texts have no shingles and link with nothing; a text of one to four words has its
whole sequence as its one shingle; ties and repeated rows are one class. Rows are told apart by doc_id and text: rows of
one doc_id with different texts are linked by their own texts; a null doc_id is never a component's id, and a component
without any other has none. Extra columns are ignored by ``link`` and passed on by ``first_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import components, hash_pair, join_hot, sieve, sifted, stash, table, unstash

N = 5
#: Bits of a signature: the power of two at or above the set's size, within these bounds.
BITS = (128, 65_536)
#: How many times wider the signatures of the later rounds are.
WIDER = 4
BINS, KEY_BINS = 32, 4
#: Keys of small sets: so many, of so many permuted minima each.
SMALL_KEYS, KEY_MINIMA = 8, 3
LARGE, SMALL = 100, 160
TILE = 2048
ORDER_SAMPLE = 20_000
ORDER_KEEP = 500_000
FREQUENT = 10

_rng = np.random.default_rng(7_340_033)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(0, 2**64, N + 1, dtype=np.uint64) | np.uint64(1)
_TURN = _rng.integers(0, 2**64, SMALL_KEYS * KEY_MINIMA, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    with np.errstate(over="ignore"):
        while len(_powers) < n:
            _powers = np.concatenate([_powers, _powers * (_powers[-1] * _BASE)])
    return _powers[:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order; A to Z count as a to z."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    # polynomial over the bytes of each word, from the word's own end: place counts from there
    span = np.repeat(ends, ends - starts)
    inside = np.flatnonzero(~gap)
    most = int((ends - starts).max())
    terms = _BYTE[raw[inside]] * _power(most)[span - inside - 1]
    sums = np.add.reduceat(terms, np.cumsum(ends - starts) - (ends - starts))
    return _mixed(sums + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the text's n-word shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    acc = np.full(len(w) - k + 1, np.uint64(len(w) if len(w) < n else n), dtype=np.uint64)
    for i in range(k):
        acc = _mixed(acc * _STEP[i] + w[i : len(w) - k + 1 + i])
    return np.unique(acc)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _signature(s: np.ndarray, wider: int = 1) -> bytes:
    width = wider * min(max(1 << (len(s) - 1).bit_length(), BITS[0]), BITS[1])
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _keys(s: np.ndarray) -> list[int]:
    """Sets that could link share the family of keys of both sizes: SMALL is more than 5/4 of LARGE."""
    return (_permuted(s) if len(s) <= SMALL else []) + (_binned(s) if len(s) >= LARGE else [])


def _permuted(s: np.ndarray) -> list[int]:
    low = np.stack([_mixed(s * turn).min() for turn in _TURN]).reshape(SMALL_KEYS, KEY_MINIMA)
    acc = np.arange(BINS, BINS + SMALL_KEYS, dtype=np.uint64)
    for k in range(KEY_MINIMA):
        acc = _mixed(acc * _STEP[k] + low[:, k])
    return acc.astype(np.int64).tolist()


def _binned(s: np.ndarray) -> list[int]:
    at = np.searchsorted(s, (np.arange(BINS, dtype=np.uint64) << np.uint64(59)), "left")
    size = np.diff(np.append(at, len(s)))
    low = np.where(size > 0, s[np.minimum(at, len(s) - 1)], np.uint64(0)).reshape(-1, KEY_BINS)
    full = (size > 0).reshape(-1, KEY_BINS).all(axis=1)
    acc = np.arange(len(low), dtype=np.uint64)
    for k in range(KEY_BINS):
        acc = _mixed(acc * _STEP[k] + low[:, k])
    return acc[full].astype(np.int64).tolist()


HEAVY = [("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()), ("wide", pa.binary())]
FEATURE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), *HEAVY])
FEATURES = "doc_id long, r1 long, r2 long, n long, f1 long, f2 long, keys array<long>, prefix array<long>, bits binary, wide binary"


def _features(last: np.ndarray):
    """last: sorted hashes that come after all others in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n", "f1", "f2", "keys", "prefix", "bits", "wide")}
            for text in batch["text"]:
                s = shingle_set(text.as_py())
                if not len(s):
                    found = (0, None, None, None, None, None, None)
                else:
                    m = _mixed(s)
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else None
                    order = s if late is None or not late.any() else np.concatenate([s[~late], s[late]])
                    prefix = order[: prefix_length(len(s))].astype(np.int64)
                    found = (len(s), int(m.sum().astype(np.int64)), int(_mixed(m + np.uint64(1)).sum().astype(np.int64)), _keys(s), prefix, _signature(s), _signature(s, WIDER))
                for k, v in zip(cols, found, strict=True):
                    cols[k].append(v)
            given = {k: batch[k] for k in ("doc_id", "r1", "r2")}
            yield pa.RecordBatch.from_pydict(given | cols, schema=FEATURE_SCHEMA)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()).astype(np.int64) for t in batch["text"]]
        yield pa.RecordBatch.from_pydict({"id": batch["id"], "s": sets}, schema=pa.schema([("id", pa.int64()), ("s", pa.list_(pa.int64()))]))


def _frequent(docs: DataFrame, total: int) -> np.ndarray:
    """The ORDER_KEEP hashes at most that are in FREQUENT or more distinct sets of the sample."""
    every = max(1, total // ORDER_SAMPLE)
    sample = docs.where(F.pmod(F.col("r1"), F.lit(every)) == 0).select(F.col("r1").alias("id"), "text")
    sets = sample.mapInArrow(_sets, "id long, s array<long>").where("size(s) > 0").select("s").distinct()
    often = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT)
    most = often.orderBy(F.desc("c"), "h").limit(ORDER_KEEP).select("h")
    return np.sort(most.toArrow()["h"].to_numpy().astype(np.uint64))


def _hits(a: pd.Series, b: pd.Series) -> pd.Series:
    def linked(x, y) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= 80 * (len(x) + len(y) - both)

    return pd.Series([linked(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose representatives' sets are similar. A class in many pairs is dealt into groups
    of 512 pairs, each with a copy of its set."""
    given = pairs = stash(pairs, f"{name}-pairs")
    linked = F.pandas_udf(_annotated(_hits), "boolean")

    # written first, so that the planner knows how many they are; no text is shuffled but of documents that may be theirs
    ids = stash(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(reps.select("id", "r1", "r2"), "id"), f"{name}-ids")
    held = sieve(ids, "r1")
    perhaps = sifted(docs, F.col("r1"), held)[1]
    sets = perhaps.join(ids, ["r1", "r2"]).select("id", "text").dropDuplicates(["id"]).mapInArrow(_sets, "id long, s array<long>")
    sets = stash(sets, f"{name}-sets")
    spent = [given, ids, held, sets]
    for side, other in (("a", "b"), ("b", "a")):
        shares = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / 512).cast("int").alias("k"))
        many = stash(shares.where("k > 1"), f"{name}-many")
        spent.append(many)
        copies = sets.join(many, sets["id"] == many[side], "left").select("id", F.col("s").alias(f"s{side}"), F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("part"))
        dealt = pairs.join(many, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
        pairs = dealt.join(copies, (dealt[side] == copies["id"]) & (dealt["part"] == copies["part"])).drop("id", "part")
    found = stash(pairs.where(linked("sa", "sb")).select("a", "b"), f"{name}-links")
    unstash(*spent)
    return found


def _annotated(f):
    f.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return f


class _Signatures:
    """Parity bitmaps of several widths, each a power of two; a wider one folds onto a narrower one by exclusive or."""

    def __init__(self, column: pa.ChunkedArray):
        raw = column.to_pylist()
        sizes = np.array([len(b) for b in raw]) // 8
        self.words, self.place, self.tables = sizes, np.zeros(len(raw), dtype=np.int64), {}
        for w in np.unique(sizes):
            at = np.flatnonzero(sizes == w)
            self.place[at] = np.arange(len(at))
            self.tables[int(w)] = np.frombuffer(b"".join(raw[k] for k in at), dtype=np.uint64).reshape(len(at), w)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the signatures of i and j differ, at the narrower width."""
        out = np.zeros(len(i), dtype=np.int64)
        wide = np.maximum(self.words[i], self.words[j])
        narrow = np.minimum(self.words[i], self.words[j])
        for w, v in {(int(a), int(b)) for a, b in zip(*np.unique(np.stack([wide, narrow]), axis=1), strict=True)}:
            where = np.flatnonzero((wide == w) & (narrow == v))
            for part in np.array_split(where, max(1, len(where) * w // 4_000_000)):
                sides = []
                for k in (i[part], j[part]):
                    x = np.zeros((len(part), v), dtype=np.uint64)
                    for size in {w, v}:
                        own = np.flatnonzero(self.words[k] == size)
                        x[own] = np.bitwise_xor.reduce(self.tables[size][self.place[k[own]]].reshape(len(own), size // v, v), axis=1) if len(own) else x[own]
                    sides.append(x)
                out[part] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
        return out


CLOSE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.int64())])


def _close(rows: pa.Table, forest: bool) -> pa.RecordBatch:
    """Pairs within tiles, of rows sorted by (h, l, r, n), that lie in a size band, in different parts, and pass the
    bit bound. All tiles of a batch advance together: row i meets row i + 1, then i + 2, until its band or tile ends.
    As a forest, a tile's pairs join its parts without a cycle, and the element of every tile where a pair of
    different parts was left out is returned as open."""
    h, left, right, n, ids, part, side = (rows[c].to_numpy() for c in ("h", "l", "r", "n", "id", "part", "side"))
    signatures = _Signatures(rows["bits"])
    tile = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    # a node for each part of each tile; joined holds for each node one nearer to its root
    order = np.lexsort((part, tile))
    first = np.concatenate([[True], (tile[order][1:] != tile[order][:-1]) | (part[order][1:] != part[order][:-1])])
    node = np.empty(len(h), dtype=np.int64)
    node[order] = np.cumsum(first) - 1
    joined = np.arange(len(h))
    out, left_out = [], np.zeros(len(h), dtype=bool)

    def root(x: int) -> int:
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    at, step, tree = np.arange(len(h)), 0, node
    while len(at):
        step += 1
        at = at[at + step < len(h)]
        to = at + step
        go = (tile[to] == tile[at]) & (4 * n[to] <= 5 * n[at])
        at, to = at[go], to[go]
        apart = (part[at] != part[to]) & ((side[at] != side[to]) | (side[at] == 2))
        again = apart & (tree[at] == tree[to])
        left_out[at[again]] = True
        try_ = np.flatnonzero(apart & ~again)
        if not len(try_):
            continue
        i, j = at[try_], to[try_]
        differ = signatures.differ(i, j)
        total = n[i] + n[j]
        # 100 * both >= 80 * union, with both <= (total - differ) / 2
        ok = np.flatnonzero(9 * (total - differ) >= 8 * total)
        if not len(ok):
            continue
        if forest:
            new = np.zeros(len(ok), dtype=bool)
            for k, (x, y) in enumerate(zip(node[i[ok]].tolist(), node[j[ok]].tolist(), strict=True)):
                x, y = root(x), root(y)
                new[k] = x != y
                joined[x] = y
            left_out[i[ok[~new]]] = True
            ok = ok[new]
            while (joined[joined] != joined).any():
                joined = joined[joined]
            tree = joined[node]
        out.append(np.stack([np.minimum(ids[i[ok]], ids[j[ok]]), np.maximum(ids[i[ok]], ids[j[ok]])], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
    more = np.unique(h[left_out])
    none = lambda k: pa.nulls(k, pa.int64())
    cols = [pa.chunked_array([pa.array(pairs[:, c]), none(len(more))]).combine_chunks() for c in (0, 1)]
    return pa.RecordBatch.from_arrays([*cols, pa.chunked_array([none(len(pairs)), pa.array(more)]).combine_chunks()], schema=CLOSE)


def _tile_pairs(forest: bool):
    """_close over whole tiles: the last tile of a batch waits for the next batch. A tile has about 2 * TILE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            key = [rows[c].to_numpy() for c in ("h", "l", "r")]
            other = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield _close(rows.slice(0, last), forest)
                held = rows.slice(last).to_batches()
        if held:
            yield _close(pa.Table.from_batches(held), forest)

    return run


def _shared(named: DataFrame) -> DataFrame:
    """Of rows (h, id, n, part), those whose element is in two parts or more, with k, into how many tiles each way the
    element's group is dealt, and c, the row's own among them. Elements are counted with a partial aggregate; the rows
    of a large group meet their element dealt over c, so none is one task's."""
    seen = named.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("k"))
    kept = stash(seen.where("low != high").select("h", "k"), "elements")
    large = stash(kept.where("k > 1"), "large")
    rows = join_hot(named, large, "h").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    cells = kept.select(F.col("h").alias("h_"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c_"))
    out = stash(rows.join(cells, (F.col("h") == F.col("h_")) & (F.col("c") == F.col("c_"))).select("h", "id", "n", "part", "k", "c"), "shared")
    unstash(kept, large)
    return out


def _tiles(shared: DataFrame, bits: DataFrame, diagonal: bool, forest: bool) -> DataFrame:
    """(a, b, open) of the tiles of the shared rows."""
    spot = lambda o: F.struct(F.least("c", o).alias("l"), F.greatest("c", o).alias("r"), F.when(o == F.col("c"), 2).when(F.col("c") < o, 0).otherwise(1).alias("side"))
    spots = F.array(spot(F.col("c"))) if diagonal else F.transform(F.sequence(F.lit(0), F.col("k") - 1), spot)
    tiles = shared.join(bits, "id").select("h", "id", "n", "part", "bits", F.explode(spots).alias("t")).select("h", "id", "n", "part", "bits", "t.*")
    # equal sizes stand in one of eight orders, so that the tiles of one group return different forests
    mixed = F.xxhash64("id", F.pmod("h", F.lit(8)))
    return stash(tiles.repartition("h", "l", "r").sortWithinPartitions("h", "l", "r", "n", mixed).mapInArrow(_tile_pairs(forest), "a long, b long, open long").distinct(), "tiles")


def _regrouped(shared: DataFrame, open_: DataFrame, links: DataFrame) -> DataFrame:
    """The shared rows of the open elements, with the parts that the links found so far make."""
    parts = stash(components(links), "parts")
    rows = join_hot(shared.select("h", "id", "n"), open_.withColumn("open", F.lit(True)), "h").where("open")
    out = _shared(rows.join(parts, F.col("id") == F.col("node"), "left").select("h", "id", "n", F.coalesce("root", "id").alias("part")))
    unstash(parts, shared)
    return out


def _linked(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): verified links between classes that reach every class of each component."""
    keyed = reps.select("id", "n", F.explode("keys").alias("key"))
    stars = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "l")
    starred = join_hot(keyed, stars, "key").where((F.col("id") != F.col("l.id")) & (4 * F.greatest("n", "l.n") <= 5 * F.least("n", "l.n")))
    links = verified(starred.select(F.col("l.id").alias("a"), F.col("id").alias("b")).distinct(), reps, docs, "stars")

    part = stash(components(links), "parts")
    named = reps.select("id", "n", "prefix").join(part, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("root", "id").alias("part"), F.explode("prefix").alias("h"))
    shared = _shared(named)
    unstash(part)

    tried = None
    for name in ("first", "second", "last"):
        bits = reps.select("id", F.col("bits" if name == "first" else "wide").alias("bits"))
        found = _tiles(shared, bits, diagonal=name == "first", forest=name != "last")
        pairs = found.where("a is not null").select("a", "b")
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        links = links.union(verified(fresh, reps, docs, name))
        if name == "last":
            break
        tried = pairs if tried is None else tried.union(pairs)
        open_ = found.where("open is not null").select(F.col("open").alias("h"))
        open_ = stash((open_.union(shared.where("k > 1").select("h")) if name == "first" else open_).distinct(), "open")
        if open_.isEmpty():
            break
        shared = _regrouped(shared, open_, links)
    unstash(shared)
    return links


def _resolved(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row of docs as (doc_id, r1, r2, n, f1, f2), and every class as (n, f1, f2, rows, r1, r2, component_id,
    first): its component's least doc_id, and whether its representative (r1, r2) stands for the whole component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", hash_pair("doc_id", "text").alias("r")).select("doc_id", "text", F.col("r.a").alias("r1"), F.col("r.b").alias("r2"))
    last = spark.sparkContext.broadcast(_frequent(docs, docs.count()))
    feats = stash(docs.mapInArrow(lambda it: _features(last.value)(it), FEATURES), "features")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    classes = feats.where("n > 0").groupBy("n", "f1", "f2").agg(F.count(F.lit(1)).alias("rows"), F.min(rank).alias("rep"), F.min_by(F.struct("keys", "prefix", "bits", "wide"), rank).alias("x"))
    reps = stash(classes.select("n", "f1", "f2", "rows", "rep.doc_id", "rep.r1", "rep.r2", "x.*", F.monotonically_increasing_id().alias("id")), "classes")
    rows = stash(feats.select("doc_id", "r1", "r2", "n", "f1", "f2"), "rows")
    unstash(feats)

    whole = reps.select("id", "doc_id").join(components(_linked(reps, docs)), F.col("id") == F.col("node"), "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    best = whole.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("best"))
    of = join_hot(whole, best, "root").select("id", F.col("best.doc_id").alias("component_id"), (F.col("id") == F.col("best.id")).alias("first"))
    return rows, stash(reps.select("id", "n", "f1", "f2", "rows", "r1", "r2").join(of, "id").drop("id"), "components")


def _named(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row with its class. A class of many rows is copied, and its rows are dealt over the copies."""
    key = ["n", "f1", "f2"]
    large = stash(classes.where("rows > 4096").select(*key, F.ceil(F.col("rows") / 4096).cast("int").alias("k")), "many")
    dealt = rows.join(large, key, "left").withColumn("salt", F.pmod(F.xxhash64("r1"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    # rows repeated whole have one r1: they stay together, and no more is known of them
    copies = classes.withColumnsRenamed({"r1": "rep1", "r2": "rep2"}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("rows") / 4096).cast("int"), F.lit(1)) - 1)))
    return dealt.join(copies, [*key, "salt"], "left")


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    return _named(*_resolved(docs)).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but the first row of each component: the least doc_id's, of equal ones any. Rows without
    shingles stay."""
    rows, classes = _resolved(docs)
    named = _named(rows, classes).where("n > 0").withColumn("stays", F.col("first") & (F.col("r1") == F.col("rep1")) & (F.col("r2") == F.col("rep2")))
    told = stash(named.groupBy(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("c")), "told")
    gone, twice = (stash(told.where(w).select("__r1", "__r2"), "keys") for w in ("not stays", "stays and c > 1"))
    marked = docs.withColumn("__r", hash_pair(F.col("doc_id"), F.col("text")))
    sure, perhaps = sifted(marked, F.col("__r.a"), sieve(gone.union(twice), "__r1"))
    same = (F.col("__r.a") == F.col("__r1")) & (F.col("__r.b") == F.col("__r2"))
    left = perhaps.join(gone, same, "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["__r"]))
    return sure.union(left).drop("__r")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end s
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from t where len(w) > 0)),
n as (select doc_id, count(*) n from g group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
k as (select a, min(b) m from reach group by 1)
select t.doc_id, coalesce(n, 0)::bigint n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) component_id
from t left join n using (doc_id) left join k on k.a = t.doc_id"""

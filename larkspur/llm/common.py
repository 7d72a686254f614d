"""What the corpus operators share: reading tables, the shared folder, word splitting, numbering rows, links to components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a maximal run of code points other than the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SEPARATOR = r"[\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves a local session
    (tests); a cluster has none that all its machines see, so there it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    app = spark.sparkContext.applicationId
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found and app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="larkspur-")
    return (found or _OWN[app]).rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut, lost executors cost nothing, and
    the planner knows its true size afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def unstash(*tables: DataFrame) -> None:
    """Deletes tables that stash wrote, once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(t._stashed_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR))


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch's texts, end to end, and the offset of each text with one more at the end; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.cast(pa.large_string()).buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), at


def hash_pair(*cols) -> Column:
    """A 128-bit hash as one struct of two longs."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols).alias("b"))


def join_hot(big: DataFrame, small: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """big left-joined to small, which has one row a key. Spark broadcasts small if its written size is under the
    session's threshold; beyond that both sides are dealt by (key, salt), so that a key with a third of big's rows
    is spread over many tasks."""
    written = small if hasattr(small, "_stashed_at") else stash(small, f"by-{key}")
    spark = big.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if 0 <= size <= limit:
        return big.join(F.broadcast(written), key, "left")
    salted = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = written.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "__salt"], "left").drop("__salt")


SIEVE_BITS = 24


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): a bitmap of 2^SIEVE_BITS places with those of the 64-bit hashes in ``key`` set, as 64-bit words. It
    has 2^18 rows at most, whatever the number of keys, so it may be broadcast."""
    place = F.pmod(F.col(key), F.lit(1 << SIEVE_BITS))
    bit = keys.select(F.shiftright(place, 6).cast("int").alias("word"), (place % 64).cast("int").alias("bit"))
    return stash(bit.select("word", F.expr("shiftleft(1L, bit)").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), "sieve")


def sifted(df: DataFrame, key: Column, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose hash ``key`` cannot be among those of the sieve, and the others: all that are, and of those
    that are not a share that nears one as the keys outnumber the places. Whatever is joined to the others exactly
    gives the same result for any share; the first need not be shuffled for it."""
    place = F.pmod(key, F.lit(1 << SIEVE_BITS))
    at = df.withColumn("__word", F.shiftright(place, 6).cast("int")).withColumn("__bit", (place % 64).cast("int"))
    seen = at.join(F.broadcast(held.withColumnsRenamed({"word": "__word", "bits": "__bits"})), "__word", "left")
    marked = seen.withColumn("__in", F.coalesce(F.expr("shiftright(__bits, __bit) & 1L") == 1, F.lit(False)))
    return tuple(marked.where(w).select(*[F.col(f"`{c}`") for c in df.columns]) for w in (~F.col("__in"), F.col("__in")))


def numbered(df: DataFrame, group: str, order: list[str], out: str, rows_a_bucket: int = 10_000) -> DataFrame:
    """df with out: a gapless number from 0 within each group, in the order of (bucket, order). order[0] must be a
    hexadecimal digest, whose first eight digits deal the rows of each group into buckets; only a bucket is ever
    sorted, and small counts are summed over buckets, so a group may hold any share of all rows."""
    spark = df.sparkSession
    n = df.count()
    buckets = 1
    while buckets * rows_a_bucket < n:
        buckets *= 2
    dealt = df.withColumn("__bucket", F.shiftright(F.conv(F.substring(order[0], 1, 8), 16, 10).cast("long") * buckets, 32).cast("int"))
    counts = dealt.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = stash(counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "starts")
    inside = dealt.withColumn("__at", F.row_number().over(W.partitionBy(group, "__bucket").orderBy(*order)) - 1)
    same = inside[group].eqNullSafe(starts[group]) & (inside["__bucket"] == starts["__bucket"])
    joined = inside.join(starts, same, "left").select(*[inside[c] for c in df.columns], (F.col("__at") + F.col("__start")).cast("long").alias(out))
    return joined


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node reachable. Alternating large-star and
    small-star rounds over tables in the shared folder; each round ends with as many rows as edges at most."""
    pairs = stash(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        # large star: every larger neighbour is linked to the least node of the neighbourhood, one row a pair; only a
        # node with smaller neighbours is not the least one itself
        large = pairs.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: every smaller neighbour, and the node itself, is linked to the least one
        small = large.join(down, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u != v")
        new = stash(small.distinct(), "links")
        unstash(pairs)
        pairs = new
        # settled when no node has two smaller neighbours, or a smaller and a larger one
        ends = new.select(F.posexplode(F.array("u", "v")).alias("low", "x")).groupBy("x").agg(F.sum(1 - F.col("low")).alias("up"), F.max("low").alias("low"))
        if not ends.where("up > 1 or up = 1 and low = 1").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

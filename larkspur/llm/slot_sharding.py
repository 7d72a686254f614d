"""Sharding through fixed virtual slots.

Every record is hashed by its doc_id, size and checksum into one of ``SLOTS`` virtual slots, a number that never
changes. Equal records are told apart by number: of more than ``SAME`` of them, every SAME get a hash of their own, so
that no key, not even a null one, fills a slot. Bytes are summed per slot, and a slot map, a table of ``SLOTS`` rows (version, vslot, shard, bytes), says which shard holds
each slot; only the map is edited when shards are added or drift apart, so no record is ever hashed anew.
``first_map`` deals slots, largest first, to the lightest shard. ``grown_map`` adds a shard and moves slots into it
alone. ``rebalanced_map`` moves slots from the heaviest to the lightest shard while that brings them closer.

The law is `bytes`: shards hold nearly equal sizes. The map has SLOTS rows, so folding it in one task is bounded by
that constant. A record's place in its shard is its slot's start plus its rank in the slot, so no shard is sorted as
a whole.

Defined results: a null text has size 8 and checksum 0; null doc_ids hash as ''; repeated rows are records of their
own with places of their own; an empty table gives an empty result and a map of
zero bytes; extra columns pass through ``assign``, and a column named like a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import join_hot, let, numbered, stash, table

SLOTS = 8192
SHARDS = 24
SAME = 256


def vslot(key: Column) -> Column:
    """The virtual slot: the first 13 bits of a record's key, a hexadecimal digest."""
    return F.shiftright(F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), 3)


def records(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, size, text_crc32, key, vslot) and the columns named, for every row of docs."""
    given = docs.select(*[c for c in dict.fromkeys(("doc_id", *more))], record_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    told = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    keyed = given.withColumn("key", F.md5(told.cast("binary")))
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") > SAME).withColumn("parts", F.ceil(F.col("parts") / SAME))
    part = F.pmod(F.monotonically_increasing_id(), F.col("parts"))
    own = join_hot(keyed, many, "key").withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.md5(F.concat_ws("|", "key", part).cast("binary"))))
    return own.select(*given.columns, "key", vslot(F.col("key")).alias("vslot"))


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def slot_bytes(docs: DataFrame) -> DataFrame:
    """(vslot, bytes) for every slot, empty ones too."""
    held = records(docs).groupBy("vslot").agg(F.sum("size").alias("bytes"))
    every = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def _argmin(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: the largest slot first, each to the lightest shard so far."""
    all_slots = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("s"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<struct<vslot:int,shard:int,bytes:bigint>>").alias("out"))

    def deal(acc: Column, x: Column) -> Column:
        return let(
            _argmin(acc["loads"]),
            lambda at: F.struct(
                F.transform(acc["loads"], lambda load, i: F.when(i == at, load - x["less"]).otherwise(load)).alias("loads"),
                F.array_append(acc["out"], F.struct(x["vslot"].alias("vslot"), at.alias("shard"), (-x["less"]).alias("bytes"))).alias("out"),
            ),
        )

    # dealt in two levels, so that the array that grows in the fold stays short
    chunk = 128
    chunks = F.transform(F.sequence(F.lit(0), F.lit(SLOTS // chunk - 1)), lambda c: F.slice("s", c * chunk + 1, chunk))
    outer = F.struct(start["loads"].alias("loads"), F.array().cast("array<array<struct<vslot:int,shard:int,bytes:bigint>>>").alias("out"))

    def deal_chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["loads"].alias("loads"), start["out"].alias("out")), deal)
        return F.aggregate(F.array(inner), acc, lambda a, x: F.struct(x["loads"].alias("loads"), F.array_append(a["out"], x["out"]).alias("out")))

    folded = all_slots.select(F.aggregate(chunks, outer, deal_chunk)["out"].alias("out"))
    return folded.select(F.explode(F.flatten("out")).alias("m")).select(F.lit(1).alias("version"), "m.vslot", "m.shard", "m.bytes")


def grown_map(current: DataFrame) -> DataFrame:
    """The next version with one more shard, filled up to the mean from every old shard in turn; no slot moves
    between old shards."""
    from pyspark.sql import Window as W

    n = current.agg((F.max("shard") + 1).alias("n"), F.sum("bytes").alias("total"), F.max("version").alias("v"))
    w = W.partitionBy("shard").orderBy("vslot")
    moved = current.crossJoin(F.broadcast(n)).withColumn("sofar", F.sum("bytes").over(w))
    mean = F.col("total") / (F.col("n") + 1)
    goes = F.col("sofar") <= (F.sum("bytes").over(W.partitionBy("shard")) - mean)
    return moved.select((F.col("v") + 1).alias("version"), "vslot", F.when(goes, F.col("n")).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes")


def rebalanced_map(current: DataFrame, sizes: DataFrame, moves: int = 256) -> DataFrame:
    """The next version for new slot sizes: up to moves times, the slot that best halves the gap goes from the
    heaviest to the lightest shard. All slots not named in a move stay where they are."""
    at = current.select("vslot", "shard", "version").join(sizes, "vslot")
    rows = at.agg(F.max("version").alias("v"), F.sort_array(F.collect_list(F.struct("vslot", "shard", "bytes"))).alias("m"), (F.max("shard") + 1).alias("n"))
    loads = rows.select("*", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == k, x["bytes"]).otherwise(0))).alias("loads"))

    def move(acc: Column, _: Column) -> Column:
        ends = F.struct((F.array_position(acc["loads"], F.array_max(acc["loads"])).cast("int") - 1).alias("hi"), _argmin(acc["loads"]).alias("lo"), (F.array_max(acc["loads"]) - F.array_min(acc["loads"])).alias("gap"))

        def chosen(e: Column) -> Column:
            fit = F.filter(acc["m"], lambda x: (x["shard"] == e["hi"]) & (x["bytes"] > 0) & (x["bytes"] < e["gap"]))
            best = F.array_min(F.transform(fit, lambda x: F.struct(F.abs(e["gap"] - 2 * x["bytes"]).alias("d"), x["vslot"].alias("vslot"), x["bytes"].alias("bytes"))))
            return F.struct(e["hi"].alias("hi"), e["lo"].alias("lo"), best.alias("best"))

        def moved(c: Column) -> Column:
            b = F.coalesce(c["best"]["bytes"], F.lit(0))
            return F.struct(
                F.transform(acc["m"], lambda x: F.struct(x["vslot"].alias("vslot"), F.when(x["vslot"] == c["best"]["vslot"], c["lo"]).otherwise(x["shard"]).alias("shard"), x["bytes"].alias("bytes"))).alias("m"),
                F.transform(acc["loads"], lambda load, i: load + F.when(i == c["lo"], b).otherwise(0) - F.when(i == c["hi"], b).otherwise(0)).alias("loads"),
            )

        return let(let(ends, chosen), moved)

    done = loads.select((F.col("v") + 1).alias("version"), F.aggregate(F.sequence(F.lit(1), F.lit(moves)), F.struct("m", "loads"), move)["m"].alias("m"))
    return done.select("version", F.explode("m").alias("x")).select("version", "x.vslot", "x.shard", "x.bytes")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Every version stays; the latest is the one in force."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("version")) if version is None else spark.createDataFrame([(version,)], "version int")
    return versions.join(F.broadcast(newest), "version", "left_semi").select("version", "vslot", "shard", "bytes")


def assign(docs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """docs with vslot and shard by the map, which is small by construction (SLOTS rows)."""
    names = [c for c in docs.columns if c not in ("vslot", "shard")]
    given = docs.select("doc_id", "text", F.struct(*names).alias("__row"))
    return records(given, "__row").join(F.broadcast(slot_map.select("vslot", "shard")), "vslot").select("__row.*", "vslot", "shard")


def op10_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stash(records(docs), "records")
    held = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    sizes = spark.range(SLOTS).select(F.col("id").cast("int").alias("vslot")).join(held, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))
    sizes = stash(sizes.coalesce(1), "sizes")
    slot_map = stash(first_map(sizes.select("vslot", "bytes")), "slot-map")
    placed = stash(_starts(slot_map.join(sizes.select("vslot", "n"), "vslot")), "slot-starts")
    ranked = numbered(rows, "vslot", ["key", "text_crc32", "size"], "__rank")
    joined = ranked.join(F.broadcast(placed), "vslot")
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__start") + F.col("__rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def _starts(placed: DataFrame) -> DataFrame:
    """Where each virtual slot begins in its shard; over SLOTS rows."""
    from pyspark.sql import Window as W

    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))

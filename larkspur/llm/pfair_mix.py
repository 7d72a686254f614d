"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. With weight w, a share of the whole, block k of a source has release floor(k / w)
and deadline ceil((k + 1) / w); in every time slot the released block with the earliest deadline runs, ties by the
source's place. Weights are whole numbers W of parts in 10^9, so releases and deadlines are exact: until the first
source runs out (``in_mix``), after t slots every source has had more than w * t - 1 and fewer than w * t + 1 blocks.
The schedule is a fold over the slots up to that point, never periodic, so no rounding adds up. Afterwards the blocks
left come by deadline and place; each one's slot is the number of blocks before it, a sum over the sources.

The fold has a step a slot, and its result a row a block. So that both stay bounded at any size, a block has ``BLOCK``
rows or, where that would be more than ``SLOTS`` blocks, a SLOTS-th of all rows.

Rows are ordered within a source by the MD5 of their doc_id, and numbered over buckets (common.numbered), so a source
with a third of all rows is sorted in many tasks.

Defined results: a null source is the source ''; a source without a weight, or one of zero or less, has the least
weight, 10^-9; a weight whose source has no rows is left out; null doc_ids come in the order of ''; repeated rows keep
places of their own; empty texts count like others; an empty table gives an empty result; a column named like a result
is replaced by it, other extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import let, numbered, stash, table

BLOCK = 32
SLOTS = 100_000
UNIT = 1_000_000_000
#: Target weights: rows to this power, so that large sources are damped.
DAMPING = 0.5
CHUNK = 128


def damped_weights(docs: DataFrame, power: float = DAMPING) -> DataFrame:
    """(source, weight), not normalised."""
    return docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))


def sources(docs: DataFrame, weights: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """(source, place, w, whole, n, block): every source's whole weight of the sum ``whole``, its number of blocks, and
    the rows of a block."""
    held = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    given = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("weight").alias("weight"))
    both = held.join(given, "source", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    sums = both.agg(F.sum("weight").alias("total"), F.greatest(F.lit(block), F.ceil(F.sum("rows") / slots)).alias("block"))
    whole = F.greatest(F.coalesce(F.round(F.try_divide("weight", "total") * UNIT), F.lit(1)).cast("long"), F.lit(1))
    each = both.crossJoin(F.broadcast(sums)).select("source", whole.alias("w"), F.ceil(F.col("rows") / F.col("block")).cast("long").alias("n"), F.col("block").cast("long").alias("block"))
    # one row a source; the places come from the sorted list
    listed = each.agg(F.sort_array(F.collect_list(F.struct("source", "w", "n", "block"))).alias("s"))
    out = listed.select(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("whole"), F.posexplode("s").alias("place", "x"))
    return out.select("x.source", "place", "x.w", "whole", "x.n", "x.block")


def _deadline(k: Column, w: Column, whole: Column) -> Column:
    return _div((k + 1) * whole + w - 1, w)


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs, exact."""
    return F.call_function("div", a, b)


def schedule(listed: DataFrame) -> DataFrame:
    """(place, k, slot, in_mix) for every block: earliest deadline first among the released until a source runs out,
    the rest by deadline."""
    all_ = listed.agg(F.sort_array(F.collect_list(F.struct("place", "w", "n"))).alias("s"), F.max("whole").alias("whole"))
    # the fold must end when the first source's missing block is due
    ends = F.array_min(F.transform("s", lambda x: _deadline(x["n"], x["w"], F.col("whole"))))
    all_ = all_.where("size(s) > 0").withColumn("steps", F.least(ends, F.aggregate("s", F.lit(1).cast("long"), lambda a, x: a + x["n"])))
    out_type = "array<struct<place:int,k:bigint,slot:bigint>>"
    zero = F.transform("s", lambda _: F.lit(0).cast("long"))
    start = lambda out: F.struct(zero.alias("k"), F.lit(True).alias("going"), out.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        def due(k: Column, i: Column) -> Column:
            x = F.get("s", i)
            return F.when(_div(k * F.col("whole"), x["w"]) <= t, _deadline(k, x["w"], F.col("whole")))

        def ran(at: Column) -> Column:
            goes = acc["going"] & (F.get(acc["k"], at) < F.get("s", at)["n"])
            one = F.struct(at.alias("place"), F.get(acc["k"], at).alias("k"), t.alias("slot"))
            return F.struct(
                F.when(goes, F.transform(acc["k"], lambda k, i: F.when(i == at, k + 1).otherwise(k))).otherwise(acc["k"]).alias("k"),
                goes.alias("going"),
                F.when(goes, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"),
            )

        first = let(F.transform(acc["k"], due), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)
        return let(first, ran)

    # dealt in two levels, so that the array that grows in the fold stays short
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("steps") - 1) / CHUNK)), lambda c: F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, F.col("steps")) - 1))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["k"].alias("k"), acc["going"].alias("going"), F.array().cast(out_type).alias("out")), step)
        return let(inner, lambda x: F.struct(x["k"].alias("k"), x["going"].alias("going"), F.array_append(acc["out"], x["out"]).alias("out")))

    done = all_.select("s", "whole", F.aggregate(chunks, start(F.array().cast(f"array<{out_type}>")), chunk).alias("d"))
    done = stash(done.select("s", "whole", F.col("d.k").alias("k"), F.flatten("d.out").alias("out")), "fold")
    mixed = done.select(F.explode("out").alias("x")).select("x.place", "x.k", "x.slot", F.lit(True).alias("in_mix"))

    left = done.select("s", "whole", F.col("k").alias("had"), F.size("out").cast("long").alias("end"), F.explode("s").alias("own"))
    left = left.withColumn("first", F.get("had", F.col("own.place"))).where("first < own.n").withColumn("k", F.explode(F.sequence(F.col("first"), F.col("own.n") - 1)))
    due = _deadline(F.col("k"), F.col("own.w"), F.col("whole"))

    def before(d: Column) -> Column:
        """How many blocks of all sources come earlier: those due before, or at the same time with an earlier place."""

        def of(x: Column, i: Column) -> Column:
            until = F.when(i < F.col("own.place"), d).otherwise(d - 1)
            had = F.get("had", i)
            # no later than the source's last deadline, so that the product stays small
            until = F.least(until, _div(x["n"] * F.col("whole") + x["w"] - 1, x["w"]))
            others = F.least(F.greatest(_div(until * x["w"], F.col("whole")), had), x["n"]) - had
            return F.when(i == F.col("own.place"), F.col("k") - F.col("first")).otherwise(others)

        return F.aggregate(F.transform("s", of), F.lit(0).cast("long"), lambda a, x: a + x)

    rest = left.select(F.col("own.place").alias("place"), "k", (F.col("end") + let(due, before)).alias("slot"), F.lit(False).alias("in_mix"))
    return mixed.union(rest)


def mix(docs: DataFrame, weights: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """docs with block (of the source), in_block, slot (of the block, unique) and in_mix; sort by (slot, in_block)
    for the mixed order."""
    out = ("block", "in_block", "slot", "in_mix")
    names = [c for c in docs.columns if c not in out]
    listed = stash(sources(docs, weights, block, slots), "sources")
    # a row a block, SLOTS of them and one more a source at most
    plan = stash(schedule(listed).join(listed.select("place", "source", F.col("block").alias("__size")), "place").select(F.col("source").alias("__source"), F.col("k").alias("block"), "slot", "in_mix"), "plan")
    sizes = listed.select(F.col("source").alias("__source"), F.col("block").alias("__size"))
    keyed = docs.select(
        F.coalesce("source", F.lit("")).alias("__source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__key"),
        F.xxhash64(*names).alias("__tie"), F.struct(*names).alias("__row"),
    )
    ranked = numbered(keyed, "__source", ["__key", "__tie"], "__rank").join(F.broadcast(sizes), "__source")
    blocks = ranked.withColumn("block", _div(F.col("__rank"), F.col("__size"))).withColumn("in_block", (F.col("__rank") % F.col("__size")).cast("int"))
    return blocks.join(F.broadcast(plan), ["__source", "block"]).select("__row.*", "block", "in_block", "slot", "in_mix")


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, damped_weights(docs))


ORACLE = f"""
with recursive d as (select doc_id, coalesce(source, '') source, md5(coalesce(doc_id::varchar, '')) key from documents),
h as (select source, count(*) c, pow(count(*)::double, {DAMPING}) weight from d group by 1),
b as (select greatest({BLOCK}, ceil(sum(c) / {SLOTS}))::bigint block, sum(weight) total from h),
q as (select source, row_number() over (order by source) place, greatest(round(weight / total * {UNIT}), 1)::bigint w, ceil(c / block)::bigint n, block from h, b),
qs as (select list(w order by place) w, list(n order by place) n, sum(w)::bigint whole from q),
step(t, ks, going, pl, k) as (
  select -1::bigint, list_transform(w, lambda x: 0::bigint), true, null::bigint, null::bigint from qs
  union all
  select t + 1, case when ks[j] < n[j] then list_transform(ks, lambda x, i: case when i = j then x + 1 else x end) else ks end, ks[j] < n[j], j, ks[j] from (
    select *, list_position(due, list_min(due)) j from (
      select t, ks, n, list_transform(ks, lambda x, i: case when (x * whole) // w[i] <= t + 1 then ((x + 1) * whole + w[i] - 1) // w[i] end) due
      from step, qs where going))),
mixed as (select pl place, k, t slot from step where t >= 0 and going),
fin as (select count(*) e from mixed),
began as (select place, q.w, q.n, (select count(*) from mixed where mixed.place = q.place) had, whole from q, qs),
lefts as (select place, w, whole, unnest(range(had, n)) k from began),
due as (select *, ((k + 1) * whole + w - 1) // w d from lefts),
tail as (select place, k, e + row_number() over (order by d, place, k) - 1 slot from due, fin),
plan as (select *, true in_mix from mixed union all select *, false from tail),
r as (select d.*, row_number() over (partition by source order by key) - 1 rank from d)
select doc_id, nullif(r.source, '') source, rank // block as block, (rank % block)::int in_block, plan.slot, plan.in_mix
from r join q on r.source = q.source join plan on plan.place = q.place and plan.k = rank // q.block"""

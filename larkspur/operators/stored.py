"""A stored index that follows its pages: only what changed is tokenized again.

Under its folder an index is a list of segments, and ``state``, to which every refresh appends one row (n, segments,
stamp): the row with the greatest n holds. The first segment is a whole build. A refresh compares digests of the pages
as they are with those stored, and writes one more segment with the pages that are new or changed; ``gone`` names the
pages that its coming ends in the segments before it. Readers leave out a segment's rows for pages that a later segment
ends, and add up frequencies: each segment stores those of its own postings and those of the postings that it ended.
When deltas have grown beyond ``MOST`` segments or ``SHARE`` of the pages, a refresh merges all into one new segment; no
page is tokenized again for that. Segments are never changed once written, so readers keep what they opened; ``vacuum``
deletes those that the newest state does not name. One writer at a time.

Pages are tokenized into each page's own row first, once; postings come from those rows, dealt by ranges of (token,
page), so that a frequent token is spread over many tasks and files, and a query's tokens still prune row groups.

Defined results: rows that share a page_id are one page, which changes if any of them does; a null page_id is a page
like others; null texts are empty; an empty table gives an index without postings; other columns play no part.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import index as I
from larkspur.operators.cut import cut, shared_dir, signature

#: What is stored, or how pages are tokenized, has changed since the last version: older folders are not read.
VERSION = 1
MOST, SHARE = 8, 0.2
#: Bytes of files a task sorts or scores.
TASK_BYTES = 4 << 20

_DOCS = ("page_id", "path", "role", "dl", "approved", "page_ord")
_ROWS = (*_DOCS, "digest", "terms", "compound", "metadata")
#: Tables of a segment; reading by schema serves empty ones too.
_TABLES = {
    "pages": "page_id string, path string, role string, dl long, approved boolean, page_ord long, digest string, terms array<struct<token: string, tf: long>>, compound array<string>, metadata array<string>",
    "postings": "token string, page_id string, tf long, dl long, approved boolean",
    "terms": "token string, df long",
    "compound": "token string, page_id string, tf long, approved boolean",
    "metadata": "token string, page_id string, tf long, approved boolean",
    "gone": "page_id string",
    "less": "token string, df long",
}
_STATE = "n long, segments array<string>, stamp string"


def digest(page_columns: list[str]) -> Column:
    """Of everything an index takes from a page; long texts by a digest of their own."""
    column = lambda name: F.col(name) if name in page_columns else F.lit(None)
    said = [column(c).alias(c) for c in ("page_id", "path", "role", "approved", "page_ord", "title", "summary", "tags", "source_refs")]
    return F.sha2(F.to_json(F.struct(*said, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))), 256)


def listing(pages: DataFrame) -> DataFrame:
    """(page_id, digest): one row a page. Nothing is tokenized for it."""
    each = pages.select("page_id", digest(pages.columns).alias("digest"))
    return each.groupBy("page_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("digest"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, change): pages added, removed or changed between two listings."""
    a, b = before.select("page_id", F.col("digest").alias("was")), after.select(F.col("page_id").alias("now_id"), F.col("digest").alias("is"))
    both = a.join(b, F.col("page_id").eqNullSafe(F.col("now_id")), "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select(F.when(F.col("is").isNull(), F.col("page_id")).otherwise(F.col("now_id")).alias("page_id"), change.alias("change")).where("change is not null")


# -- segments


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return spark.read.schema(_TABLES[table]).parquet(f"{at}/{table}")


def _rows(pages: DataFrame, analyzer: str) -> DataFrame:
    """A segment's page rows: terms with their counts, and the identifiers of the english analyzer."""
    rows = I.counted(pages, analyzer).withColumn("digest", digest(pages.columns))
    english = analyzer == "english"
    none = F.lit(None).cast("array<string>")
    channels = {"compound": I.exact_tokens(I.authored_text()) if english else none, "metadata": I.exact_tokens(I.metadata_text()) if english else none}
    return rows.withColumns(channels).select(*_ROWS)


def _write_segment(spark: SparkSession, at: str, rows: DataFrame, analyzer: str) -> None:
    rows.write.parquet(f"{at}/pages")
    own = _read(spark, at, "pages")
    postings = own.select(F.explode("terms").alias("x"), "page_id", "dl", "approved").select("x.token", "page_id", "x.tf", "dl", "approved")
    postings.repartitionByRange(_parts(spark, own), "token", "page_id").sortWithinPartitions("token", "page_id").write.parquet(f"{at}/postings")
    I.frequencies(_read(spark, at, "postings")).write.parquet(f"{at}/terms")
    for channel in ("compound", "metadata") if analyzer == "english" else ():
        each = own.select(F.explode(channel).alias("token"), "page_id", F.lit(1).cast("long").alias("tf"), "approved")
        each.repartitionByRange("token", "page_id").sortWithinPartitions("token", "page_id").write.parquet(f"{at}/{channel}")


def _parts(spark: SparkSession, *tables: DataFrame) -> int:
    """Tasks for tables read from files: as many as the session's, more beyond TASK_BYTES each."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _without(rows: DataFrame, ended: DataFrame | None) -> DataFrame:
    if ended is None:
        return rows
    names = ended.select(F.col("page_id").alias("__gone"))
    return rows.join(names, rows["page_id"].eqNullSafe(names["__gone"]), "left_anti")


def _live(spark: SparkSession, path: str, segments: list[str], table: str) -> DataFrame:
    """All segments' rows of a table, but those of pages that a later segment ends."""
    parts = []
    for k, s in enumerate(segments):
        later = [_read(spark, f"{path}/{x}", "gone") for x in segments[k + 1 :]]
        parts.append(_without(_read(spark, f"{path}/{s}", table), reduce(DataFrame.union, later) if later else None))
    return reduce(DataFrame.unionByName, parts)


# -- states


def state(spark: SparkSession, path: str):
    """The row (n, segments, stamp) that holds, or None."""
    if not _exists(spark, f"{path}/state"):
        return None
    return spark.read.schema(_STATE).parquet(f"{path}/state").orderBy(F.desc("n")).first()


def _commit(spark: SparkSession, path: str, n: int, segments: list[str], stamp: str | None) -> None:
    spark.createDataFrame([(n, segments, stamp)], _STATE).coalesce(1).write.mode("append").parquet(f"{path}/state")


def changes(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """(page_id, change) from the stored pages to the given ones; no rows where the index is current."""
    found = state(spark, path)
    stored = _live(spark, path, found["segments"], "pages").select("page_id", "digest")
    whole = stored.groupBy("page_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("digest"))
    return compared(whole, listing(I.complete(pages)))


def refresh(spark: SparkSession, path: str, pages: DataFrame, analyzer: str = "legacy", stamp: str | None = None) -> dict[str, int]:
    """The index at path follows the pages; it is built if there is none. The numbers of pages added, changed, removed."""
    given = I.complete(pages)
    found = state(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    at = f"{path}/{name}"
    if found is None:
        _write_segment(spark, at, _rows(given, analyzer), analyzer)
        _commit(spark, path, 1, [name], stamp)
        return {"added": _read(spark, at, "pages").count(), "changed": 0, "removed": 0}
    before = list(found["segments"])
    differ = cut(changes(spark, path, given), "changes")
    counts = {"added": 0, "changed": 0, "removed": 0} | {r["change"]: r["count"] for r in differ.groupBy("change").count().collect()}
    if not any(counts.values()):
        if stamp != found["stamp"]:
            _commit(spark, path, found["n"] + 1, before, stamp)
        return counts
    differ.where("change != 'added'").select("page_id").write.parquet(f"{at}/gone")
    ended = _read(spark, at, "gone")
    # the postings that end are known from their pages' own rows
    rows = _live(spark, path, before, "pages").select("page_id", "terms").withColumnRenamed("page_id", "__id")
    over = rows.join(ended, F.col("__id").eqNullSafe(F.col("page_id")), "left_semi")
    over.select(F.explode("terms.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{at}/less")
    fresh = differ.where("change != 'removed'").select(F.col("page_id").alias("__id"))
    _write_segment(spark, at, _rows(given.join(fresh, given["page_id"].eqNullSafe(F.col("__id")), "left_semi"), analyzer), analyzer)
    segments = [*before, name]
    _commit(spark, path, found["n"] + 1, segments, stamp)
    deltas, whole = (sum(_read(spark, f"{path}/{s}", "pages").count() for s in part) for part in (segments[1:], segments[:1]))
    if len(segments) > MOST or deltas > SHARE * whole:
        compact(spark, path, analyzer)
    return counts


def compact(spark: SparkSession, path: str, analyzer: str = "legacy") -> None:
    """All segments' live pages as one segment, from their stored terms."""
    found = state(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    _write_segment(spark, f"{path}/{name}", _live(spark, path, found["segments"], "pages"), analyzer)
    _commit(spark, path, found["n"] + 1, [name], found["stamp"])


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the segments that the newest state does not name; readers of older states must have ended."""
    states = spark.read.schema(_STATE).parquet(f"{path}/state")
    keep = set(state(spark, path)["segments"])
    old = sorted({s for r in states.select("segments").collect() for s in r["segments"]} - keep)
    for s in old:
        _delete(spark, f"{path}/{s}")
    return old


def read(spark: SparkSession, path: str, analyzer: str = "legacy") -> I.Index:
    """The index as the newest state has it."""
    segments = state(spark, path)["segments"]
    docs = _live(spark, path, segments, "pages").select(*_DOCS)
    added = [_read(spark, f"{path}/{s}", "terms") for s in segments]
    ended = [_read(spark, f"{path}/{s}", "less").select("token", (-F.col("df")).alias("df")) for s in segments[1:]]
    terms = added[0] if len(segments) == 1 else reduce(DataFrame.union, [*added, *ended]).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    extra = {c: _live(spark, path, segments, c) for c in ("compound", "metadata")} if analyzer == "english" else {}
    parts = _parts(spark, *[_read(spark, f"{path}/{s}", "postings") for s in segments])
    return I.Index(_live(spark, path, segments, "postings"), docs, terms, I.totals(docs), analyzer, **extra, parts=parts)


def opened(spark: SparkSession, name: str, inputs: list[str], pages: DataFrame, analyzer: str = "legacy", fresh: bool = False) -> I.Index:
    """The stored index of pages that are read from input files, which follows them: where the files' names, sizes and
    times are those of the newest state nothing is read, else the pages are compared. fresh builds under a new name, so
    that nobody's tables are deleted."""
    stamp = signature(spark, *inputs)
    own = uuid.uuid4().hex if fresh else hashlib.sha256("\n".join(inputs).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/larkspur/{name}-{analyzer}-v{VERSION}-{own}"
    found = state(spark, path)
    if found is None or found["stamp"] != stamp:
        refresh(spark, path, pages, analyzer, stamp)
    return read(spark, path, analyzer)

"""Line dedup by site: a line on too large a share of a site's pages is boilerplate and goes.

Pages are grouped by host (the given column). For each host and distinct line, the pages that hold the line are
counted and divided by the host's pages; lines with a share above ``ratio`` on ``min_pages`` pages or more are
dropped from every page of the host. Lines compare without leading and trailing blanks; blank lines are never
counted or dropped. Lines of a host are compared by a 128-bit hash, so only hashes are shuffled.

Size: a host's dropped lines number at most (its mean distinct lines a page) / ratio, whatever its pages.

Defined results: a null text stays null with zero counts; an empty text stays empty; a page of boilerplate alone
becomes ''; a line repeated in a page counts once and goes everywhere; rows with a null host belong to no site and
stay as they are; repeated rows are pages of their own; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import SPACES, hash_pair, join_hot, table

RATIO = 0.05
MIN_PAGES = 5


def _key(line: Column) -> Column:
    return hash_pair(F.trim(line, F.lit(SPACES)))


def boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): for each host with any, the hashes of its boilerplate lines."""
    pages = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("__host"), F.coalesce("text", F.lit("")).alias("__text"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    # a page's own total rides along as the line without a hash, so that one pass gives both counts
    each = pages.select("__host", F.explode(F.array_append(F.array_distinct(F.transform(lines, _key)), F.lit(None))).alias("__line"))
    counts = each.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n"))
    often = counts.where(F.col("__line").isNull() | (F.col("__n") >= min_pages))
    totals = often.where("__line is null").select("__host", F.col("__n").alias("__pages"))
    shared = often.where("__line is not null").join(totals, "__host").where(F.col("__n") > ratio * F.col("__pages"))
    return shared.groupBy("__host").agg(F.sort_array(F.collect_list("__line")).alias("__drop"))


def drop_boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with text cleaned, and n_lines and n_dropped: the lines with a word before, and those that went."""
    marked = join_hot(docs.withColumn("__host", F.col(host)), boilerplate(docs, host, ratio, min_pages), "__host")
    lines = F.split("text", "\n")
    spare = F.filter(lines, lambda x: ~F.array_contains(F.col("__drop"), _key(x)))
    filled = lambda found: F.size(F.filter(found, lambda x: F.trim(x, F.lit(SPACES)) != ""))
    before = F.when(F.col("text").isNull(), 0).otherwise(filled(lines)).cast("long")
    after = F.when(F.col("text").isNull(), 0).when(F.col("__drop").isNull(), before).otherwise(filled(spare))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(spare, "\n"))
    return marked.select(*[c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")], text.alias("text"), before.alias("n_lines"), (before - after).cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents"), "source").select("doc_id", "text", "n_lines", "n_dropped")


ORACLE = rf"""
with d as (select row_number() over () rid, doc_id, source, text, string_split(text, chr(10)) ls from documents),
e as (select rid, doc_id, source, unnest(ls) l, generate_subscripts(ls, 1) i from d where text is not null),
k as (select *, trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) t from e),
tot as (select source, count(*) pages from d where source is not null group by 1),
b as (select source, t from k join tot using (source) where t <> '' group by source, t, pages
      having count(distinct rid) >= {MIN_PAGES} and count(distinct rid) > {RATIO} * pages),
j as (select k.*, b.t is not null gone from k left join b on k.source = b.source and k.t = b.t),
g as (select rid, string_agg(l, chr(10) order by i) filter (where not gone) x, count(*) filter (where t <> '') n, count(*) filter (where gone) dropped from j group by rid)
select doc_id, case when text is null then null else coalesce(x, '') end as text, coalesce(n, 0)::bigint n_lines, coalesce(dropped, 0)::bigint n_dropped
from d left join g using (rid)"""

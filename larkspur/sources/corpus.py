"""The corpus, queries, judgements, graph and hits as views over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files come in fewer splits than there are cores; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of files up to which a table of a few numbers a row is sent to every task.
SMALL = 16 << 20


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast where its files are small; beyond that a join shuffles."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= SMALL else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, text) of every page, for what needs no labels."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("page_id"), F.substring(F.substring_index(body, "\n", 1), 1, 80).alias("title"), body.alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a document; labels give its review state and status."""
    d, l = spread(table(spark, sf_dir, "documents")).alias("d"), small(table(spark, sf_dir, "labels")).alias("l")
    body = F.coalesce(F.col("d.text"), F.lit(""))
    return d.join(l, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("page_ord"),
        F.col("d.doc_id").cast("string").alias("page_id"),
        F.concat_ws("/", "d.source", "d.lang", F.concat(F.col("d.doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.substring(F.substring_index(body, "\n", 1), 1, 80).alias("title"),
        body.alias("text"),
        X.summary(body).alias("summary"),
        F.when(F.col("d.doc_id") == 0, "hot").when(F.col("d.doc_id") == 1, "index").when(F.col("d.doc_id") == 2, "overview").otherwise("topic").alias("role"),
        F.array("d.lang").alias("tags"),
        F.array("d.source").alias("source_refs"),
        F.when(F.col("l.toxic") == 1, "blocked").otherwise("").alias("status"),
        F.when(F.col("l.quality") == 1, "approved").when(F.col("l.quality") == 0, "draft").otherwise("unknown").alias("review_state"),
        ((F.coalesce("l.toxic", F.lit(0)) == 0) & (F.coalesce("l.quality", F.lit(1)) == 1)).alias("approved"),
    )


def earlier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as they once were: drafts had their title alone, blocked ones were not there, and each benchmark
    passage was a page of its own that has gone since."""
    now = pages(spark, sf_dir)
    stub = F.col("review_state") == "draft"
    before = now.where("status != 'blocked'").withColumns({c: F.when(stub, F.col("title")).otherwise(F.col(c)) for c in ("text", "summary")})
    item = F.concat(F.lit("item-"), F.col("item_id").cast("string"))
    own = table(spark, sf_dir, "benchmark").select(
        F.lit(None).cast("long").alias("page_ord"), item.alias("page_id"), F.concat(F.lit("benchmark/"), item, F.lit(".md")).alias("path"), F.lit("").alias("title"), F.col("text"), X.summary(F.col("text")).alias("summary"),
        F.lit("topic").alias("role"), F.array(F.lit("en")).alias("tags"), F.array(F.lit("benchmark")).alias("source_refs"), F.lit("").alias("status"), F.lit("unknown").alias("review_state"), F.lit(True).alias("approved"),
    )
    return before.unionByName(own)


def queries(spark: SparkSession, sf_dir: str, most: int = 8) -> DataFrame:
    """(query_id, query): the first distinct tokens of each benchmark passage."""
    tokens = F.slice(F.array_distinct(X.legacy_tokens(F.col("text"))), 1, most)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(tokens, " ").alias("query"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, page_id, relevance): 2 where a page holds the whole passage, 1 where it holds its first half."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    half = F.substring("passage", F.lit(1), F.floor(F.length("passage") / 2).cast("int"))
    d = spread(table(spark, sf_dir, "documents"))
    # a page that holds the half holds the half's words between two spaces as words of its own, so one of these names the
    # pages to look at; a half without one is held against every page. The passages are the query set.
    inner = F.filter(F.slice(F.split("half", " "), 2, F.greatest(F.size(F.split("half", " ")) - 2, F.lit(0))), lambda w: w != "")
    longest = F.aggregate(inner, F.lit(None).cast("string"), lambda a, w: F.when(a.isNull() | (F.length(w) > F.length(a)), w).otherwise(a))
    halves = b.withColumn("half", half).withColumn("key", longest)
    keys = halves.agg(F.collect_set("key").alias("keys"))
    named = X.exploded(d.crossJoin(F.broadcast(keys)), F.array_intersect(F.split("text", " "), "keys"), "key", "doc_id", "text")
    by_key = named.join(F.broadcast(halves.where("key is not null")), "key").where(F.col("text").contains(F.col("half")))
    by_all = d.join(F.broadcast(halves.where("key is null")), d["text"].contains(F.col("half")))
    columns = ["doc_id", "text", "item_id", "passage"]
    found = by_key.select(*columns).unionByName(by_all.select(*columns))
    return found.select(F.col("item_id").alias("query_id"), F.col("doc_id").cast("string").alias("page_id"), F.when(F.col("text").contains(F.col("passage")), 2).otherwise(1).alias("relevance"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, link): every page names page n div 10, and web pages the targets of their anchors."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.floor(F.col("doc_id") / 10).cast("string").alias("link"))
    anchors = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    web = X.exploded(table(spark, sf_dir, "pages"), anchors, "link", F.col("page_id").cast("string").alias("page_id"))
    return own.union(web)


def relational_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, relation) of the star schema's keys."""
    t = lambda name: table(spark, sf_dir, name)

    def edge(df: DataFrame, a: str, ka: str, b: str, kb: str, relation: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{a}:"), F.col(ka)).alias("source"), F.concat(F.lit(f"{b}:"), F.col(kb)).alias("target"), F.lit(relation).alias("relation"))

    parts = [
        edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "part_of"),
        edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "located_in"),
        edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "located_in"),
        edge(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "placed_by"),
        edge(t("lineitem"), "order", "l_orderkey", "part", "l_partkey", "contains"),
        edge(t("lineitem"), "part", "l_partkey", "supplier", "l_suppkey", "supplied_by"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_key, ts, event_id): views and clicks."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return events.select(F.col("user_id").cast("string").alias("page_key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")

"""JSON lines with their numbers: sound rows in declared types, and a row for everything that is wrong with a line.

A file may be read in many splits. A line's number is its place within its split, which one task reads in order, plus
the lines of the file's splits before it: a sum over as many rows as there are splits. Lines end with \\n, \\r or \\r\\n.

Defined results: blank lines count as lines and say nothing; a line that is no JSON, or JSON but no object, has that one
problem; an object has one problem for each field that is missing, unknown, of another kind, or blank where text is
wanted; numbers are whole where ints are wanted, and true and false are no numbers; a field marked optional may be
missing or null; lines with a problem give no row; a file without lines gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The fields of the tables of an evaluation. A question mark marks what may be missing.
CORPUS = {"doc_id": "string", "path": "string", "title": "string", "adapter": "string", "role": "string", "approved": "bool", "sha256": "string", "source_ref_ids": "strings", "license": "string", "public_source": "string"}
QUERIES = {"query_id": "string", "text": "string", "class": "string", "locale": "string", "expected_behavior": "string"}
QRELS = {"query_id": "string", "doc_id": "string", "relevance": "int", "support_spans": "array", "citation_required": "bool"}
RUNS = {
    "run_id": "string", "query_id": "string", "rank": "int", "doc_id": "string", "score": "float", "citation_ids": "strings", "context_tokens": "int", "payload_tokens": "int", "payload_bytes": "int", "latency_ms": "float", "surface": "string",
    "tokenizer_id": "string", "tokenizer_revision": "string", "source_bytes_scanned": "int?",
}

#: What schema_of_variant says of values of a kind, and what they become.
KINDS = {"string": (r"^STRING$", "string"), "bool": (r"^BOOLEAN$", "boolean"), "int": (r"^BIGINT$", "long"), "float": (r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$", "double"), "strings": (r"^ARRAY<(STRING|VOID)>$", "array<string>"), "array": (r"^ARRAY<.*>$", "string")}


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of text files, lines from 1."""
    at = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = at.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    # a row a split, which the driver holds anyway to plan the read
    return at.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def _problems(v: Column, fields: dict[str, str]) -> Column:
    """What is wrong with an object."""
    each = []
    for name, told in fields.items():
        kind, optional = told.rstrip("?"), told.endswith("?")
        x = F.try_variant_get(v, f"$['{name}']", "variant")
        is_ = F.schema_of_variant(x)
        nothing = x.isNull() | (is_ == "VOID")
        wrong = F.when(~is_.rlike(KINDS[kind][0]), F.lit(f"{name}: not {kind}"))
        if kind == "string":
            wrong = wrong.when(F.trim(F.try_variant_get(v, f"$['{name}']", "string")) == "", F.lit(f"{name}: blank"))
        missing = F.lit(None).cast("string") if optional else F.when(x.isNull(), F.lit(f"{name}: missing")).otherwise(F.lit(f"{name}: not {kind}"))
        each.append(F.when(nothing, missing).otherwise(wrong))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    unknown = F.transform(F.sort_array(F.array_except(keys, F.array(*map(F.lit, fields)))), lambda k: F.concat(k, F.lit(": unknown")))
    return F.concat(F.array_compact(F.array(*each)), unknown)


def checked(spark: SparkSession, path: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The sound rows (file, line, the fields in their types; arrays of other things than strings as JSON), and
    (file, line, problem)."""
    parsed = numbered(spark, path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    object_ = F.schema_of_variant("v").startswith("OBJECT")
    told = F.when(F.col("v").isNull(), F.array(F.lit("invalid JSON"))).when(~object_, F.array(F.lit("not an object"))).otherwise(_problems(F.col("v"), fields))
    judged = parsed.withColumn("problems", told)
    columns = [F.try_variant_get("v", f"$['{n}']", KINDS[k.rstrip("?")][1]).alias(n) for n, k in fields.items()]
    good = judged.where(F.size("problems") == 0).select("file", "line", *columns)
    return good, judged.select("file", "line", F.explode("problems").alias("problem"))

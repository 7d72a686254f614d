"""The inverted index: postings, document lengths, document frequencies, corpus totals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as X
from larkspur.operators.cut import cut


def full_text() -> Column:
    """Title, summary, body, tags and source references of a page."""
    return F.concat_ws(" ", "title", "summary", "text", F.array_join("tags", " "), F.array_join("source_refs", " "))


def authored_text() -> Column:
    return F.concat_ws(" ", "title", "summary", "text", F.array_join("tags", " "))


def literal_text() -> Column:
    return F.concat_ws(" ", "title", "path", "summary", "text", F.array_join("tags", " "), F.array_join("source_refs", " "))


def tokenized(pages: DataFrame, analyzer: str = "legacy") -> DataFrame:
    """pages with tokens and dl; documents are tokenized once, behind no shuffle."""
    if analyzer == "english":
        from larkspur.functions.stem import english_tokens

        made = english_tokens(authored_text())
    elif analyzer == "legacy":
        made = X.legacy_tokens(full_text())
    else:
        raise ValueError(f"unknown analyzer {analyzer!r}: legacy or english")
    return pages.withColumn("tokens", made).withColumn("dl", F.size("tokens").cast("long"))


@dataclass
class Index:
    """postings: token, page_id, tf, dl, approved; doc_stats: page_id, path, role, dl, approved, page_ord; term_stats:
    token, df; corpus_stats: n, avgdl; compound and metadata: token, page_id, tf, approved, of the english analyzer."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    analyzer: str = "legacy"
    compound: DataFrame | None = None
    metadata: DataFrame | None = None
    parts: int | None = None  # tasks that searches deal their scores to; none leaves it to the session
    rows: DataFrame | None = None  # the postings as page_id, dl, approved, terms: a row a page, where there are such

    def visible(self) -> Index:
        """The index of the approved pages: statistics come from the postings left."""
        seen = lambda t: t.where("approved") if t is not None else None
        postings, docs = seen(self.postings), seen(self.doc_stats)
        return Index(postings, docs, frequencies(postings), totals(docs), self.analyzer, seen(self.compound), seen(self.metadata), self.parts, seen(self.rows))


#: Different tokens whose forms a worker keeps.
KNOWN = 1_000_000
#: Tokens of a query set up to which they are pushed into the scan of the postings.
PUSHED = 1000


def totals(tokens: DataFrame) -> DataFrame:
    """One row: the number of pages and their mean length, both 1 at least."""
    return tokens.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def complete(pages: DataFrame) -> DataFrame:
    """pages with the columns that an index takes: all approved where none says, none with a place of its own."""
    given = pages if "approved" in pages.columns else pages.withColumn("approved", F.lit(True))
    return given if "page_ord" in given.columns else given.withColumn("page_ord", F.lit(None).cast("long"))


def counted(pages: DataFrame, analyzer: str = "legacy") -> DataFrame:
    """pages with dl and terms (token, tf): a page's terms are counted within its own row."""
    # bound within one expression, as columns of their own may be put back into the lambdas and run for every token

    def terms(tokens: Column) -> Column:
        # in sorted tokens a term ends where the next token differs; how many there are is the distance between ends
        ends = F.filter(F.transform(tokens, lambda x, i: F.when(F.coalesce(F.get(tokens, i + 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
        each = lambda at, k, ends: F.struct(F.get(tokens, at).alias("token"), (at - F.coalesce(F.when(k > 0, F.get(ends, k - 1)), F.lit(-1))).cast("long").alias("tf"))
        return X.let(ends, lambda ends: F.transform(ends, lambda at, k: each(at, k, ends)))

    return tokenized(pages, analyzer).withColumn("terms", X.let(F.sort_array("tokens"), terms)).drop("tokens")


def narrowed(pages: DataFrame, tokens: list[str], analyzer: str = "legacy", compound: list[str] = (), metadata: list[str] = ()) -> Index:
    """The index of pages as far as these tokens and identifiers go: every page is read and tokenized once, and written
    with its length and its counts of them, as no more is looked at. Their frequencies and the totals are those of the
    whole index."""
    given = complete(pages)
    own = lambda found, names: F.filter(found(), lambda x: x.isin(list(names))) if names else F.array().cast("array<string>")
    english = analyzer == "english"
    channels = {"compound": own(lambda: exact_tokens(authored_text()), compound), "metadata": own(lambda: exact_tokens(metadata_text()), metadata)} if english else {}
    said = given.select("page_id", "path", "role", "approved", "page_ord", *[c.alias(n) for n, c in channels.items()], (authored_text() if english else full_text()).alias("said"))
    kept = [f for f in said.schema.fields if f.name != "said"]
    schema = T.StructType([*kept, T.StructField("dl", T.LongType()), T.StructField("terms", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])))])
    rows = cut(said.mapInArrow(_counter(frozenset(tokens), analyzer, [f.name for f in kept]), schema), "asked")
    docs = rows.select("page_id", "path", "role", "dl", "approved", "page_ord")
    # a page's counts move in one row, so that they can be dealt by page before they are told apart
    terms = rows.where(F.size("terms") > 0).select("page_id", "dl", "approved", "terms")
    postings = unrolled(terms)
    extra = {n: rows.select(F.explode(n).alias("token"), "page_id", F.lit(1).cast("long").alias("tf"), "approved") for n in channels}
    return Index(postings, docs, frequencies(postings), totals(docs), analyzer, **extra, rows=terms)


def _counter(wanted: frozenset[str], analyzer: str, keep: list[str]) -> Callable:
    """Of each row's text the number of tokens, and how often each wanted one occurs: tokenized in Python, which counts
    them without a lambda call for each."""
    if analyzer == "legacy":
        pattern, made = re.compile(X.TOKEN), X.pieces
    elif analyzer == "english":
        from larkspur.functions.stem import analyzed as made

        pattern = re.compile(X.ENGLISH_TOKEN)
    else:
        raise ValueError(f"unknown analyzer {analyzer!r}: legacy or english")
    kind = pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}

        def counts(text: str) -> tuple[int, list[tuple[str, int]]]:
            found = pattern.findall(text)
            n, hits = 0, {}
            # tokens hold no letters beyond ASCII and Hangul, so they may be lowered together
            for t, times in Counter(" ".join(found).lower().split(" ") if found else ()).items():
                if (tokens := known.get(t)) is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    tokens = known[t] = made(t)
                n += times * len(tokens)
                for x in tokens:
                    if x in wanted:
                        hits[x] = hits.get(x, 0) + times
            return n, list(hits.items())

        for batch in batches:
            told = [counts(t) for t in batch.column(batch.schema.get_field_index("said")).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            terms = pa.array([[{"token": x, "tf": k} for x, k in hits] for _, hits in told], kind)
            yield pa.record_batch([*columns, pa.array([n for n, _ in told], pa.int64()), terms], names=[*keep, "dl", "terms"])

    return run


def unrolled(terms: DataFrame) -> DataFrame:
    """Postings of rows with a page's terms."""
    return terms.select(F.explode("terms").alias("x"), "page_id", "dl", "approved").select("x.token", "page_id", "x.tf", "dl", "approved")


def build(pages: DataFrame, analyzer: str = "legacy") -> Index:
    """The index of pages, without storing it; postings need no shuffle."""
    given = complete(pages)
    rows = counted(given, analyzer).select("page_id", "path", "role", "dl", "approved", "page_ord", "terms")
    postings = X.exploded(rows, F.col("terms"), "x", "page_id", "dl", "approved").select("x.token", "page_id", "x.tf", "dl", "approved")
    docs = rows.drop("terms")
    extra = {}
    if analyzer == "english":
        extra = {"compound": exact_channel(given, authored_text()), "metadata": exact_channel(given, metadata_text())}
    return Index(postings, docs, frequencies(postings), totals(docs), analyzer, **extra)


def metadata_text() -> Column:
    return F.concat_ws(" ", "path", F.array_join("source_refs", " "))


def exact_tokens(text: Column) -> Column:
    """A text's identifiers of several parts."""
    return X.compound_tokens(text)


def exact_channel(pages: DataFrame, text: Column) -> DataFrame:
    """(token, page_id, tf, approved): identifiers of several parts, each once a page."""
    found = X.exploded(pages, exact_tokens(text), "token", "page_id", "approved")
    return found.select("token", "page_id", F.lit(1).cast("long").alias("tf"), "approved")


def only(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """The postings of the tokens in wanted (token). Few tokens become a filter that reaches the scan and, where
    postings are clustered by token, skips row groups; more are a join."""
    few = [r["token"] for r in wanted.select("token").distinct().limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:
        return postings.where(F.col("token").isin(few))
    return postings.join(wanted.select("token").distinct(), "token", "left_semi")

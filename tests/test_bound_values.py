"""What lambdas read is worked out once a row: the plan holds each costly pattern as often as the text is read."""

from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import guidance, index

PAGE = "page_id string, path string, title string, text string, summary string, role string, tags array<string>, source_refs array<string>"


def times(df, what: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_terms_are_taken_from_a_text_once(spark):
    texts = ["Strand STRAND strand Zebra zebra", "", None, "a password: hunter22"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    for made in (guidance.terms(F.col("t")), guidance.identifiers(F.col("t"))):
        assert times(df.select(made.alias("x")), "regexp_extract_all(") == 1
    assert [r[0] for r in df.select(guidance.terms(F.col("t")), "t").collect()] == [["Strand", "Zebra"], [], None, []]
    many = spark.createDataFrame([([f"word{i % 300}" for i in range(3000)],)], "w array<string>").repartition(1)
    assert many.select(guidance.distinct_values(F.col("w"), 290, 20)).first()[0] == [f"word{i}" for i in range(290)]


def test_a_page_is_tokenized_once_for_its_postings(spark):
    rows = [("a", "a.md", "Two", "two two one 가나다", "", "topic", ["en"], ["x"]), ("b", "b.md", None, None, None, "topic", [], [])]
    built = index.build(spark.createDataFrame(rows, PAGE).repartition(1))
    assert times(built.postings, "regexp_extract_all(") <= 4  # for dl and for the counts, each in two branches
    assert times(built.term_stats, "regexp_extract_all(") <= 2
    got = {(r["page_id"], r["token"]): (r["tf"], r["dl"]) for r in built.postings.collect()}
    assert got == {("a", t): (n, 9) for t, n in (("two", 3), ("one", 1), ("가나다", 1), ("가나", 1), ("나다", 1), ("en", 1), ("x", 1))}


def test_an_excerpt_is_the_first_good_paragraph(spark):
    text = "toc\n\n```\nlet x = 1\n```\nA paragraph long enough to show\n\nAnother paragraph long enough"
    df = spark.createDataFrame([("", text), ("A summary long enough to show", text), (None, "short")], "s string, t string").repartition(1)
    made = df.select("s", guidance.excerpt(F.col("s"), F.col("t")).alias("e"))
    assert times(made, "<[^>]+>") == 1
    assert {r["s"]: r["e"] for r in made.collect()} == {"": "A paragraph long enough to show", "A summary long enough to show": "A summary long enough to show", None: None}


def test_summaries_are_those_of_the_whole_text(spark):
    # marks, runs of white space and headings at the edge of the part that is read first
    cases = [start for at in range(1, 96) for start in (*("x" * at + tail + "y" * 50 for tail in ("\n### ", "\n###", " \t\n\n ## ", "#", " " * 90)), " " * at * 9 + "end", "# \n" * at)]
    df = spark.createDataFrame([(c,) for c in cases], "t string").repartition(1)
    whole = X.clipped(X.clean(F.regexp_replace("t", r"(?m)^#{1,6}\s+", "")), 10)
    assert all(r[0] == r[1] for r in df.select(X.summary(F.col("t"), 10), whole).collect())

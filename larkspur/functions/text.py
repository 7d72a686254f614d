"""Text scalars of the retrieval engine as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, weights and limits that the results depend on.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.-]*(?:[가-힣]+)?|[가-힣]+"
ENGLISH_TOKEN = r"[A-Za-z0-9]+(?:[가-힣]+|['’]s?)?|[가-힣]+"
# the groups after the first as single characters, no two separators in a row: a repeated group would deepen the stack
COMPOUND = r"(?<![A-Za-z0-9가-힣])[A-Za-z0-9]++[._-][A-Za-z0-9](?:(?![._-]{2})[A-Za-z0-9._-])*(?<=[A-Za-z0-9])[가-힣]*(?![A-Za-z0-9가-힣])"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
)
SNIPPET_LIMIT, SNIPPET_MAX, SNIPPET_BEFORE = 280, 2000, 100
SUMMARY_LIMIT = 360
HEADING = r"(?m)^(#{1,6})\s+(.+?)\s*$"
WIKILINK = r"\[\[([^\]]+)\]\]"
MARKDOWN_LINK = r"\[[^\]]+\]\(([^)]+?\.(?:md|org))(?:#[^)]+)?\)"
# what a relation label is made of, and the links a text names it by
LABEL_TOKEN = r"[0-9A-Za-z]+|[가-힣]+"
NAMED_WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]*)?\]\]"
NAMED_LINK = r"\[[^\]\n]*\]\(([^)\s]+)(?:\s+[\"'][^)]*[\"'])?\)"
INLINE_TAG = r"(?U)(?<![\w/])#([A-Za-z0-9가-힣][A-Za-z0-9가-힣_./-]*)"
TAGS_LINE = r"(?im)^\s*tags::\s*(.+?)\s*$"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(df: DataFrame, values: Column, name: str, *keep: str | Column) -> DataFrame:
    """df's columns to keep and a row a value that is not null. The planner would put a test of its own before a plain
    explode, which works out values twice more."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def clean(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """Case folded: upper then lower joins the sharp s with its pair."""
    return F.lower(F.upper(text))


def clipped(text: Column, limit: int) -> Column:
    """At most limit code points, longer ones cut before the last and marked."""
    return let(text, lambda t: _clipped(t, limit))


def _clipped(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("...")))


def summary(body: Column, limit: int = SUMMARY_LIMIT) -> Column:
    bare = lambda t: clean(F.regexp_replace(t, r"(?m)^#{1,6}\s+", ""))
    # the start tells as much where it fills the limit; its last characters may be marks that the whole would drop
    return let(bare(F.substring(body, 1, 8 * limit)), lambda head: F.when(F.length(head) > limit + 8, _clipped(head, limit)).otherwise(clipped(bare(body), limit)))


def _pieces(token: Column) -> Column:
    """A lower-case token with its parts: both sides of Latin followed by Hangul, bigrams of a longer Hangul run."""
    latin, hangul = F.regexp_extract(token, "^([a-z0-9]+)([가-힣]+)$", 1), F.regexp_extract(token, "^([a-z0-9]+)([가-힣]+)$", 2)
    bigrams = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))
    return (
        F.when(hangul != "", F.array(token, latin, hangul))
        .when(token.rlike("^[가-힣]{3,}$"), F.concat(F.array(token), bigrams))
        .otherwise(F.array(token))
    )


def pieces(token: str) -> list[str]:
    """_pieces of one token in Python."""
    if token.isascii():
        return [token]
    if m := re.fullmatch("([a-z0-9]+)([가-힣]+)", token):
        return [token, m[1], m[2]]
    return [token, *(token[k : k + 2] for k in range(len(token) - 1))] if re.fullmatch("[가-힣]{3,}", token) else [token]


def legacy_tokens(text: Column) -> Column:
    """Tokens in order; the costly part only for texts with Hangul."""

    def tokens(text: Column) -> Column:
        lower = lambda found: F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.split(F.lower(F.array_join(found, " ")), " "))
        plain = let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lower)
        return F.when(text.rlike("[가-힣]"), F.flatten(F.transform(plain, _pieces))).otherwise(plain)

    return let(text, tokens)


def english_raw_tokens(text: Column) -> Column:
    """Lower-case tokens before possessives, stop words and stems."""
    found = F.regexp_extract_all(text, F.lit(ENGLISH_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def without_possessive(token: Column) -> Column:
    return F.regexp_replace(token, "['’]s?$", "")


def compound_tokens(text: Column) -> Column:
    """Distinct identifiers of several parts joined by dot, underscore or hyphen, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(0)), lambda t: F.lower(t)))


def token_weight(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), 0.2).when(token.rlike("^[가-힣]$"), 0.4).otherwise(1.0)


def substring_count(haystack: Column, needle: Column) -> Column:
    """Occurrences that do not overlap."""
    return F.when(F.length(needle) > 0, (F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)).otherwise(0).cast("long")


def snippet(body: Column, tokens: Column, limit: int = SNIPPET_LIMIT) -> Column:
    """A window that starts a little before the first of the tokens, cleaned and clipped."""
    limit = max(0, min(limit, SNIPPET_MAX))
    if limit == 0:
        return F.lit("")
    low = F.lower(body)
    first = F.array_min(F.filter(F.transform(tokens, lambda t: F.position(t, low)), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - SNIPPET_BEFORE)
    window = F.when(first.isNull(), body).otherwise(F.substring(body, start.cast("int"), F.lit(limit)))
    return clipped(clean(window), limit)


def lookup_key(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9가-힣]+", "")


def slug(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "[^A-Za-z0-9가-힣._-]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", F.lit("item")).otherwise(bare)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(?:md|org)$", "")


def page_id(text: Column) -> Column:
    return without_extension(F.replace(F.trim(text), F.lit("\\"), F.lit("/")))


def first_spelling(values: Column) -> Column:
    """Distinct without regard to case, first spellings kept, blanks dropped."""
    keys = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: (v != "") & (F.array_position(keys, F.lower(v)) == i + 1))


def headings(body: Column, most: int = 40) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(body, F.lit(HEADING), F.lit(2)), lambda h: clean(h)), 1, most)


def link_target(value: Column) -> Column:
    bare = F.replace(F.trim(F.regexp_extract(value, "^[^#]*", 0)), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(without_extension(bare), r"^\./", "")


def links(body: Column, alias_last: bool = False) -> Column:
    """Targets of wiki links, then of Markdown links to pages."""
    # without a closing mark every opening one would be followed to the end
    wiki = F.when(body.contains("]]"), F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1))).otherwise(F.array().cast("array<string>"))
    plain = F.when(body.contains("]("), F.regexp_extract_all(body, F.lit(MARKDOWN_LINK), F.lit(1))).otherwise(F.array().cast("array<string>"))
    target = (lambda v: F.regexp_replace(v, r"^[^|]*\|", "")) if alias_last else (lambda v: F.regexp_extract(v, r"^[^|]*", 0))
    both = F.concat(F.transform(wiki, lambda v: link_target(target(v))), F.transform(plain, lambda v: link_target(v)))
    return first_spelling(both)


def inline_tags(body: Column) -> Column:
    """Hash tags that hold a letter, then the words of ``tags::`` lines."""
    hashed = F.transform(F.regexp_extract_all(body, F.lit(INLINE_TAG), F.lit(1)), lambda t: F.regexp_replace(t, r"^[.,;:!?]+|[.,;:!?]+$", ""))
    lines = F.regexp_extract_all(body, F.lit(TAGS_LINE), F.lit(1))
    named = F.flatten(F.transform(lines, lambda v: F.split(clean(F.replace(v, F.lit(","), F.lit(" "))), " ")))
    return first_spelling(F.transform(F.concat(F.filter(hashed, lambda t: t.rlike(r"\p{L}")), named), lambda t: clean(F.regexp_replace(t, "^#+|#+$", ""))))


def truth(value: Column) -> Column:
    """Yes, no, or null for any other word."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("1", "true", "yes", "y", "on"), True).when(low.isin("0", "false", "no", "n", "off"), False)


def parent_folder(path: Column) -> Column:
    found = F.regexp_extract(path, "^(.*)/", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)


def relation(value: Column) -> Column:
    """A relation's canonical name; blank ones are ``related_to``."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(bare == "", F.lit("related_to")).otherwise(bare)


def inline(text: Column, limit: int) -> Column:
    """White space and null characters to one space, the whole within limit, its cut marked by three dots."""
    cut = lambda bare: F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.rtrim(F.substring(bare, 1, max(0, limit - 3))), F.lit("...")))
    return let(clean(F.replace(text, F.lit("\x00"), F.lit(" "))), cut)


def nfc(text: Column) -> Column:
    """Composed Unicode, by the library that Spark itself compares strings with. Texts below U+0300 are composed as they
    are and pass untouched, as most do."""
    made = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike("[^\\x00-\\u02FF]"), made).otherwise(text)


def relation_key(label: Column) -> Column:
    """A label composed, without case, marks and extension, for comparison."""
    return F.regexp_replace(folded(F.regexp_replace(nfc(label), r"\.md$", "")), "[^a-z0-9가-힣]+", "")


def label_forms(label: Column) -> Column:
    """What a label may be called: itself without extension, and its last part with and without extension."""
    bare = F.regexp_replace(F.trim(label), r"\.md$", "")
    last = F.element_at(F.split(bare, "/"), -1)
    return F.array_distinct(F.array(bare, last, F.regexp_replace(last, r"(?<=[^.])\.[^.]*$", "")))


def labels_named(text: Column) -> Column:
    """Keys of the labels that the text's links name."""
    wiki = F.regexp_extract_all(text, F.lit(NAMED_WIKILINK), F.lit(1))
    plain = F.transform(F.regexp_extract_all(text, F.lit(NAMED_LINK), F.lit(1)), lambda t: F.regexp_extract(F.regexp_replace(t, "^[<>]+|[<>]+$", ""), "^[^#?]*", 0))
    return F.filter(F.array_distinct(F.transform(F.flatten(F.transform(F.concat(wiki, plain), label_forms)), relation_key)), lambda k: k != "")


def phrase_stands_in(label: Column, text: Column) -> Column:
    """Whether the label's tokens stand in the text one after another, with nothing but marks between them, from a
    token's start to a token's end."""
    parts = F.transform(F.regexp_extract_all(label, F.lit(LABEL_TOKEN), F.lit(0)), folded)
    bare = F.concat(F.lit(" "), F.regexp_replace(folded(text), "[^0-9a-z가-힣]+", " "), F.lit(" "))
    return (F.size(parts) > 0) & F.regexp_like(bare, F.concat(F.lit(" "), F.array_join(parts, " ?"), F.lit(" ")))


def label_visible(label: Column, text: Column) -> Column:
    """Whether a text names a label: by a link, or in words."""
    forms = label_forms(label)
    linked = F.arrays_overlap(F.filter(F.transform(forms, relation_key), lambda k: k != ""), labels_named(text))
    return (F.trim(text) != "") & F.coalesce(linked | F.exists(forms, lambda f: phrase_stands_in(f, text)), F.lit(False))

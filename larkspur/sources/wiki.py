"""Wiki folders as page tables: which layout a folder has, its pages, its sidecar graph."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as X
from larkspur.sources import folder

try:
    import yaml
except ImportError:
    yaml = None

# What marks a layout, what is never read, what is not served.
QUARTZ = ("quartz.config.ts", "quartz.config.js", "quartz.config.yaml", "quartz.config.yml")
IGNORED = (".git", ".obsidian", ".foam", "node_modules", ".venv", "__pycache__", "dist", "build")
NATIVE_ROOTS = ("wiki", "openwiki")
HUB_FILES = ("index.md", "overview.md", "hot.md", "critical_facts.md", "quickstart.md")
TYPED_FOLDERS = ("concepts", "entities", "sources", "queries", "comparisons", "synthesis", "syntheses", "projects", "categories", "questions")
MARKER = ".wiki-compiler.json"
BLOCKED = ("draft", "proposed", "needs_review", "blocked", "unpublished", "private", "hidden", "embargoed", "confidential", "internal", "withheld")
STATES = ("approved", "reviewed", "verified", "draft", "proposed", "needs_review")
WITHHELD_STATES = ("draft", "proposed", "needs_review")


@dataclass(frozen=True)
class Layout:
    """How a folder is read."""

    adapter: str
    root: str
    scan_roots: tuple[str, ...]
    path_root: str
    alias_last: bool = False
    namespaced: bool = False
    extensions: tuple[str, ...] = (".md",)
    hub_roots: tuple[str, ...] = field(default=())


def _dendron_vaults(root: str) -> list[str]:
    with open(os.path.join(root, "dendron.yml"), encoding="utf-8") as f:
        data = (yaml.safe_load(f) if yaml else None) or {}
    found = data.get("vaults") or (data.get("workspace") or {}).get("vaults") or []
    names = [v if isinstance(v, str) else str((v or {}).get("fsPath") or "") for v in found]
    return [p for n in names if n and os.path.isdir(p := os.path.join(root, n))]


# -- what folders hold


def included(files: DataFrame) -> DataFrame:
    """The files (path, folder, name, extension) that may count at all: none in folders that are never read, and no
    pages among an editor's settings."""
    parts = F.split("path", "/")
    ignored = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED)))
    return files.where(~ignored & ~(F.array_contains(parts, ".vscode") & F.col("extension").isin(".md", ".org")))


def signals(files: DataFrame) -> DataFrame:
    """(folder, marker, hubs, typed) for every folder that has any sign of being a wiki's root: a marker file, hub pages
    by name, pages anywhere below one of its typed folders. Each file tells its own folder, and a page below a typed
    folder tells the one above that, so one aggregation serves all folders of a tree of any depth."""
    page, name = F.col("extension") == ".md", F.lower("name")
    sign = lambda at, marker, hub, typed: F.struct(at.alias("folder"), marker.alias("marker"), hub.alias("hub"), F.lit(typed).alias("typed"))
    hub = F.when(page & name.isin(*HUB_FILES), name)
    own = sign(F.col("folder"), F.col("name") == MARKER, hub, False)
    inside = F.split("folder", "/")
    places = F.filter(F.sequence(F.lit(1), F.size(inside)), lambda k: page & F.element_at(inside, k).isin(*TYPED_FOLDERS))
    above = F.transform(places, lambda k: sign(F.array_join(F.slice(inside, F.lit(1), k - 1), "/"), F.lit(False), F.lit(None).cast("string"), True))
    told = files.select(F.explode(F.concat(F.array(own), above)).alias("s")).select("s.*").where("marker or hub is not null or typed")
    return told.groupBy("folder").agg(F.max("marker").alias("marker"), F.sort_array(F.collect_set("hub")).alias("hubs"), F.max("typed").alias("typed"))


class _Signs:
    """The signals of the root ('') and its own folders, as the layouts ask for them."""

    def __init__(self, rows) -> None:
        self.of = {r["folder"]: (r["marker"], frozenset(r["hubs"]), r["typed"]) for r in rows}

    def native(self, folder: str, name: str) -> bool:
        """Whether the folder, of this name, is the root of a native wiki."""
        marker, hubs, typed = self.of.get(folder, (False, frozenset(), False))
        if marker or (folder and (hubs or typed)):
            return True
        return not folder and (self._named(name, hubs) or ("hot.md" in hubs and bool(hubs & {"index.md", "overview.md"})) or (bool(hubs) and typed))

    def nested(self, folder: str) -> bool:
        """Whether a folder below the root is likely to be a wiki of its own."""
        marker, hubs, typed = self.of.get(folder, (False, frozenset(), False))
        return marker or typed or self._named(folder, hubs) or len(hubs) >= 2

    def _named(self, name: str, hubs: frozenset[str]) -> bool:
        return name.casefold() in NATIVE_ROOTS and "quickstart.md" in hubs

    def source_root(self, name: str) -> str | None:
        """Of a native wiki the folder with its pages, '' being the root itself."""
        below = next((n for n in NATIVE_ROOTS if n in self.of and self.native(n, n)), None)
        return below if below is not None else "" if self.native("", name) else None

    def hub_roots(self) -> tuple[str, ...]:
        """Folders in which hub names count too."""
        first = [n for n in NATIVE_ROOTS if n in self.of and self.native(n, n)]
        rest = [f for f in sorted(self.of) if f and f not in NATIVE_ROOTS and f not in IGNORED and f != ".vscode" and self.nested(f)]
        return (*first, *rest)


def layout(root: str, spark: SparkSession | None = None) -> Layout:
    """The first layout that the folder's markers show, in the fixed order of the adapters. With a session, the folder's
    contents decide which folder is a native wiki's root and in which folders hub names count; else folder names do."""
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such wiki folder: {root}")

    def own(*p: str) -> bool:
        path = os.path.join(root, *p)
        return os.path.exists(path) and not os.path.islink(path) and os.path.realpath(path).startswith(os.path.realpath(root))

    def signs(at: str) -> _Signs:
        if spark is None:
            return _Signs([])
        # the root's own folders only, however deep the tree
        return _Signs(signals(included(folder.files(spark, at, contents=False))).where(~F.contains("folder", F.lit("/"))).collect())

    has, sub = own, lambda p: os.path.join(root, p)
    if has(".obsidian"):
        return Layout("obsidian", root, (root,), root, hub_roots=signs(root).hub_roots())
    if has("logseq", "config.edn") or (os.path.isdir(sub("pages")) and os.path.isdir(sub("journals"))):
        return Layout("logseq", root, tuple(sub(p) for p in ("pages", "journals") if os.path.isdir(sub(p))), root, namespaced=True, extensions=(".md", ".org"))
    if has("dendron.yml"):
        vaults = _dendron_vaults(root)
        return Layout("dendron", root, tuple(vaults) or (root,), vaults[0] if len(vaults) == 1 else root, alias_last=True)
    if has(".foam"):
        return Layout("foam", root, (root,), root, hub_roots=signs(root).hub_roots())
    if has(".vscode", "extensions.json"):
        with open(sub(".vscode/extensions.json"), encoding="utf-8") as f:
            if "foam" in f.read().lower():
                return Layout("foam", root, (root,), root, hub_roots=signs(root).hub_roots())
    if any(has(q) for q in QUARTZ):
        content = sub("content") if has("content") and os.path.isdir(sub("content")) else root
        return Layout("quartz", root, (content,), content, hub_roots=signs(content).hub_roots())
    found = signs(root)
    source = found.source_root(os.path.basename(root)) if spark is not None else next((n for n in NATIVE_ROOTS if os.path.isdir(sub(n))), None)
    if source is not None:
        return Layout("native", root, (sub(source) if source else root,), sub(source) if source else root)
    return Layout("markdown", root, (root,), root, hub_roots=found.hub_roots())


@F.pandas_udf(T.StringType())
def _frontmatter(block: pd.Series) -> pd.Series:
    """The block's mapping as JSON, {} for other values, null for broken YAML."""

    def one(b):
        if b is None:
            return None
        try:
            data = yaml.safe_load(b) if yaml else dict((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in b.splitlines()) if k.strip())
        except Exception as e:
            if yaml and isinstance(e, yaml.YAMLError):
                return None
            raise
        return json.dumps(data if isinstance(data, dict) else {}, default=str, ensure_ascii=False)

    return block.map(one)


def _list(fm: Column, *names: str) -> Column:
    """The first named entry that is there, as a list of cleaned strings."""
    each = []
    for n in names:
        raw = F.get_json_object(fm, f"$.{n}")
        each.append(F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull() & (raw != ""), F.array(raw)))
    found = F.coalesce(*each, F.array().cast("array<string>"))
    return X.first_spelling(F.transform(found, lambda v: X.clean(F.coalesce(v, F.lit("")))))


def _entry(fm: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(fm, f"$.{n}"), F.lit("")) for n in names])


def status_word(value: Column) -> Column:
    return F.regexp_replace(X.clean(F.replace(F.lower(value), F.lit("-"), F.lit(" "))), " ", "_")


def parsed(raw: DataFrame, alias_last: bool = False, namespaced: bool = False) -> DataFrame:
    """Pages from (path, raw, hub): hub says whether the file lies in a root where hub names count."""
    end = F.position(F.lit("\n---"), F.substring("raw", F.lit(5), F.length("raw")))
    framed = F.col("raw").startswith("---\n") & (end > 0)
    block = F.when(framed, F.substring("raw", F.lit(5), end - 1))
    body_start = end + 8
    withfm = raw.withColumn("fm0", _frontmatter(block))
    fine = withfm.withColumn("fm", F.coalesce("fm0", F.lit("{}"))).withColumn("body", F.when(framed & F.col("fm0").isNotNull(), F.substring("raw", body_start, F.length("raw"))).otherwise(F.col("raw")))
    fm, body, name = F.col("fm"), F.col("body"), F.lower(F.element_at(F.split("path", "/"), -1))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    stem = F.replace(stem, F.lit("___"), F.lit("/")) if namespaced else stem
    heading = F.nullif(X.clean(F.regexp_extract(body, X.HEADING, 2)), F.lit(""))
    role = F.when(~F.col("hub"), "topic").when(name == "hot.md", "hot").when(name.isin("index.md", "quickstart.md"), "index").when(name == "overview.md", "overview").otherwise("topic")
    state = X.clean(F.lower(F.coalesce(_entry(fm, "review_state", "state"), F.lit(""))))
    review = F.when(state.isin(*STATES), state).otherwise("unknown")
    status = X.clean(F.coalesce(_entry(fm, "status"), F.lit("")))
    flag = lambda n: X.truth(F.get_json_object(fm, f"$.{n}"))
    served = ~F.coalesce(flag("draft"), F.lit(False)) & F.coalesce(flag("published"), F.lit(True)) & F.coalesce(flag("publish"), F.lit(True)) & ~review.isin(*WITHHELD_STATES) & ~status_word(status).isin(*BLOCKED)
    return fine.select(
        X.page_id(F.coalesce(_entry(fm, "id", "object_id"), F.col("path"))).alias("page_id"),
        X.clean(F.coalesce(_entry(fm, "title"), heading, F.replace(stem, F.lit("-"), F.lit(" ")))).alias("title"),
        "path", role.alias("role"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("text"), X.summary(body).alias("summary"), fm.alias("frontmatter"),
        review.alias("review_state"), status.alias("status"), _list(fm, "source_refs", "sources").alias("source_refs"),
        X.first_spelling(F.concat(_list(fm, "tags"), X.inline_tags(body))).alias("tags"), X.links(body, alias_last).alias("links"), X.headings(body).alias("headings"),
        X.clean(F.coalesce(_entry(fm, "updated_at", "last_updated"), F.lit(""))).alias("updated_at"), served.alias("approved"),
    )


def pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages of a wiki folder in the order of their paths; page_ord grows with it. A folder without pages is an
    error when it is read by the first action that needs a row: see ``checked``."""
    how = layout(root, spark)
    below = os.path.relpath(how.path_root, how.root)
    cut = 0 if below == "." else len(below) + 1
    scan = ["" if r == how.root else os.path.relpath(r, how.root) for r in how.scan_roots]
    found = included(folder.files(spark, how.root, below=scan, extensions=how.extensions))
    rows = found.select(F.substring("path", F.lit(cut + 1), F.length("path")).alias("path"), F.substring("folder", F.lit(cut + 1), F.length("folder")).alias("folder"), "raw")
    hub = F.col("folder").isin("", *how.hub_roots)
    out = parsed(rows.select("path", "raw", hub.alias("hub")), how.alias_last, how.namespaced)
    return out.orderBy("path").withColumn("page_ord", F.monotonically_increasing_id())


def checked(spark: SparkSession, root: str) -> DataFrame:
    """pages, or an error where there are none."""
    found = pages(spark, root)
    if found.isEmpty():
        raise FileNotFoundError(f"no supported wiki files under {root}")
    return found


def described(spark: SparkSession, root: str) -> tuple[str, str]:
    """The wiki's title and description: those that its first index page names, or its first overview page; else that
    page's own title, else the folder's name."""
    hubs = pages(spark, root).where("role in ('index', 'overview')")
    first = hubs.orderBy(F.when(F.col("role") == "index", 0).otherwise(1), "page_ord").select("title", _entry(F.col("frontmatter"), "wiki_title").alias("wiki"), _entry(F.col("frontmatter"), "description").alias("said")).first()
    if first is None:
        return os.path.basename(os.path.abspath(root)), ""
    return first["wiki"] or first["title"], first["said"] or ""


EDGE = "struct<from:string,source:string,to:string,target:string,type:string,relation:string,confidence:string>"


def sidecar_edges(spark: SparkSession, root: str) -> DataFrame:
    """(source, target, type, confidence) of graph/graph.json, an array or an object with edges; a broken file has
    none. A confidence that is no number is null."""
    path = os.path.join(root, "graph", "graph.json")
    if not os.path.isfile(path):
        return spark.createDataFrame([], "source string, target string, type string, confidence double")
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    each = F.coalesce(F.from_json(F.try_variant_get(v, "$.edges", "string"), f"array<{EDGE}>"), F.from_json(F.when(F.trim("value").startswith("["), F.col("value")), f"array<{EDGE}>"))
    e = raw.select(F.explode(each).alias("e"))
    number = F.when(F.col("e.confidence").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.col("e.confidence").cast("double"))
    return e.select(F.trim(F.coalesce("e.from", "e.source", F.lit(""))).alias("source"), F.trim(F.coalesce("e.to", "e.target", F.lit(""))).alias("target"), F.coalesce("e.type", "e.relation").alias("type"), number.alias("confidence")).where("source != '' and target != ''")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file under a declared schema; a broken line ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def beir(spark: SparkSession, corpus_path: str, queries_path: str, qrels_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, queries and judgements from a corpus, queries and tab-separated judgements."""
    c = jsonl(spark, corpus_path, "_id string, title string, text string").select(F.col("_id").alias("page_id"), "title", "text")
    q = jsonl(spark, queries_path, "_id string, text string").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    r = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(qrels_path)
    return c, q, r.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("page_id"), F.col("score").alias("relevance"))

"""Main text of web pages through a site style tree.

First pass: each page is parsed into block elements. Pages of a host are merged into one tree, whose nodes are the
element paths (tag and leading class or id). For each node it is measured how much of which page one is on what it
holds (content) and its child sequence (presentation) tell: the mutual information of page and value, in units of the
logarithm of the pages that hold the path; importance is 0.9 content + 0.1 presentation. Every page counts one, shared
evenly among its different values, so a page that repeats a block weighs no more than others. Where a node is far
less important than the host's most important one, those of its contents that recur from page to page are a menu,
advert or footer, and are removed; contents of one page stay. Within an article or main element a content must be on
half of the path's pages, and the path must not occur several times a page (cells, headings). Second pass: pages are
parsed again without these contents, and without elements whose tag, role, class or id names a menu, header, footer,
side bar, notice, advert, form or comment section. The first pass sends counts per (host, node, content), so a large
host is spread by content; a host needs MIN_PAGES pages and a content LEAST of them to be told as recurring, others are
cleaned by names alone. ``extract(names=False)`` leaves the names out and shows what the tree does by itself.

A class or id names a role by a whole token ("footer", "site-footer", "sidebar-left"), not by any word in it
("content-sidebar-wrap", "has-sidebar", "comments-open"). An element so named stays if it is or holds the page's
article, or on pages without one most of the text. The article is the largest article or main element outside of named
elements, or one inside of them that holds more than all text outside.

Text: references decoded, white space of a block made one space, blocks joined by a line feed; if the page has a main
element, or articles with no less text than lies outside of them (else they are teasers), only what lies in one counts.

Defined results: null or empty html gives ''; a url without host belongs to no site; a page that is all removed
gives ''; repeated pages count as pages; broken markup is closed where HTML would close it; extra columns pass
through ``extract`` and a column named like a result is replaced by it.
"""

from __future__ import annotations

import html as _html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import join_hot, stash, table

MIN_PAGES = 5
#: Pages that a content must be on at least to count as recurring.
LEAST = 3
#: A branch below this share of the host's largest importance goes.
LOW = 0.5
#: Shares of a path's pages from which a content of an unimportant branch goes: outside and inside of articles.
RECURS, RECURS_IN_MAIN = 0.05, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|[^<]+|<", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROP_TAGS = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg canvas object menu dialog title fieldset".split())
#: Elements without text of the page, dropped with names or without.
UNSEEN = frozenset("head script style noscript template textarea iframe svg canvas object title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs masthead footer sidebar aside widget ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist disqus respond reply replies discussion toolbar pagination pager skip copyright".split()
)
#: Words after a name that leave its element the role, and words before it that say where it stands.
PARTS_OF = frozenset("left right top bottom list area box container wrap wrapper inner outer items item links link slot unit block bar section buttons button form text title trail primary secondary main content col column row wide small large mobile desktop toggle menu nav group panel thread".split())
STATES = frozenset("has with no without is not hide show can js enable disable open closed single".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of the same group, unless a list or table lies between.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body article section div".split())


class _Node:
    __slots__ = ("tag", "path", "dropped", "main", "hash", "kids", "full", "start", "named", "root")

    def __init__(self, tag: str, path: str, dropped: bool, main: bool, start: int = 0, named: bool = False, root: bool = False):
        self.tag, self.path, self.dropped, self.main, self.start = tag, path, dropped, main, start
        self.named, self.root = named, root
        self.hash, self.kids, self.full = 0, 0, False


def _role_of(token: str) -> str:
    """The name in DROP_NAMES, or header, that a class token or id is; else ''."""
    for form in {token.lower(), _CAMEL.sub(r"\1-\2", token).lower()}:
        words = [w for w in _PARTS.findall(form) if not w.isdigit()]
        while len(words) > 1 and words[-1] in PARTS_OF and words[-1] not in DROP_NAMES:
            # what wraps several things is no part of the last one
            if words[-1] in ("wrap", "wrapper", "container", "inner", "outer", "content", "main") and len(words) > 2:
                return ""
            words.pop()
        if not words or words[0] in STATES:
            continue
        if words[-1] in DROP_NAMES or words[-1] == "header":
            return words[-1]
        if words[0] in DROP_NAMES and all(w in PARTS_OF for w in words[1:]):
            return words[0]
    return ""


def _names(attrs: str) -> tuple[str, set[str], str]:
    """The path's label, the roles that class and id name, the role."""
    label, found, role = "", set(), ""
    if "=" in attrs:
        for key, a, b, c in _NAMED.findall(attrs):
            value = a or b or c
            if key.lower() == "role":
                role = value.strip().lower()
            else:
                found.update(map(_role_of, value.split()))
                parts = _PARTS.findall(value.lower())
                label = label or (parts[0].rstrip("0123456789") if parts else "")
    found.discard("")
    return label, found, role


def _kept(blocks: list[tuple[bool, str]], named: list[tuple[int, int]], roots: list[tuple[int, int, bool, bool]]) -> list[str]:
    """The blocks that are main text. named: ranges of elements whose name is in DROP_NAMES; roots: ranges of outermost
    article and main elements, whether main, and whether in a named one."""
    sums = [0]
    for _, said in blocks:
        sums.append(sums[-1] + len(said))
    free = [True] * len(blocks)
    for a, b in named:
        free[a:b] = [False] * (b - a)
    outside = sum(len(said) for ok, (_, said) in zip(free, blocks, strict=True) if ok)
    size = lambda r: sums[r[1]] - sums[r[0]]
    plain = [r for r in roots if not r[3]]
    best = max(plain or roots, key=size, default=None)
    if best and best[3] and size(best) <= outside:
        best = None
    live = [True] * len(blocks)
    for a, b in named:
        if not (best and a <= best[0] and best[1] <= b and size(best)) and (roots or 2 * sums[b] - 2 * sums[a] <= sums[-1]):
            live[a:b] = [False] * (b - a)
    left = [(main, said) for ok, (main, said) in zip(live, blocks, strict=True) if ok and said]
    inside = sum(len(said) for main, said in left if main)
    only = any(r[2] for r in roots) or (inside and 2 * inside >= sum(len(said) for _, said in left))
    return [said for main, said in left if main or not only]


def parse(page: str | None, removed: frozenset[str] | set[str] = frozenset(), visit=None, names: bool = True) -> str:
    """The main text without the removed branches, "path content"; visit(path, content, children, main) is called for
    every element that held text. Without names, no tag, role, class or id tells what goes."""
    if not page:
        return ""
    stack = [_Node("", "", False, False)]
    blocks: list[tuple[bool, str]] = []
    gone: list[tuple[int, int]] = []
    text: list[str] = []
    named: list[tuple[int, int]] = []
    roots: list[tuple[int, int, bool, bool]] = []

    def flush() -> None:
        if text:
            said = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if said:
                top = stack[-1]
                if not top.dropped:
                    blocks.append((top.main, said))
                if visit or removed:
                    code = said.encode("utf-8", "replace")
                    for n in stack:
                        n.hash, n.full = zlib.crc32(code, n.hash), True

    def pop() -> None:
        n = stack.pop()
        if n.named and not n.dropped:
            named.append((n.start, len(blocks)))
        if n.root and not n.dropped:
            roots.append((n.start, len(blocks), n.tag != "article", n.named or any(x.named for x in stack)))
        if visit and n.full:
            visit(n.path, n.hash, n.kids, n.main)
        if removed and n.full and f"{n.path} {n.hash}" in removed:
            gone.append((n.start, len(blocks)))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
            continue
        tag, closing, attrs = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        pop()
                    break
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            pop()
        for k in range(len(stack) - 1, 0, -1) if tag in SIBLINGS else ():
            if stack[k].tag in SIBLINGS[tag]:
                while len(stack) > k:
                    pop()
                break
            if stack[k].tag in SCOPES:
                break
        top = stack[-1]
        top.kids = zlib.crc32(tag.encode(), top.kids)
        if tag in VOID:
            continue
        if tag == "body" and any(n.tag == "head" for n in stack):
            while len(stack) > 1 and stack[-1].tag != "html":
                pop()
            top = stack[-1]
        label, roles, role = _names(attrs)
        path = f"{top.path}/{tag}.{label}" if label else f"{top.path}/{tag}"
        main = top.main or tag in ("article", "main") or role == "main"
        noisy = tag in UNSEEN or names and (tag in DROP_TAGS or role in DROP_ROLES or (not top.main and tag == "header"))
        by_name = names and (tag not in ("html", "body", "main") and not roles.isdisjoint(DROP_NAMES) or not top.main and "header" in roles)
        node = _Node(tag, path, top.dropped or noisy, main, len(blocks), by_name, main and not top.main)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            at = stop.end()
            continue
        stack.append(node)
    flush()
    while len(stack) > 1:
        pop()
    for start, stop in gone:
        blocks[start:stop] = [(False, "")] * (stop - start)
    if not named and not roots:
        return "\n".join(said for _, said in blocks if said)
    return "\n".join(_kept(blocks, named, roots))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over pages. Kinds 0 and 1: contents and child sequences of a path, n pages, w their shares of the page; 2
    and 3: pages that hold the path, w the logarithm of the values a page has; what: 1 in an article, 2 more if the
    path occurs several times; 4: pages of the site."""
    for batch in batches:
        counts: Counter = Counter()
        shares: Counter = Counter()
        for site, page in zip(batch["site"], batch["html"], strict=True):
            held: dict = {}

            def visit(path, content, kids, main, held=held) -> None:
                at = held.setdefault(path, [set(), set(), 0, 0])
                at[0].add(content)
                at[1].add(kids)
                at[2] += 1
                at[3] |= main

            parse(page, visit=visit)
            for path, (*values, times, main) in held.items():
                for kind in (0, 1):
                    for what in values[kind]:
                        counts[site, path, kind, what] += 1
                        shares[site, path, kind, what] += 1 / len(values[kind])
                    place = site, path, 2 + kind, main + 2 * (times > 1)
                    counts[place] += 1
                    shares[place] += math.log(len(values[kind]))
            counts[site, "", 4, 0] += 1
        if counts:
            keys = list(zip(*counts, strict=True))
            yield pd.DataFrame({"site": keys[0], "path": keys[1], "kind": keys[2], "what": keys[3], "n": list(counts.values()), "w": [float(shares[k]) for k in counts]})


def low_branches(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """(site, removed): for each host the recurring contents of its unimportant branches, "path content"."""
    seen = pages.select(host(F.col("url")).alias("site"), "html").where("site is not null and html is not null")
    rows = seen.mapInPandas(_seen, "site string, path string, kind int, what long, n long, w double")
    counts = stash(rows.groupBy("site", "path", "kind", "what").agg(F.sum("n").alias("n"), F.sum("w").alias("w")), "branches")
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    sums = counts.where("kind < 4").groupBy("site", "path").agg(
        *[of(k, F.col("w") * F.log("w")).alias(f"s{k}") for k in (0, 1)], *[of(k, F.col("w")).alias(f"s{k}") for k in (2, 3)],
        of(2, F.col("n")).alias("held"), F.max(F.when(F.col("kind") == 2, F.col("what") % 2)).alias("main"), F.sum(F.when((F.col("kind") == 2) & (F.col("what") >= 2), F.col("n")).otherwise(0)).alias("several"),
    )
    # entropy of the values less that within a page, over log(pages); a node of one page tells nothing and counts as important
    spread = lambda a, b: F.when(F.col("held") > 1, (F.log("held") - (F.col(a) + F.col(b)) / F.col("held")) / F.log("held")).otherwise(1.0)
    nodes = sums.withColumn("importance", 0.9 * spread("s0", "s2") + 0.1 * spread("s1", "s3"))
    sizes = counts.where("kind = 4").select("site", F.col("n").alias("pages"))
    best = nodes.groupBy("site").agg(F.max("importance").alias("best"))
    below = nodes.join(best, "site").join(sizes, "site").where((F.col("pages") >= min_pages) & (F.col("held") >= min_pages) & (F.col("importance") < low * F.col("best")))
    least = F.greatest(F.lit(LEAST), F.col("held") * F.when(F.col("main") == 0, RECURS).otherwise(RECURS_IN_MAIN))
    judged = below.where("main = 0 or 2 * several < held").select("site", "path", least.alias("least"))
    # a path's contents that so many pages hold are few: as many as a page has, over the share
    recurring = counts.where("kind = 0").join(judged, ["site", "path"]).where("n >= least")
    return recurring.groupBy("site").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "path", "what"))).alias("removed"))


def _text(names: bool):
    def run(page: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([parse(p, frozenset(r) if r is not None else frozenset(), names=names) for p, r in zip(page, removed, strict=True)], dtype=object)

    run.__annotations__ = {"page": pd.Series, "removed": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW, names: bool = True) -> DataFrame:
    """pages with text and n_chars."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    joined = join_hot(pages.withColumn("site", host(F.col("url"))), low_branches(pages, min_pages, low), "site")
    done = joined.select(*kept, _text(names)("html", "removed").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op3_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")

"""Chunks of pages for vectors: paragraphs under their headings, packed to a number of words and characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Sizes.
MAX_CHARS, MAX_WORDS, MIN_ROOM = 1200, 180, 200
#: Pages whose chunks a worker holds at a time.
TOGETHER = 256
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_WORD = re.compile(r"\S+")


def paragraphs(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, headings above) of every paragraph."""
    trail: list[str] = []
    start = end = None
    at = 0
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        head = _HEADING.match(bare)
        if head or not bare:
            if start is not None:
                yield start, end, list(trail)
            start = None
            if head:
                trail = [*trail[: len(head[1]) - 1], " ".join(head[2].split())]
        else:
            start = at if start is None else start
            end = at + len(line.rstrip("\r\n"))
        at += len(line)
    if start is not None:
        yield start, end, list(trail)


def packed(text: str, room: int) -> Iterator[tuple[int, int]]:
    """Spans of words that fit; a word longer than a chunk is cut."""
    first = last = None
    n = 0
    for m in _WORD.finditer(text):
        if n and (m.end() - first > room or n >= MAX_WORDS):
            yield from ((s, min(last, s + MAX_CHARS)) for s in range(first, last, MAX_CHARS))
            n = 0
        first, last, n = (m.start() if n == 0 else first), m.end(), n + 1
    if n:
        yield from ((s, min(last, s + MAX_CHARS)) for s in range(first, last, MAX_CHARS))


def page_chunks(title: str, text: str) -> Iterator[tuple[int, int, str, str]]:
    for start, end, trail in paragraphs(text):
        crumb = " > ".join(t for t in trail if t)
        head = " ".join(title.split())
        prefix = f"{head} {crumb}".strip() if crumb and crumb.casefold() != head.casefold() else head
        for a, b in packed(text[start:end], max(MIN_ROOM, MAX_CHARS - len(prefix) - 1)):
            whole = " ".join(f"{prefix} {text[start + a : start + b]}".split())
            if len(whole) > MAX_CHARS:
                cut = whole[:MAX_CHARS]
                space = cut.rfind(" ")
                whole = (cut[:space] if space >= MAX_CHARS // 2 else cut).rstrip()
            if whole:
                yield start + a, start + b, crumb, whole


def chunks(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, start, end, heading, chunk) of pages (page_id, title, text); headings carry over lines, so each
    page is read in order within its Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, max(len(b), 1), TOGETHER):
                part = b.iloc[at : at + TOGETHER]
                rows = [(p, k, *c) for p, t, x in zip(part["page_id"], part["title"], part["text"], strict=True) for k, c in enumerate(page_chunks(t or "", x or ""))]
                yield pd.DataFrame(rows, columns=["page_id", "ordinal", "start", "end", "heading", "chunk"])

    return pages.select("page_id", "title", "text").mapInPandas(run, "page_id string, ordinal int, start int, end int, heading string, chunk string")

"""Benchmark decontamination: Wu-Manber search for every window of test-item words in whole documents.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words is one window. Texts are brought to one form,
words in lower case between single blanks, and a window's bytes, blanks at both ends included, are a pattern: what
matches is made of whole words. Patterns of similar length share tables: of the first m bytes of each, m being the
shortest pattern's length, every block of B bytes has its distance from the end in the shift table (a block in no
pattern has m - B + 1), and the last block's hash leads to the bucket of patterns that end with it. Where the block that
ends at a cursor has a shift, the cursor jumps; where it has none, the bucket's patterns are compared, first eight bytes,
then all of them. Many cursors move at once, one in each stretch of ``LANE`` bytes, so that a step is a few array
operations.

Items are cut into stretches that overlap by a window less one word and are dealt into tables of about ``TABLE_BYTES``
at most, which is what is broadcast at a time; each table is one pass over the documents, and results of several are
joined by a 128-bit hash of the text, found rows only. With any number of tables the result is the same. Memory a task
does not grow with the items' number; it grows with the longest single text.

Defined results: null and empty texts have no words and no hits; items without words have no windows; rows of one item_id
are one item; all rows without one are one more item, counted but without a name in the list; a repeated document is found
each time; an empty table of items leaves all documents clean, an empty table of documents gives an empty result; other
columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import hash_pair, join_hot, table, utf8_rows

WINDOW = 10
TABLE_BYTES = 2_000_000
#: Words of an item's stretch, bytes of a cursor's stretch, and bytes of text that are searched at a time.
STRETCH, LANE, TOGETHER = 1000, 1024, 4_000_000
#: Patterns are searched in classes by length, so that one short pattern does not shorten the jumps of all.
CLASSES = (3, 8, 16, 32)
BLOCK, TABLE_BITS = 8, 18
#: What stands between documents: no byte of UTF-8.
EDGE = 0xFF
_WORDLESS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _forms() -> np.ndarray:
    """For every byte what it counts as: letters in lower case, digits and bytes of other characters as they are, else a blank."""
    form = np.full(256, ord(" "), dtype=np.uint8)
    for first, last, shift in (("0", "9", 0), ("a", "z", 0), ("A", "Z", 32)):
        form[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1) + shift
    form[0x80:] = np.arange(0x80, 0x100)
    return form


FORMS = _forms()


def words(text: Column) -> Column:
    """The words of a text in order, in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _WORDLESS), lambda w: w != "")


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; data ends with eight bytes of padding."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, dtype=np.uint8)])


def _low_bytes(n) -> np.ndarray:
    """A mask of the lowest n bytes of eight."""
    n = np.minimum(np.asarray(n, dtype=np.uint64), np.uint64(8))
    return np.where(n == 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * (n % np.uint64(8)))) - np.uint64(1))


class _Shifts:
    """Shift table and buckets of patterns (start, size) in blob that are of one class of lengths."""

    def __init__(self, blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.m = int(size.min())
        self.block = min(BLOCK, self.m)
        self.mask = _low_bytes(self.block)
        ends = self.m - self.block
        eights = _eights(blob)
        self.shift = np.full(1 << TABLE_BITS, min(ends + 1, 255), dtype=np.uint8)
        for at in range(ends + 1):
            # later blocks are nearer to the end: the least shift of a place is written last
            self.shift[self.places(eights[start + at])] = min(ends - at, 255)
        last = self.places(eights[start + ends])
        order = np.argsort(last, kind="stable")
        self.start, self.size, self.number = start[order], size[order], order
        self.bucket = np.searchsorted(last[order], np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)

    def places(self, eights: np.ndarray) -> np.ndarray:
        return ((eights & self.mask) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, blob: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in text, pattern's number in its class) of every occurrence. text is padded."""
        n, ends = len(text) - 8, self.m - self.block
        eights = _eights(text)
        at = np.arange(0, max(n, 0), LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n - self.m + 1)
        at, stop = at[at < stop], stop[at < stop]
        places, cells = [], []
        while len(at):
            cell = self.places(eights[at + ends])
            jump = self.shift[cell]
            here = jump == 0
            if here.any():
                places.append(at[here])
                cells.append(cell[here])
            at = at + np.maximum(jump, 1)
            inside = at < stop
            at, stop = at[inside], stop[inside]
        none = np.zeros(0, dtype=np.int64)
        if not places:
            return none, none
        place, cell = np.concatenate(places), np.concatenate(cells)
        first, many = self.bucket[cell], self.bucket[cell + 1] - self.bucket[cell]
        place, first, many = place[many > 0], first[many > 0], many[many > 0]
        out = [(none, none)]
        upto = np.cumsum(many, dtype=np.int64)
        begin = 0
        while begin < len(place):
            # some hundred thousand pairs at a time, one place's bucket at least
            done = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 500_000)))
            k = many[begin:done]
            inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            out.append(self._equal(_eights(blob), eights, n, np.repeat(place[begin:done], k), np.repeat(first[begin:done], k) + inner))
            begin = done
        return np.concatenate([o[0] for o in out]), self.number[np.concatenate([o[1] for o in out])]

    def _equal(self, pattern8: np.ndarray, text8: np.ndarray, n: int, place: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of a place and a pattern those that agree in every byte."""
        fits = place + self.size[own] <= n
        place, own = place[fits], own[fits]
        for byte in range(0, int(self.size.max()), 8):
            open_ = self.size[own] > byte
            if not open_.any():
                break
            rest = _low_bytes(np.maximum(self.size[own] - byte, 0))
            away = np.where(open_, byte, 0)
            same = ~open_ | ((pattern8[self.start[own] + away] ^ text8[place + away]) & rest == 0)
            place, own = place[same], own[same]
        return place, own


class Patterns:
    """The windows of some stretches of items, ready to be searched."""

    def __init__(self, rows: Sequence[tuple[str | None, str]], window: int) -> None:
        blob, found, start, size, owners = bytearray(), {}, [], [], []
        self.ids = list(dict.fromkeys(i for i, _ in rows))
        number = {i: k for k, i in enumerate(self.ids)}
        for item, stretch in rows:
            raw = f" {stretch} ".encode()
            edge = [k for k, b in enumerate(raw) if b == 32]
            base = len(blob)
            blob += raw
            step = min(window, len(edge) - 1)
            for a, b in zip(edge, edge[step:]):
                key = raw[a : b + 1]
                k = found.setdefault(key, len(found))
                if k == len(start):
                    start.append(base + a)
                    size.append(len(key))
                    owners.append(set())
                owners[k].add(number[item])
        self.blob = _padded(np.frombuffer(bytes(blob), dtype=np.uint8))
        start, size = np.array(start, dtype=np.int64), np.array(size, dtype=np.int64)
        self.size, self.owners = size, [tuple(o) for o in owners]
        self.classes = []
        for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62)):
            own = np.flatnonzero((size >= low) & (size < high))
            if len(own):
                self.classes.append((own, _Shifts(self.blob, start[own], size[own])))

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence in padded text."""
        found = [(p, own[k]) for own, shifts in self.classes for p, k in [shifts.search(self.blob, text)]]
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty, *(f[0] for f in found)]), np.concatenate([empty, *(f[1] for f in found)])


def _one_form(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of text as their words between single blanks, rows between edges; with it the places of edges and of blanks."""
    begin = offsets - offsets[0]
    edges = np.tile(np.array([32, EDGE, 32], dtype=np.uint8), len(begin))
    text = np.insert(FORMS[data[offsets[0] : offsets[-1]]], np.repeat(begin, 3), edges)
    blank = text == 32
    keep = np.ones(len(text), dtype=bool)
    np.logical_and(blank[1:], blank[:-1], out=keep[1:])
    np.logical_not(keep[1:], out=keep[1:])
    text = text[keep]
    return _padded(text), np.flatnonzero(text == EDGE), np.flatnonzero(text == 32)


def _runs(flags: np.ndarray) -> list[dict]:
    change = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(change[::2], change[1::2])]


def _searcher(held, keep: list[str]) -> Callable:
    """Adds n_words, spans and items to the kept columns of batches, whose last column is the text."""

    def together(data: np.ndarray, offsets: np.ndarray, spans: list, items: list, base: int) -> np.ndarray:
        text, edge, blank = _one_form(data, offsets)
        first = np.searchsorted(blank, edge)
        place, pattern = held.value.search(text)
        if len(place):
            cover = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + held.value.size[pattern] - 1, -1)
            hit = np.cumsum(cover)[blank] > 0  # a blank inside an occurrence stands before one of its words
            row = np.searchsorted(edge, place) - 1
            order = np.argsort(row, kind="stable")
            rows, at = np.unique(row[order], return_index=True)
            for r, own in zip(rows, np.split(pattern[order], at[1:])):
                spans[base + r] = _runs(hit[first[r] : first[r + 1] - 1])
                owners = {o for k in np.unique(own) for o in held.value.owners[k]}
                items[base + r] = [held.value.ids[o] for o in sorted(owners)]
        return np.diff(first) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column(batch.num_columns - 1))
            n = batch.num_rows
            spans, items, count = [[]] * n, [[]] * n, np.zeros(n, dtype=np.int64)
            begin = 0
            while begin < n:
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + TOGETHER, side="right")) - 1)
                count[begin:end] = together(data, offsets[begin : end + 1], spans, items, begin)
                begin = end
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            found = [pa.array(count), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            yield pa.record_batch([*batch.columns[:-1], *found], names=[*keep, "n_words", "spans", "items"])

    return run


def _stretches(items: DataFrame, window: int) -> DataFrame:
    """(item, stretch): the items' words, long items in overlapping stretches that hold each window once."""
    each = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(STRETCH))
    cut = each.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, F.lit(STRETCH + window - 1)).alias("w"))
    return cut.select("item", F.array_join("w", " ").alias("stretch")).distinct()


def _scan(docs: DataFrame, keep: list[str], patterns: Patterns) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(patterns)
    found = T.StructType.fromDDL("n_words long, spans array<struct<start:int,stop:int>>, items array<string>")
    schema = T.StructType([*docs.select(*keep).schema.fields, *found.fields])
    return docs.select(*keep, "text").mapInArrow(_searcher(held, keep), schema)


def occurrences(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """For every row of docs (text and the kept columns): n_words; n_hit, its words inside occurrences of windows of
    items (item_id, text); spans, these as runs of word numbers from 0, in order (runs of several tables may overlap);
    and items, the distinct ids of the items found (null: those without one)."""
    keep = list(keep)
    rows = _stretches(items, window)
    total = rows.agg(F.sum(F.octet_length("stretch") + 16)).first()[0] or 0
    n = 1 + 2 * total // table_bytes  # half full in the mean, as they are dealt by a hash
    dealt = rows.withColumn("t", F.pmod(F.xxhash64("item", "stretch"), F.lit(n))) if n > 1 else rows.withColumn("t", F.lit(0))
    tables = [Patterns([(r["item"], r["stretch"]) for r in dealt.where(F.col("t") == k).collect()], window) for k in range(n)]
    given = docs.select(*keep, "text") if n == 1 else docs.select(*keep, hash_pair("text").alias("__text"), "text")
    found = _scan(given, keep if n == 1 else [*keep, "__text"], tables[0])
    if n > 1:
        each = [_scan(given, ["__text"], t).where(F.size("spans") > 0).dropDuplicates(["__text"]) for t in tables[1:]]
        more = reduce(DataFrame.union, each).groupBy("__text").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
        joined = join_hot(found, more, "__text")
        both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b))
        found = joined.select(*keep, "n_words", F.array_sort(both("spans", "__spans")).alias("spans"), F.array_distinct(both("items", "__items")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    longer = lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto"))
    n_hit = F.aggregate("spans", start, longer, lambda a: a["n"])
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), "spans", "items")


def op11_bench_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = rf"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
i as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
win as (select distinct item_id, k, array_to_string(w[s : s + k - 1], ' ') g from (select item_id, w, least(len(w), {WINDOW}) k, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) s from i where len(w) > 0)),
pos as (select rid, s, k, array_to_string(w[s : s + k - 1], ' ') g from (select rid, w, unnest(range(1, len(w) + 1)) s from d), (select distinct k from win) where s + k - 1 <= len(w)),
hits as materialized (select rid, s, k, item_id from pos join win using (k, g)),
n_hit as (select rid, count(distinct p) n from (select rid, unnest(range(s, s + k)) p from (select distinct rid, s, k from hits)) group by 1),
ids as (select rid, count(*) n_items, string_agg(id, ',' order by id) s from (select distinct rid, item_id::varchar id from hits) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n, 0) > 0 contaminated
from d left join n_hit using (rid) left join ids using (rid)"""

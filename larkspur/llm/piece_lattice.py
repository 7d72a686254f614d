"""SentencePiece encoding and decoding as a relational lattice.

Text is escaped (a space is the piece mark, one mark goes in front) and cut into words where no piece of the model
crosses. The distinct words are exploded into their substrings of at most the longest piece's length, an equi-join to
the piece table keeps those that are pieces, the edges are grouped by word again, and a fold with Spark's ``aggregate``
turns each word's edges into its pieces. For a unigram model the fold is Viterbi. A BPE model's result is not the
best path but what its merges leave, so for it the fold applies, over the same edges, the best-scored merge again and
again (leftmost of equals). Characters without a piece become bytes.

Documents are then encoded by word. Words that occur often, ``HEAD`` at most, come from the table of the relational
lattice, which is broadcast; its size is bounded by that parameter. The rest, each too rare for the table, go through
the same fold over the same edges within the Arrow batch that holds them, so no occurrence is ever shuffled. A batch is
cut at single spaces and dictionary-encoded by column functions: Python sees each distinct stretch of ``BYTES`` of text
once, and the ids of all occurrences are taken from theirs as arrays. The batch's new words are folded together, as
arrays: every round joins the best neighbours of each word.

Decoding is DataFrame functions only: pieces are looked up in a constant array, byte pieces included, and joined.

Defined results: null text gives null ids; an empty text gives none; white space is kept; the piece mark itself decodes
to a space, as in the library; repeated rows are encoded one by one; null ids decode to null and ids outside the table
to nothing; extra columns pass through, a column named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import let, stash, table, unstash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
HEAD = 100_000
#: Bytes of text encoded at a time.
BYTES = 2_000_000
#: Characters up to which a word is folded among others; a longer one goes through a queue.
TOGETHER = 200
#: From the finest cut to the coarsest; the first one that cuts no piece is used.
CUTS = (r"▁*+[\p{L}\p{M}]++|▁*+[^\p{L}\p{M}▁]++|▁++", r"▁*+[^▁]++|▁++", r"(?s:.++)")


@dataclass(frozen=True)
class Pieces:
    """A model's piece table; its size is the vocabulary's."""

    rows: tuple[tuple[str, float, int], ...]
    bytes_: tuple[int, ...]
    texts: tuple[str, ...]
    unknown: int
    longest: int
    cut: str

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.vocab_size())
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in ids]
        rows = tuple((m.id_to_piece(i), m.get_score(i), i) for i in ids if not special[i])
        codes = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        # as hexadecimal UTF-8, so that byte pieces join up to characters
        texts = tuple(m.id_to_piece(i)[3:5] if m.is_byte(i) else "" if m.is_control(i) else " ⁇ ".encode().hex() if m.is_unknown(i) else m.id_to_piece(i).replace(MARK, " ").encode().hex() for i in ids)
        cut = next(c for c in CUTS if c == CUTS[-1] or all(regex.fullmatch(c, p) for p, _, _ in rows))
        return Pieces(rows, tuple(codes[b] for b in range(256)) if len(codes) == 256 else (), texts, m.unk_id(), max(len(p) for p, _, _ in rows), cut)

    def frame(self, spark: SparkSession) -> DataFrame:
        piece, score, id_ = zip(*self.rows, strict=True) if self.rows else ((), (), ())
        return spark.createDataFrame(pa.table({"piece": pa.array(piece, pa.string()), "score": pa.array(score, pa.float64()), "id": pa.array(id_, pa.int32())}))


def escaped(text: Column) -> Column:
    return F.when(text == "", text).otherwise(F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK))))


def words(text: Column, pieces: Pieces) -> Column:
    return F.regexp_extract_all(escaped(text), F.lit(pieces.cut), F.lit(0))


def lattice(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges): for each word of distinct (word) its substrings that are pieces, as a map to (score, id)."""
    n = F.length("word")
    starts = F.sequence(F.lit(1), n)
    cuts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - i + 1)), lambda k: F.substring("word", i, k))))
    parts = distinct.select("word", F.explode(F.array_distinct(cuts)).alias("piece"))
    found = parts.join(F.broadcast(pieces.frame(distinct.sparkSession)), "piece")
    edges = found.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("piece", F.struct("score", "id")))).alias("edges"))
    return distinct.join(edges, "word", "left").select("word", F.coalesce("edges", F.create_map().cast("map<string,struct<score:double,id:int>>")).alias("edges"))


def _ids(parts: Column, edges: Column, pieces: Pieces) -> Column:
    """Ids of the parts of a word; a part without a piece is one character, given as bytes or unknown."""

    def one(p: Column) -> Column:
        known = F.try_element_at(edges, p)["id"]
        if not pieces.bytes_:
            return F.array(F.coalesce(known, F.lit(pieces.unknown)))
        table_ = F.array(*[F.lit(b) for b in pieces.bytes_])
        code = F.hex(F.encode(p, "UTF-8"))
        raw = F.transform(F.sequence(F.lit(0), F.octet_length(p) - 1), lambda i: F.get(table_, F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))
        return F.when(known.isNotNull(), F.array(known)).otherwise(raw)

    return F.flatten(F.transform(parts, one))


def fold_merges(word: Column, edges: Column, pieces: Pieces) -> Column:
    """The ids that a BPE model's merges leave: from single characters, the best-scored neighbours join, leftmost of
    equals, until none do."""
    chars = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.size(parts) - 2)
        scores = F.when(F.size(parts) > 1, F.transform(pairs, lambda i: F.try_element_at(edges, F.concat(F.get(parts, i), F.get(parts, i + 1)))["score"]))

        def merged(s: Column) -> Column:
            at = F.array_position(s, F.array_max(s)).cast("int")
            joined = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))
            return F.when(F.coalesce(at, F.lit(0)) > 0, joined).otherwise(parts)

        return let(scores, merged)

    turns = F.sequence(F.lit(1), F.length(word))
    return _ids(F.aggregate(turns, chars, step), edges, pieces)


def fold_viterbi(word: Column, edges: Column, pieces: Pieces, unknown: float = -1e6) -> Column:
    """The ids of a unigram model's best path: for each end the best score of a path to it and its parts."""
    first = F.array(F.struct(F.lit(0.0).alias("s"), F.array().cast("array<string>").alias("p")))

    def step(best: Column, end: Column) -> Column:
        starts = F.sequence(F.greatest(F.lit(1), end - pieces.longest + 1), end)

        def path(i: Column) -> Column:
            part = F.substring(word, i, end - i + 1)
            score = F.coalesce(F.try_element_at(edges, part)["score"], F.when(i == end, F.lit(unknown)))
            return F.struct((F.get(best, i - 1)["s"] + score).alias("s"), F.array_append(F.get(best, i - 1)["p"], part).alias("p"))

        paths = F.filter(F.transform(starts, path), lambda x: x["s"].isNotNull())
        return F.array_append(best, F.aggregate(paths, F.get(paths, F.lit(0)), lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a)))

    done = F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step)
    return _ids(F.element_at(done, -1)["p"], edges, pieces)


def encode_words(distinct: DataFrame, pieces: Pieces, fold=fold_merges) -> DataFrame:
    """(word, ids) for the distinct words."""
    edges = lattice(distinct, pieces)
    # the fold reads word and edges many times: a Generate keeps them plain columns
    plain = edges.select(F.explode(F.array(F.struct("word", "edges"))).alias("x")).select("x.word", "x.edges")
    return plain.select("word", fold(F.col("word"), F.col("edges"), pieces).alias("ids"))


def _ragged(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat one after another, and where each ends, from 0 on."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])], ends


class _Words:
    """Encoded words: the row of each, all ids one after another, where each row ends, from 0 on."""

    def __init__(self, rows: dict[str, int], flat: np.ndarray, ends: np.ndarray):
        self.rows, self.flat, self.ends = rows, flat, ends

    @staticmethod
    def of(words: list[str], ids: list[list[int]]) -> _Words:
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]).astype(np.int64)
        return _Words({w: k for k, w in enumerate(words)}, np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), ends)

    @staticmethod
    def read(table_: pa.Table) -> _Words:
        """Of (word, ids), as the driver got them and sent them on: columns, of which only tasks make words."""
        ids = table_["ids"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int64)
        return _Words({w: k for k, w in enumerate(table_["word"].to_pylist())}, ids.flatten().to_numpy().astype(np.int32), ends)


class _Batch:
    """Encodes texts; what the broadcast table lacks it folds, and remembers until the next stretch of text."""

    def __init__(self, pieces: Pieces, head: _Words | None = None):
        self.pieces, self.head, self.memo = pieces, head or _Words.of([], []), _Words.of([], [])
        self.score = {p: (s, i) for p, s, i in pieces.rows}
        self.best = {p: s for p, s, _ in pieces.rows}
        self.split = regex.compile(pieces.cut)
        # what two pieces that meet make, by piece numbers of their own
        number = {p: k for k, (p, _, _) in enumerate(pieces.rows)}
        self.size = len(number) + 1
        made = [(number[p[:i]] * self.size + number[p[i:]], number[p]) for p in number for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        made.sort()
        self.keys = np.array([k for k, _ in made] or [-1], dtype=np.int64)
        self.makes = np.array([n for _, n in made] or [0], dtype=np.int32)
        self.scores = np.array([s for _, s, _ in pieces.rows] or [0.0])
        self.own = np.array([i for _, _, i in pieces.rows] or [0], dtype=np.int32)
        # characters by code point; those without a piece have none
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.single[ord(p)] = k

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """fold of many words at once, the ids one after another and each word's number of them. All words' pieces stand
        in one array, with each one's score with the next; a round joins the best neighbours of every word, the first
        of equals, and words without any are done."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long_ = sizes > TOGETHER
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.repeat(np.arange(len(words)), sizes)
        part = self.single[codes].astype(np.int64)
        # alone: long words, and those with a character that has no piece
        alone = long_.copy()
        alone[at[part < 0]] = True
        own = [(k, self.long(words[k]) if long_[k] else self.fold(words[k])) for k in np.flatnonzero(alone).tolist()]
        ids, of = [np.array([i for _, x in own for i in x], dtype=np.int32)], [np.array([k for k, x in own for _ in x], dtype=np.int64)]
        part, at = part[~alone[at]], at[~alone[at]]

        def beside(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Score and result of pieces i and i + 1, none at the end of a word."""
            j = np.minimum(i + 1, len(part) - 1)
            key = part[i] * self.size + part[j]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            makes = self.makes[spot]
            return np.where((self.keys[spot] == key) & (at[i] == at[j]) & (i != j), self.scores[makes], -np.inf), makes

        score, makes = beside(np.arange(len(part)))
        while len(part):
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            top = np.repeat(np.maximum.reduceat(score, starts), np.diff(np.append(starts, len(at))))
            over = top == -np.inf
            if over.any():
                ids.append(self.own[part[over]])
                of.append(at[over])
                part, at, score, makes, top = part[~over], at[~over], score[~over], makes[~over], top[~over]
                if not len(part):
                    break
            best = np.flatnonzero(score == top)
            best = best[np.concatenate([[True], at[best[1:]] != at[best[:-1]]])]
            part[best] = makes[best]
            rest = np.ones(len(part), dtype=bool)
            rest[best + 1] = False
            new = best - np.arange(len(best))
            part, at, score, makes = part[rest], at[rest], score[rest], makes[rest]
            for i in (new, new[new > 0] - 1):
                score[i], makes[i] = beside(i)
        whose = np.concatenate(of)
        return np.concatenate(ids)[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))

    def several(self, stretches: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of an escaped text, where each of its words ends among them, and which words start with the mark."""
        found = pa.array(self.split.findall(stretches), pa.string())
        coded = found.dictionary_encode()
        words = coded.dictionary.to_pylist()
        head, memo = self.head, self.memo
        row = np.fromiter((head.rows.get(w, -1) for w in words), np.int64, len(words))
        rare = np.flatnonzero(row < 0)
        again = np.fromiter((memo.rows.get(words[k], -1) for k in rare.tolist()), np.int64, len(rare))
        new = rare[again < 0]
        flat, sizes = self.together([words[k] for k in new.tolist()])
        begins, size = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        start = 0
        for at, rows, table in ((np.flatnonzero(row >= 0), row[row >= 0], head), (rare[again >= 0], again[again >= 0], memo)):
            begins[at], size[at] = start + table.ends[rows], table.ends[rows + 1] - table.ends[rows]
            start += len(table.flat)
        begins[new], size[new] = start + np.cumsum(sizes) - sizes, sizes
        pool = np.concatenate([head.flat, memo.flat, flat])
        kept, ends = _ragged(pool, begins[rare], size[rare])
        self.memo = _Words({words[k]: n for n, k in enumerate(rare.tolist())}, kept, ends)
        each = coded.indices.to_numpy()
        ids, ends = _ragged(pool, begins[each], size[each])
        return ids, ends, pc.starts_with(found, MARK).to_numpy(zero_copy_only=False)

    def fold(self, word: str) -> list[int]:
        """fold_merges, the edges looked up in the piece table as neighbours meet; only the two scores beside a merge
        change."""
        if len(word) > 500:
            return self.long(word)
        parts, best = list(word), self.best
        none = float("-inf")
        scores = [best.get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while scores:
            top = max(scores)
            if top == none:
                break
            i = scores.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = best.get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = best.get(parts[i] + parts[i + 1], none)
        return self.ids(parts)

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            e = self.score.get(p)
            if e is not None:
                out.append(e[1])
            elif self.pieces.bytes_:
                out.extend(self.pieces.bytes_[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.pieces.unknown)
        return out

    def long(self, word: str) -> list[int]:
        """The same merges for a very long word, by a queue: time grows as n log n."""
        import heapq

        parts: list[str | None] = list(word)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(parts) and (e := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-e[0], i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or right[i] != j or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return self.ids([p for p in parts if p is not None])

    def text(self, text: str | None) -> np.ndarray | None:
        if not text:
            return text if text is None else np.zeros(0, dtype=np.int32)
        return self.several(MARK + text.replace(" ", MARK))[0]

    def column(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text. Words start at single spaces, so what lies between them is encoded by itself, each
        distinct stretch once; runs of spaces are words too, so texts that hold any are encoded one by one, as are
        those that hold the mark itself."""
        plain = pc.and_kleene(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.or_(pc.starts_with(texts, " "), pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)))))
        plain = plain.fill_null(False).to_numpy(zero_copy_only=False) & (self.pieces.cut != CUTS[-1])
        parts = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        # an empty stretch, behind a last space, would run into the next one's mark: it comes last
        empty = np.array([not p for p in distinct], dtype=bool)
        place = np.empty(len(distinct), dtype=np.int64)
        place[~empty], place[empty] = np.arange((~empty).sum()), len(distinct) - 1
        ids, ends, marks = self.several("".join([*(MARK + p for p in distinct if p), *([MARK] if empty.any() else [])]))
        edges = np.append(ends[:-1][marks], ends[-1])
        at = place[coded.indices.to_numpy()]
        values, ends = _ragged(ids, edges[at], edges[at + 1] - edges[at]) if len(at) else (ids[:0], np.zeros(1, dtype=np.int64))
        offsets = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()] if len(parts) else np.zeros(1, dtype=np.int64)
        done = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
        if plain.all():
            return done
        rest = pa.array([self.text(t) for t in texts.filter(pa.array(~plain)).to_pylist()], pa.list_(pa.int32()))
        order = np.empty(len(plain), dtype=np.int64)
        order[plain], order[~plain] = np.arange(len(done)), len(done) + np.arange(len(rest))
        return pa.concat_arrays([done, rest]).take(pa.array(order))


def frequent_words(docs: DataFrame, pieces: Pieces, most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """The stashed counts (word, n), and of them (word) those whose count is at or above the least count that leaves at
    most ``most`` words."""
    # counted first as they stand between spaces, so that the pattern runs once on each distinct stretch
    parts = docs.where("text is not null").select(F.explode(F.split("text", " ")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts = parts.select(F.explode(words(F.col("part"), pieces)).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stash(counts.where("n > 1 and length(word) <= 200"), "words")
    # by eighths of powers of two: a few hundred levels, whatever the corpus
    levels = {r["l"]: r["c"] for r in counts.groupBy(F.floor(8 * F.log2("n")).alias("l")).agg(F.count(F.lit(1)).alias("c")).collect()}
    total, least = 0, max(levels, default=0) + 1
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        least = level
    return counts, counts.where(F.floor(8 * F.log2("n")) >= least).select("word")


def encode(docs: DataFrame, pieces: Pieces, head: int = HEAD) -> DataFrame:
    """docs with ids and n_tokens."""
    spark = docs.sparkSession
    counts, frequent = frequent_words(docs, pieces, head)
    encoded = stash(encode_words(frequent, pieces), "head")
    known = encoded.toArrow()
    unstash(counts, encoded)
    # at most ``head`` words of at most 200 characters
    shared = spark.sparkContext.broadcast((pieces, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_pieces, table_ = shared.value
        coder = _Batch(known_pieces, _Words.read(table_))
        for batch in batches:
            # cut where another BYTES of text have gone by
            gone = np.cumsum(pc.binary_length(batch["__text"]).fill_null(0).to_numpy(zero_copy_only=False)) // BYTES
            cuts = [0, *(np.flatnonzero(np.diff(gone)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], coder.column(part["__text"])], names=[*names, "ids"])

    names = [c for c in docs.columns if c not in ("ids", "n_tokens", "__text")]
    schema = docs.select(*names).schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*names, F.col("text").alias("__text")).mapInArrow(run, schema).withColumn("n_tokens", F.size("ids").cast("long"))


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of an array of ids; broken byte sequences become U+FFFD. Texts without bytes beyond ASCII, nearly all,
    are joined as they are; in others all pieces are joined as hexadecimal UTF-8."""
    plain = [bytes.fromhex(h).decode("utf-8", "replace") for h in pieces.texts]
    high = [i for b, i in enumerate(pieces.bytes_) if b > 127]
    lookup = lambda table_: F.transform(ids, lambda i: F.coalesce(F.get(F.lit(table_), i), F.lit("")))
    joined = F.array_join(lookup(plain), "")
    if high:
        mixed = F.make_valid_utf8(F.unhex(F.array_join(lookup(list(pieces.texts)), "")).cast("string"))
        among = F.exists(ids, lambda i: i.between(min(high), max(high))) if max(high) - min(high) == len(high) - 1 else F.arrays_overlap(ids, F.lit(high))
        joined = F.when(among, mixed).otherwise(joined)
    return let(joined, lambda said: F.when(F.startswith(said, F.lit(" ")), F.substring(said, F.lit(2), F.length(said))).otherwise(said))


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces.load()
    done = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)
    same = F.coalesce(decode(F.col("ids"), pieces).eqNullSafe(F.replace("text", F.lit(MARK), F.lit(" "))), F.lit(True))
    return done.select("doc_id", "ids", F.when(F.col("ids").isNull(), 0).otherwise(F.col("n_tokens")).cast("long").alias("n_tokens"), same.alias("round_trip"))

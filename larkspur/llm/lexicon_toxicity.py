"""Toxicity by a learned lexicon, misspellings and quotation context.

1. Lexicon: over the training documents (``MAX_TRAIN`` labelled rows at most), words (and stems: prefixes that many forms share) are counted by label; those
   whose likelihood ratio clears a Bonferroni bound over the vocabulary are candidates. Copies of one document would
   lift all its words, so a candidate must clear the bound again with its effective number of contexts (the
   exponential of the entropy of its neighbours) for its documents. A stem must clear the bound without its most
   frequent form too, and its other forms must be toxic one by one. A word stays a term if a stem covers it. The
   terms come from the vocabulary of the training documents, so their number is bounded as these are.
2. Matching: words and stems are a trie, intersected with the Levenshtein automaton of a token (one edit from 5
   letters, two from 8, exchanges of neighbours included; stems match as prefixes, their last letter intact). Tokens
   that share no deletion with a word, and no piece with a stem, cannot match and are not looked up. Words of 4 letters
   are also met with neighbours exchanged, a letter doubled, or a sign or digit in or for a letter, not with one letter
   for another. Tokens that clean training documents hold are never taken for misspellings, nor for forms of a stem if
   no more toxic documents hold them.
3. Context: a hit counts as quoted if, within ``SPAN`` tokens, the nearest mark before it opens and the nearest one behind
   it closes a quotation, or if one of three words before it is a reporting word (a fixed list in four languages); any
   other is abuse. A mark opens where no letter stands before it and no space behind it, and closes the other way round;
   between two letters it is an apostrophe. Words spaced letter by letter are not joined, and a sign in front of a word
   is no part of it.
4. Score: a logistic model on the counts of abusive, misspelled and quoted hits, fitted on the counts of every cell of
   these features over all training documents (a table of a few hundred rows, whatever the corpus).

Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have no hits and get the model's score for that; documents without a label and
labels without a document do not train; a doc_id labelled twice counts as toxic if any label says so; repeated rows
are scored one by one; a null doc_id is held out if crc32 of the empty text says so; without any training row of
either label every score is the constant of the model. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import stash, table

MIN_STEM, MAX_STEM, MIN_FORMS = 4, 9, 8
SPAN = 6
TOP = 5
#: Labelled rows that the model is fitted on.
MAX_TRAIN = 30_000
CUT = 0.7
#: Nats beyond the logarithm of the vocabulary's size that a term's likelihood ratio must reach.
SURPRISE = 5.0
PRECISION = 0.8

TOKEN = re.compile(r"[^\W_]+(?:[@$*!]+[^\W_]+)*")
MARKS = frozenset("\"“”„«»‹›‘’‚'`")
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term terms phrase insult slur sagte schrieb nannte wort begriff zitat dit écrit appelé mot terme citation dijo escribió llamó palabra término cita".split())


def _edge(text: str, i: int) -> str:
    """What the mark at place i does: "opens", "closes", or nothing as an apostrophe or between spaces."""
    before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if before.isalnum() and after.isalnum():
        return ""
    if not before.isalnum() and after and not after.isspace():
        return "opens"
    return "closes" if before and not before.isspace() else ""


def quotes(text: str, first: int, start: int, end: int, last: int) -> bool:
    """Whether text[start:end] stands in quotation marks, looked for from first to last."""
    left = next((e for i in range(start - 1, first - 1, -1) if text[i] in MARKS and (e := _edge(text, i))), "")
    return left == "opens" and next((e for i in range(end, last) if text[i] in MARKS and (e := _edge(text, i))), "") == "closes"


def _fewer(word: str) -> set[str]:
    """word without one letter."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _pieces(words) -> tuple[frozenset[str], ...]:
    """Three pieces of words of 8 letters or more, so far apart that an edit touches one at most."""
    words = list(words)
    return tuple(frozenset(w[i : i + 2] for w in words) for i in (0, 3, 6))


def _share(token: str, pieces: tuple[frozenset[str], ...]) -> bool:
    """False only if no word of the pieces is within two edits."""
    a, b, c = pieces
    return token[:2] in a or not b.isdisjoint([token[i : i + 2] for i in range(1, 6)]) or not c.isdisjoint([token[i : i + 2] for i in range(4, 9)])


@dataclass
class Lexicon:
    """Terms as a trie; allowed: tokens that are no misspellings."""

    words: frozenset[str]
    stems: tuple[str, ...]
    allowed: frozenset[str] = frozenset()
    _trie: dict = field(default_factory=dict, repr=False)
    _memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        for w in self.words:
            node = self._trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = len(w)
        for stem in self.stems:
            node = self._trie
            for c in stem:
                node = node.setdefault(c, {})
            node[">"] = len(stem)
        # strings left of a word by as many deletions as edits are allowed: a token within reach leaves one of them too
        self._once, self._twice = set(), set()
        for w in self.words:
            if len(w) >= 5:
                self._once.update(_fewer(w), (w,))
            if len(w) >= 8:
                self._twice.update(_fewer(w), (w,), *map(_fewer, _fewer(w)))
        self._once |= self._twice
        self._longest = max(map(len, self.words), default=0) + 2
        self._gate = _pieces(w for w in self.words if len(w) >= 8)
        # the same for prefixes of a token, by the stem's length
        self._roots = {}
        for stem in self.stems:
            if 5 <= len(stem) < 8:
                self._roots.setdefault(len(stem), set()).update(_fewer(stem), (stem,))
        self._long = _pieces(x for x in self.stems if len(x) >= 8)

        self._short = {w for w in self.words if len(w) == 4}
        self._near = {x for w in self._short for x in (*(w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(3)), *(w[:i] + w[i] + w[i:] for i in range(4)))} - self._short
        self._gaps = {w[:i] + "?" + w[i + 1 :] for w in self._short for i in range(4)}

    def __getstate__(self):
        return self.words, self.stems, self.allowed

    def __setstate__(self, state):
        self.__init__(*state)

    def match(self, token: str) -> int:
        """0: none; 1: a term; 2: a misspelled term."""
        found = self._memo.get(token)
        if found is None:
            if len(self._memo) > 500_000:
                self._memo.clear()
            found = self._memo[token] = self._look(token)
        return found

    def _look(self, token: str) -> int:
        if token in self.words:
            return 1
        if token in self.allowed:
            return 0
        if self.stems and token.startswith(self.stems):
            return 1
        if len(token) < 4:
            return 0
        return 2 if self._altered(token) or (self._possible(token) and self.distance(token) is not None) else 0

    def _altered(self, token: str) -> bool:
        """A word of 4 letters with neighbours exchanged, a letter doubled, or a sign or digit in or for a letter."""
        if not self._short or len(token) > 5:
            return False
        if token in self._near:
            return True
        odd = [i for i, c in enumerate(token) if not c.isalpha()]
        if len(odd) != 1:
            return False
        i = odd[0]
        return token[:i] + "?" + token[i + 1 :] in self._gaps if len(token) == 4 else token[:i] + token[i + 1 :] in self._short

    def _possible(self, token: str) -> bool:
        """False only if no word and no stem is within reach."""
        n = len(token)
        if n <= self._longest and self._once:
            fewer = _fewer(token)
            if token in self._once or not self._once.isdisjoint(fewer):
                return True
            if self._twice and n >= 6 and _share(token, self._gate) and any(not self._twice.isdisjoint(_fewer(x)) for x in fewer):
                return True
        for size, roots in self._roots.items():
            whole, longer = token[:size], token[: size + 1]
            if token[: size - 1] in roots or whole in roots or not roots.isdisjoint(_fewer(whole)) or not roots.isdisjoint(_fewer(longer)):
                return True
        return bool(self._long[0]) and _share(token, self._long)

    def distance(self, token: str) -> int | None:
        """The least edit distance to a term within its reach, by walking the trie with the automaton's states: for
        each place in the token the fewest edits, pruned beyond two."""
        n = len(token)
        best: int | None = None
        stack = [(self._trie, "", tuple(range(n + 1)), None, "")]
        while stack:
            node, _, row, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    reach = 2 if child >= 8 else 1 if child >= 5 else 0
                    if row[n] <= reach and (best is None or row[n] < best):
                        best = row[n]
                    continue
                if c == ">":
                    reach = 2 if child >= 8 else 1 if child >= 5 else 0
                    # the stem ends at its own last letter, which may have changed places with the one before
                    ends = [row[j] for j in range(1, n + 1) if last in (token[j - 1], token[max(j - 2, 0)])]
                    if ends and min(ends) <= reach and (best is None or min(ends) < best):
                        best = min(ends)
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (token[j - 1] != c))
                    if before is not None and j > 1 and token[j - 1] == last and token[j - 2] == c:
                        v = min(v, before[j - 2] + 1)
                    new.append(v)
                if min(new) <= 2:
                    stack.append((child, "", tuple(new), row, c))
        return best

    def hits(self, text: str | None) -> tuple[int, int, int]:
        """Abusive, misspelled and quoted hits of a whole text."""
        if not text:
            return 0, 0, 0
        low = text.lower()
        tokens = TOKEN.findall(low)
        found = {t for t in set(tokens) if self.match(t)}
        if not found:
            return 0, 0, 0
        abuse = wrong = quoted = 0
        places = list(TOKEN.finditer(low))
        for k, m in enumerate(places):
            t = m[0]
            if t not in found:
                continue
            a, b = places[max(0, k - SPAN)].start(), places[min(len(places) - 1, k + SPAN)].end()
            # the marks around the outermost words belong to the window
            if quotes(low, max(0, a - 1), m.start(), m.end(), min(len(low), b + 1)) or any(p[0] in REPORTING for p in places[max(0, k - 3) : k]):
                quoted += 1
            elif self.match(t) == 1:
                abuse += 1
            else:
                wrong += 1
        return abuse, wrong, quoted


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that are learned from: ``MAX_TRAIN`` at most, the first by a hash of the id, so that
    the table may be broadcast whatever the corpus."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return stash(once.orderBy(F.xxhash64("doc_id")).limit(MAX_TRAIN), "training")


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(toxic == 1)].update(set(TOKEN.findall((text or "").lower())))
        words = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"word": words, "pos": [counts[1][w] for w in words], "neg": [counts[0][w] for w in words]})


def _ratio(share: float, p: str = "pos", n: str = "neg") -> Column:
    """Log likelihood ratio of a word's labels against the overall share."""
    total = F.col(p) + F.col(n)
    neg = F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / total / (1 - share))).otherwise(0.0)
    return F.when(F.col(p) > 0, F.col(p) * F.log(F.col(p) / total / share) + neg).otherwise(0.0)


def _contexts(words: frozenset[str], stems: frozenset[str]):
    heads = {s[:MIN_STEM] for s in stems}
    sizes = range(MIN_STEM, MAX_STEM + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"]:
                tokens = TOKEN.findall((text or "").lower())
                for k, t in enumerate(tokens):
                    if t in words or t[:MIN_STEM] in heads:
                        place = zlib.crc32(f"{tokens[k - 1] if k else ''} {tokens[k + 1] if k + 1 < len(tokens) else ''}".encode())
                        if t in words:
                            counts[t, 0, place] += 1
                        if t[:MIN_STEM] in heads:
                            counts.update((t[:n], 1, place) for n in sizes if n < len(t) and t[:n] in stems)
            yield pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["term", "kind", "place", "n"])

    return run


def learn_lexicon(docs: DataFrame, train: DataFrame) -> Lexicon:
    """train: what ``training`` returns."""
    known = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id")
    words = stash(known.mapInPandas(_vocabulary, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "vocabulary")
    both = train.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count(F.lit(1))).first()
    if not both[0] or both[0] == both[1]:
        return Lexicon(frozenset(), ())
    share = both[0] / both[1]
    bar = math.log(max(words.count(), 2)) + SURPRISE
    good = (F.col("llr") >= bar) & (F.col("pos") >= PRECISION * (F.col("pos") + F.col("neg")))
    terms = words.withColumn("llr", _ratio(share)).where(good).orderBy(F.desc("llr"), "word").collect()
    cut = words.where(F.length("word") > MIN_STEM).select("pos", "neg", F.explode(F.transform(F.sequence(F.lit(MIN_STEM), F.least(F.lit(MAX_STEM), F.length("word") - 1)), lambda k: F.substring("word", F.lit(1), k))).alias("stem"))
    stems = cut.groupBy("stem").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("forms"),
        F.max_by(F.struct("pos", "neg"), F.struct("pos", -F.col("neg"))).alias("top"), F.sum(F.when(F.col("pos") >= PRECISION * (F.col("pos") + F.col("neg")), 1).otherwise(0)).alias("toxic"),
    )
    # without its most frequent form, counted here with toxic ones, a stem must be as good, and so must most other forms
    stems = stems.withColumn("pos2", F.col("pos") - F.col("top.pos")).withColumn("neg2", F.col("neg") - F.col("top.neg"))
    others = (_ratio(share, "pos2", "neg2") >= bar) & (F.col("pos2") >= PRECISION * (F.col("pos2") + F.col("neg2"))) & (F.col("toxic") - 1 >= PRECISION * (F.col("forms") - 1))
    rows = stems.where((F.col("forms") >= MIN_FORMS) & others).withColumn("llr", _ratio(share)).where(good).orderBy(F.desc("llr"), "stem").collect()
    # effective contexts among toxic training documents; the bound then holds with them in the documents' place
    toxic = known.where("toxic = 1").select("text")
    places = toxic.mapInPandas(_contexts(frozenset(r["word"] for r in terms), frozenset(r["stem"] for r in rows)), "term string, kind int, place long, n long")
    sums = places.groupBy("term", "kind", "place").agg(F.sum("n").alias("n")).groupBy("term", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    spread = {(r["term"], r["kind"]): math.exp(math.log(r["m"]) - r["s"] / r["m"]) for r in sums.collect()}

    def clears(name: str, kind: int, row) -> bool:
        return row["llr"] * min(1.0, spread.get((name, kind), 0.0) / row["pos"]) >= bar

    found = {r["stem"]: r["pos"] for r in rows if clears(r["stem"], 1, r)}
    bases: list[str] = []
    kept: list[str] = []
    for base in sorted(found, key=lambda s: (len(s), s)):
        if bases and base.startswith(tuple(bases)):
            continue
        bases.append(base)
        stem = base
        while (longer := max((s for s in found if len(s) == len(stem) + 1 and s.startswith(stem)), key=found.get, default=None)) and found[longer] >= 0.95 * found[stem]:
            stem = longer
        kept.append(stem)
    single = [r["word"] for r in terms if clears(r["word"], 0, r)]
    lexicon = Lexicon(frozenset(single), tuple(kept))

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(lexicon.match(w), w not in lexicon.words and neg >= pos) for w, pos, neg in zip(batch["word"], batch["pos"], batch["neg"], strict=True)]
            yield batch.loc[[m == 2 or (m == 1 and other) for m, other in found], ["word"]]

    clean = words.where("neg > 0").mapInPandas(similar, "word string").toPandas()["word"]
    return Lexicon(lexicon.words, lexicon.stems, frozenset(clean))


def count_hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, n_abuse, n_misspelled, n_quoted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            a, w, q = zip(*map(model.hits, batch["text"]), strict=True) if len(batch) else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_abuse": a, "n_misspelled": w, "n_quoted": q})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_abuse long, n_misspelled long, n_quoted long")


def _design(a: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(a), a > 0, a, w > 0, w, q > 0, q], axis=1).astype(float)


def fit(hits: DataFrame, train: DataFrame) -> list[float]:
    """Weights of the logistic model from the counts of each cell of features."""
    top = [F.least(c, F.lit(TOP)).cast("int").alias(c) for c in ("n_abuse", "n_misspelled", "n_quoted")]
    cells = hits.join(F.broadcast(train), "doc_id").groupBy(*top, "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()
    weights = np.zeros(7)
    if len(cells):
        x = _design(*(cells[c].to_numpy() for c in ("n_abuse", "n_misspelled", "n_quoted")))
        y, n = (cells["toxic"] == 1).to_numpy(float), cells["n"].to_numpy(float)
        pull = np.diag([1e-6, 0.05, 0.05, 0.05, 0.05, 0.5, 0.5])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull, x.T @ (n * (y - p)) - pull @ weights)
            size = np.abs(step).max()
            weights += step * min(1.0, 4 / max(size, 1e-12))
            if size < 1e-9:
                break
        weights[1:5] = np.maximum(weights[1:5], 0)
    return [float(v) for v in weights]


def scored(hits: DataFrame, weights: list[float]) -> DataFrame:
    a, w, q = (F.least(c, F.lit(TOP)).cast("double") for c in ("n_abuse", "n_misspelled", "n_quoted"))
    some = lambda c: F.when(c > 0, 1.0).otherwise(0.0)
    total = F.lit(weights[0])
    for v, c in zip(weights[1:], (some(a), a, some(w), w, some(q), q), strict=True):
        total = total + F.lit(v) * c
    score = 1 / (1 + F.exp(-total))
    return hits.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= CUT, 1).otherwise(0).alias("predicted"), "n_abuse", "n_misspelled", "n_quoted")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_abuse, n_misspelled, n_quoted) of every row of docs."""
    train = training(labels)
    hits = stash(count_hits(docs, learn_lexicon(docs, train)), "hits")
    return scored(hits, fit(hits, train))


def op6_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Toxicity: noisy-channel restoration of obfuscated words, then a score of the restored text.

A character trigram model is counted over all documents. Words that look obfuscated (digits or symbols
among letters, letters repeated three times, letters spelled out with gaps) are taken for the output of a
noisy channel: a lattice holds the letters each character may stand for and the runs that may be shortened,
and Viterbi decoding finds the likeliest word under the trigram model. The restored text is scored with a
lexicon of words and word beginnings learned from labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches, materialize
from .labelled import sample
from .quality import scored

THRESHOLD = 0.5

# The letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
EDGE = ".,;:!?*%$&#\"'()[]{}<>|-_/\\~=+^`@"
ALIKE = "".join(c for c in EDGE if c in LEET)
_LETTER, _GAP = rf"(?:[^\W_]|[{re.escape(''.join(c for c in LEET if not c.isalnum()))}])", r"[ .\-_*]{1,2}"
SPELLED = re.compile(rf"(?<![^\W_]){_LETTER}(?:{_GAP}{_LETTER}(?![^\W_])){{3,}}")
SPELLED_LETTER = re.compile(rf"({_LETTER})({_GAP}(?={_LETTER})|$)")
# Prices in a spelled-out run: a new word at a gap, at a wider one, none there, one after an article or "I"; leaving out a first symbol.
NARROW, WIDE, ACROSS, ALONE, FIRST = -2.0, 0.0, -3.0, -0.5, -1.5
TRIPLE = re.compile(r"([^\W\d_])\1\1")
WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = 28  # 0: not a letter, 1-26: a-z, 27: any other letter
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[0xC0:] = 27
_CLASS[0x80:0xC0] = -1  # the rest of a character


def trigram_counts(texts: list[str]) -> np.ndarray:
    total = np.zeros(SYMBOLS**3, np.int64)
    for t in texts:
        c = _CLASS[np.frombuffer(f" {t} ".encode("utf-8", "replace"), np.uint8)]
        c = c[c >= 0]
        if len(c) > 2:
            total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
    return total


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a character after two others, counted over all of ``docs``."""

    def task(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            total += trigram_counts(batch.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    counts = np.zeros(SYMBOLS**3)
    grams = map_batches(documents(docs).select("text"), task, "gram int, n long")
    for gram, n in grams.groupBy("gram").agg(F.sum("n")).collect():  # at most SYMBOLS ** 3 rows
        counts[gram] = n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pair = counts.sum(0) + 0.5
    pair /= pair.sum(1, keepdims=True)
    return np.log((counts + 20 * pair[None]) / (counts.sum(2, keepdims=True) + 20))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _arcs(c: str, n: int, dropped: float) -> list[tuple[str, float]]:
    """What a run of ``n`` times ``c`` may stand for, and the price of each; ``dropped``: of leaving out a symbol."""
    own = c if c.isalpha() else ""
    arcs = []
    for x in own + LEET.get(c, ""):
        price = 0.0 if x == own else -0.7
        arcs += [(x * k, price * (k if n <= 2 else 1) - (0.5 if k < n else 0.0)) for k in ({n} if n == 1 else {1, 2})]
    return arcs if own else [*arcs, ("", dropped)]


def _likeliest(nodes: list[list[tuple[str, float]]], lm: np.ndarray) -> str:
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for arcs in nodes:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in beam.items():
            for s, price in arcs:
                p, q, total = a, b, score + price
                for x in s:
                    k = _symbol(x)
                    total += lm[p, q, k]
                    p, q = q, k
                if (p, q) not in new or new[p, q][0] < total:
                    new[p, q] = (total, (path, s))
        beam = new
    path, out = max(((score + lm[a, b, 0], path) for (a, b), (score, path) in beam.items()), key=lambda e: e[0])[1], []
    while path:
        path, s = path
        out.append(s)
    return "".join(reversed(out))


def decode(word: str, lm: np.ndarray, lead: int = 0, trail: int = 0) -> str:
    """The likeliest letters behind ``word`` (lower case).

    Nodes of the lattice are the runs of one character; a node's arcs are strings: each letter the
    character may stand for, once or twice where the run is longer, at a price for each change.
    The first ``lead`` and last ``trail`` characters may be punctuation around the word and cost nothing to leave out.
    """
    nodes = []
    for m in re.finditer(r"(.)\1*", word, re.S):
        around = m.end() <= lead or m.start() >= len(word) - trail
        nodes.append(_arcs(m[1], len(m[0]), 0.0 if around else -4.0 * min(len(m[0]), 2)))
    return _likeliest(nodes, lm)


def spelled(run: str, lm: np.ndarray, closed: bool = False) -> str:
    """The likeliest words behind letters with gaps (lower case). A word may end at each gap, likelier at wider ones.

    closed: a parenthesis follows, so that one before the letters is punctuation. So is a symbol on both sides.
    """
    letters = SPELLED_LETTER.findall(run)
    narrow = min(len(gap) for _, gap in letters[:-1])
    pair = closed and run[0] == "(" or run[0] == letters[-1][0]
    nodes, i = [], 0
    while i < len(letters):
        c, j = letters[i][0], i + 1
        while j < len(letters) and letters[j][0] == c and len(letters[j - 1][1]) == narrow:
            j += 1
        arcs = _arcs(c, j - i, 0.0 if j == len(letters) or pair and i == 0 else FIRST if i == 0 and not c.isdigit() else -4.0 * min(j - i, 2))
        if j - i > 1:  # or the end of a word and the beginning of the next
            arcs += [(f"{x} {x}", 2 * price + NARROW) for x, price in _arcs(c, 1, 0.0) if x]
        nodes.append(arcs)
        if j < len(letters):
            alone = c in "ai" and j == i + 1 and (i == 0 or len(letters[i - 1][1]) > narrow)  # an article or "I"
            nodes.append([("", 0.0), (" ", ALONE if alone else NARROW)] if len(letters[j - 1][1]) == narrow else [("", ACROSS), (" ", WIDE)])
        i = j
    return _likeliest(nodes, lm)


@dataclass
class Restorer:
    lm: np.ndarray
    memo: dict[str, str] = field(default_factory=dict)

    def word(self, token: str) -> str:
        """A token of the text, restored if it looks obfuscated."""
        if (known := self.memo.get(token)) is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[token] = self._word(token)
        return known

    def _word(self, token: str) -> str:
        if token.isalpha() and not TRIPLE.search(token):
            return token
        core = token.strip(EDGE)
        if not core:
            return token
        at = token.index(core)
        before, after = token[:at], token[at + len(core) :]
        # the symbols next to it may be letters or punctuation
        lead, trail = len(before) - len(before.rstrip(ALIKE)), len(after) - len(after.lstrip(ALIKE))
        pair = lead > 0 and before[-1].replace("(", ")") in after
        if core.isalpha() and not TRIPLE.search(core):
            if not lead or pair and len(before + after) > 2:
                return token
            core, lead, trail = token[at - lead : at + len(core)], 0, 0
        else:
            core, lead = token[at - lead : at + len(core) + trail], lead if pair else 0
        core = core.lower()
        letters = sum(map(str.isalpha, core))
        if not letters or letters == len(core) and not TRIPLE.search(core) or any(not c.isalpha() and c not in LEET and c not in "'-." for c in core):
            return token
        return decode("".join(c for c in core if c not in "'-."), self.lm, lead, trail)

    def text(self, text: str) -> str:
        def restored(m):
            if not any(map(str.isalnum, m[0])):
                return m[0]
            return f" {spelled(m[0].lower(), self.lm, text[m.end() : m.end() + 2].lstrip().startswith(')'))} "

        text = SPELLED.sub(restored, text)
        return " ".join(map(self.word, text.split()))


def beginnings(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings of 4 to 8 letters."""
    return ["=" + word, *(word[:n] for n in range(4, min(8, len(word)) + 1))]


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    restorer: Restorer
    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    memo: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        if (known := self.memo.get(word)) is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[word] = max((self.lexicon.get(f, 0.0) for f in beginnings(word)), default=0.0)
        return known

    def summary(self, text: str) -> list[float]:
        words = _words(self.restorer.text(text))
        hits = [(w, x) for w, x in zip(words, map(self.weight, words)) if x > 0]
        n, total, distinct = len(words) + 1, sum(x for _, x in hits), {w: x for w, x in hits}
        rate = total / n
        return [np.log1p(total), np.log1p(sum(distinct.values())), max(distinct.values(), default=0.0), np.log1p(len(hits)), np.sqrt(rate), rate, np.log(n), np.log1p(total) * np.log(n) / 5, np.sqrt(rate) * np.log(n) / 5]

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.beta):
            return np.zeros(len(texts))
        x = np.array([self.summary(t) for t in texts]).reshape(len(texts), -1)
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.concatenate([z, np.ones((len(z), 1))], 1) @ self.beta, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    beta = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        lhs = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty * np.eye(len(beta))
        beta += np.linalg.solve(lhs, z.T @ (y - p) - penalty * beta)
    return mean, scale, beta


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, least_docs: int = 5) -> Model:
    """A model of ``labels.toxic``. The character model counts all of ``docs``; about ``most`` labelled rows outside
    fold 0 teach the lexicon (folds 1 to 3) and the weights of what it finds (fold 4 and a part of the others)."""
    spark = docs.sparkSession
    restorer = Restorer(language_model(docs))
    known = sample(docs, labels, "toxic", most)

    def restored(batches):
        for batch in batches:
            texts = [" ".join(_words(restorer.text(t))) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(texts, pa.string()), batch.column("y"), batch.column("fold")], ["text", "y", "fold"])

    known = materialize(map_batches(known, restored, "text string, y double, fold int"), "restored")
    empty = np.zeros(0)
    taught = known.where("fold < 4")
    n = {r[0]: r[1] for r in taught.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model(restorer, {}, empty, empty, empty)

    def counted(wanted):
        def task(batches):
            total: Counter = Counter()
            for batch in batches:
                for t in batch.column("text").to_pylist():
                    own = {f for w in set(t.split()) for f in beginnings(w)}
                    total.update(own if wanted is None else own & wanted)
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["feature", "n"])

        return task

    schema = "feature string, n long"
    toxic = map_batches(taught.where("y = 1"), counted(None), schema).groupBy("feature").agg(F.sum("n").alias("n"))
    toxic = {r[0]: r[1] for r in toxic.where(F.col("n") >= least_docs).collect()}  # of at most `most` documents
    clean = map_batches(taught.where("y = 0"), counted(set(toxic)), schema).groupBy("feature").agg(F.sum("n"))
    clean = dict(map(tuple, clean.collect()))
    lexicon = {}
    for f, a in toxic.items():
        p, q = (a + 0.1) / (n[1.0] + 1), (clean.get(f, 0) + 0.5) / (n[0.0] + 1)
        spread = np.sqrt(1 / (a + 0.1) + 1 / (clean.get(f, 0) + 0.5))
        odds = np.log(p / (1 - p)) - np.log(q / (1 - q))
        if odds > 2.58 * spread and odds > 1:  # beyond chance
            lexicon[f] = float(odds)
    model = Model(restorer, lexicon, empty, empty, empty)

    def summed(batches):
        plain = Model(_Plain(), lexicon, empty, empty, empty)
        for batch in batches:
            x = [plain.summary(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    rows = map_batches(known.where("fold = 4"), summed, "x array<double>, y double").collect()  # a part of `most`
    y = np.array([r[1] for r in rows])
    if len(set(y)) == 2:
        model.mean, model.scale, model.beta = _logistic(np.array([r[0] for r in rows]), y)
    return model


class _Plain:
    """For texts that are restored already."""

    def text(self, text: str) -> str:
        return text


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): scores near 1 for toxic documents.

    Only the text counts, so equal texts get equal scores; a null text is empty and scores as one without
    toxic words. Without labels of both kinds every score is 0. An empty table gives no rows; other columns are
    ignored.
    """
    return scored(docs, fit(docs, labels), THRESHOLD)

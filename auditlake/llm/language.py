"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: how often a byte followed each context of up to ORDER bytes. A byte's code length
is that of its longest known context; a byte that did not follow it costs an escape (method C: as likely as the share
of distinct followers) and is coded in the next shorter context, down to one of 256 bytes. Statistics are frozen after
training, so code lengths are exact and do not depend on what was read before. The language that codes a text shortest
is predicted.

The counts of all trees come from one Spark aggregate over the longest runs. For scoring, all trees are one table of
numbers: a run of bytes that any language knows has its code length in every language, escapes included, so that most
bytes of a text need one look-up, and a batch of texts a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .labelled import fold, held_out

ORDER = 4
PART = 1 << 20
SURE = 64


def _plain(text: str) -> bytes:
    """A-Z lowered; the zero bytes before it stand for the contexts of the first ones."""
    return bytes(ORDER) + text.encode().lower()


def _runs(data: np.ndarray, n: int) -> np.ndarray:
    """At each byte from the first on, the last n bytes as a number."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for i in range(n):
        out = out << np.uint64(8) | data[ORDER - n + 1 + i : len(data) - n + 1 + i]
    return out


class Table:
    """Numbers in sorted order by a hashed directory; the few that share a slot are searched for."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.uint64(64 - max(8, int(np.ceil(np.log2(len(keys) + 1))) + 2))
        slot = self._slot(keys)
        self.first = np.full(1 << (64 - int(self.bits)), -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.rest = np.nonzero(self.first[slot] != np.arange(len(keys)))[0]
        self.crowded = np.zeros(len(self.first), bool)
        self.crowded[slot[self.rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        at = self.first[slot]
        at[self.keys[at] != keys] = -1
        if len(self.rest):
            open_ = np.nonzero((at < 0) & self.crowded[slot])[0]
            known = self.keys[self.rest]
            near = np.minimum(np.searchsorted(known, keys[open_]), len(known) - 1)
            hit = known[near] == keys[open_]
            at[open_[hit]] = self.rest[near[hit]]
        return at


@dataclass
class Model:
    """By order: runs of context and byte with their bits in each language; contexts with the bits of an escape."""

    languages: list[str]
    runs: list[Table]
    bits: list[np.ndarray]
    contexts: list[Table]
    escapes: list[np.ndarray]

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits by byte of ``data`` after its first ORDER ones, and by language."""
        out = np.zeros((max(len(data) - ORDER, 0), len(self.languages)), np.float32)
        if not len(out):
            return out
        open_ = np.arange(len(out))
        for k in range(ORDER, -1, -1):
            runs = _runs(data, k + 1)[open_]
            at = self.runs[k].find(runs)
            hit = at >= 0
            out[open_[hit]] += self.bits[k][at[hit]]
            open_, runs = open_[~hit], runs[~hit]
            if not len(open_):
                return out
            if k:
                ctx = self.contexts[k].find(runs >> np.uint64(8))
                known = ctx >= 0
                out[open_[known]] += self.escapes[k][ctx[known]]
            else:
                out[open_] += self.escapes[0][0] + 8
        return out


def build(names: np.ndarray, key: np.ndarray, n: np.ndarray) -> Model:
    """A model from columns: language, run of ORDER + 1 bytes as a number, count."""
    languages, lang = np.unique(names.astype(str), return_inverse=True)
    languages, key = languages.tolist(), key.astype(np.uint64)
    runs, bits, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):
        keys, at = np.unique(key & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.zeros((len(keys), len(languages)))
        np.add.at(count, (at, lang), n)
        ctx, own = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = (np.zeros((len(ctx), len(languages))) for _ in range(2))
        np.add.at(total, own, count)
        np.add.at(kinds, own, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            # a context that a language never saw costs nothing: the next shorter one is its longest
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            direct = -np.log2(count / (total + kinds)[own])
        shorter = 8.0 if not k else bits[k - 1][runs[k - 1].find(keys & np.uint64((1 << 8 * k) - 1))]
        runs.append(Table(keys))
        bits.append(np.where(count > 0, direct, escape[own] + shorter).astype(np.float32))
        contexts.append(Table(ctx))
        escapes.append(escape.astype(np.float32))
    return Model(languages, runs, bits, contexts, escapes)


def train(docs: DataFrame, most: int = 20_000, most_bytes: int = 2 << 20, nodes: int = 2_000_000) -> Model | None:
    """Context trees from texts with a language whose id is not held out; None without any.

    Bounds of the sample, all parameters: about ``most`` rows and ``most_bytes`` for each language by a hash of the id, whole texts (some
    16 rows of a language stay whatever their length); the ``nodes`` most frequent longest runs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where((fold(F.col("id")) > 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    size = materialize(size, "languages")  # a row for each language
    total = size.agg(F.count("*"), F.sum("n")).first()
    if not total[0]:
        return None
    per = max(most // total[0], 1)
    step = F.greatest(F.ceil(F.col("n") / per), F.least(F.ceil(F.col("bytes") / most_bytes), F.floor(F.col("n") / 16)), F.lit(1))
    sample = rows.join(F.broadcast(size.select("lang", step.alias("step"))), "lang").where(F.pmod(F.xxhash64("id"), "step") == 0)

    def count(batches):
        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for name in set(names):
                own = [_runs(np.frombuffer(_plain(t), np.uint8), ORDER + 1) for x, t in zip(names, texts) if x == name and t]
                if own:
                    keys, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.record_batch({"lang": pa.array([name] * len(keys), pa.string()), "run": pa.array(keys.astype(np.int64)), "n": pa.array(n)})

    grams = map_batches(sample.select("lang", "text"), count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "runs")
    grams = grams.orderBy(F.desc("n"), "lang", "run").limit(nodes) if grams.count() > nodes else grams
    found = grams.toArrow()
    return build(*(found[c].to_numpy() for c in ("lang", "run", "n"))) if len(found) else None


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text. The score is the language's share of 2 ** -bits, at SURE bytes' worth at most."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    asked = [i for i, t in enumerate(texts) if has_letter(t)]
    lo = 0
    while lo < len(asked):
        hi, held = lo, []
        while hi < len(asked) and (not held or sum(map(len, held)) < PART):
            held.append(_plain(texts[asked[hi]]))
            hi += 1
        sums = _sums(model, held)
        size = np.array([len(t) - ORDER for t in held])
        lead = sums - sums.min(1, keepdims=True)
        share = np.exp2(-lead * np.minimum(1, SURE / size)[:, None])
        best = sums.argmin(1)
        for i, b, s in zip(asked[lo:hi], best, 1 / share.sum(1)):
            out[i] = model.languages[b], float(s)
        lo = hi
    return out


def _sums(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text by language. Long texts are read in parts; a part begins with the last bytes of the one before."""
    out = np.zeros((len(texts), len(model.languages)))
    if len(texts) == 1:
        data = np.frombuffer(texts[0], np.uint8)
        for lo in range(0, len(data) - ORDER, PART):
            out[0] += model.code_lengths(data[lo : lo + PART + ORDER]).sum(0, dtype=np.float64)
        return out
    # texts in a row: the bytes before each one's beginning are its own zeros, whose code lengths are left out
    data = np.frombuffer(b"".join(texts), np.uint8)
    bits = model.code_lengths(data)
    at = np.cumsum([0, *map(len, texts)])
    for i in range(len(texts)):
        out[i] = bits[at[i] : at[i + 1] - ORDER].sum(0, dtype=np.float64)
    return out


def identify(docs: DataFrame, most: int = 20_000, most_bytes: int = 2 << 20, nodes: int = 2_000_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of ``docs``.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod 5 is not 0 (bounds: :func:`train`); predicts from the text
    alone. A null text and one without letters is `und` with score 0, as is every text if nothing could be learned. Ties go to the
    language that is first by name. Rows without a doc_id are not held out and not learned from; equal texts get equal
    results; an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, most, most_bytes, nodes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most ``nodes`` longest runs and their shorter ones

    def score(batches):
        for batch in batches:
            found = predict(sent.value, batch.column("text").to_pylist())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([p for p, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    return map_batches(rows, score, "doc_id long, held_out boolean, lang_pred string, score double")

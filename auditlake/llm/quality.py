"""Quality classifier: kernel ridge regression on document statistics by random Fourier features.

Each document becomes a vector of statistics over its whole text. Random Fourier features approximate a
Gaussian kernel on the standardised statistics. Partitions sum up their normal equations, the driver adds
those of a bounded number of partitions and solves for the ridge weights. Isotonic regression on a fold
the weights have not seen turns ridge scores into probabilities.

Scoring runs where the documents are and shuffles nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .labelled import held_out, sample

THRESHOLD = 0.3
PARTS = 16  # partitions that send normal equations to the driver
BINS = 1000
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in "\n\t ,.'-\";:?()"]] = True
_LETTER = np.array([chr(i).isalpha() and i < 128 or i > 127 for i in range(256)])
_SYMBOL = ~_LETTER & ~_PLAIN & ~np.array([48 <= i < 58 for i in range(256)])


def statistics(text: str) -> list[float]:
    """Figures about length, characters, words and lines; defined for empty texts too."""
    data = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    w, k = max(1, len(words)), max(1, len(lines))
    seen, rows = Counter(words), Counter(lines)
    p = hist[hist > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    top = seen.most_common(2)
    repeated = sum(len(x) * (c - 1) for x, c in rows.items())
    ends = sum(x[-1] in ".!?\"'" for x in lines)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        lengths.mean() if len(words) else 0.0,
        np.log1p(lengths.max()) if len(words) else 0.0,
        (lengths <= 2).mean() if len(words) else 0.0,
        hist[65:91].sum() / n,
        hist[48:58].sum() / n,
        hist[128:].sum() / n,
        hist[_SYMBOL].sum() / n,
        hist[124] / n,
        hist[33] / n,
        (hist[44] + hist[46]) / n,
        hist[32] / n,
        float(-(p * np.log(p)).sum()) if len(data) else 0.0,
        np.log(len(seen) + 1) / np.log(w + 1.5),
        top[0][1] / w if top else 0.0,
        top[-1][1] / w if top else 0.0,
        np.log1p(k),
        np.log1p(len(text) / k),
        repeated / n,
        1 - len(rows) / k,
        ends / k,
        len(zlib.compress(data, 1)) / (n + 20),
    ]


@dataclass
class Model:
    """Fixed size: some hundred features whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.x):
            return np.full(len(texts), 0.5)
        raw = self.raw(np.array([statistics(t) for t in texts]).reshape(len(texts), -1))
        # a slight slope keeps order within the steps of the isotonic fit
        return np.clip(0.99 * np.interp(raw, self.x, self.y) + 0.01 / (1 + np.exp(-8 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in the order of x: the blocks' mean x and mean y."""
    blocks: list[list[float]] = []
    for a, b, c in sorted(zip(x, y, n)):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    out = np.array(blocks)
    return out[:, 0] / out[:, 2], out[:, 1] / out[:, 2]


def _stats_of(rows: DataFrame) -> DataFrame:
    def task(batches):
        for batch in batches:
            stats = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("y"), batch.column("fold"), pa.array(stats, pa.list_(pa.float64()))], ["y", "fold", "stats"])

    return map_batches(rows, task, "y double, fold int, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, features: int = 256, ridge: float = 1.0, most: int = 200_000, seed: int = 11) -> Model:
    """A model of ``labels.quality``. Weights come from folds 1 to 3, calibration from fold 4; fold 0 is not read.

    most: about so many labelled rows are used at most. Without labels of both kinds every score is 0.5.
    """
    spark = docs.sparkSession
    known = materialize(_stats_of(sample(docs, labels, "quality", most)), "stats")
    dim = len(statistics(""))
    aggs = [f(F.get("stats", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(dim)]
    *moments, kinds = known.agg(*aggs, F.count_distinct("y")).first()
    empty = np.zeros(0)
    if kinds < 2:
        return Model(empty, empty, empty, empty, empty, empty, empty)
    rng = np.random.default_rng(seed)
    scale = np.array(moments[dim:])
    w = rng.normal(size=(dim, features)) / np.sqrt(dim)
    model = Model(np.array(moments[:dim]), np.where(scale > 1e-9, scale, 1.0), w, rng.uniform(0, 2 * np.pi, features), empty, empty, empty)

    def equations(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.features(np.array(batch.column("stats").to_pylist()))
            total += z.T @ np.concatenate([z, np.array(batch.column("y"))[:, None]], 1)
        yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    fitted = known.where("fold < 4").coalesce(PARTS)
    total = np.sum([r[0] for r in map_batches(fitted, equations, "sums array<double>").toLocalIterator()], 0).reshape(features + 1, -1)
    penalty = ridge * np.eye(features + 1)
    penalty[-1, -1] = 1e-6
    model.beta = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    def scores(batches):
        for batch in batches:
            raw = model.raw(np.array(batch.column("stats").to_pylist()).reshape(batch.num_rows, -1))
            yield pa.record_batch([pa.array(raw), batch.column("y")], ["raw", "y"])

    rest = map_batches(known.where("fold = 4"), scores, "raw double, y double")
    bins = rest.groupBy(F.floor(F.greatest(F.lit(-2), F.least(F.lit(3), "raw")) * BINS)).agg(F.avg("raw"), F.avg("y"), F.count("*")).collect()
    if bins:
        model.x, model.y = isotonic(*(np.array([r[i] for r in bins], float) for i in (1, 2, 3)))
    else:
        model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(docs: DataFrame, model, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""

    def task(batches):
        for batch in batches:
            score = model.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = map_batches(rows, task, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): scores near 1 for good documents.

    Only the text counts, so equal texts get equal scores; a null text is empty. An empty table gives no
    rows; other columns are ignored.
    """
    return scored(docs, fit(docs, labels), THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    model = fit(docs, labels)

    def task(batches):
        for batch in batches:
            score = model.score([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(score >= THRESHOLD)).columns, names)

    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Spark would take a name with a dot for a field
    return map_batches(plain, task, docs.schema)

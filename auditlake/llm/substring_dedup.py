"""Suffix-array dedup: remove every byte of a string of `length` bytes that also starts elsewhere.

A depth-limited most-significant-digit radix sort of all suffixes, through their first `length` tokens only;
equal groups of such a sort are exactly the repeated windows. Tokens are bytes, or words for passages. To keep
rows few, the passes handle runs of neighbouring suffixes:

1. The first digit of a window is its anchor, the gram (64 bytes, 8 words) with the least hash in it; equal
   windows have equal anchors at equal places. Runs of windows share an anchor. Runs whose anchor is nowhere
   else are finished: none of their windows repeats.
2. The second digit is the hash of all tokens that a run's windows cover. Runs that agree in it are
   finished: all of their windows repeat.
3. What is left, one run for each content, is split into its single windows. Their last digit is the
   hash of their `length` tokens; groups of two and more repeat.

The last pass works on buckets of anchors in a task. An anchor with very many contents (a gram that a third
of all rows hold) has its windows dealt out one by one instead, and counted by partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, map_batches, materialize, release

CHUNK = 1 << 21  # window starts handled at once
BUCKET = 5000  # contents in a task of the last pass
HOT = 5000  # contents of one anchor
_rng = np.random.default_rng(20)
TABLE = _rng.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the base and its inverse, made once for as many bytes as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, INVERSE))])
        return self.up[:n], self.down[:n]


class Hashes:
    """Hashes of substrings of ``data``, bytes or hashes of words, from sums of all prefixes."""

    def __init__(self, data: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(data) + 1)
        values = TABLE[data] if data.dtype == np.uint8 else data
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(data)])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def windows(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def tokenizer(unit: str):
    """From a text in UTF-8 to its tokens: its bytes, or hashes of its words (A-Z lowered, between ASCII spaces)."""
    if unit == "bytes":
        return lambda text: np.frombuffer(text, np.uint8)
    known = WordHashes()
    return known.of


def runs(texts: list[np.ndarray], length: int, gram: int, powers: Powers) -> list[np.ndarray]:
    """Columns (text, gram's hash, contents' hash, anchor, first and last window start) of the runs of some texts' tokens."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.concatenate(texts)
    out: list[list[np.ndarray]] = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        if len(part) < length:
            break
        h = Hashes(part, powers)
        grams = h.windows(gram)
        places = np.arange(len(grams), dtype=np.uint64)
        least = _least((grams & ~np.uint64(0xFFFFFF)) | places, length - gram + 1)
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(len(anchor))
        text = np.searchsorted(ends, start + at, "right")
        fits = start + at + length <= ends[text]
        start, anchor, text = start[fits], anchor[fits], text[fits]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(text) != 0) | (np.diff(start) != 1)]))
        last = np.concatenate([new[1:], [len(start)]]) - 1
        first, final, mid, own = start[new], start[last], anchor[new], text[new]
        g = grams[mid]
        content = _mix(h.of(first, final + length) ^ _mix(g + ((mid - first) << 32 | (final - mid)).astype(np.uint64)))
        shift = at - np.concatenate([[0], ends])[own]
        out.append([own, g, content, mid + shift, first + shift, final + shift])
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def _batches(batch: pa.RecordBatch, split):
    """Tokens of a batch's texts in lists of texts of about CHUNK bytes, with the place of the first."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > CHUNK:
            yield begin, list(map(split, texts[begin:i]))
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, list(map(split, texts[begin:]))


def _runs(rows: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    schema = "doc_id long, r long, g long, c long, a long, p0 long, p1 long"

    def task(batches):
        powers, split = Powers(), tokenizer(unit)
        for batch in batches:
            for begin, texts in _batches(batch, split):
                own, g, c, a, p0, p1 = runs(texts, length, gram, powers)
                at = pa.array(own + begin)
                cols = [batch.column("doc_id").take(at), batch.column("r").take(at), *(pa.array(x.astype(np.int64)) for x in (g, c, a, p0, p1))]
                yield pa.record_batch(cols, ["doc_id", "r", "g", "c", "a", "p0", "p1"])

    return map_batches(rows, task, schema)


def _contents(rows: DataFrame, wanted: DataFrame, length: int, unit: str) -> DataFrame:
    """The wanted runs with the tokens that their windows cover."""
    each = wanted.groupBy("doc_id", "r").agg(F.collect_list(F.struct("g", "a", "p0", "p1", "n", "k")).alias("runs"))
    found = rows.join(each.toDF("_i", "_r", "runs"), rows["doc_id"].eqNullSafe(F.col("_i")) & (rows["r"] == F.col("_r"))).select("doc_id", "r", "text", "runs")

    def task(batches):
        split = tokenizer(unit)
        for batch in batches:
            ids, r, texts, all_runs = (batch.column(c) for c in ("doc_id", "r", "text", "runs"))
            texts = texts.cast(pa.binary())
            at, cols = [], {k: [] for k in ("g", "a", "p0", "n", "k", "content")}
            for i, own in enumerate(all_runs.to_pylist()):
                tokens = split(texts[i].as_py())
                for run in own:
                    at.append(i)
                    for k in ("g", "a", "p0", "n", "k"):
                        cols[k].append(run[k])
                    cols["content"].append(tokens[run["p0"] : run["p1"] + length].tobytes())
            at = pa.array(at, pa.int64())
            values = [pa.array(v, pa.binary() if k == "content" else pa.int64()) for k, v in cols.items()]
            yield pa.record_batch([ids.take(at), r.take(at), *values], ["doc_id", "r", *cols])

    return map_batches(found, task, "doc_id long, r long, g long, a long, p0 long, n long, k long, content binary")


def _windows(part: pd.DataFrame, length: int, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some runs: the run's place, the window's in the run, and the last digit."""
    data = np.frombuffer(b"".join(part["content"]), np.uint8 if unit == "bytes" else np.uint64)
    sizes = np.array([len(c) for c in part["content"]]) // data.itemsize
    begins = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    run = np.repeat(np.arange(len(part)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begins[run] + inner
    left = (part["a"] - part["p0"]).to_numpy()[run] - inner
    g = part["g"].to_numpy().view(np.uint64)[run]
    return run, inner, _mix(Hashes(data, Powers()).of(start, start + length) ^ _mix(g + left.astype(np.uint64)))


def _repeated(part: pd.DataFrame, run: np.ndarray, inner: np.ndarray, again: np.ndarray) -> pd.DataFrame:
    """Runs of windows that repeat: (doc_id, r, p0, p1)."""
    run, inner = run[again], inner[again]
    if not len(run):
        return pd.DataFrame({c: pd.Series([], dtype="Int64" if c == "doc_id" else "int64") for c in ("doc_id", "r", "p0", "p1")})
    new = np.flatnonzero(np.concatenate([[True], (np.diff(run) != 0) | (np.diff(inner) != 1)]))
    last = np.concatenate([new[1:], [len(run)]]) - 1
    own = part.iloc[run[new]]
    p0 = own["p0"].to_numpy()
    return pd.DataFrame({"doc_id": own["doc_id"].astype("Int64").to_numpy(), "r": own["r"].to_numpy(), "p0": p0 + inner[new], "p1": p0 + inner[last]})


def repeated_windows(rows: DataFrame, length: int, unit: str = "bytes") -> DataFrame:
    """(doc_id, r, p0, p1): starts of the windows of ``rows`` that repeat, as runs, each once or more; a written table."""
    gram = max(1, length * 4 // 25)
    found = materialize(_runs(rows, length, gram, unit), "runs")
    u = F.xxhash64("doc_id", "r", "a", "p0")
    each = found.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(u).alias("one"))
    digits = materialize(each, "digits")
    anchors = digits.groupBy("g").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1")
    each = digits.join(anchors, "g").select("g", "c", "n", "one", "k", (F.col("least") == 1).alias("open"))
    each = materialize(each.where("n > 1 OR open"), "digits")
    release(digits)
    again = materialize(found.join(each, ["g", "c"]), "again")
    release(found)
    release(each)
    whole = again.where("n > 1").select("doc_id", "r", "p0", "p1")

    wanted = again.where(F.col("open") & (F.col("k") > 1) & (F.col("one") == u)).dropDuplicates(["g", "c"])
    single = materialize(_contents(rows, wanted, length, unit), "contents")
    buckets = max(1, -(-single.count() // BUCKET))
    schema = "doc_id long, r long, p0 long, p1 long"

    def last_digit(part: pd.DataFrame) -> pd.DataFrame:
        run, inner, digit = _windows(part, length, unit)
        _, at, n = np.unique(digit, return_inverse=True, return_counts=True)
        return _repeated(part, run, inner, (n[at] > 1) & (part["n"].to_numpy()[run] == 1))

    few = single.where(F.col("k") <= HOT).groupBy(F.pmod(F.xxhash64("g"), F.lit(buckets))).applyInPandas(last_digit, schema)

    def deal(batches):
        for batch in (b.iloc[i : i + 500] for b in batches for i in range(0, len(b), 500)):
            if len(batch):
                run, inner, digit = _windows(batch, length, unit)
                own = batch.iloc[run]
                yield pd.DataFrame({"doc_id": own["doc_id"].astype("Int64").to_numpy(), "r": own["r"].to_numpy(), "p": own["p0"].to_numpy() + inner, "n": own["n"].to_numpy(), "d": digit.view(np.int64)})

    hot = single.where(F.col("k") > HOT)
    used = [again, single]
    out = whole.unionByName(few)
    if not hot.isEmpty():
        dealt = materialize(hot.mapInPandas(deal, "doc_id long, r long, p long, n long, d long"), "dealt")
        twice = materialize(dealt.groupBy("d").count().where("count > 1").select("d"), "twice")
        out = out.unionByName(dealt.where("n = 1").join(twice, "d").select("doc_id", "r", F.col("p").alias("p0"), F.col("p").alias("p1")))
        used += [dealt, twice]
    out = materialize(out, "repeated")
    for table in used:
        release(table)
    return out


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (begin, end) as maximal ones, in order; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def dedup_substrings(docs: DataFrame, length: int = 400, passage: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_kept, n_repeated_words, kept), a row for each row of ``docs``.

    Texts are UTF-8 bytes, null is empty. A byte goes when some string of ``length`` bytes that covers it also
    starts anywhere else, in the same document or another; strings are judged on the input, and matches never
    cross documents. n_spans counts maximal runs of removed bytes; kept are the other n_kept bytes. n_repeated_words
    reports, and removes nothing: the words that ``passage`` consecutive words cover which also start elsewhere, however
    few bytes they have and however they are spaced. Equal rows repeat each other. An empty table gives no rows; other
    columns are ignored.
    """
    rows = documents(docs).withColumn("r", F.xxhash64("text"))
    gone = [repeated_windows(rows, n, unit).withColumn("unit", F.lit(unit)) for n, unit in ((length, "bytes"), (passage, "words"))]
    each = gone[0].unionByName(gone[1]).groupBy("doc_id", "r").agg(F.collect_set(F.struct("unit", "p0", "p1")).alias("gone")).toDF("_i", "_r", "gone")
    joined = rows.join(each, rows["doc_id"].eqNullSafe(F.col("_i")) & (rows["r"] == F.col("_r")), "left").select("doc_id", "text", "gone")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, n_kept long, n_repeated_words long, kept binary"

    def task(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            texts, spans = batch.column("text").cast(pa.binary()), batch.column("gone").to_pylist()
            for i, own in enumerate(spans):
                text = texts[i].as_py()
                cut, words = (covered([(s["p0"], s["p1"] + n) for s in own or [] if s["unit"] == unit]) for n, unit in ((length, "bytes"), (passage, "words")))
                ends = [0, *(x for span in cut for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                for col, v in zip(cols, (len(text), len(text) - len(kept), len(cut), len(kept), sum(b - a for a, b in words), kept)):
                    col.append(v)
            arrays = [pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(cols)]
            yield pa.record_batch([batch.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_kept", "n_repeated_words", "kept"])

    return map_batches(joined, task, schema)

"""Benchmark decontamination with suffix arrays over the training documents.

The benchmark is a query set: it is read in blocks of bounded size, and each block goes to all tasks. A
task cuts its documents into shards, builds the suffix array of each shard (word suffixes, ordered
through the window's length) and binary-searches every benchmark suffix in it. The equal range of a
window gives all its places; consecutive places on one diagonal are one longest verbatim match.
Documents stay where they are: with a benchmark of one block nothing shuffles.

Suffixes are left out of the array when one of their first words occurs nowhere in the block, since no
window can match there; this changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches, materialize, on_row, quoted, row_keyed

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SHARD_BYTES = 16 << 20
MATCHES = "array<struct<start:int,length:int,item_id:long,item_start:int>>"


def words(text: bytes) -> list[bytes]:
    """A-Z lowered; words are runs of digits, letters and everything outside ASCII."""
    return WORD.findall(text.lower())


class Block:
    """Some benchmark items: their vocabulary and their windows as rows of sorted distinct keys."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.per = 64 // max(1, len(self.vocabulary).bit_length())  # words in a key
        seen: dict[tuple[int, ...], int] = {}
        self.places: list[list[tuple[int, int]]] = []  # of each distinct window: item, offset
        for item, ws in items:
            ids = [self.vocabulary[w] for w in ws]
            length = min(window, len(ids))
            for at in range(len(ids) - length + 1 if ids else 0):
                k = seen.setdefault(tuple(ids[at : at + length]), len(seen))
                if k == len(self.places):
                    self.places.append([])
                self.places[k].append((item, at))
        self.lengths = np.array([len(w) for w in seen], np.int32)
        self.least = int(self.lengths.min()) if seen else window
        padded = np.zeros((len(seen), window), np.uint64)
        for i, w in enumerate(seen):
            padded[i, : len(w)] = w
        top = padded.copy()
        for i, n in enumerate(self.lengths):
            top[i, n:] = (1 << (64 // self.per)) - 1
        self.low, self.high = self.keys(padded), self.keys(top)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Rows of word ids as byte strings in the same order."""
        bits = np.uint64(64 // self.per)
        flat = np.zeros((len(rows), -(-self.window // self.per)), ">u8")
        for k, at in enumerate(range(0, self.window, self.per)):
            key = np.zeros(len(rows), np.uint64)
            for j in range(at, min(at + self.per, self.window)):
                key = (key << bits) | rows[:, j]
            flat[:, k] = key << np.uint64(int(bits) * max(0, at + self.per - self.window))
        return flat.view(f"S{8 * flat.shape[1]}").ravel()

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
        """Of each text: its number of words, and its longest matches (start, length, item, item's start)."""
        get = self.vocabulary.get
        each = [words(t) for t in texts]
        sizes = [len(ws) for ws in each]
        starts = np.cumsum([0] + [n + 1 for n in sizes])  # a 0 after each text
        ids = np.zeros(int(starts[-1]) + self.window, np.uint64)
        for at, ws in zip(starts, each):
            ids[at : at + len(ws)] = [get(w, 0) for w in ws]
        out: list[tuple[int, list]] = [(n, []) for n in sizes]
        if not len(self.lengths):
            return out
        known = ids[: starts[-1]] != 0
        for j in range(1, self.least):
            known &= ids[j : j + int(starts[-1])] != 0
        places = np.flatnonzero(known)
        suffixes = self.keys(ids[places[:, None] + np.arange(self.window)]) if len(places) else self.keys(np.zeros((0, self.window), np.uint64))
        order = np.argsort(suffixes, kind="stable")
        array, places = suffixes[order], places[order]
        low, high = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        diagonals: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for k in np.flatnonzero(high > low):
            length = int(self.lengths[k])
            for p in places[low[k] : high[k]]:
                doc = int(np.searchsorted(starts, p, "right")) - 1
                at = int(p - starts[doc])
                for item, offset in self.places[k]:
                    diagonals.setdefault((doc, item, at - offset), []).append((at, length))
        for (doc, item, shift), found in sorted(diagonals.items()):
            found.sort()
            begin, end = found[0][0], sum(found[0])
            last = begin
            for at, length in found[1:]:
                if at != last + 1:
                    out[doc][1].append((begin, end - begin, item, begin - shift))
                    begin = at
                last, end = at, at + length
            out[doc][1].append((begin, end - begin, item, begin - shift))
        return out


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_words`` words, or one item. Rows without an id or words are left out."""
    items: list[tuple[int, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).where("item_id IS NOT NULL")
    for item, text in rows.toLocalIterator():
        ws = words(text.encode())
        if items and size + len(ws) > block_words:
            yield Block(items, window)
            items, size = [], 0
        items.append((item, ws))
        size += len(ws)
    yield Block(items, window)


def _pass(rows: DataFrame, block: Block) -> DataFrame:
    """(doc_id, r1, r2, n_words, matches) of each row."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item_id", pa.int64()), ("item_start", pa.int32())]))

    def task(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size < SHARD_BYTES):
                    size += len(texts[end].as_py())
                    end += 1
                found = sent.value.search(texts.slice(begin, end - begin).to_pylist())
                part = batch.slice(begin, end - begin)
                matches = [[dict(zip(("start", "length", "item_id", "item_start"), m)) for m in ms] for _, ms in found]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("r1"), part.column("r2"), pa.array([n for n, _ in found], pa.int64()), pa.array(matches, kind)],
                    ["doc_id", "r1", "r2", "n_words", "matches"],
                )
                begin = end

    return map_batches(rows, task, f"doc_id long, r1 long, r2 long, n_words long, matches {MATCHES}")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000) -> DataFrame:
    """(doc_id, r1, r2, n_words, matches), a row for each row of ``docs``.

    matches: longest verbatim runs of at least ``window`` words (all words of a shorter item) that a
    document shares with an item. Null text has no words. Items without an id or words match nothing; rows
    of one item_id are one item. Equal rows get equal results; an empty table gives none; other columns are
    ignored.
    """
    rows = row_keyed(documents(docs))
    found = None
    for block in blocks(benchmark, window, block_words):
        if found is None:
            found = _pass(rows, block)
            continue
        if isinstance(found, DataFrame):
            found = [materialize(found, "matches")]
        found.append(materialize(_pass(rows, block), "matches"))
    if isinstance(found, DataFrame):
        return found
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    both = both.groupBy("doc_id", "r1", "r2").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    return on_row(rows.drop("text"), both)


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what :func:`matches` returns."""
    ends = F.aggregate(
        F.array_sort("matches"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, m: F.struct(
            F.greatest(a["end"], m["start"] + m["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), m["start"] + m["length"] - F.greatest(a["end"], m["start"]))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        ends.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark."""
    rows = row_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*map(quoted, docs.columns)).alias("row")))
    bad = matches(docs, benchmark, window).where(F.size("matches") > 0).select("doc_id", "r1", "r2")
    bad = materialize(bad, "contaminated")  # with its size known, the planner broadcasts it only when small
    return on_row(rows.drop("text"), bad, "left_anti").select("row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM
      (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM w),
p AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM
      (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT p.rid, p.i, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.g = w.g),
h AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

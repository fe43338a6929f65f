"""Phrase collocations: candidates from a sketch, exact counts from Aho-Corasick automata.

Texts are dealt to blocks of one language and some BLOCK bytes. A block counts its words and word pairs by sketch
cell; cells meet in buckets, whose sums are upper bounds for every phrase of a cell. The cells that reach the
threshold go back to the blocks that hold them, and only there: nothing is broadcast, and a block sees no more than
its own phrases. Phrases of three and four words are counted so in a second round, where all their pairs have
passed. What has passed compiles into automata over the block's text, whose words stand between single spaces and
whose pieces are apart, so a match is a whole phrase; overlapping matches count. A block's counts go to buckets as its
cells did, in lists; sums over the blocks are exact, as hashes decide only what is looked for. Cuts, scores and containment are joins of the phrases that reach the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, materialize, prepare, release

BLOCK = 4 << 20
SLICE = 8 << 20
PATTERNS = 100_000
SALTS = 32
MOST_WORDS = 4

_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)


def _normal(text: str) -> bytes:
    """A-Z lowered, single spaces, and a line feed between spaces where a piece ends."""
    plain = text.encode().lower().translate(_ENDS).replace(b"\n", b" \n ")
    return re.sub(rb" {2,}", b" ", b" \n " + plain + b" ")


def _slices(texts: list[str]) -> Iterator[bytes]:
    """The texts of a block, each followed by the end of a piece, in parts of whole pieces and some SLICE bytes."""
    held, size = [], 0
    for text in texts:
        text = _normal(text)
        while text:
            cut = text.find(b"\n ", SLICE) if len(text) > SLICE else -1
            part, text = (text, b"") if cut < 0 else (text[:cut], b" " + text[cut:])
            if size and size + len(part) > SLICE:
                yield b"".join(held) + b" \n "
                held, size = [], 0
            held.append(part)
            size += len(part)
    if held:
        yield b"".join(held) + b" \n "


def _inverse(n: int) -> int:
    return pow(n, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a normal text: places, whether a word ends a piece, and hashes of runs of them."""

    def __init__(self, text: bytes):
        self.text = text
        at = np.frombuffer(text, np.uint8)
        space = at == 32
        self.start = np.nonzero(space[:-1] & ~space[1:])[0] + 1
        self.end = np.nonzero(space[1:] & ~space[:-1])[0] + 1
        self.stop = (at[self.start] == 10) & (self.end - self.start == 1)
        # a word's polynomial, from sums of bytes times powers of an odd base
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((at + np.uint64(1)) * _powers(_BASE, len(at)), dtype=np.uint64)])
        own = (sums[self.end] - sums[self.start]) * _powers(_inverse(_BASE), len(at) + 1)[self.start]
        own ^= own >> np.uint64(29)
        own *= _MIX
        self.own = own ^ (own >> np.uint64(32))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each k words in a row their hash, and whether they are in one piece."""
        n = max(len(self.own) - k + 1, 0)
        out, whole = np.full(n, k, np.uint64), np.ones(n, bool)
        for i in range(k):
            out = (out ^ self.own[i : i + n]) * _MIX
            out ^= out >> np.uint64(31)
            whole &= ~self.stop[i : i + n]
        return out, whole

    def phrase(self, i: int, k: int) -> str:
        return self.text[self.start[i] : self.end[i + k - 1]].decode()


def _cells(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and cell within it as one number."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) & ~_LOW) | (hashes & _LOW)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


def _kept(words: Words, heavy: np.ndarray, buckets: int, longest: int) -> list[np.ndarray]:
    """By number of words - 1, which runs of words may reach the threshold as far as heavy cells say."""
    out = []
    for k in range(1, longest + 1):
        hashes, whole = words.runs(k)
        if k > 1:
            whole &= out[-1][:-1] & out[-1][1:]
        at = np.nonzero(whole)[0]
        ok = np.zeros(len(whole), bool)
        ok[at[_among(_cells(hashes[at], buckets), heavy)]] = True
        out.append(ok)
    return out


def _counted(texts: list[str], buckets: int, most: int, heavy: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells and their counts, at most ``most``: of words and pairs, or given those cells of longer phrases."""
    found = []
    for text in _slices(texts):
        words = Words(text)
        if heavy is None:
            each = [words.runs(k) for k in (1, 2)]
        else:
            pairs = _kept(words, heavy, buckets, 2)[1]
            each = []
            for k in range(3, MOST_WORDS + 1):
                hashes, whole = words.runs(k)
                for i in range(k - 1):
                    whole = whole & pairs[i : i + len(whole)]
                each.append((hashes, whole))
        found += [np.unique(_cells(hashes[whole], buckets), return_counts=True) for hashes, whole in each]
    cells, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.nonzero(np.diff(cells, prepend=cells[:1] ^ np.uint64(1)))[0]
    return cells[first], np.minimum(np.add.reduceat(counts, first) if len(first) else counts, most)


def _heavy(part: pa.Table, least: int) -> pa.Table:
    """Of the blocks in a bucket, each one's cells whose sum over all of them reaches the threshold."""
    cells = [np.frombuffer(x, np.uint32) for x in part["cells"].to_pylist()]
    counts = [np.frombuffer(x, np.uint8) for x in part["counts"].to_pylist()]
    both = np.sort(np.concatenate(cells).astype(np.uint64) << np.uint64(8) | np.concatenate(counts))
    each = both >> np.uint64(8)
    first = np.nonzero(np.diff(each, prepend=each[:1] ^ np.uint64(1)))[0]
    sums = np.add.reduceat((both & np.uint64(255)).astype(np.int64), first)
    known = each[first[sums >= least]].astype(np.uint32)
    high = np.uint64(part["bucket"][0].as_py()) << np.uint64(32)
    kept = [(high | c[_among(c, known)].astype(np.uint64)).tobytes() for c in cells]
    return pa.table({"lang": part["lang"], "block": part["block"], "heavy": pa.array(kept, pa.binary())}).filter(pa.array([len(k) > 0 for k in kept]))


def _matches(texts: list[str], heavy: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, phrases, counts) of a block, an entry a phrase in a row's two lists; the empty phrase counts all words."""
    out = []
    for text in _slices(texts):
        words = Words(text)
        out.append((0, b"", np.array([(~words.stop).sum()], np.int64).tobytes()))
        each = []
        for k, ok in enumerate(_kept(words, heavy, buckets, MOST_WORDS), 1):
            at = np.nonzero(ok)[0]
            hashes, first = np.unique(words.runs(k)[0][at], return_index=True)
            each.append(((_cells(hashes, buckets) >> np.uint64(32)).astype(np.int64), at[first], np.full(len(first), k)))
        bucket, at, k = (np.concatenate(x) for x in zip(*each))
        order = np.argsort(bucket, kind="stable")
        wanted = [words.phrase(i, n) for i, n in zip(at[order].tolist(), k[order].tolist())]
        counts, whole = np.zeros(len(wanted), np.int64), text.decode()
        for lo in range(0, len(wanted), PATTERNS):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            own = wanted[lo : lo + PATTERNS]
            for i, phrase in enumerate(own):
                automaton.add_word(f" {phrase} ", i)
            automaton.make_automaton()
            counts[lo : lo + PATTERNS] = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(whole)), np.int64), minlength=len(own))
        cuts = np.nonzero(np.diff(bucket[order], prepend=-1))[0].tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(wanted)]):
            out.append((int(bucket[order[lo]]), "\n".join(wanted[lo:hi]).encode(), counts[lo:hi].tobytes()))
    return out


def _summed(part: pa.Table, least: int) -> pa.Table:
    """Of the blocks in a bucket, (lang, phrase, k, n) of the phrases whose counts reach the threshold, and of the empty one."""
    each = pc.list_flatten(pc.split_pattern(pa.array(part["phrases"].to_pylist(), pa.large_binary()).cast(pa.large_string()), "\n"))
    counts = np.frombuffer(b"".join(part["counts"].to_pylist()), np.int64)
    sums = pa.table({"phrase": each, "n": counts}).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
    empty = pc.equal(sums["phrase"], "")
    k = pc.if_else(empty, 0, pc.add(pc.count_substring(sums["phrase"], " "), 1))
    out = pa.table({"lang": pa.repeat(part["lang"][0], len(sums)), "phrase": sums["phrase"].cast(pa.string()), "k": k.cast(pa.int32()), "n": sums["n_sum"]})
    return out.filter(pc.or_(empty, pc.greater_equal(out["n"], least)))


def _union(binaries: list[bytes]) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(binaries), np.uint64))


def _bounds(blocks: DataFrame, least: int, before: DataFrame | None) -> DataFrame:
    """(lang, block, heavy): cells of each block that may hold a phrase of at least ``least`` occurrences."""

    def count(part: pa.Table, known: pa.Table | None = None) -> pa.Table:
        lang, block = part["lang"][0].as_py(), part["block"][0].as_py()
        heavy = None if known is None else _union(known["heavy"].to_pylist())
        cells, counts = _counted(part["text"].to_pylist(), part["buckets"][0].as_py(), min(least, 255), heavy)
        high = (cells >> np.uint64(32)).astype(np.int64)
        cuts = np.nonzero(np.diff(high, prepend=-1))[0]
        ends = np.append(cuts[1:], len(cells))
        low, counts = (cells & _LOW).astype(np.uint32), counts.astype(np.uint8)
        rows = [(lang, block, int(high[a]), low[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts, ends)]
        return pa.Table.from_pylist([dict(zip(("lang", "block", "bucket", "cells", "counts"), r)) for r in rows], schema)

    def grouped(part: pa.Table, known: pa.Table) -> pa.Table:
        return count(part, known) if len(part) and len(known) else schema.empty_table()

    schema = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("bucket", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
    kind = "lang string, block int, bucket long, cells binary, counts binary"
    groups = blocks.groupBy("lang", "block")
    counted = groups.applyInArrow(lambda part: count(part), kind) if before is None else groups.cogroup(before.groupBy("lang", "block")).applyInArrow(grouped, kind)
    counted = materialize(counted, "cells")
    heavy = materialize(counted.groupBy("lang", "bucket").applyInArrow(lambda part: _heavy(part, min(least, 255)), "lang string, block int, heavy binary"), "heavy")
    release(counted)
    return heavy


def phrase_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, phrase, k, n): all phrases of 1 to 4 words with n >= ``least`` occurrences in a language; k = 0 counts all its words.

    Sums above 255 are not needed to pass, so a ``least`` above 255 prunes as 255 does; counts stay exact.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = text.groupBy("lang").agg(F.ceil((F.sum(F.octet_length("text")) + 1) / BLOCK).cast("int").alias("buckets"))
    placed = text.join(beside(materialize(sizes, "sizes")), "lang")
    # rows have no key of their own: numbered anew as the table is written, and read from there ever after
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("buckets")).cast("int")
    blocks = materialize(placed.withColumn("block", deal), "blocks")
    short = _bounds(blocks, least, None)
    heavy = short.unionByName(_bounds(blocks, least, short))

    def scan(part: pa.Table, known: pa.Table) -> pa.Table:
        found = _matches(part["text"].to_pylist(), _union(known["heavy"].to_pylist()), part["buckets"][0].as_py()) if len(part) else []
        return pa.Table.from_pylist([{"lang": part["lang"][0].as_py(), "bucket": b, "phrases": p, "counts": n} for b, p, n in found], schema)

    # a block's counts travel by bucket, as its cells do: a row for each bucket, not one for each phrase
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])
    found = blocks.groupBy("lang", "block").cogroup(heavy.groupBy("lang", "block")).applyInArrow(scan, "lang string, bucket long, phrases binary, counts binary")
    found = found.groupBy("lang", "bucket").applyInArrow(lambda part: _summed(part, least), "lang string, phrase string, k int, n long")
    counts = materialize(found, "phrases")
    release(blocks)
    return counts


def _wide(c: Column | str) -> Column:
    return F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")


def _score(a: str, left: str, right: str) -> Column:
    """floor(2000000 * a / (l + r)), exact beyond 64 bits; at most 1000000, as both parts occur wherever the whole does."""
    return F.expr(f"CAST((CAST(2000000 AS decimal(7,0)) * CAST({a} AS decimal(20,0))) div (CAST({left} AS decimal(20,0)) + CAST({right} AS decimal(20,0))) AS long)")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` collocations of each language.

    Phrases are 2 to 4 words within a piece with a >= ``least`` occurrences, overlapping ones counted; l and r belong to the
    cut with the smallest score. Phrases within a longer one that has at least ``share`` percent of their occurrences go.
    Ranks run by score and a, largest first, then by phrase in UTF-8 order. A null lang is `und`, a null text empty;
    repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    counts = phrase_counts(docs, least)
    part = counts.where("k > 0").select("lang", "phrase", "n")
    wide = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    words, join = F.split("phrase", " "), lambda of, i, n: F.array_join(F.slice(of, i, n), " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("i"), join(words, F.lit(1), i).alias("first"), join(words, i + 1, F.col("k") - i).alias("rest"))))
    cuts = wide.select("lang", "phrase", "a", cut.alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(part.toDF("lang", "first", "l"), ["lang", "first"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", _score("a", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "i")).alias("c")).select("lang", "phrase", "a", "c.*")

    def inner(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: join(words, i, F.lit(n)))

    within = F.array_distinct(F.concat(*[F.when(F.col("k") > n, inner(n)).otherwise(F.array().cast("array<string>")) for n in range(2, MOST_WORDS)]))
    longer = wide.where("k > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(_wide("longer") * 100 < _wide("a") * share, F.lit(True)))
    # the first of each share of the phrases, then of all: no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    total = beside(counts.where("k = 0").select("lang", F.col("n").alias("words")))
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


ORACLE_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS i FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT AS score, c.i FROM c
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.i + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT lang, a, string_split(phrase, ' ') AS w, k, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE k > m),
x AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM o GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN x USING (lang, phrase) WHERE NOT coalesce(100 * longer::HUGEINT >= 80 * b.a::HUGEINT, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000
"""

"""Best-fit packing of tokenised documents into fixed-length sequences by large-item matching.

Lengths are whole numbers up to the capacity, so a packing depends on the corpus only through its
histogram of lengths: at most ``capacity`` counts, whatever the corpus' size. The driver packs the
histogram: lengths above a third of the capacity are matched greedily, two to a bin at most; shorter ones,
longest first, go to the smallest gap that holds them. Each step fills many alike bins at once, so the
plan is a bounded list of runs "documents of length L with ranks a..b, k to a bin, from bin c at offset o".
Spark then ranks the pieces of each length and looks their places up in the plan.

A length that a third of all pieces share is no hot spot: pieces are ranked in hash buckets of a length,
and the buckets' counts are summed up.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, materialize

END = "<|endoftext|>"
BUCKET_ROWS = 1_000, 50_000  # rows of a hash bucket: four times the root of all, within these


class Encoder:
    """Byte-level BPE ids as the ``tokenizers`` file gives them.

    The same vocabulary as ranks (``tiktoken``) encodes about four times as fast; texts with very long runs,
    where its time would grow with their square, and texts that it rejects, go to ``tokenizers``.
    """

    LONG = 2000

    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.pattern = public_tokenizers.PATTERN
        self.fast = self.exact = None

    def _exact(self, text: str) -> list[int]:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.fast is None:
            import tiktoken

            with open(self.ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={END: len(ranks)})
        if END in text or len(text) > self.LONG and (max(map(len, text.split()), default=0) > self.LONG or any(c * 500 in text for c in " \n\t\r")):
            return self._exact(text)
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, encoder: Encoder | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents' ids with ``end_id`` after them, cut where longer
    than ``capacity`` so that only the first piece may be shorter."""
    encode = encoder or Encoder()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    ints = pa.list_(pa.int32())

    def task(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                row = np.array(encode(text) + [end_id], "<u4")
                at, piece = 0, 0
                while at < len(row):
                    to = at + ((len(row) - at) % capacity or capacity)
                    for col, v in zip(cols, (doc_id, piece, at, to - at, zlib.crc32(row[at:to].tobytes()), row[at:to].astype("i4") if ids else None)):
                        col.append(v)
                    at, piece = to, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), ints]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if ids else 5
            yield pa.record_batch([pa.array(c, k) for c, k in list(zip(cols, kinds))[:n]], names[:n])

    return map_batches(documents(docs), task, schema)


Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """(length, first rank, pieces, pieces to a bin, first bin, offset) for a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c}
    ranks = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: first bin, bins
    bins = 0

    def put(length: int, n: int, each: int, bin_: int, offset: int) -> None:
        runs.append((length, ranks[length], n, each, bin_, offset))
        ranks[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((m for m in large if m <= min(a, capacity - a) and left[m] > (m == a)), 0)
            n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            if a == b:
                put(a, 2 * n, 2, bins, 0)
            else:
                put(a, n, 1, bins, 0)
                if b:
                    put(b, n, 1, bins, a)
            gaps[capacity - a - b].append((bins, n))
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            gap = next((g for g in range(s, capacity) if gaps[g]), 0)
            if not gap:
                gap, n = capacity, -(-left[s] // (capacity // s))
                gaps[gap].append((bins, n))
                bins += n
            first, n = gaps[gap].pop()
            each = min(gap // s, left[s])
            used = min(n, left[s] // each)
            put(s, used * each, each, first, capacity - gap)
            gaps[gap - each * s].append((first, used))
            if used < n:
                gaps[gap].append((first + used, n - used))
    return runs


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, encoder: Encoder | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): a row for each piece.

    Sequences hold at most ``capacity`` tokens, without gaps from offset 0. A null text is empty and makes a piece
    of ``end_id`` alone. Equal rows are packed each for itself; a row without a doc_id is packed like any other.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, end_id, encoder, ids), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    kind = "length long, low long, n long, each long, bin long, at long"
    placed = spark.createDataFrame(runs, kind)  # at most a few runs for each length
    total = sum(counts.values())
    buckets = max(1, round(total / np.clip(4 * total**0.5, *BUCKET_ROWS)))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (
        cut.groupBy("length", "bucket")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    here = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(placed), "length")
        .where((F.col("rank") >= F.col("low")) & (here < F.col("n")))
        .select(
            *["doc_id", "piece", "start", "length", "ids_crc32"],
            (F.col("bin") + F.floor(here / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + here % F.col("each") * F.col("length")).cast("long").alias("offset"),
            *["ids"] * ids,
        )
    )

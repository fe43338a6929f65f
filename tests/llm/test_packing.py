import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import packing

from .conftest import nasty


def want_pieces(rows, encode, capacity):
    out = []
    for i, t in rows:
        ids = encode(t or "") + [2]
        at, k = 0, 0
        while at < len(ids):
            to = at + ((len(ids) - at) % capacity or capacity)
            out.append((i, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
            at, k = to, k + 1
    return sorted(out, key=repr)


def test_whole_packing(docs, no_docs):
    encode = packing.Encoder()
    for capacity in (1024, 64):
        got = packing.pack(docs, capacity, ids=True).collect()
        assert sorted(((*r[:5],) for r in got), key=repr) == want_pieces([r[:2] for r in nasty()], encode._exact, capacity)
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        for b in bins.values():
            ends = [sum(x) for x in sorted(b)]
            assert [0, *ends[:-1]] == [x[0] for x in sorted(b)] and ends[-1] <= capacity
        assert len(bins) <= -(-sum(r["length"] for r in got) // capacity) * 1.1 + 1
    assert packing.pack(no_docs).count() == 0


def fill(runs, capacity):
    bins, seen = defaultdict(list), Counter()
    for length, low, n, each, first, at in runs:
        assert low == seen[length]
        seen[length] += n
        for k in range(n):
            bins[first + k // each].append((at + k % each * length, length))
    for b in bins.values():
        ends = [sum(x) for x in sorted(b)]
        assert [0, *ends[:-1]] == [x[0] for x in sorted(b)] and ends[-1] <= capacity
    return bins, seen


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25))
def test_plan_is_whole(counts):
    bins, seen = fill(packing.plan(counts, 40), 40)
    assert +seen == +Counter(counts)
    total = sum(k * v for k, v in counts.items())
    large = sum(v for k, v in counts.items() if 2 * k > 40)
    assert len(bins) <= max(-(-total // 40), large) * 1.34 + 1
    assert all(sum(3 * n > 40 for _, n in b) <= 2 for b in bins.values())


def test_plan_is_small_and_dense():
    rng = random.Random(3)
    counts = dict(Counter(min(1024, int(rng.lognormvariate(6, 1)) + 1) for _ in range(100_000)))
    runs = packing.plan({k: v * 1000 for k, v in counts.items()}, 1024)
    assert len(runs) < 8 * 1024
    bins = max(b + -(-n // e) for _, _, n, e, b, _ in runs)
    assert bins <= sum(k * v for k, v in counts.items()) * 1000 / 1024 * 1.03


def test_fast_ids_are_the_files_ids():
    encode = packing.Encoder()
    rng = random.Random(5)
    texts = ["", " ", "a" * 3000, " " * 5000 + "x", "it's 12'LL  \n\n é日本 <|endoftext|> end", "  x", "\r\n\t  y "]
    texts += ["".join(rng.choice("ab é日\n\t .'0<|>S~́") for _ in range(300)) for _ in range(50)]
    assert [encode(t) for t in texts] == [encode._exact(t) for t in texts]


def test_both_encoders_agree_on_a_whole_table(spark):
    encode = packing.Encoder()
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    odd = [" " * 700, "a" * 3000, "\n" * 600 + "x", "é" * 2500, "<|endoftext|>", "x <|endoftext|> y", "\u200b", "0" * 2100]
    assert all(encode(t) == encode._exact(t) for t in texts + odd)

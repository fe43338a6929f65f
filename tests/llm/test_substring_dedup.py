import random
import re
from collections import Counter

import pytest

from auditlake.llm import substring_dedup as s
from auditlake.llm.common import LOWER, UPPER

from .conftest import nasty, table_of


def brute(rows, length):
    seen = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(x and not (k and gone[k - 1]) for k, x in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytearray(c for c, x in zip(b, gone) if not x)))
    return sorted(out, key=repr)


def brute_words(rows, words):
    split = [(i, re.split("[ \\t-\\r]+", (t or "").translate(str.maketrans(UPPER, LOWER)).strip(" \t\n\v\f\r"))) for i, t in rows]
    split = [(i, w if w != [""] else []) for i, w in split]
    seen = Counter(tuple(w[p : p + words]) for _, w in split for p in range(len(w) - words + 1))
    out = []
    for i, w in split:
        hit = {x for p in range(len(w) - words + 1) if seen[tuple(w[p : p + words])] > 1 for x in range(p, p + words)}
        out.append((i, len(hit)))
    return sorted(out, key=repr)


def case(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    shared = [text(rng.choice([30, 49, 50, 51, 80, 200])) for _ in range(8)]
    rows = [(i, "".join(text(rng.randrange(70)) + rng.choice(shared) for _ in range(rng.randrange(6)))) for i in range(n)]
    rows += [(100, "ab" * 90), (101, "z" * 130), (102, "z" * 50), (103, None), (104, ""), (None, rows[5][1]), (5, rows[5][1]), (105, text(3000) + shared[5] + shared[5])]
    # one passage between many unlike neighbours
    return rows + [(200 + i, text(20) + shared[5][:45] + "0123456789" + text(20)) for i in range(40)]


COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]


@pytest.mark.parametrize("length,chunk,hot,seed", [(50, 1 << 21, 5000, 1), (50, 700, 3, 2), (12, 1 << 21, 4, 3), (3, 500, 5000, 4)])
def test_against_brute_force(spark, monkeypatch, length, chunk, hot, seed):
    monkeypatch.setattr(s, "CHUNK", chunk)
    monkeypatch.setattr(s, "HOT", hot)
    rows = case(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, r int, g string").repartition(4)
    found = s.dedup_substrings(df, length, 6).cache()
    assert table_of(found, *COLS) == brute(rows, length)
    assert table_of(found, "doc_id", "n_repeated_words") == brute_words(rows, 6)
    assert found.where("n_kept <> n_bytes - n_removed").isEmpty()


def test_nasty_and_empty(docs, no_docs):
    found = s.dedup_substrings(docs, 40, 7).cache()
    assert table_of(found, *COLS) == brute([r[:2] for r in nasty()], 40)
    assert table_of(found, "doc_id", "n_repeated_words") == brute_words([r[:2] for r in nasty()], 7)
    assert s.dedup_substrings(no_docs).count() == 0


def test_a_passage_under_the_byte_length_is_reported(spark):
    passage = " ".join(["ab", "c", "de"] * 17 + ["end"])  # 52 words, fewer than 400 bytes
    rows = [(1, f"one {passage} tail"), (2, f"two {passage.replace(' ', chr(10))} other"), (3, "nothing of the kind here")]
    found = s.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert table_of(found, "doc_id", "n_removed", "n_repeated_words") == [(1, 0, 52), (2, 0, 52), (3, 0, 0)]

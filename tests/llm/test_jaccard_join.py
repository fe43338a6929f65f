import random
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import jaccard_join as j

from .conftest import nasty, table_of
from .test_components import brute as roots


def sets(text, k):
    ws = [w.lower() for w in (text or "").encode().split()]
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, k, p, q):
    own = [(i, sets(t, k)) for i, t in rows]
    edges = []
    for x, (i, a) in enumerate(own):
        for m, b in own[:x]:
            if i is not None and m is not None and a and b and q * len(a & b) >= p * len(a | b):
                edges.append((i, m))
    of = dict(roots(edges))
    return sorted(((i, len(s), of.get(i, i)) for i, s in own), key=repr)


def case(seed, n=140):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    texts = [[word() for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90, 200]))] for _ in range(n // 4)]
    while len(texts) < n:  # near copies of near copies
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = word()
        texts.append(t[rng.randrange(2) :] or t)
    base = [word() for _ in range(300)]
    texts += [base[:a] + ["Q"] + base[a:] for a in range(0, 300, 10)]
    return [(7 * i, " ".join(t).upper() if i % 9 == 0 else "\t".join(t)) for i, t in enumerate(texts)] + [(i, t) for i, t, *_ in nasty() if i is None or i < 6]


COLS = ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("k,p,q,block,dense,seed", [(3, 90, 100, 512, 4, 1), (5, 80, 100, 512, 0, 2), (3, 90, 100, 6, 0, 3), (2, 70, 100, 9, 4, 4)])
def test_against_brute_force(spark, monkeypatch, k, p, q, block, dense, seed):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "DENSE", dense)  # 0: whatever is left is linked within its block
    rows = case(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, keys string").repartition(4)
    got, want = table_of(j.groups(df, k, p, q), *COLS), brute(rows, k, p, q)
    assert got == want and max(Counter(r[2] for r in want).values()) > 4


def test_nasty_and_empty(docs, no_docs):
    rows = [r[:2] for r in nasty()]
    of = {r[0]: r[2] for r in brute(rows, 5, 80, 100)}
    got = table_of(j.groups(docs), *COLS)
    assert [(r[0], r[1]) for r in got] == sorted([(i, len(sets(t, 5))) for i, t in rows], key=repr)
    assert all(of[r[0]] == r[2] for r in got)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if of[i] == i), key=repr)
    assert j.groups(no_docs).count() == 0 and j.keep_one(no_docs).count() == 0


def test_segments_cover_every_pair():
    for p, q in ((90, 100), (80, 100)):
        s = j.Segments(p, q)
        for a in range(1, 150):
            for b in range(a, a * q // p + 1):
                shared = set(s.of(a)) & set(s.of(b))
                least = -(-p * (a + b) // (p + q))
                assert any(m - spare > a + b - 2 * least for _, m, spare in shared), (a, b)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(8)
    for p, q in ((90, 100), (80, 100), (60, 100)):
        s = j.Segments(p, q)
        for n in [*range(2, 60), 200, 500] * 3:
            common = max(1, -(-n * p // q))
            pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[n - common : n], pool[n : n + (n - common) * 2 // 5]]))
            if j.linked(a, b, p, q):
                assert set(s.keys(a)) & set(s.keys(b)), (p, n)


def test_tree_prunes_only_what_cannot_link():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (30, 60, 200)]
    x = []
    for i in range(90):
        s = base[i % 3].copy()
        s[: rng.integers(0, 9)] = rng.integers(0, 2**63, 1).astype(np.uint64)
        x.append(np.unique(s))
    n, bits, own = np.array([len(s) for s in x]), np.stack([j.bitmap(s) for s in x]), np.arange(90) // 2
    tree = lambda a, b: j.Tree(n[a:b], bits[a:b], own[a:b])
    for left, right, shift in ((tree(0, 90),) * 2 + (0,), (tree(0, 40), tree(40, 90), 40)):
        found = {tuple(sorted((a, b + shift))) for a, b, _ in j.pairs(left, right, 90, 100).tolist()}
        every = [(a, b) for b in range(90) for a in range(b if shift == 0 else min(b, 40)) if b >= shift and own[a] != own[b]]
        want = {(a, b) for a, b in every if j.linked(x[a], x[b], 90, 100)}
        assert want <= found and len(found) < 0.6 * len(every)
    some = j.best(np.array([[0, 1, 5], [0, 2, 9], [1, 2, 3], [0, 3, 7]]), 2)
    assert some.tolist() == [[0, 2, 9], [0, 3, 7], [1, 2, 3]]


def test_many_sets_just_below_the_threshold(spark, monkeypatch):
    """All share most words, too few to link, and bitmaps can't tell; output stays in proportion to the documents."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(880)]
    rows = [(i, " ".join(base + [f"o{i}x{k}" for k in range(120)])) for i in range(150)]
    rows += [(1000 + i, " ".join(base + [f"o{i}x{k}" for k in range(90)] + [f"n{i}x{k}" for k in range(30)])) for i in range(0, 150, 10)]
    rng.shuffle(rows)
    left = []
    inner = j._may_link

    def watched(*args):
        found = inner(*args)
        left.append((found[0].count(), found[1] is not None, args[-1]))
        return found

    monkeypatch.setattr(j, "_may_link", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert table_of(j.groups(df, 1, 80, 100), *COLS) == brute(rows, 1, 80, 100)
    assert [(n < 20 * len(rows), most) for n, _, most in left] == [(True, j.FIRST), (True, None)] and left[1][1]

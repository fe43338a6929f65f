import numpy as np
import pytest

from auditlake.llm import embedding_dedup as e

from .conftest import table_of
from .test_components import brute as roots


def brute(rows, least=0.98):
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, edges = dict.fromkeys(range(len(rows)), 0), []
    for x in good:
        for y in good:
            a, b = np.array(rows[x][1], float), np.array(rows[y][1], float)
            if x != y and rows[x][2] == rows[y][2] and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                n[x] += 1
                edges.append((rows[x][0], rows[y][0]))
    of = dict(roots(edges))
    return sorted(((i, n[k], of.get(i, i), i is not None and of.get(i, i) == i) for k, (i, _, _) in enumerate(rows)), key=repr)


def case():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 5 == 0)))
    rows += [(1000 + i, rows[3][1], 0) for i in range(8)] + [(1001, rows[3][1], 0), (1020, rows[3][1], 1), (1021, [2 * x for x in rows[3][1]], 0)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [nan] + [1.0] * 15, [inf] + [1.0] * 15, rows[3][1][:8], rows[3][1][:8]]
    rows += [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, rows[3][1], None), (None, rows[3][1], 0)]
    return rows


COLS = ["vec_id", "n_links", "component_id", "kept"]


def test_against_brute_force(spark, monkeypatch):
    rows = case()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, n string, cell int").repartition(3)
    assert table_of(e.near_duplicates(df), *COLS) == brute(rows)
    monkeypatch.setattr(e, "BLOCK", 16)  # hot cells in blocks
    assert table_of(e.near_duplicates(df, sample=60), *COLS) == brute(rows)
    assert e.near_duplicates(df.limit(0)).count() == 0
    assert e.near_duplicates(df.where("label IS NULL")).count() == 1


def test_probes_are_sufficient():
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(3000, 8)))
    y = unit(x + rng.normal(size=x.shape) * 0.04)
    index = e.fit(x, 40)
    cell, codes, err = index.encode(y)
    near = (x * y).sum(1) >= 0.98
    assert near.sum() > 500 and index.probes(x, 0.2)[np.arange(len(x)), cell][near].all()


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_probes_fall_with_the_table_and_keep_recall():
    """Of isotropic vectors, whose neighbours lie at the radius, where they cross most."""
    rng = np.random.default_rng(5)
    shares = []
    for n in (2000, 8000, 32000):
        x = unit(rng.normal(size=(n, 64)))
        index = e.fit(x[:8000], round(n**0.5))
        asked = x[:1500]
        off = rng.normal(size=asked.shape)
        near = unit(asked + 0.2 * unit(off - (off * asked).sum(1, keepdims=True) * asked))
        index.share = min(1.0, e.SPREAD / np.sqrt(index.dims))
        hit = index.probes(asked, 0.2)
        assert hit[np.arange(len(asked)), e._nearest(near, index.centres)].mean() >= 0.999
        shares.append(hit.mean())
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.06


def test_recall_in_many_dimensions(spark):
    rng = np.random.default_rng(6)
    base = unit(rng.normal(size=(700, 48)))
    near = unit(base + rng.uniform(0.05, 0.22, size=(700, 1)) * unit(rng.normal(size=base.shape)))
    x = np.concatenate([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in e.near_duplicates(df).collect()}
    y = unit(x.astype(float))
    want = (y @ y.T >= 0.98).sum(1) - 1
    assert want.sum() > 900 and sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))


@pytest.mark.parametrize("dim", [64, 256, 768])
def test_mixed_dimensions(spark, dim):
    """Vectors along a circle among isotropic ones: their offsets all point at a bisector."""
    rng = np.random.default_rng(dim)
    plane = np.linalg.qr(rng.normal(size=(dim, 2)))[0]
    turn = rng.uniform(0, 2 * np.pi, 800)
    x = np.concatenate([unit(rng.normal(size=(1200, dim))), unit(np.stack([np.cos(turn), np.sin(turn)], 1) @ plane.T)]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    y = unit(x.astype(float))
    linked = y @ y.T >= 0.98
    want = linked.sum(1) - 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(df).collect()}
    assert want.sum() > 30_000 and sum(n for n, _ in got.values()) >= 0.99 * want.sum() and all(got[i][0] <= n for i, n in enumerate(want))
    if dim == 64:
        rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
        assert sum(r["n_links"] for r in e.near_duplicates(df, exact=True).collect()) == want.sum() and len(rows) == len(got)


def test_links_count_for_both_sides(spark, monkeypatch):
    """With a reach that is far too small, a link that one side finds still counts for the other, copies included."""
    monkeypatch.setattr(e, "SPREAD", 0.5)
    monkeypatch.setattr(e, "_measured", lambda *a: 0.0)
    rng = np.random.default_rng(9)
    base = unit(rng.normal(size=(150, 4)))
    x = np.concatenate([base, unit(base + 0.1 * unit(rng.normal(size=base.shape))), base[:40]])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    linked = unit(x) @ unit(x).T >= 0.98
    got = np.array([r["n_links"] for r in e.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= linked.sum(1) - 1).all() and got.sum() >= 0.5 * (linked.sum() - len(x))
    assert got.sum() % 2 == 0  # each link twice

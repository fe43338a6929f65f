import itertools
import math
import zlib

import numpy as np
import pytest

from auditlake.llm import labelled, quality, toxicity

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("module,column,least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(tables, module, column, least):
    docs, labels = tables
    rows = module.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r[column] for r in held]) >= least
    one, zero = ([r["score"] for r in held if r[column] == y] for y in (1, 0))
    assert np.mean([[a > b for b in zero] for a in one]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= module.THRESHOLD) for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(docs, no_docs, tables, module):
    labels = tables[1]
    out = module.classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    assert not [r for r in out.where("doc_id IS NULL").collect() if r["held_out"]]
    assert module.classify(no_docs, labels).count() == 0
    assert module.classify(docs, labels.limit(0)).count() == docs.count()


def test_quality_filter(tables):
    docs, labels = tables
    kept = quality.keep_good(docs, labels)
    good = quality.classify(docs, labels).where("predicted = 1").select("doc_id")
    assert kept.columns == docs.columns and kept.select("doc_id").exceptAll(good).count() == 0 and kept.count() == good.count()
    clean = labels.where("quality = 1").join(docs, "doc_id", "left_semi")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.01 * clean.count()


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0]), np.ones(6))
    assert (np.diff(y) > 0).all() and np.allclose(y, [0, 1 / 3, 1]) and np.allclose(x, [0, 2, 4.5])


def test_sample_is_bounded(tables):
    docs, labels = tables
    all_rows = labelled.sample(docs, labels, "toxic", 10**6)
    some = labelled.sample(docs, labels, "toxic", 100)
    assert 0 < some.count() <= 150 < all_rows.count() and all_rows.where("fold = 0").count() == 0


@pytest.fixture(scope="module")
def restorer(spark):
    texts = ["you are an idiot and a worthless moron", "what a pathetic clown and loser, stupid trash", "all letters of that disgusting scum"] * 50
    return toxicity.Restorer(toxicity.language_model(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")))


@pytest.mark.parametrize(
    "seen,word",
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("m0r0n!!", "moron"), ("p@thet1c", "pathetic"), ("idiooooot", "idiot"), ("$cum", "scum"), ("TR4SH", "trash"), ("m-0-r-0-n", "moron")],
)
def test_restoration(restorer, seen, word):
    assert word in restorer.text(f"so {seen} there").lower().split()


@pytest.mark.parametrize(
    "seen,word",
    [("$tup1d", "stupid"), ("+r@sh", "trash"), ("(l0wn", "clown"), ("$tuuupid", "stupid"), ("$(um", "scum"), ("$cum!!!", "scum"), ("wor+hle$$", "worthless"), ("(1d10t)", "idiot"), ("*m0r0n*", "moron"), ('"$tup1d!"', "stupid")],
)
def test_symbols_at_the_ends_of_a_word(restorer, seen, word):
    assert word in restorer.text(f"so {seen} there").lower().split()


@pytest.mark.parametrize(
    "seen,words",
    [
        ("you are a s t u p i d person", "you are a stupid person"),
        ("y o u i d i o t", "you idiot"),
        ("what I s t u p i d there", "what i stupid there"),
        ("that s t u p i d  c l o w n", "that stupid clown"),
        ("l.o.s.e.r..t.r.a.s.h", "loser trash"),
        ("what 2 i d i o t s", "what idiots"),
        ("an $ t u p i d loser", "an stupid loser"),
        ("an i d ! o t there", "an idiot there"),
        ("an ( i d i o t ) there", "an idiot ) there"),
        ("an i d i o t ! there", "an idiot there"),
        ("! ! ! ! !", "! ! ! ! !"),
    ],
)
def test_spelled_out_words(seen, words):
    texts = ["you are an idiot and a worthless moron", "what a pathetic clown and loser, stupid trash", "and I said that I am, a person there"] * 50
    counts = toxicity.trigram_counts(texts).reshape((toxicity.SYMBOLS,) * 3)
    pair = counts.sum(0) + 0.5
    pair /= pair.sum(1, keepdims=True)
    lm = np.log((counts + 20 * pair) / (counts.sum(2, keepdims=True) + 20))
    assert toxicity.Restorer(lm).text(seen).lower().split() == words.split()


def test_plain_words_stay(restorer):
    assert restorer.text("all letters of that, a 1999 book: été!!") == "all letters of that, a 1999 book: été!!"
    assert restorer.text("") == ""


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    dim, n = 8, 40_000
    empty = np.zeros(0)
    model = quality.Model(np.zeros(dim), np.ones(dim), rng.normal(size=(dim, n)) / np.sqrt(dim), rng.uniform(0, 2 * np.pi, n), empty, empty, empty)
    x = rng.normal(size=(30, dim))
    z = model.features(x)[:, :-1]
    exact = [[math.exp(-sum((p - q) ** 2 for p, q in zip(a, b)) / (2 * dim)) for b in x] for a in x]
    assert np.abs(z @ z.T - exact).max() < 0.03


def test_summed_equations_give_the_ridge_solution(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels, features=32)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(quality.statistics(texts[r["doc_id"]]), r["quality"], fold(r["doc_id"])) for r in labels.collect() if r["doc_id"] in texts and fold(r["doc_id"])]
    stats = np.array([s for s, _, _ in known])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.where(stats.std(0) > 1e-9, stats.std(0), 1.0))
    part = [k for k, (_, _, f) in enumerate(known) if f < 4]
    z, y = model.features(stats[part]), np.array([known[k][1] for k in part], float)
    rows = np.concatenate([z, np.diag([1.0] * 32 + [1e-3])])  # ridge regression as least squares over more rows
    beta = np.linalg.lstsq(rows, np.concatenate([y, np.zeros(33)]), rcond=None)[0]
    assert np.allclose(model.beta, beta, atol=1e-5)
    rest = [k for k, (_, _, f) in enumerate(known) if f == 4]
    order = model.raw(stats[rest])
    assert (np.diff(np.interp(np.sort(order), model.x, model.y)) >= 0).all()


def naive_path(nodes, lm):
    """The best of all paths through a lattice, each scored whole."""

    def score(path):
        total, a, b = sum(price for _, price in path), 0, 0
        for x in "".join(s for s, _ in path):
            k = toxicity._symbol(x)
            total, a, b = total + lm[a, b, k], b, k
        return total + lm[a, b, 0]

    return max(score(path) for path in itertools.product(*nodes)), score


def test_trigram_counts_and_decoding_against_brute_force():
    rng = np.random.default_rng(4)
    texts = ["you 1d10t, an Idiot", "Été à la  plage!", "", "a", "trash & scum"] * 3
    counts = np.zeros((toxicity.SYMBOLS,) * 3, int)
    for t in texts:
        symbols = [toxicity._symbol(c.lower() if c.isascii() else c) if c.isascii() else 27 for c in f" {t} "]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            counts[a, b, c] += 1
    assert (toxicity.trigram_counts(texts).reshape(counts.shape) == counts).all()

    lm = np.log(rng.dirichlet(np.ones(toxicity.SYMBOLS), size=(toxicity.SYMBOLS, toxicity.SYMBOLS)))
    pieces = ["1", "d", "0", "@", "$", "tt", "!", "b", "66", "ooo"]
    seen = []
    inner = toxicity._likeliest

    def watched(nodes, own):
        out = inner(nodes, own)
        best, score = naive_path(nodes, own)
        paths = [p for p in itertools.product(*nodes) if "".join(s for s, _ in p) == out]
        assert max(map(score, paths)) == pytest.approx(best)
        seen.append(out)
        return out

    toxicity._likeliest = watched
    try:
        for _ in range(40):
            toxicity.decode("".join(rng.choice(pieces, rng.integers(1, 6))), lm, int(rng.integers(2)), int(rng.integers(2)))
            toxicity.spelled(" ".join(rng.choice(["i", "d", "1", "0", "t", "a", "$"], rng.integers(4, 6))), lm)  # gaps are arcs: a word ends or goes on
    finally:
        toxicity._likeliest = inner
    assert len(seen) == 80 and any(" " in s for s in seen)

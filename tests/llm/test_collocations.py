import random
import re
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import collocations as c

from .conftest import table_of

COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most):
    total, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    for lang in total:
        found = {p: a for (x, p), a in f.items() if x == lang and a >= least and len(p) > 1}
        scored = []
        for p, a in found.items():
            inside = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, _, p, a, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), a, left, right, total[lang], -score))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(4)
    vocab = ["the", "of", "Été", "été", "ÀB", "New", "york", "city", "a\x00b", "日本", "x-y", "'s"]
    made = []
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", " \x0b"]) for w in words)
        made.append((i, text, rng.choice(["en", "de", None, "und"])))
    made += [(900, None, "en"), (901, "", "en"), (902, " \t", "fr"), (903, "New York city " * 400 + "the the the the", "en"), (903, "New York city " * 400, "en"), (None, "of the " * 40, None)]
    return made + [(950, "same words over and over. " * 3, "de")] * 20


@pytest.mark.parametrize("least, most", [(3, 2000), (12, 5), (30, 2000)])
def test_against_brute_force(spark, monkeypatch, least, most):
    made = rows()
    df = spark.createDataFrame([(*r, "b", 1, 2) for r in made], "doc_id long, text string, lang string, phrase string, block int, k int").repartition(3)
    monkeypatch.setattr(c, "BLOCK", 4000)
    monkeypatch.setattr(c, "PATTERNS", 50)
    assert table_of(c.collocations(df, least, most), *COLS) == brute(made, least, most)
    if most == 5:
        assert c.collocations(df.limit(0)).count() == 0


def test_slices_hold_whole_pieces(monkeypatch):
    text = "New York, the city of x. " * 300 + "no end " * 200
    monkeypatch.setattr(c, "SLICE", 1000)
    parts = list(c._slices([text, "", "of x"]))
    assert len(parts) > 5
    count = lambda t: Counter(tuple(p.split()) for p in t.split(b"\n") if p.split())
    assert sum(map(count, parts), Counter()) == count(b"\n".join(map(c._normal, [text, "of x"])))


def test_sums_decide_across_blocks(spark, monkeypatch):
    """A phrase that is rare in each block is found by the sum of its cells."""
    monkeypatch.setattr(c, "BLOCK", 200)
    made = [(i, f"w{i} alpha beta gamma z{i}", "en") for i in range(40)]
    got = table_of(c.collocations(spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(4), 30), *COLS)
    assert got == brute(made, 30, 2000) and [r[2] for r in got] == ["alpha beta gamma"]


def test_score_is_exact_beyond_64_bits(spark):
    a, left, right = 2**62 + 1, 2**63 - 1, 2**62 + 12345
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(c._score("a", "l", "r")).first()[0] == 2_000_000 * a // (left + right)


def test_blocks_give_a_row_a_bucket(spark, monkeypatch):
    """What the blocks hand on are lists by bucket: more phrases make no more rows."""
    texts = ["one two three four five. " * 3, "two three and one two"]
    blocks = [c.Words(t) for t in c._slices(texts)]
    cells = [c._cells(w.runs(k)[0], 2) for w in blocks for k in range(1, 5)]
    found = c._matches(texts, np.unique(np.concatenate(cells)), 2)
    assert len(found) <= 3 and {b for b, *_ in found} <= {0, 1}
    rows = [(p, n) for _, ps, ns in found for p, n in zip(ps.decode().split("\n"), np.frombuffer(ns, np.int64).tolist(), strict=True)]
    assert dict(rows) | {"": 20, "two three": 4, "one two three four": 3, "and one two": 1} == dict(rows) and len(dict(rows)) == len(rows)

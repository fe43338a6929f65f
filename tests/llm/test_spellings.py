import random
import re
import zlib
from collections import Counter

import pytest

from auditlake.llm import spellings as s

from .conftest import table_of

COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, near = {}, {}
    for w in n:
        own = [v for v in n if distance_one(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abé×") for _ in range(rng.randint(6, 10))) for _ in range(60)] + ["abababab" + x for x in "abé"]
    made = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "a" + w[at + 1 :]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        made.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    chain = [("tttttttt", 1), ("ttttttttu", 20), ("ttttttttuv", 250), ("ttttttttuvw", 2600)]
    made += [(500, " ".join(" ".join([w] * (n * 2)) for w, n in chain)), (None, " ".join(base)), (None, None), (501, None), (502, ""), (503, "x" * 30000 + " " + "y" * 9), (503, "x" * 30000)]
    return made + [(600, "repeated repeates")] * 3


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, monkeypatch, hot):
    made = rows()
    if hot:
        monkeypatch.setattr(s, "HOT", 10)
        monkeypatch.setattr(s, "PART", 4)
        monkeypatch.setattr(s, "SHARD", 50)
        monkeypatch.setattr(s, "FLUSH", 20)
    df = spark.createDataFrame([(*r, "w", 1, True) for r in made], "doc_id long, text string, word string, n int, front boolean").repartition(3)
    got = table_of(s.spelling_variants(df), *COLS)
    assert got == brute(made)
    assert any(r[1] and r[1] != r[2] for r in got)
    if hot:
        assert s.spelling_variants(df.limit(0)).count() == 0


def test_a_pair_shares_exactly_one_key():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
        at = rng.randrange(len(a) + 1)
        b = rng.choice([a[:at] + a[at + 1 :], a[:at] + "b" + a[at:], a[:at] + "c" + a[at + 1 :]])
        assert s.one_edit(a, b) == distance_one(a, b)
        if distance_one(a, b):
            assert len(set(s._owned(a)) & set(s._asked(b))) == 1

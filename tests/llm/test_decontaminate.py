import hashlib
import random
import re

from auditlake.llm import decontaminate as d

from .conftest import table_of


def brute(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        ws, hit, found = words(t), set(), set()
        for item, b in items:
            bs = words(b)
            n = min(window, len(bs))
            grams = {tuple(bs[k : k + n]) for k in range(len(bs) - n + 1)} if n else set()
            for k in range(len(ws) - n + 1):
                if n and item is not None and tuple(ws[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["Ab", "cd", "É", "x1", "zz", "q"]) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(10, text(30)), (9, text(12)), (9, text(12)), (7, "ab cd zz"), (3, ""), (4, None), (None, text(11)), (11, text(400))]
    docs = [(i, text(rng.randrange(60))) for i in range(20)] + [(50, None), (51, ""), (None, items[0][1]), (52, "AB, cd; zz")]
    docs += [(60 + i, text(5) + " " + items[i % 2][1][3:] + " " + text(20)) for i in range(6)] * 2 + [(70, items[7][1] * 3)]
    return docs, items


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_against_brute_force(spark):
    for seed, block_words in ((1, 500_000), (2, 40)):
        docs, items = case(seed)
        a = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        assert table_of(d.report(d.matches(a, b, block_words=block_words)), *COLS) == brute(docs, items)


def test_longest_matches(spark):
    item = [f"w{i}" for i in range(25)]
    b = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    a = spark.createDataFrame([(1, " ".join(["a", "b"] + item[3:20] + ["c"]))], "doc_id long, text string")
    assert [tuple(m) for m in d.matches(a, b).first()["matches"]] == [(2, 17, 5, 3)]


def test_removal_and_empty_tables(spark, docs, no_docs):
    b = spark.createDataFrame([(5, "one two")], "item_id long, text string")
    out = d.decontaminate(docs, b)
    assert out.columns == docs.columns and out.count() == docs.count() - 1
    assert d.decontaminate(no_docs, b).count() == 0
    assert d.decontaminate(docs, b.limit(0)).count() == docs.count()

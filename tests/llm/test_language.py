import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import language as m
from auditlake.llm import registry
from auditlake.llm.labelled import held_out

from .conftest import table_of


def brute_bits(texts, text):
    """Bits of a text by the definition, context by context."""
    follow = defaultdict(Counter)
    for t in texts:
        data = m._plain(t)
        for i in range(m.ORDER, len(data)):
            for k in range(m.ORDER + 1):
                follow[data[i - k : i]][data[i]] += 1
    bits, data = 0.0, m._plain(text)
    for i in range(m.ORDER, len(data)):
        for k in range(m.ORDER, -1, -1):
            seen = follow.get(data[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def model_of(texts):
    rows = Counter((lang, int(k)) for lang, own in texts.items() for t in own for k in m._runs(np.frombuffer(m._plain(t), np.uint8), m.ORDER + 1))
    return m.build(np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], np.int64), np.array(list(rows.values())))


def test_code_lengths_by_definition(monkeypatch):
    rng = random.Random(2)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = {"a": [text("abc de", 300), text("abc", 5)], "b": [text("xyz aé", 200)], "c": [text("abxy日 ", 250)]}
    model = model_of(texts)
    asked = ["abc", "é", "q", text("abcdexyzé日q ", 80), text("abc ", 400)]
    got = m._sums(model, [m._plain(t) for t in asked])
    want = [[brute_bits(texts[lang], t) for lang in model.languages] for t in asked]
    assert np.allclose(got, want, rtol=1e-4)
    monkeypatch.setattr(m, "PART", 100)  # a long text in parts
    assert np.allclose(m._sums(model, [m._plain(asked[-1])]), want[-1:], rtol=1e-4)
    assert [p for p, _ in m.predict(model, asked)] == [p for p, _ in (m.predict(model, [t])[0] for t in asked)]


def test_table_finds_all_and_no_others():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = m.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(np.setdiff1d(rng.integers(0, 1 << 40, 5000).astype(np.uint64), keys)) == -1).all()
    assert len(table.rest) and (m.Table(keys[:0]).find(keys) == -1).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = registry.QUERIES["op13_language"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id")
    r = found.agg(F.count("*").alias("n"), F.avg((F.expr("lang = lang_pred AND held_out")).cast("int")).alias("ok"), F.avg(F.col("held_out").cast("int")).alias("held"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["n"] == docs.count() and r["ok"] / r["held"] >= 0.99 and 0 <= r["lo"] <= r["hi"] <= 1


def test_odd_rows(spark, docs, no_docs):
    rng = random.Random(5)
    word = {"en": "the and of ", "de": "der und das ", "fr": None}
    made = [(i, word[x] * rng.randint(1, 9) if word[x] else None, x) for i in range(60) for x in word]
    made += [(1000, None, "en"), (1001, "", None), (1002, "12 :; \t", "en"), (1003, "und " * 300_000, None), (None, "the and", "xx"), (1003, "of the", None), (1003, "of the", None)]
    df = spark.createDataFrame([(*r, "p", 1.0) for r in made], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in m.identify(df).collect()}
    assert m.identify(df).count() == len(made)
    by = {k[0]: v for k, v in got.items()}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0) and by[1003][0] in ("de", "en") and by[None][0] == "en"
    assert {v[0] for v in by.values()} == {"und", "en", "de"}  # fr has no text, xx no id: neither is learned
    assert table_of(m.identify(docs), "lang_pred") == [("und",)] * docs.count()  # no row has a language
    assert m.identify(no_docs).count() == 0


@pytest.mark.parametrize("most, most_bytes, nodes", [(8, 1 << 20, 10_000), (20_000, 500, 10_000), (20_000, 1 << 20, 40)])
def test_bounds_of_the_sample(spark, most, most_bytes, nodes):
    rows = [(i, ("the cat sat " if i % 2 else "der hund lief ") * 5, "en" if i % 2 else "de") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = m.identify(df, most, most_bytes, nodes).join(df.select("doc_id", "lang", held_out(F.col("doc_id")).alias("h")), "doc_id")
    assert found.where("lang = lang_pred AND held_out = h").count() == 400

import re

import pytest

from auditlake.plans import registry

from .oracle import both, views

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(DATA)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_same_rows(spark, con, name):
    got, want = both(spark, con, DATA, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())


def test_edits_do_not_overlap(spark):
    rows = registry.QUERIES["edit_overlap"](spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["file_path"], r["start"], r["end"], r["rule_id"])):
        kept = by.setdefault(r["file_path"], [])
        clash = any((r["start"] < e and s < r["end"]) or (s == r["start"] and s == e and r["start"] == r["end"]) for s, e in kept)
        assert r["kept"] != clash
        if not clash:
            kept.append((r["start"], r["end"]))


def test_middleware_of_all_events(spark):
    folder = "/root/testdata/sf0.01"
    name = "middleware_before_all"
    got, want = both(spark, views(folder), folder, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert got == want and len(got) > 10_000


def test_first_sentence_of_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = registry.QUERIES["first_sentence_all"](spark, folder).collect()
    want = {k: None if t is None else re.sub(r"\.$", "", re.sub(r"\s+", " ", t, flags=re.A).split(". ")[0]) for k, t in texts.items()}
    assert len(rows) == len(texts) and {r["doc_id"]: r["hint"] for r in rows} == want
    assert max(len(h or "") for h in want.values()) > 300


def test_closure_from_every_root(spark):
    folder = "/root/testdata/sf0.001"
    roots = {r["root"] for r in registry.QUERIES["call_closure_all"](spark, folder).select("root").distinct().collect()}
    assert roots == {r["o_orderkey"] for r in spark.read.parquet(f"{folder}/orders.parquet").collect()}

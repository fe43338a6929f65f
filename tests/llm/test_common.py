import ast
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import auditlake.llm
import corpus_pipeline
from auditlake.llm import collocations, decontaminate, embedding_dedup, jaccard_join, language, line_dedup, packing, quality, secret_scan, spellings, substring_dedup, toxicity, warc
from auditlake.llm.common import DROP_SHUFFLES, materialize

from .conftest import nasty


def test_materialize_keeps_rows_and_the_session_setting(spark):
    before = spark.conf.get(DROP_SHUFFLES, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    first, second = materialize(counts, "test"), materialize(counts, "test")  # the second write needs its shuffle anew
    assert sorted(first.collect()) == sorted(second.collect()) and first.count() == 7
    assert spark.conf.get(DROP_SHUFFLES, None) == before
    spark.conf.set(DROP_SHUFFLES, "false")
    materialize(counts, "test")
    assert spark.conf.get(DROP_SHUFFLES) == "false"
    spark.conf.unset(DROP_SHUFFLES)


def test_writes_of_several_threads_restore_the_setting(spark):
    before = spark.conf.get(DROP_SHUFFLES, None)
    threads = [threading.Thread(target=lambda i=i: materialize(spark.range(100 * i).groupBy("id").count(), "test")) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(DROP_SHUFFLES, None) == before


def names() -> list[str]:
    """All names that the operators' modules use for columns, keys and the like: every string that may be one; and a dotted name."""
    found = set()
    for path in Path(auditlake.llm.__file__).parent.glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier() and len(node.value) < 16:
                found.add(node.value.lower())
    return sorted(found - {"doc_id", "text", "embedding", "label", "vec_id", "page_id", "url", "html", "item_id", "quality", "toxic"}) + ["a.b", "back`tick"]


def clashing(df):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names()) if n not in df.columns])


@pytest.fixture(scope="module")
def side_tables(spark):
    labels = spark.createDataFrame([(3 * i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "password abcdefghijkl012")], "item_id long, text string")
    return labels, benchmark


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(i, t) for i, t, *_ in nasty()]
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return plain, materialize(clashing(plain), "wide")


def with_lang(df):
    return df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))


OPERATORS = {
    "1": lambda d, labels, items: line_dedup.line_dedup(d),
    "2": lambda d, labels, items: secret_scan.scan(d),
    "3": lambda d, labels, items: quality.classify(d, labels).select("doc_id", "predicted"),
    "4": lambda d, labels, items: toxicity.classify(d, labels).select("doc_id", "predicted"),
    "5": lambda d, labels, items: decontaminate.matches(d, items),
    "6": lambda d, labels, items: packing.pack(d).select("doc_id", "piece", "ids_crc32"),
    "8": lambda d, labels, items: jaccard_join.groups(d),
    "9": lambda d, labels, items: substring_dedup.dedup_substrings(d),
    "11": lambda d, labels, items: collocations.collocations(with_lang(d), least=2),
    "12": lambda d, labels, items: spellings.spelling_variants(d, least_chars=3),
    "13": lambda d, labels, items: language.identify(with_lang(d)),
}


@pytest.mark.parametrize("n", OPERATORS)
def test_columns_with_clashing_names_change_nothing(wide, side_tables, n):
    plain, clash = wide
    got, want = (sorted(map(tuple, OPERATORS[n](d, *side_tables).collect()), key=repr) for d in (clash, plain))
    assert got == want and got


def test_clashing_names_of_vectors_and_pages(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 3), 0.5], 1) for i in range(12)], "vec_id long, embedding array<double>, label int")
    p = spark.createDataFrame([(i, "u", f"x{i % 4}" if i % 5 else None) for i in range(12)], "page_id long, url string, html string")
    for operator, df in ((embedding_dedup.near_duplicates, v), (warc.round_trip, p)):
        got, want = (sorted(map(tuple, operator(d).collect()), key=repr) for d in (clashing(df), df))
        assert got == want and len(got) == 12


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_clashing_columns(wide, side_tables, k, spark, tmp_path):
    for name, df in zip(("labels", "benchmark"), side_tables):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    plain, clash = wide
    stage = corpus_pipeline.STAGES[k][1]
    got, want = stage(spark, clash, str(tmp_path)), stage(spark, plain, str(tmp_path))
    assert got.columns == clash.columns and [f.dataType for f in got.schema] == [f.dataType for f in clash.schema]
    own = [i for i, n in enumerate(clash.columns) if n in ("doc_id", "text")]
    rows = sorted((tuple(r[i] for i in own) for r in got.collect()), key=repr)
    assert rows == sorted(map(tuple, want.select("doc_id", "text").collect()), key=repr)
    fixed = clash.columns.index("a.b")
    assert {r[fixed] for r in got.collect()} <= {names().index("a.b")}


def test_run_with_odd_rows(spark, tmp_path, side_tables, docs, no_docs):
    """Nulls, empty texts, repeated rows and other columns through the whole pipeline; and an empty table."""
    for tag, table in (("odd", docs), ("none", no_docs)):
        folder = f"{tmp_path}/{tag}"
        for name, df in zip(("labels", "benchmark", "documents"), (*side_tables, table)):
            df.write.parquet(f"{folder}/{name}.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        rows = out.collect()
        assert (len(rows) > 0) == (tag == "odd") and all(0 < r["length"] <= 1024 for r in rows)
        assert {r["doc_id"] for r in rows} <= {i for i, *_ in nasty()}

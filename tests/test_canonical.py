import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from auditlake.functions import canonical
from auditlake.plans import reports
from auditlake.sources import packs


def test_numbers_as_on_the_driver(spark):
    rnd = random.Random(7)
    values = [0.0, -0.0, 5e-324, 2e23, 1e23, 1e21, 1e-6, 1e-7, 2.0**53, 2.0**63, 1.7976931348623157e308, 2.2250738585072014e-308, 0.1 + 0.2, 9.5e-322, 7.040758118638911e18, 5.966672584960166e-154, 1584749955525932.5]
    while len(values) < 20_000:
        values += [rnd.random() * 10 ** rnd.randint(-8, 25), round(rnd.random() * 1e6, 2), -(2.0 ** rnd.randint(-1070, 1020))]
        values += [v for v in [struct.unpack(">d", rnd.randbytes(8))[0]] if math.isfinite(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", canonical.number(F.col("v")).alias("json")).collect()
    assert not [r for r in rows if r["json"] != reports.canonical_json(r["v"])]


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_numbers_that_json_lacks(spark, bad):
    with pytest.raises(Exception, match="not a JSON number"):
        spark.createDataFrame([(bad,)], "v double").select(canonical.number(F.col("v"))).collect()


def test_nested_values_as_on_the_driver(spark):
    kind = "b string, a struct<z:double,`\u20ac`:array<map<string,long>>,`\U0001f600`:boolean,`\ufb33`:int>, e array<string>, d decimal(10,2)"
    odd = "".join(map(chr, range(40))) + '\\u000b"é\u2028\U0001f600\x7f/'
    rows = [
        (odd, (1e21, [{"\U0001f600": 2**60 + 1, "\ufb33": -1, odd: None}, {}], True, 3), [None, "", odd], None),
        (None, (None, None, None, None), [], None),
        ("", None, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    each = df.select(F.struct("*").alias("v"))
    got = [r[0] for r in each.select(canonical.value(F.col("v"), each.schema["v"].dataType)).collect()]
    assert got == [reports.canonical_json(r[0].asDict(True)) for r in each.collect()]
    bare = [r[0] for r in each.select(canonical.value(F.col("v"), each.schema["v"].dataType, drop_nulls=True)).collect()]
    assert bare[1] == '{"a":{},"e":[]}' and bare[2] == '{"b":""}'
    with pytest.raises(TypeError):
        canonical.value(F.col("v"), spark.sql("SELECT date'2020-01-01' AS v").schema["v"].dataType)


def test_content_hash_reads_lists_and_numbers(spark):
    rules = spark.createDataFrame([("p", "b", [1.0, 2.5], {"k": None}), ("p", "a", None, {})], "provider string, rule_id string, n array<double>, m map<string,string>")
    text = '[{"m":{},"n":null,"rule_id":"a"},{"m":{"k":null},"n":[1,2.5],"rule_id":"b"}]'
    assert packs.content_hash(rules, ["provider"], ["n", "rule_id", "m"]).first()["content_hash"] == spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


def test_written_report(spark, tmp_path):
    row = ("f", "r/a", "high", "not-verified", "p", 3, None, "h", "x", False)
    kind = "finding_id string, rule_id string, severity string, state string, file_path string, line int, snippet string, handler_id string, line_hash string, suppressed boolean"
    reports.write_json(spark.createDataFrame([row], kind), str(tmp_path))
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/findings").collect()]
    assert lines == ['{"file_path":"p","finding_id":"f","handler_id":"h","line":3,"line_hash":"x","rule_id":"r/a","severity":"high","state":"not-verified","suppressed":false}']
    whole = spark.read.text(f"{tmp_path}/envelope").first()[0]
    assert json.loads(whole)["schema"] == 1 and whole == reports.canonical_json(json.loads(whole))

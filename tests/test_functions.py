import json
import subprocess

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import scalars as x
from auditlake.operators import joins, predicates
from auditlake.plans.reports import canonical_json
from auditlake.sources import history, packs
from auditlake.streaming import watch


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "s string").select(*columns).first())


def test_lines_and_names(spark):
    s = F.col("s")
    assert one(spark, " a \t b \n", x.normal_line(s)) == ("a b",)
    assert one(spark, "a.b.c", x.dotted_suffixes(s)) == (["a.b.c", "b.c", "c"],)
    assert one(spark, "src/A.b.TSX", x.extension(s), x.basename(s)) == (".tsx", "A.b.TSX")
    assert one(spark, "ghp_1", x.secret_class(s)) == ("github-token",) and one(spark, "x", x.secret_class(s)) == ("unknown",)
    assert one(spark, "failed https://h/x with whsec_12", x.sanitised(s)) == ("failed <redacted> with <redacted>",)
    assert [one(spark, n, x.queue_call(s))[0] for n in ("jobQueue.add", "set.add", "Worker")] == [("bullmq", "enqueue"), None, ("bullmq", "consume")]


def test_redaction_leaves_no_literal(spark):
    text = """k = "whsec_abc"; n = 'it\\'s' + 12.5; f(x1)"""
    (got,) = one(spark, text, x.redacted(F.col("s"), ["whsec_"]))
    assert got == "k = <SECRET_LITERAL>; n = <STRING:5> + <NUMBER>; f(x1)"


@pytest.mark.parametrize(
    "pattern,path,fits",
    [("*.md", "a/b.md", True), ("/x", "a/x", False), ("docs/", "a/docs/x/y", True), ("docs/", "a/docs", False), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("f?.ts", "f/.ts", False), ("{a,b}.py", "x/b.py", True)],
)
def test_ignore_patterns(spark, pattern, path, fits):
    regex, _ = x.ignore_regex(pattern)
    assert one(spark, path, F.col("s").rlike(regex)) == (fits,)


@pytest.mark.parametrize("value,text", [(0, "0"), (-0.0, "0"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (123.456, "123.456"), (-5e-324, "-5e-324"), (333333333.3333333, "333333333.3333333")])
def test_canonical_numbers(value, text):
    assert canonical_json(value) == text


json_values = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda v: st.lists(v) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), v), max_leaves=12)


@given(json_values)
def test_canonical_json_round_trips(value):
    text = canonical_json(value)
    again = json.loads(text, parse_int=float)
    assert again == value and canonical_json(again) == text


def test_canonical_json_order_and_errors():
    assert canonical_json({"\U0001f600": 1, "דּ": 2, "a": [True, None]}) == '{"a":[true,null],"\U0001f600":1,"דּ":2}'
    for bad in (float("nan"), object(), "\ud800"):
        with pytest.raises((ValueError, TypeError)):
            canonical_json(bad)


CASES = [
    ("nothing", "stripe", [], [("path_pattern_match", "stripe")], {"missing-signature-verification": "not-verified"}),
    ("sdk", "stripe", [("stripe.webhooks.constructEvent", "stripe")], [("sdk_verify_call", "stripe"), ("body_as_bytes_or_buffer", "unknown")], {"library-verified": "verified"}),
    ("unsafe", "stripe", [("crypto.createHmac", None), ("crypto.sha256", None)], [("signature_header_read", "stripe"), ("body_as_bytes_or_buffer", "unknown")], {"timing-unsafe-comparison": "not-verified", "missing-timestamp-check": "manual-review"}),
    ("safe", "stripe", [("crypto.createHmac", None), ("crypto.sha256", None), ("crypto.timingSafeEqual", None), ("Date.now", None)], [("body_as_bytes_or_buffer", "unknown")], {}),
    ("md5", "stripe", [("createHmac", None), ("crypto.md5", None), ("timingSafeEqual", None), ("Date.now", None)], [], {"wrong-hmac-algorithm": "not-verified"}),
    ("both", "stripe", [("createHmac", None), ("crypto.md5", None), ("crypto.sha256", None), ("timingSafeEqual", None), ("Date.now", None)], [], {"wrong-hmac-algorithm": "manual-review"}),
    ("import", "stripe", [], [("sdk_import", "stripe")], {"missing-signature-verification": "not-verified", "unreachable-verification": "manual-review"}),
    ("tie", "multiple", [("createHmac", None)], [("signature_header_read", "stripe")], {}),
]


def test_rule_decisions(spark):
    handlers = spark.createDataFrame([(c[0], c[1]) for c in CASES], "handler_id string, provider string")
    reached = spark.createDataFrame([(c[0], n, s, 1) for c in CASES for n, s in c[2]], "handler_id string, qualified_name string, import_source string, hops int")
    seen = spark.createDataFrame([(c[0], k, p) for c in CASES for k, p in c[3]], "handler_id string, kind string, provider string")
    known = spark.sql("SELECT 'stripe' AS provider, array('stripe') AS packages, array('webhooks.constructEvent') AS calls, 'sha256' AS algorithm, 'raw_body' AS input_format")
    got = {}
    for r in predicates.verdicts(predicates.features(handlers, reached, seen, known)).collect():
        got.setdefault(r["handler_id"], {})[r["rule_class"]] = r["state"]
    assert got == {c[0]: c[4] for c in CASES if c[4]}


def test_plans_stay_distributed(spark):
    t = spark.range(1000).selectExpr("id AS handler_id", "concat('a.b', id % 7) AS qualified_name", "'x' AS import_source")
    calls = spark.createDataFrame([("p", "b1"), ("q", "b2")], "provider string, call string")
    plan = joins.verify_calls(t, calls, spark.createDataFrame([("p", "x"), ("q", "y")], "provider string, package string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan


def test_history(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", tmp_path, "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    for i, (name, text) in enumerate([("a.py", "x = 1\n"), ("b.py", "x = 1\n"), ("a.py", "x = 2\n"), ("bin", "a\0b")]):
        (tmp_path / name).write_text(text)
        git("add", "-A")
        git("commit", "-qm", str(i))
    got = {(r["path"], r["text"]) for r in history.blobs(spark, str(tmp_path)).collect()}
    assert {t for _, t in got} == {"x = 1\n", "x = 2\n"} and len(got) == 2
    (tmp_path / "b.py").write_text("y\n")
    assert {r[0] for r in history.changed(spark, str(tmp_path), "HEAD~2").collect()} == {"a.py", "bin", "b.py"}
    assert history.base_ref(None, {"GITHUB_BASE_REF": "main"}, "abc") == "origin/main" and history.base_ref(None, {}, None) == "HEAD~1"


def test_settings():
    defaults = {"a": 1, "b": 2, "c": 3}
    assert packs.config({"a": 9}, {"a": 8, "b": 7}, '{"b": 6, "c": 5}', defaults) == {"a": 9, "b": 7, "c": 5}
    with pytest.raises(ValueError):
        packs.config({}, {}, '{"z": 1}', defaults)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ts").write_text("app.post('/webhooks/stripe', f);\n")
    for n in (1, 2):
        watch.watch(watch.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        got = {r["file_path"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert got == ({"a.ts"} if n == 1 else {"a.ts", "b.py"})
        (tmp_path / "in" / "b.py").write_text("from fastapi import FastAPI\n@app.post('/hook')\ndef f(): pass\n")


def test_paths_of_any_depth(spark):
    rows = [("a/b/c", "../../x.ts", "a/x.ts"), ("a", "./y", "a/y"), ("", "../z", "../z"), ("a", "../../z", "../z"), ("/".join("abcdefghijkl"), "../" * 11 + "m", "a/m"), ("a/b", "..", "a"), (None, "q", "q"), ("/r/s", "../t", "/r/t"), ("a", "./b/./../c", "a/c")]
    df = spark.createDataFrame(rows, "folder string, path string, want string")
    assert [r for r in df.select("want", x.joined_path(F.col("folder"), F.col("path")).alias("got")).collect() if r["want"] != r["got"]] == []

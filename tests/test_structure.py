import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import extract, ordered, structure
from auditlake.plans import handlers, scan
from auditlake.sources import files
from auditlake.sources.tables import written

from .oracle import both, views

SOURCES = {
    "a.ts": "/* app.post('/x', f) ' */ // it's\nconst t = `a ${b} // no`; const r = /['\"(]/g;\napp.post(\n  '/webhooks/stripe', // c\n  mw,\n  async (req, res) => {\n    foo.bar(1, [2, \"x,y\"], baz());\n  }\n);\n"
    "class A extends B {\n  constructor(x) { super(x); }\n  async go(a: string): Promise<void> {\n    const f = async (y) => { inner(y); };\n    if (q(a)) { z() }\n  }\n}\nexport default function (r) { return k(r) }\nconst g = x => { m(x) };\nh();\n",
    "b.py": '"""doc: app.post("/x")"""\nimport os\nclass A(\n    B,\n):\n    def one(self,\n            x):\n        y = f(x)\n        def nested():\n            return g()\n\n        return y\n    z = w()\nif True:\n    def two(): pass\n# def three():\nthree()\n',
    "c.go": "package main\nfunc (s *T) Serve(w http.W, r *R) (int, error) {\n  if ok(r) { go f() }\n}\nfunc Get(a int) error {\n x()\n}\n",
    "d.php": "<?php\n#[Route('/a')]\nclass C { public function run(): int { return $this->go(\"a'b\"); } }\n# function no()\n",
    "e.ts": "", "f.ts": "}) ( [", "g.ts": "/* open\n app.post('/webhooks/x', f)",
}


@pytest.fixture(scope="module")
def texts(spark):
    out = extract.texts(files.given(spark, SOURCES))
    return extract.Texts(out.rows, out.toks.cache(), out.functions.cache())


def test_masking_keeps_places(spark):
    given = files.given(spark, SOURCES)
    for r in given.select("file_path", "text", structure.masked(F.col("text"), F.col("language")).alias("m")).collect():
        assert len(r["m"]) == len(r["text"]) and r["m"].count("\n") == r["text"].count("\n")
        assert all(x in (y, " ") for x, y in zip(r["m"], r["text"]))
    plain = {r["file_path"]: r["m"] for r in given.select("file_path", structure.masked(F.col("text"), F.col("language")).alias("m")).collect()}
    assert "it's" not in plain["a.ts"] and "// no`" in plain["a.ts"] and "/['\"(]/g" in plain["a.ts"]
    assert "doc" not in plain["b.py"] and "#[Route" in plain["d.php"] and "no()" not in plain["d.php"] and "app.post" not in plain["g.ts"]


def test_long_texts_do_not_exhaust_the_stack(spark):
    long = "x = '" + "a\\'" * 200_000 + "'; /*" + "*" * 200_000 + "*/ f(" + "1," * 50_000 + "2);\n"
    given = files.given(spark, {"l.ts": long})
    toks = structure.tokens(given.withColumn("text", structure.masked(F.col("text"), F.col("language"))))
    assert toks.where("ch = ','").count() == 50_000 and structure.parts(toks).agg(F.max("n")).first()[0] == 50_001


def test_calls_and_callers(texts):
    got = {(r["file_path"], r["line"], r["caller"], r["qualified_name"]) for r in extract.calls(texts.toks, texts.functions).collect()}
    ts = [(3, "<module>", "app.post"), (7, "<module>", "foo.bar"), (7, "<module>", "baz"), (13, "f", "inner"), (14, "go", "q"), (14, "go", "z"), (17, "default", "k"), (18, "g", "m"), (19, "<module>", "h")]
    py = [(3, "<module>", "A"), (8, "one", "f"), (10, "nested", "g"), (13, "<module>", "w"), (17, "<module>", "three")]
    other = [("c.go", 3, "Serve", "ok"), ("c.go", 3, "Serve", "f"), ("c.go", 6, "Get", "x"), ("d.php", 2, "<module>", "Route"), ("d.php", 3, "run", "$this->go")]
    assert got - {("b.py", 3, "<module>", "A")} == {("a.ts", *t) for t in ts} | {("b.py", *t) for t in py if t[2] != "A"} | set(other)


def test_function_extents(texts):
    got = {(r["file_path"], r["name"], r["owner"], r["start"], r["end"]) for r in texts.functions.collect()}
    assert {("a.ts", "A", None, 10, 16), ("a.ts", "go", "A", 12, 15), ("a.ts", "f", None, 13, 13), ("a.ts", "default", None, 17, 17), ("a.ts", "g", None, 18, 18)} <= got
    assert {("b.py", "A", None, 3, 13), ("b.py", "one", "A", 6, 12), ("b.py", "nested", None, 9, 11), ("c.go", "Serve", None, 2, 4), ("d.php", "run", "C", 3, 3)} <= got
    symbols = {(r["file_path"], r["name"]) for r in extract.symbols(texts.functions).collect()}
    assert {("b.py", "A.one"), ("a.ts", "A.go"), ("a.ts", "default")} <= symbols


def test_parts(texts):
    rows = structure.parts(texts.toks.where("file_path = 'a.ts' AND (line = 7 OR k < 9)")).collect()
    call = [r for r in rows if r["k"] == 9]
    assert [(r["index"], r["n"], r["text"]) for r in sorted(call, key=lambda r: r["index"])] == [(0, 3, "1"), (1, 3, None), (2, 3, None)]
    assert [r["text"] for r in sorted((r for r in rows if r["k"] == 11), key=lambda r: r["index"])] == ["2", '"x,y"']


@pytest.mark.parametrize("name", ["handler_statements", "inline_middleware"])
def test_all_layouts(spark, name):
    folder = "/root/testdata/sf0.01"
    got, want = both(spark, views(folder), folder, handlers.QUERIES[name], handlers.ORACLE_SQL[name])
    assert got == want and len(got) > 10_000


def test_short_circuits_do_not_verify(spark):
    rows = spark.createDataFrame([("a", 1, 0, "verify", True, True), ("a", 1, 1, "db.query", False, False), ("a", 1, 2, "log", False, True)], "file_path string, body_k int, statement int, name string, tested boolean, returns boolean")
    sinks = spark.createDataFrame([("verify", "verification"), ("db.query", "side_effect")], "name string, class string")
    assert [r["class"] for r in ordered.classified(rows, sinks).orderBy("ord").collect()] == ["verification", "side_effect", "short_circuit"]


def test_routes_in_any_layout(spark):
    """What line expressions lost: broken calls, options over lines, prefixes, class views; and what they took from comments."""
    sources = {
        "a.ts": "import Stripe from 'stripe';\napp.post(\n  '/webhooks/stripe',\n  async (req, res) => {\n    db.insert(req.body);\n  },\n);\nstripe.webhooks.constructEvent(a, b, c);\n",
        "b.ts": "import fastify from 'fastify';\nserver.route({\n  method: 'POST',\n  url: '/webhooks/stripe',\n  handler: async (req) => {},\n});\n",
        "c.ts": "/*\napp.post('/webhooks/stripe', h);\n*/\n",
        "api/r.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.post('/stripe')\nasync def hook(r):\n    pass\n",
        "api/main.py": "from fastapi import FastAPI\napp.include_router(\n    router, prefix='/webhooks',\n)\n",
        "dj/views.py": "from django.views import View\nclass Hook(View):\n    def post(self, r):\n        return 1\n",
        "dj/urls.py": "from django.urls import path\nurlpatterns = [path('hooks/x', Hook.as_view())]\n",
        "l.php": "<?php\nuse Illuminate\\Support\\Facades\\Route;\nRoute::post('/shopify/webhook', function ($r) {\n  $b = $r->getBody();\n  $h = $_SERVER['HTTP_X_SHOPIFY_HMAC_SHA256'];\n});\n",
    }
    result = scan.scan(files.given(spark, sources))
    got = {(r["file_path"], r["framework"], r["route"], r["method"], r["line"], r["end_line"]) for r in result.handlers.collect()}
    assert got == {
        ("a.ts", "express", "/webhooks/stripe", "POST", 2, 7),
        ("b.ts", "fastify", "/webhooks/stripe", "POST", 2, 6),
        ("api/r.py", "fastapi", "/webhooks/stripe", "POST", 3, 5),
        ("dj/views.py", "django", "/hooks/x", "POST", 3, 4),
        ("dj/urls.py", "django", "/hooks/x", "POST", 2, 2),
        ("l.php", "laravel", "/shopify/webhook", "POST", 3, 6),
    }
    states = {(r["file_path"], r["rule_id"]): r["state"] for r in result.findings.collect()}
    assert states["a.ts", "stripe/missing-signature-verification"] == "not-verified"  # the call after the handler's end is not its own
    assert ("l.php", "shopify/raw-body-misuse") not in states


def test_brackets_of_many_files_at_once(spark):
    """Against a plain walk of each file: unbalanced brackets, empty and missing texts, batches and code points beyond one byte."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["(", ")", "[", "]", "{", "}", ",", ";", "é\n", "日x", " a ", "𝒳"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "no brackets", ")))((", None]
    want = []
    for f, text in enumerate(texts):
        toks, level, open_at, line, gap = [], 0, {}, 1, ""
        for pos, c in enumerate(text or ""):
            line += c == "\n"
            if c not in "()[]{},;":
                gap += c
                continue
            group = open_at.get(level) if level > 0 else None
            toks.append([f"{f}.ts", len(toks), c, gap, line, pos, group, None])
            gap = ""
            if c in "([{":
                level += 1
                open_at[level] = len(toks) - 1
            elif c in ")]}":
                if group is not None:
                    toks[group][7] = len(toks) - 1
                level -= 1
        want += map(tuple, toks)
    given = spark.createDataFrame([(f"{f}.ts", "js", t) for f, t in enumerate(texts)], "file_path string, language string, text string").repartition(3)
    toks = structure.tokens(given)
    got = [tuple(r) for r in toks.select("file_path", "k", "ch", "gap", "line", "pos", "group", "end_k").where(F.col("ch").isin(*"()[]{},;")).collect()]  # what follows the last of them is a row too
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by = {(r["file_path"], r["k"]): r for r in toks.collect()}
    for (f, k), r in by.items():
        assert r["group_ch"] == (None if r["group"] is None else by[f, r["group"]]["ch"])
        after = by.get((f, k + 1))
        assert r["next_ch"] == (after and after["ch"]) and (r["prev_gap"] is None) == (not (k and by[f, k - 1]["ch"] == "["))
        end = r["end_k"] is not None and by[f, r["end_k"]]
        assert [r[c] for c in ("end_line", "end_pos", "then_ch", "then_gap")] == ([end[c] for c in ("line", "pos", "next_ch", "next_gap")] if end else [None] * 4)


def test_ends_of_brackets_need_no_join(spark):
    t = extract.texts(files.given(spark, {"a.ts": "class A { go(a) { f(b); } }\nh(1);\n"}), written)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (structure._braced(t.toks), extract.calls(t.toks, t.functions))]
    assert not any("Join" in p for p in plans)
    assert {(r["caller"], r["qualified_name"]) for r in extract.calls(t.toks, t.functions).collect()} == {("go", "f"), ("<module>", "h")}

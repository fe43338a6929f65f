"""Plans over intermediate tables: what is small only as a compressed file must not be broadcast, and nothing is computed several times."""

from pyspark.sql import functions as F

from auditlake.operators import extract, joins, reachability, structure
from auditlake.sources import files, tables, workflow
from auditlake.sources.tables import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    one = written(spark.range(2000).select("id", F.lit("x").alias("a")), "one")
    assert "Broadcast" not in plan(one.join(spark.range(3000).withColumn("b", F.lit(1)), "id", "left"))
    assert "BroadcastHashJoin" in plan(one.join(joins.few(spark.range(3).toDF("id")), "id"))  # catalogs still are


def test_calls_of_source_texts_broadcast_nothing(spark):
    text = extract.texts(files.given(spark, {"a.ts": "class A {\n  go() { f(); }\n}\n", "b.py": "class A:\n    def go(self):\n        f()\n"}), written)
    for df in (structure.functions(text.toks, text.rows), extract.calls(text.toks, text.functions)):
        assert "BroadcastExchange" not in plan(df)


def test_files_are_dealt_out_once(spark):
    given = written(files.given(spark, {"a.ts": "f(a, [b], { c: 1 });\n"}), "masked")
    assert plan(structure.tokens(given)).count("Exchange ") == 1 and structure.tokens(given).where("ch rlike '[^ \\\\n]'").count() == 9


def test_statements_read_their_tokens_once(spark):
    source = {f"{i}.ts": "app.post('/x', (req) => {\n  if (!verify(req)) { return; }\n  db.query(a);\n});\n" for i in range(3)}
    toks = extract.texts(files.given(spark, source), written).toks
    bodies = written(structure.last_bodies(toks, toks.where("ch = '(' AND gap = 'app.post'").select("file_path", "k")), "bodies")
    kept = []
    found = structure.statements(toks, bodies, lambda df, tag: kept.append(tag) or written(df, tag))
    assert kept == ["body_tokens"] and "bodies-" not in plan(found)
    rows = {(r["statement"], r["name"], r["tested"], r["returns"]) for r in found.where("file_path = '1.ts'").collect()}
    assert rows == {(0, "verify", True, True), (1, "db.query", False, False)}


def test_closure_sorts_roots_only_where_some_are_cut(spark):
    edges = spark.range(40).selectExpr("id AS src", "id + 1 AS dst", "id AS ord")
    seeds = edges.selectExpr("src AS root", "dst AS node", "ord")
    whole, cut = reachability.closure(seeds, edges, 4, 4), reachability.closure(seeds, edges, 4, 3)
    assert "Window" not in plan(whole) and "Window" in plan(cut)
    want = {(r, r + h, h) for r in range(40) for h in range(1, 5) if r + h <= 40}
    assert {tuple(r) for r in whole.collect()} == want and {tuple(r) for r in cut.collect()} == {w for w in want if w[2] < 4}


def test_scan_is_planned_in_small_steps(spark, monkeypatch):
    from auditlake.plans import scan
    from auditlake.operators import reachability as closing

    sizes = {}

    def kept(df, tag):
        sizes[tag] = max(sizes.get(tag, 0), plan(df).count("Exchange "))
        return spark.createDataFrame([], df.schema)  # the plans are what counts here

    monkeypatch.setattr(scan, "written", kept)
    monkeypatch.setattr(closing, "written", kept)
    scan.scan(files.given(spark, {"a.ts": "app.post('/webhooks/x', (req) => { f(req); });\n"}))
    assert sizes["evidence"] <= 20 and sizes["findings"] <= 20, sizes


def test_lines_within_brackets_share_the_exchange_of_indents(spark):
    source = "def f(\n    a,\nb,\n):\n    x = [\n1,\n]\n    return (a)\n\nclass A(\nB):\n  def g(self): pass\n)\n[\ndef h(): pass\n"
    given = written(files.given(spark, {"a.py": source, "b.py": "def f():\n  pass\n"}), "masked")
    toks = written(structure.tokens(given), "tokens")
    found = structure._indented(toks, extract.lines(given))
    assert {(r["file_path"], r["name"], r["start"], r["end"]) for r in found.collect()} == {("a.py", "f", 1, 9), ("a.py", "A", 10, 12), ("a.py", "g", 12, 12), ("a.py", "h", 15, 15), ("b.py", "f", 1, 2)}
    assert "LeftAnti" not in plan(found)


def test_workflow_documents_are_parsed_once(spark):
    hook = '{"name": "W", "type": "n8n-nodes-base.webhook", "parameters": {"path": "in"}}'
    docs = [None, "{", "[]", '{"nodes": null, "connections": {}}', f'{{"nodes": [{hook}]}}', f'{{"nodes": [null, {hook}, {hook}], "connections": {{}}}}', '{"nodes": [{"type": "my.Webhook"}], "connections": {}}']
    flows = written(spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "file_path string, text string"), "flows")
    for df in (workflow.handlers(flows), workflow.open_triggers(flows)):
        assert (plan(df).count("from_json("), plan(df).count("parseJson(")) == (1, 1)
        assert sorted((r["file_path"], r["node"], r["route"]) for r in df.collect()) == [("5", "W", "/in"), ("5", "W", "/in")]


def test_steps_within_files_need_no_exchange(spark):
    source = {f"{i}.ts": "app.post('/x', (req) => {\n  if (!verify(req)) { return; }\n  db.query(a);\n});\nfunction f() { g(1); }\n" for i in range(9)}
    text = extract.texts(files.given(spark, source), tables.dealt)
    calls = text.toks.where("ch = '(' AND gap = 'app.post'").select("file_path", "k")
    bodies = tables.dealt(structure.last_bodies(text.toks, calls), "bodies")
    kept = []
    found = structure.statements(text.toks, bodies, lambda df, tag: kept.append(df) or tables.dealt(df, tag))
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with tables._where_files_are(spark):
        for df in (structure.functions(text.toks, text.rows), structure.last_bodies(text.toks, calls), extract.calls(text.toks, text.functions), *kept, found):
            assert "Exchange hashpartitioning" not in plan(df)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    rows = {(r["statement"], r["name"], r["tested"], r["returns"]) for r in found.where("file_path = '1.ts'").collect()}
    assert rows == {(0, "verify", True, True), (1, "db.query", False, False)}
    assert {tuple(r) for r in extract.calls(text.toks, text.functions).where("file_path = '1.ts'").select("caller", "qualified_name").collect()} == {("<module>", "app.post"), ("<module>", "verify"), ("<module>", "db.query"), ("f", "g")}


def test_next_brace_beside_a_parenthesis(spark):
    given = files.given(spark, {"a.ts": "f(a) { g(b); }; h(c, () => { i(); });\nif (x) y();", "b.py": "f(a)\n"})
    rows = structure.tokens(given).where("ch = '('").select("file_path", "gap", "body_ch", "body_k", "body_end_k").collect()
    found = {(r["file_path"], r["gap"].strip()): (r["body_ch"], r["body_k"], r["body_end_k"]) for r in rows}
    assert found["a.ts", "f"] == ("{", 2, 6) and found["a.ts", "g"] == (";", 5, None) and found["a.ts", "i"] == (";", 15, None)
    assert found["a.ts", "h"] == (";", 18, None) and found["a.ts", "if"] == (";", 23, None) and found["b.py", "f"] == (None, None, None)
    assert found["a.ts", ""] == ("{", 12, 16)


def test_overrides_read_a_written_table_by_file(spark):
    from auditlake.plans import scan
    from auditlake.sources import packs

    pack = spark.createDataFrame([("a/x", "a", "high", [], "x", {}, [(["src/**"], "low")], ["R"]), ("a/y", "a", "info", ["flask"], "y", {}, [], [])], packs.RULES)
    rows = [("a/x", "h1", "src/a.ts", 1, "verified", "c", "express"), ("a/x", "h2", "lib/a.ts", 1, "verified", "c", "express"), ("a/y", "h3", "src/b.ts", 1, "verified", "c", "express")]
    found = scan._by_rules(spark.createDataFrame(rows, "rule_id string, handler_id string, file_path string, line int, state string, code string, framework string"), pack)
    with tables._where_files_are(spark):
        assert "auditlake_kept_" in plan(found) and "Exchange hashpartitioning" not in plan(found)
    assert {(r["file_path"], r["severity"], tuple(r["references"])) for r in found.collect()} == {("src/a.ts", "low", ("R",)), ("lib/a.ts", "high", ("R",))}


def test_matchers_read_written_steps(spark, monkeypatch):
    from auditlake.plans import handlers

    kept = []
    for name in ("dealt", "written"):
        monkeypatch.setattr(handlers, name, lambda df, tag, f=getattr(tables, name): kept.append(tag) or f(df, tag))
    monkeypatch.setattr(handlers.matchers, "verdicts", lambda facts, *_: facts.arguments.withColumns({"handler_id": F.lit(""), "rule_id": F.lit(""), "state": F.lit("")}))
    handlers.matcher_verdicts(spark, "/root/testdata/sf0.001")
    assert {"reached", "arguments", "middleware"} <= set(kept)


def test_inline_middleware_reads_written_routes(spark, monkeypatch):
    from auditlake.plans import handlers

    kept = []
    monkeypatch.setattr(handlers, "dealt", lambda df, tag: kept.append(tag) or tables.dealt(df, tag))
    assert handlers.inline_middleware(spark, "/root/testdata/sf0.001").count() > 0 and kept[-2:] == ["routes", "inline"]

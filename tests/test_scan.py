import json
import os

import pytest

from auditlake import catalog
from auditlake.operators import extract, joins, reachability
from auditlake.plans import reports, scan
from auditlake.sources import files, packs, tables, workflow

SOURCES = {
    "src/open.ts": "import express from 'express';\nimport Stripe from 'stripe';\nconst app = express();\napp.post('/webhooks/stripe', (req, res) => {\n  const s = req.headers['stripe-signature'];\n  db.insert(req.body);\n});\n",
    "src/sdk.ts": "import Stripe from 'stripe';\nconst stripe = new Stripe(k);\nrouter.post('/api/webhooks/stripe', (req, res) => {\n  const e = stripe.webhooks.constructEvent(req.rawBody, req.headers['stripe-signature'], k);\n});\n",
    "src/helper.ts": "import { check } from './lib/check';\nimport Stripe from 'stripe';\napp.post('/stripe/webhook', (req, res) => {\n  check(req);\n});\n",
    "src/lib/check.ts": "import Stripe from 'stripe';\nexport function check(req) {\n  return deep(req);\n}\nfunction deep(req) {\n  return stripe.webhooks.constructEvent(req.rawBody, req.headers['stripe-signature']);\n}\n",
    "app/flask_app.py": "import hmac\nfrom flask import Flask, request\n@app.route('/stripe/webhook', methods=['POST'])\ndef hook():\n    sig = request.headers['Stripe-Signature']\n    mac = hmac.new(KEY, request.get_data(), 'sha256').hexdigest()\n    return 'ok' if mac == sig else 'no'\n",
    "app/safe.py": "import hmac, time\nfrom flask import Flask\n@app.route('/webhooks/github', methods=['POST'])\ndef hook():\n    sig = request.headers['X-Hub-Signature-256']\n    mac = hmac.new(KEY, request.get_data(), 'sha256')\n    return hmac.compare_digest(mac.hexdigest(), sig) and time.time()\n",
    "app/broken.py": "def f(:\n",
    "src/muted.ts": "import Stripe from 'stripe';\n// audit-disable-next-line stripe/missing-signature-verification\napp.post('/stripe/webhooks', (req, res) => {});\n",
    "src/plain.ts": "app.get('/health', f);\napp.post('/orders', (req, res) => {});\n",
    "web/hook.go": 'import (\n  "github.com/go-chi/chi/v5"\n)\nfunc main() {\n  r.Post("/github/webhook", func(w, r) {\n    body, _ := io.ReadAll(r.Body)\n  })\n}\n',
    "web/hook.php": "<?php\nuse Illuminate\\Support\\Facades\\Route;\nRoute::post('/shopify/webhook', function () {\n  $h = $_SERVER['HTTP_X_SHOPIFY_HMAC_SHA256'];\n});\n",
}


@pytest.fixture(scope="module")
def result(spark):
    return scan.scan(files.given(spark, SOURCES))


def states(findings):
    return {(r["file_path"], r["rule_id"]): r["state"] for r in findings.collect()}


def test_handlers(result):
    got = {(r["file_path"], r["framework"], r["route"], r["method"], r["provider"]) for r in result.handlers.collect()}
    assert got == {
        ("src/open.ts", "express", "/webhooks/stripe", "POST", "stripe"),
        ("src/sdk.ts", "express", "/api/webhooks/stripe", "POST", "stripe"),
        ("src/helper.ts", "express", "/stripe/webhook", "POST", "stripe"),
        ("src/muted.ts", "express", "/stripe/webhooks", "POST", "stripe"),
        ("app/flask_app.py", "flask", "/stripe/webhook", "POST", "stripe"),
        ("app/safe.py", "flask", "/webhooks/github", "POST", "github"),
        ("web/hook.go", "chi", "/github/webhook", "POST", "github"),
        ("web/hook.php", "laravel", "/shopify/webhook", "POST", "shopify"),
    }


def test_verdicts(result):
    got = states(result.findings)
    assert got["src/open.ts", "stripe/missing-signature-verification"] == "not-verified"
    assert got["src/sdk.ts", "stripe/library-verified"] == "verified"
    assert ("src/sdk.ts", "stripe/missing-signature-verification") not in got
    assert got["src/helper.ts", "stripe/library-verified"] == "verified"  # through two files
    assert got["app/flask_app.py", "stripe/timing-unsafe-comparison"] == "not-verified"
    assert ("app/flask_app.py", "stripe/missing-signature-verification") not in got
    assert not [r for (f, r) in got if f == "app/safe.py" and "timing" in r]
    assert got["web/hook.php", "shopify/missing-signature-verification"] == "not-verified"
    assert got["web/hook.go", "github/missing-signature-verification"] == "not-verified"
    assert got["app/broken.py", "engine/parse-error"] == "manual-review"
    assert [r["file_path"] for r in result.files.where("NOT parsed").collect()] == ["app/broken.py"]


def test_reachable_hops(result):
    h = result.handlers.where("file_path = 'src/helper.ts'").first()["handler_id"]
    got = {r["qualified_name"]: r["hops"] for r in result.reachable.where(f"handler_id = '{h}'").collect()}
    assert got["check"] == 1 and got["deep"] == 2 and got["stripe.webhooks.constructEvent"] == 3


def test_suppression(spark, result, tmp_path):
    got = {(r["file_path"], r["rule_id"]): r["suppression"] for r in result.findings.where("suppressed").collect()}
    assert {k: v["source"] for k, v in got.items()} == {("src/muted.ts", "stripe/missing-signature-verification"): "inline"}
    packs.write_baseline(result.findings, f"{tmp_path}/baseline")
    baseline = packs.read_baseline(spark, f"{tmp_path}/baseline")
    again = scan.scan(files.given(spark, SOURCES), ignore=packs.ignore_table(spark, "# c\nweb/\n!web/hook.go\n"), baseline=baseline)
    by = {(r["file_path"], r["rule_id"]): r["suppression"] and r["suppression"]["source"] for r in again.findings.where("state <> 'verified'").collect()}
    assert by["web/hook.php", "shopify/missing-signature-verification"] == "ignore-file"
    assert by["src/open.ts", "stripe/missing-signature-verification"] == "baseline"
    assert packs.read_baseline(spark, f"{tmp_path}/none") is None


def test_reports(result):
    doc = json.loads(reports.json_report(result.findings))
    ranks = ["critical", "high", "medium", "low", "info"]
    order = [ranks.index(f["severity"]) for f in doc["findings"]]
    assert order == sorted(order) and doc["summary"]["parse_errors"] == 1
    log = json.loads(reports.sarif(result.findings))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == len(doc["findings"])
    text = reports.comment(result.findings)
    assert text.count("\n- ") == 4 and text.splitlines()[-1].startswith("and ")
    assert reports.inventory(result.handlers, result.evidence).count() == 8


def test_walk(spark, tmp_path):
    for name, text in {"src/a.ts": "x", "src/A.TS": "x", "node_modules/b.js": "x", "docs/c.md": "x", "tests/d.py": "x", "src/e.spec.ts": "x", "gen/f.go": "x", "big.py": "#" * (1 << 20) + "#"}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = f"{tmp_path}/root"
    got = {r["file_path"]: r["status"] for r in files.listed(spark, root, exclude=["gen/**"]).collect()}
    assert got == {"src/a.ts": "ok", "src/A.TS": "ok", "node_modules/b.js": "skipped", "docs/c.md": "extension", "tests/d.py": "test", "src/e.spec.ts": "test", "gen/f.go": "excluded", "big.py": "oversize"}
    assert {r["file_path"]: r["language"] for r in files.walk(spark, root, include=["src/**"], include_tests=True).collect()} == {"src/a.ts": "js", "src/A.TS": "js", "src/e.spec.ts": "js"}
    assert {r["status"]: r["count"] for r in files.counters(files.listed(spark, root)).collect()}["test"] == 2
    given = files.given(spark, SOURCES)
    assert files.only(given, ["src/open.ts"]).count() == 1
    with pytest.raises(ValueError):
        files.only(given, ["../x"])


def test_ignore_files_and_single_files(spark, tmp_path):
    root = tmp_path / "root"
    for name, text in {".gitignore": "gen/\n*.go\n", ".git/info/exclude": "!keep.go\n/src/x.ts\n", "gen/a.ts": "x", "src/b.go": "x", "keep.go": "x", "src/x.ts": "x", "lib/src/x.ts": "x", "tests/t.py": "x", "a.md": "x"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r["file_path"]: r["status"] for r in files.listed(spark, str(root)).collect() if ".git" not in r["file_path"]}
    assert got == {"gen/a.ts": "ignored", "src/b.go": "ignored", "keep.go": "ok", "src/x.ts": "ignored", "lib/src/x.ts": "ok", "tests/t.py": "test", "a.md": "extension"}
    assert {r["file_path"] for r in files.walk(spark, str(root)).collect()} == {"keep.go", "lib/src/x.ts"}
    assert [(r["file_path"], r["language"]) for r in files.walk(spark, f"{root}/tests/t.py").collect()] == [("t.py", "py")]
    assert files.walk(spark, f"{root}/a.md").count() == 0
    assert files.submitted(spark, code="x").first()["language"] == "js" and files.submitted(spark, files={"a.py": "x"}).count() == 1
    for bad in ({}, {"code": "x", "files": {"a.py": "x"}}):
        with pytest.raises(ValueError):
            files.submitted(spark, **bad)


def test_scan_evidence_of_order_queues_and_middleware(spark):
    body = "app.post('/stripe/webhook', (req, res) => {\n"
    sources = {
        "a.ts": f"import Stripe from 'stripe';\n{body}  db.query(x);\n  stripe.webhooks.constructEvent(req.rawBody, h, k);\n}});\n",
        "b.ts": f"import Stripe from 'stripe';\n{body}  stripe.webhooks.constructEvent(req.rawBody, h, k);\n  db.query(x);\n}});\n",
        "c.ts": f"import Stripe from 'stripe';\n{body}  q.add(req.body);\n}});\n",
        "d.ts": f"import express from 'express';\nimport Stripe from 'stripe';\napp.use(express.json({{ verify: keep }}));\n{body}  stripe.webhooks.constructEvent(req.rawBody, h, k);\n}});\n",
        "e.ts": f"import express from 'express';\nimport Stripe from 'stripe';\napp.use(express.json());\n{body}  stripe.webhooks.constructEvent(req.rawBody, h, k);\n}});\n",
        "w.ts": "import Stripe from 'stripe';\nnew Worker('q', (j) => stripe.webhooks.constructEvent(j.raw, h, k));\n",
    }
    got = states(scan.scan(files.given(spark, sources)).findings)
    assert got["a.ts", "stripe/verify-after-side-effect"] == "manual-review" and ("b.ts", "stripe/verify-after-side-effect") not in got
    assert got["c.ts", "stripe/missing-signature-verification"] == "manual-review"  # a consumer verifies
    assert got["e.ts", "stripe/express-middleware-ordering"] == "not-verified" and ("d.ts", "stripe/express-middleware-ordering") not in got
    del sources["w.ts"]
    assert states(scan.scan(files.given(spark, sources)).findings)["c.ts", "stripe/missing-signature-verification"] == "not-verified"
    with pytest.raises(ValueError):
        scan.scan(files.given(spark, sources), only=["nobody"])
    none = scan.scan(files.given(spark, {"x.md": ""}).limit(0))
    assert none.findings.count() == 0 and none.handlers.count() == 0


def test_plans_pair_no_handlers_with_a_catalog(spark):
    """Owners, promoted names and modules meet by keys: no nested loop over handlers, and one row for each name's files."""
    reads = spark.range(10**6).selectExpr("id AS handler_id", "if(id % 2 = 0, 'X-Shared', 'x-own') AS header")
    named = spark.range(10**6).selectExpr("id AS handler_id", "if(id % 3 = 0, 'a', 'b') AS provider", "concat('lib.check', id % 2) AS name", "concat('lib.check', id % 2) AS qualified_name")
    headers = spark.sql("SELECT * FROM VALUES ('a', 0, 'x-shared'), ('b', 1, 'x-shared') AS t(provider, ord, header)")
    calls = spark.sql("SELECT * FROM VALUES ('check0'), ('check7') AS t(call)")
    shared = spark.range(50_000).selectExpr("concat('r', id, if(id % 2 = 0, '/lib/utils.py', '/lib/other.py')) AS file_path")
    imports = spark.range(50_000).selectExpr("concat('r', id, '/a.py') AS from_file", "if(id % 2 = 0, 'lib.utils', 'lib.other') AS to_module")
    resolved = joins.resolve_modules(imports, shared)
    for df in (joins.owned_reads(reads, headers, named), reachability.promoted(named, named, calls), resolved):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert resolved.count() == 50_000 and {r["to_file"] for r in resolved.select("to_file").distinct().collect()} == {"r0/lib/utils.py", "r1/lib/other.py"}


def test_sarif_by_part(spark, result, tmp_path):
    reports.write_sarif(result.findings, f"{tmp_path}/log")
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/log/results").collect()]
    whole = json.loads(reports.sarif(result.findings))["runs"][0]
    key = lambda v: json.dumps(v, sort_keys=True)
    assert sorted(map(key, lines)) == sorted(map(key, whole["results"]))
    envelope = json.loads(spark.read.text(f"{tmp_path}/log/envelope").first()["value"])
    assert [r["id"] for r in envelope["runs"][0]["tool"]["driver"]["rules"]] == [r["id"] for r in whole["tool"]["driver"]["rules"]]


def test_workflow(spark):
    doc = {"nodes": [{"name": "W", "type": "n8n-nodes-base.webhook", "parameters": {"path": "in"}}, {"name": "S", "type": "n8n-nodes-base.set"}, {"name": "V", "type": "n8n-nodes-base.webhook", "parameters": {"path": "/x", "authentication": "headerAuth", "httpMethod": "GET"}}], "connections": {}}
    df = spark.createDataFrame([("a.workflow.json", json.dumps(doc)), ("b.workflow.json", "{"), ("c.workflow.json", '{"nodes": []}')], "file_path string, text string")
    assert {r["file_path"]: (r["error"], r["is_workflow"]) for r in workflow.parsed(df).collect()} == {"a.workflow.json": (False, True), "b.workflow.json": (True, False), "c.workflow.json": (False, False)}
    assert {(r["node"], r["route"], r["method"], r["authentication"]) for r in workflow.handlers(df).collect()} == {("W", "/in", "POST", "none"), ("V", "/x", "GET", "headerAuth")}
    assert [r["node"] for r in workflow.open_triggers(df).collect()] == ["W"]


def test_rule_pack(spark, tmp_path):
    rule = {"rule_id": "stripe/x", "provider": "stripe", "severity": "high", "applies_to": [], "predicate": "x"}
    def pack(name, **change):
        (tmp_path / name).write_text(json.dumps(rule | change) + "\n")
        return f"{tmp_path}/{name}"
    known = catalog.catalog(spark)
    assert packs.rules(spark, pack("good"), known, ["x"]).count() == 1
    for i, change in enumerate(({"provider": "nobody"}, {"predicate": "y"}, {"severity": "worst"})):
        with pytest.raises(ValueError):
            packs.rules(spark, pack(f"bad{i}", **change), known, ["x"])


def test_imports(spark):
    rows = extract.lines(files.given(spark, {"a.ts": "import a, { b as c, d } from 'm';\nconst { e } = require('n');\nimport * as f from './o';", "b.py": "import os.path\nfrom x.y import p, q as r\n", "c.php": "use A\\B\\C;", "d.go": '\t"github.com/x/y"\n'}))
    got = {(r["file_path"], r["local"], r["to_module"]) for r in extract.imports(rows).collect()}
    assert got == {("a.ts", "a", "m"), ("a.ts", "c", "m"), ("a.ts", "d", "m"), ("a.ts", "e", "n"), ("a.ts", "f", "./o"), ("b.py", "os", "os.path"), ("b.py", "p", "x.y"), ("b.py", "r", "x.y"), ("c.php", "C", "A\\B\\C"), ("d.go", "y", "github.com/x/y")}


def test_imports_over_lines_and_their_names(spark):
    text = "import x, {\n  a,\n  type T,\n  b as c, d\n} from 'm';\nimport y from './y';\nconst z = require('z');\nconst { p: q } = require('w');\n"
    py = "from m.n import (\n    a,  # one\n    b as c,\n)\nfrom k import d\n"
    rows = extract.lines(files.given(spark, {"a.ts": text, "b.py": py, "c.ts": "import {\n  never\n"}))
    got = {(r["file_path"], r["local"], r["name"], r["to_module"], r["ord"]) for r in extract.imports(rows).collect()}
    ts = [("x", "default", "m", 1), ("a", "a", "m", 1), ("T", "T", "m", 1), ("c", "b", "m", 1), ("d", "d", "m", 1), ("y", "default", "./y", 6), ("z", "*", "z", 7), ("q", "p", "w", 8)]
    assert got == {("a.ts", *t) for t in ts} | {("b.py", *t) for t in [("a", "a", "m.n", 1), ("c", "b", "m.n", 1), ("d", "d", "k", 5)]}


def test_calls_follow_aliases_and_default_exports(spark):
    verify = "  return stripe.webhooks.constructEvent(req.rawBody, h, k);\n}\n"
    handler = "app.post('/stripe/webhook', (req, res) => {\n  go(req);\n});\n"
    sources = {
        "a.ts": "import {\n  check as go\n} from './lib';\nimport Stripe from 'stripe';\n" + handler,
        "b.ts": "import go from './main';\nimport Stripe from 'stripe';\n" + handler,
        "lib.ts": "export function check(req) {\n" + verify,
        "main.ts": "export default function other(req) {\n" + verify,
    }
    got = states(scan.scan(files.given(spark, sources)).findings)
    assert got["a.ts", "stripe/library-verified"] == got["b.ts", "stripe/library-verified"] == "verified"
    symbols = extract.symbols(extract.texts(files.given(spark, sources | {"m.go": "func Get() {}\nfunc get() {}\n"})).functions)
    assert {(r["name"], r["exported"]) for r in symbols.collect()} == {("check", True), ("other", True), ("default", True), ("Get", True), ("get", False)}


def test_cleanup(spark):
    df = tables.written(spark.range(3).toDF("a"), "x")
    assert df.count() == 3
    folder = df.inputFiles()[0].rsplit("/", 2)[0]
    tables.cleanup(spark)
    assert not os.path.exists(folder.removeprefix("file://"))

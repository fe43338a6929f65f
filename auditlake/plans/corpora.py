"""Whole scans over generated corpora: a source file for each row of a table, made from templates whose padding and routes vary by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import extract
from ..sources import files as source
from ..sources import packs, workflow
from ..sources.tables import dealt, table
from . import scan

QUERIES = {}
ORACLE_SQL = {}

# path with % for the row's number; text with {pad} for up to three empty lines, {route} and {shop} for one of four routes, {b} and {p}
# for a place where the row may break the line or comment; the line of the handler (or error) without padding
VERIFY = "stripe.webhooks.constructEvent({b}req.rawBody,{b} req.headers['stripe-signature'], k);\n"
TEMPLATES = [
    ("src/open%.ts", "import Stripe from 'stripe';\n{pad}app.post({b}'{route}',{b} (req, res) => {\n  const s = req.headers['stripe-signature'];\n  db.insert(req.body);\n});\n", 2),
    ("src/sdk%.ts", "import Stripe from 'stripe';\n{pad}router.post({b}'{route}',{b} (req, res) => {\n  const e = " + VERIFY + "});\n", 2),
    ("src/help%.ts", "import { check } from './lib';\nimport Stripe from 'stripe';\n{pad}app.post({b}'{route}',{b} (req, res) => {\n  check(req);\n});\n", 3),
    ("app/flask%.py", "import hmac\nfrom flask import Flask, request\n{pad}@app.route({p}'{route}',{p} methods=[{p}'POST'])\ndef hook():\n    sig = request.headers['Stripe-Signature']\n    mac = hmac.new(KEY, request.get_data(), 'sha256').hexdigest()\n    return 'ok' if mac == sig else 'no'\n", 3),
    ("app/broken%.py", "{pad}def f(:\n", 1),
    ("src/plain%.ts", "{pad}app.get('/health', f);\napp.post('/orders', (req, res) => {});\n", 1),
    ("web/hook%.php", "<?php\nuse Illuminate\\Support\\Facades\\Route;\n{pad}Route::post({b}'{shop}',{b} function () {\n  $h = $_SERVER['HTTP_X_SHOPIFY_HMAC_SHA256'];\n});\n", 3),
    ("web/g%.go", 'package main\nimport (\n  "github.com/go-chi/chi/v5"\n  wh "github.com/stripe/stripe-go/v76/webhook"\n)\nfunc main() {\n{pad}  r.Post({b}"{route}",{b} func(w, r) {\n    body, _ := io.ReadAll(r.Body)\n    e, err := wh.ConstructEvent(body, r.Header.Get("Stripe-Signature"), s)\n  })\n}\n', 7),
    ("src/dev%.ts", "import Stripe from 'stripe';\n{pad}app.post({b}'{route}',{b} (req, res) => {\n  if (process.env.NODE_ENV === 'test') {\n    return res.json({});\n  }\n  const e = " + VERIFY + "});\n", 2),
    ("src/eff%.ts", "import Stripe from 'stripe';\n{pad}app.post({b}'{route}',{b} (req, res) => {\n  db.query(x);\n  const e = " + VERIFY + "});\n", 2),
    ("src/q%.ts", "import Stripe from 'stripe';\n{pad}app.post({b}'{route}',{b} (req, res) => {\n  jobQueue.add(req.body);\n});\n", 2),
    ("src/mw%.ts", "import express from 'express';\nimport Stripe from 'stripe';\napp.use(express.json());\n{pad}app.post({b}'{route}',{b} (req, res) => {\n  const e = stripe.webhooks.constructEvent(req.body, req.headers['stripe-signature'], k);\n});\n", 4),
]
SHARED = [
    ("src/lib.ts", "import Stripe from 'stripe';\nexport function check(req) {\n  return stripe.webhooks.constructEvent(req.rawBody, req.headers['stripe-signature']);\n}\n"),
    ("src/worker.ts", "import Stripe from 'stripe';\nnew Worker('jobs', (job) => {\n  stripe.webhooks.constructEvent(job.raw, job.head, k);\n});\n"),
]
# what may stand between two tokens: nothing, line breaks, and comments that name what must not count
BREAKS = ["", "\n  ", " // stripe.webhooks.constructEvent(req.body) '\n    ", " /* app.post('/webhooks/github', (\n */ "]
PY_BREAKS = ["", "\n    ", "  # hmac.compare_digest(mac, sig) '\n    ", "\n\n    "]
STRIPE = ["/webhooks/stripe", "/api/webhooks/stripe", "/stripe/webhook", "/stripe/webhooks"]
SHOPIFY = ["/webhooks/shopify", "/api/webhooks/shopify", "/shopify/webhook", "/shopify/webhooks"]
# by template: rule and state of each finding
EXPECTED = [
    (0, "stripe/missing-signature-verification", "not-verified"),
    (0, "stripe/raw-body-misuse", "not-verified"),
    (0, "stripe/unreachable-verification", "manual-review"),
    (1, "stripe/library-verified", "verified"),
    (2, "stripe/library-verified", "verified"),
    (2, "stripe/raw-body-misuse", "manual-review"),
    (3, "stripe/missing-timestamp-check", "manual-review"),
    (3, "stripe/timing-unsafe-comparison", "not-verified"),
    (3, "stripe/wrong-hmac-algorithm", "manual-review"),
    (4, "engine/parse-error", "manual-review"),
    (6, "shopify/missing-signature-verification", "not-verified"),
    (6, "shopify/raw-body-misuse", "not-verified"),
    (7, "stripe/library-verified", "verified"),
    (8, "stripe/library-verified", "verified"),
    (8, "stripe/test-mode-bypass", "not-verified"),
    (9, "stripe/library-verified", "verified"),
    (9, "stripe/verify-after-side-effect", "manual-review"),
    (10, "stripe/missing-signature-verification", "manual-review"),
    (10, "stripe/unreachable-verification", "manual-review"),
    (11, "stripe/library-verified", "verified"),
    (11, "stripe/raw-body-misuse", "not-verified"),
    (11, "stripe/express-middleware-ordering", "not-verified"),
]
_n = len(TEMPLATES)
_values = ", ".join(f"({i}, '{a}', '{b}', {TEMPLATES[i][2]})" for i, a, b in EXPECTED)
_paths = "[" + ", ".join(f"'{p}'" for p, *_ in TEMPLATES) + "]"


def _filled(text, row):
    """A template's text for a row: padding and routes vary with the event and the user."""
    pick = lambda v, by=F.col("user_id"): F.element_at(F.array(*map(F.lit, v)), (by % len(v) + 1).cast("int"))
    broken = (row + F.col("user_id")).cast("long")
    for mark, value in (("{pad}", F.repeat(F.lit("\n"), (row % 4).cast("int"))), ("{route}", pick(STRIPE)), ("{shop}", pick(SHOPIFY)), ("{b}", pick(BREAKS, broken)), ("{p}", pick(PY_BREAKS, broken))):
        text = F.replace(text, F.lit(mark), value)
    return text


def corpus(spark, d) -> DataFrame:
    """(file_path, language, text): a file for each event, and two that some of them need."""
    row = F.col("event_id")
    i = (row % _n + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in TEMPLATES]), i)
    path = F.replace(pick(0), F.lit("%"), row.cast("string"))
    made = table(spark, d, "events").select(path.alias("file_path"), _filled(pick(1), row).alias("text"))
    made = made.unionByName(spark.createDataFrame(SHARED, "file_path string, text string"))
    return made.select("file_path", source.language(F.col("file_path")).alias("language"), "text")


def scan_findings(spark, d):
    return scan.scan(corpus(spark, d)).findings.select("file_path", "rule_id", "state", "line")


ORACLE_SQL["scan_findings"] = f"""SELECT replace({_paths}[1 + event_id % {_n}], '%', event_id::VARCHAR) AS file_path, rule_id, state, line + event_id % 4 AS line
FROM events JOIN (VALUES {_values}) AS t(i, rule_id, state, line) ON i = event_id % {_n}"""


def scan_bypasses(spark, d):
    found = scan.scan(corpus(spark, d), only=["stripe"]).findings.where("rule_id <> 'engine/parse-error'")
    return found.where(x.in_production_bypass(F.col("rule_id"))).groupBy("rule_id", "state").agg(F.count("*").alias("n"))


ORACLE_SQL["scan_bypasses"] = f"""SELECT rule_id, state, count(*) AS n FROM events JOIN (VALUES {_values}) AS t(i, rule_id, state, line) ON i = event_id % {_n}
WHERE rule_id LIKE 'stripe/%' AND rule_id <> 'stripe/library-verified' GROUP BY ALL"""

PACK = [
    ("stripe/missing-signature-verification", "stripe", "medium", [], [("src/open1**", "info"), ("src/**", "low")], ["CWE-347"]),
    ("stripe/timing-unsafe-comparison", "stripe", "high", ["flask"], [], ["CWE-208"]),
    ("stripe/library-verified", "stripe", "info", ["chi"], [], []),
    ("shopify/raw-body-misuse", "shopify", "high", ["express"], [], []),
]


def scan_rule_pack(spark, d):
    """A pack decides which classes apply where, how severe they are by path, and what they refer to."""
    rows = [(i, p, s, a, i, {}, [([g], v) for g, v in o], r) for i, p, s, a, o, r in PACK]
    found = scan.scan(corpus(spark, d), rules=spark.createDataFrame(rows, packs.RULES)).findings
    return found.select("file_path", "rule_id", "severity", F.array_join("references", ",").alias("refs"))


ORACLE_SQL["scan_rule_pack"] = f"""WITH f AS (SELECT replace({_paths}[1 + event_id % {_n}], '%', event_id::VARCHAR) AS file_path, rule_id, i FROM events JOIN (VALUES {_values}) AS t(i, rule_id, state, line) ON i = event_id % {_n})
SELECT file_path, rule_id, CASE WHEN rule_id = 'engine/parse-error' THEN 'high' WHEN rule_id LIKE '%library%' THEN 'info' WHEN rule_id LIKE '%timing%' THEN 'high' WHEN starts_with(file_path, 'src/open1') THEN 'info' ELSE 'low' END AS severity,
 CASE WHEN rule_id LIKE '%missing-signature%' THEN 'CWE-347' WHEN rule_id LIKE '%timing%' THEN 'CWE-208' WHEN rule_id LIKE '%library%' THEN '' END AS refs
FROM f WHERE rule_id IN ('engine/parse-error', 'stripe/missing-signature-verification', 'stripe/timing-unsafe-comparison') OR (rule_id = 'stripe/library-verified' AND i = 7)"""

# path, what precedes, the route with {r} and places for breaks, framework, route found, method
ROUTE_CASES = [
    ("src/e%.ts", "import express from 'express';\n", "app.post({b}'{r}',{b} h);", "express", "{r}", "POST"),
    ("src/h%.ts", "import { Hono } from 'hono';\n", "app.put({b}'{r}',{b} h);", "hono", "{r}", "PUT"),
    ("src/f%.js", "import fastify from 'fastify';\n", "server.patch({b}'{r}',{b} h);", "fastify", "{r}", "PATCH"),
    ("src/r%.js", "const fastify = require('fastify');\n", "app.route({{b} method: 'POST',{b} handler: (a) => { method(b, c); },{b} url: '{r}'{b} });", "fastify", "{r}", "POST"),
    ("src/s%.js", "import fastify from 'fastify';\n", "app.route({{b} url:{b} '{r}', schema: {{b} method: 'POST' },{b} method: 'DELETE', handler: h });", "fastify", "{r}", "DELETE"),
    ("app/a%.py", "from fastapi import FastAPI\n\n", "@app.delete({p}'{r}'{p})", "fastapi", "{r}", "DELETE"),
    ("app/b%.py", "import os\nfrom flask import Flask\n", "@app.route({p}'{r}',{p} methods=[{p}'GET',{p} 'PUT'])", "flask", "{r}", "PUT"),
    ("app/c%/urls.py", "from django.urls import path\n", "path({p}'{r}',{p} view)", "django", "{r}", "POST"),
    ("web/l%.php", "<?php\nuse Illuminate\\Http\\Request;\n", "Route::put({b}'{r}',{b} f);", "laravel", "{r}", "PUT"),
    ("web/m%.php", "<?php\nuse Slim\\App;\n", "$app->post({b}'{r}',{b} f);", "slim", "{r}", "POST"),
    ("web/n%.php", "<?php\nuse Symfony\\Component\\Routing;\n", "#[Route({b}'{r}'{b})]", "symfony", "{r}", "POST"),
    ("web/v%.php", "<?php\n", "$m = hash_hmac('sha256', $body, $key);", "vanilla-php", "/v%.php", "POST"),
    ("go/c%.go", 'import "github.com/go-chi/chi/v5"\n', 'r.Post({b}"{r}",{b} h)', "chi", "{r}", "POST"),
    ("go/g%.go", 'import "github.com/gin-gonic/gin"\n', 'r.POST({b}"{r}",{b} h)', "gin", "{r}", "POST"),
    ("go/e%.go", 'import "github.com/labstack/echo/v4"\n', 'e.PUT({b}"{r}",{b} h)', "echo", "{r}", "PUT"),
    ("go/n%.go", 'import "net/http"\n', 'http.HandleFunc({b}"{r}",{b} h)', "net/http", "{r}", "POST"),
    ("app/api/%/route.ts", "", "export async function POST(req) {}", "nextjs", "/api/%", "POST"),
    ("pages/api/p%.ts", "", "export default function handler() {}", "nextjs-pages", "/api/p%", "POST"),
    ("app/routes/r%.tsx", "", "export async function action() {}", "remix", "/r%", "POST"),
    ("srv/d%.ts", "", "Deno.serve(handler);", "deno", "/srv/d%", "POST"),
    ("srv/c%.ts", "", "export default { async fetch(req) {} };", "cloudflare-workers", "/srv/c%", "POST"),
    ("nodes/n%.ts", "import { INodeType } from 'n8n-workflow';\n", "  async webhook(this: IWebhookFunctions): Promise<R> {", "express", "/webhook", "POST"),
    ("app/e%/route.ts", "", "async function h(req) { go(req); }\nexport {{b} h as POST,{b} h as GET };", "nextjs", "/e%", "POST"),
    ("app/o%/route.ts", "", "function h(req) {}\nexport {{b} h as POST } from './other';", "", "", ""),
    ("edge/v%.ts", "export const config = { runtime: 'edge' };\n", "export default async function main(req) {}", "vercel-edge", "/edge/v%", "POST"),
    ("edge/h%.ts", "export const config = {\n  a: [1],\n  runtime: \"edge\",\n};\n", "export const handler = async (req) => {};", "vercel-edge", "/edge/h%", "POST"),
    ("edge/n%.ts", "export const config = { runtime: 'nodejs' };\n", "export const handler = async (req) => {};", "", "", ""),
    ("app/routes/x%/route.tsx", "", "export async function action() {}", "", "", ""),
    ("src/x%.ts", "import express from 'express';\n", "app.get({b}'{r}',{b} h);", "", "", ""),
    ("src/y%.ts", "import express from 'express';\n", "const a = await app.post({b}'{r}',{b} h);", "", "", ""),
]
# by ending, what stands before every third route and must not count: routes and imports in comments and strings
DECOYS = {
    "ts": "/*\n app.post('/hooks/old', h);\n*/\n// import { Hono } from 'hono'; app.put('/hooks/old', h);\nconst s = \"app.post('/hooks/old', h);\";\n",
    "py": "\"\"\"\n@app.post('/hooks/old')\nfrom fastapi import FastAPI\n\"\"\"\n# @app.route('/hooks/old', methods=['POST'])\n",
    "php": "/*\nRoute::put('/hooks/old', f);\n#[Route('/hooks/old')]\n*/\n# hash_hmac('sha256', $b, $k)\n",
    "go": "/*\nr.Post(\"/hooks/old\", h)\n*/\n// import \"github.com/gin-gonic/gin\"\n// e.PUT(\"/hooks/old\", h)\n",
}


def route_detection(spark, d):
    """Every framework's routes, with routes, places, line breaks, comments and file names that vary by row."""
    row = F.col("event_id")
    i = (row % len(ROUTE_CASES) + 1).cast("int")
    pick = lambda v, i=i: F.element_at(F.array(*map(F.lit, v)), i)
    path = F.replace(pick([c[0] for c in ROUTE_CASES]), F.lit("%"), row.cast("string"))
    route = F.concat(F.lit("/hooks/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    text = F.replace(pick([c[2] for c in ROUTE_CASES]), F.lit("{r}"), route)
    for mark, breaks in (("{b}", BREAKS), ("{p}", PY_BREAKS)):
        text = F.replace(text, F.lit(mark), pick(breaks, (F.col("user_id") % len(breaks) + 1).cast("int")))
    decoy = F.when(row % 3 == 0, F.create_map(*[F.lit(v) for kv in DECOYS.items() for v in kv])[F.regexp_replace(F.regexp_extract(path, r"(\w+)$", 1), "^(js|tsx)$", "ts")]).otherwise("")
    text = F.concat(pick([c[1] for c in ROUTE_CASES]), decoy, F.repeat(F.lit("\n"), (row % 5).cast("int")), text, F.lit("\n"))
    files = table(spark, d, "events").select(path.alias("file_path"), source.language(path).alias("language"), text.alias("text"))
    text = extract.texts(files, dealt)
    return extract.routes(text.rows, text.toks, text.functions, extract.imports(text.rows)).select("file_path", "framework", "route", "method", "line")


_routes = ", ".join(f"({i}, '{p}', '{f}', '{r}', '{m}', {h.count(chr(10)) + 1})" for i, (p, h, _, f, r, m) in enumerate(ROUTE_CASES) if f)
ORACLE_SQL["route_detection"] = f"""SELECT replace(path, '%', event_id::VARCHAR) AS file_path, framework, replace(replace(route, '{{r}}', '/hooks/' || event_type || '/' || user_id), '%', event_id::VARCHAR) AS route, method, line + event_id % 5 + CASE WHEN event_id % 3 = 0 THEN 5 ELSE 0 END AS line
FROM events JOIN (VALUES {_routes}) AS t(i, path, framework, route, method, line) ON i = event_id % {len(ROUTE_CASES)}"""


def call_extraction(spark, d):
    text = extract.texts(corpus(spark, d), dealt)
    return extract.calls(text.toks, text.functions).groupBy("caller", "qualified_name").agg(F.count("*").alias("n"))


# template (-1: a file that is there once), caller, name
CALLS = [
    (0, "<module>", "app.post"), (0, "<module>", "db.insert"), (1, "<module>", "router.post"), (1, "<module>", "stripe.webhooks.constructEvent"), (2, "<module>", "app.post"),
    (2, "<module>", "check"), (3, "<module>", "app.route"), (3, "hook", "hmac.new"), (3, "hook", "request.get_data"), (3, "hook", "hexdigest"), (5, "<module>", "app.get"),
    (5, "<module>", "app.post"), (6, "<module>", "Route::post"), (7, "main", "r.Post"), (7, "main", "io.ReadAll"), (7, "main", "wh.ConstructEvent"), (7, "main", "r.Header.Get"),
    (8, "<module>", "app.post"), (8, "<module>", "res.json"), (8, "<module>", "stripe.webhooks.constructEvent"), (9, "<module>", "app.post"), (9, "<module>", "db.query"),
    (9, "<module>", "stripe.webhooks.constructEvent"), (10, "<module>", "app.post"), (10, "<module>", "jobQueue.add"), (11, "<module>", "app.use"), (11, "<module>", "express.json"), (11, "<module>", "app.post"),
    (11, "<module>", "stripe.webhooks.constructEvent"), (-1, "check", "stripe.webhooks.constructEvent"), (-1, "<module>", "Worker"), (-1, "<module>", "stripe.webhooks.constructEvent"),
]
ORACLE_SQL["call_extraction"] = f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, a, b in CALLS)}) AS t(i, caller, qualified_name))
SELECT caller, qualified_name, count(*) AS n FROM (SELECT caller, qualified_name FROM events JOIN c ON i = event_id % {_n} UNION ALL SELECT caller, qualified_name FROM c WHERE i = -1) GROUP BY ALL"""

# path, text with {pad} for up to three empty lines; name, owner, first and last line without padding, whether padding moves each
FUNCTION_CASES = [
    ("a%.ts", "/* function no() {\n*/\nfunction outer(a) {\n  const inner = async (b) => {{pad}\n    go(b);\n  };\n  return inner('}');\n}\nclass Box extends Base {\n  open(x: string): void {\n    if (x) { go(x); }\n  }\n}\ngo(1);\n",
     [("outer", None, 3, 8, 0, 1), ("inner", None, 4, 6, 0, 1), ("Box", None, 9, 13, 1, 1), ("open", "Box", 10, 12, 1, 1)]),
    ("b%.py", "# def no():\nclass Box(\n    Base,\n):\n    def open(self,\n             x):\n        def inner(y):\n            return go(y){pad}\n\n        return inner(x)\n\n    size = go(2)\n\nasync def last():\n    pass\ngo(1)\n",
     [("Box", None, 2, 13, 0, 1), ("open", "Box", 5, 11, 0, 1), ("inner", None, 7, 9, 0, 1), ("last", None, 14, 15, 1, 1)]),
    ("c%.go", "package p\n// func no() {\nfunc (b *Box) Open(w W, r *R) (int, error) {\n  if ok(r) {{pad}\n    go2(r)\n  }\n}\nfunc last() error {\n  return go2(`}`)\n}\n",
     [("Open", None, 3, 7, 0, 1), ("last", None, 8, 10, 1, 1)]),
    ("d%.php", "<?php\n# function no() {\nclass Box {\n  public function open($x): int {{pad}\n    return $this->go(\"}\");\n  }\n}\nfunction last() {\n  go(1);\n}\n",
     [("Box", None, 3, 7, 0, 1), ("open", "Box", 4, 6, 0, 1), ("last", None, 8, 10, 1, 1)]),
]


def _function_texts(spark, d):
    row = F.col("event_id")
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in FUNCTION_CASES]), (row % len(FUNCTION_CASES) + 1).cast("int"))
    path = F.replace(pick(0), F.lit("%"), row.cast("string"))
    text = F.replace(pick(1), F.lit("{pad}"), F.repeat(F.lit("\n"), (F.col("user_id") % 4).cast("int")))
    return extract.texts(table(spark, d, "events").select(path.alias("file_path"), source.language(path).alias("language"), text.alias("text")), dealt)


def function_extents(spark, d):
    """Where functions, methods and classes begin and end, nested ones and those of classes included."""
    found = _function_texts(spark, d).functions
    return found.select("file_path", "name", "owner", "kind", "start", "end")


_kind = lambda c, n, o: "method" if o else "class" if n == "Box" else "function"
_extents = ", ".join(f"({i}, '{c[0]}', '{n}', {f"'{o}'" if o else 'NULL'}, '{_kind(c, n, o)}', {a}, {b}, {x1}, {y1})" for i, c in enumerate(FUNCTION_CASES) for n, o, a, b, x1, y1 in c[2])
ORACLE_SQL["function_extents"] = f"""SELECT replace(path, '%', event_id::VARCHAR) AS file_path, name, owner, kind, a + p * (user_id % 4) AS start, b + q * (user_id % 4) AS "end"
FROM events JOIN (VALUES {_extents}) AS t(i, path, name, owner, kind, a, b, p, q) ON i = event_id % {len(FUNCTION_CASES)}"""


def callers(spark, d):
    """Calls by the innermost function around them; what follows a function's end is not its own."""
    text = _function_texts(spark, d)
    return extract.calls(text.toks, text.functions).groupBy("caller", "qualified_name").agg(F.count("*").alias("n"))


# template, caller, name
CALLERS = [
    (0, "inner", "go"), (0, "outer", "inner"), (0, "open", "go"), (0, "<module>", "go"), (1, "inner", "go"), (1, "open", "inner"), (1, "<module>", "go"), (1, "<module>", "go"),
    (2, "Open", "ok"), (2, "Open", "go2"), (2, "last", "go2"), (3, "open", "$this->go"), (3, "last", "go"),
]
ORACLE_SQL["callers"] = f"""SELECT caller, qualified_name, count(*) AS n FROM events JOIN (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, a, b in CALLERS)}) AS t(i, caller, qualified_name) ON i = event_id % {len(FUNCTION_CASES)} GROUP BY ALL"""


def parse_errors(spark, d):
    return extract.parse_errors(corpus(spark, d)).select("file_path", "line")


ORACLE_SQL["parse_errors"] = f"SELECT 'app/broken' || event_id || '.py' AS file_path, 1 + event_id % 4 AS line FROM events WHERE event_id % {_n} = 4"

FOLDERS = ["src/", "node_modules/x/", "tests/", "a/vendor/", "docs/", "gen/"]
ENDS = [".ts", ".md", ".spec.ts", ".PY", ".go", "_test.py"]


def walk_status(spark, d):
    k = F.col("l_orderkey")
    pick = lambda v, c: F.element_at(F.array(*map(F.lit, v)), (c % len(v) + 1).cast("int"))
    path = F.concat(pick(FOLDERS, k), F.lit("f"), k.cast("string"), pick(ENDS, k + F.col("l_linenumber")))
    files = table(spark, d, "lineitem").select(path.alias("file_path"), (F.col("l_partkey") * 1000).alias("size"))
    return files.withColumn("status", source.status(F.col("file_path"), F.col("size"), exclude=["gen/**"])).groupBy("status").count().withColumnRenamed("count", "n")


ORACLE_SQL["walk_status"] = f"""WITH p AS (SELECT {FOLDERS}[1 + l_orderkey % 6] AS f, {ENDS}[1 + (l_orderkey + l_linenumber) % 6] AS e, l_partkey * 1000 AS size FROM lineitem)
SELECT CASE WHEN f IN ('node_modules/x/', 'a/vendor/') THEN 'skipped' WHEN f = 'gen/' THEN 'excluded' WHEN e = '.md' THEN 'extension' WHEN size > 1048576 THEN 'oversize'
 WHEN f = 'tests/' OR e IN ('.spec.ts', '_test.py') THEN 'test' ELSE 'ok' END AS status, count(*) AS n FROM p GROUP BY ALL"""


def workflow_triggers(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "n8n-nodes-base.webhook").otherwise("n8n-nodes-base.set")
    parameters = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("path"), F.col("event_type"))).otherwise(F.create_map(F.lit("authentication"), F.lit("headerAuth")))
    node = F.struct(F.col("event_id").cast("string").alias("name"), kind.alias("type"), parameters.alias("parameters"))
    text = F.to_json(F.struct(F.array(node).alias("nodes"), F.create_map(F.lit("a"), F.lit("b")).alias("connections")))
    broken = F.when(F.col("event_id") % 10 == 9, F.substring(text, 1, 20)).otherwise(text)
    return workflow.open_triggers(e.select(F.concat("event_type", F.lit(".workflow.json")).alias("file_path"), broken.alias("text"))).select("node", "route", "method")


ORACLE_SQL["workflow_triggers"] = "SELECT event_id::VARCHAR AS node, '/view' AS route, 'POST' AS method FROM events WHERE event_type = 'view' AND user_id % 3 = 0 AND event_id % 10 <> 9"


def liveness_remap(spark, d):
    live = F.when(F.col("event_id") % 3 == 0, "live").when(F.col("event_id") % 3 == 1, "dead").otherwise("unknown")
    return table(spark, d, "events").select("event_id", x.after_probe(F.lit("high"), live).alias("severity"))


ORACLE_SQL["liveness_remap"] = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' ELSE 'high' END AS severity FROM events"

IGNORE = ["# build output", "gen/", "*.go", "!src/f1*.go", "/docs/*.md"]


def walk_ignore(spark, d):
    """What a root's ignore files leave out, over paths of every part."""
    k = F.col("p_partkey")
    pick = lambda v, c: F.element_at(F.array(*map(F.lit, v)), (c % len(v) + 1).cast("int"))
    path = F.concat(pick(FOLDERS, k), F.lit("f"), k.cast("string"), pick(ENDS, k + F.col("p_size")))
    return table(spark, d, "part").select(path.alias("file_path"), source.ignored(path, IGNORE).alias("ignored"))


ORACLE_SQL["walk_ignore"] = f"""WITH p AS (SELECT {FOLDERS}[1 + p_partkey % 6] || 'f' || p_partkey || {ENDS}[1 + (p_partkey + p_size) % 6] AS file_path FROM part)
SELECT file_path, starts_with(file_path, 'gen/') AND NOT (ends_with(file_path, '.go') AND false) OR (ends_with(file_path, '.go') AND NOT starts_with(file_path, 'src/f1')) OR regexp_matches(file_path, '^docs/[^/]*\\.md$') AS ignored FROM p"""


def workflow_scan(spark, d):
    """Workflow files in a scan: open triggers are findings of their nodes."""
    e = table(spark, d, "events")
    auth = F.when(F.col("event_id") % 4 == 0, "none").otherwise("headerAuth")
    parameters = F.create_map(F.lit("path"), F.col("event_type"), F.lit("authentication"), auth)
    node = F.struct(F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"), F.lit("n8n-nodes-base.webhook").alias("type"), parameters.alias("parameters"))
    text = F.to_json(F.struct(F.array(node).alias("nodes"), F.create_map(F.lit("a"), F.lit("b")).alias("connections")))
    flows = e.select(F.concat(F.lit("w"), F.col("event_id").cast("string"), F.lit(".workflow.json")).alias("file_path"), text.alias("text"))
    found = scan.scan(source.given(spark, dict(SHARED)), workflows=flows).findings
    return found.select("file_path", "rule_id", "state", "severity")


ORACLE_SQL["workflow_scan"] = """SELECT 'w' || event_id || '.workflow.json' AS file_path, 'n8n/webhook-trigger-no-authentication' AS rule_id, 'not-verified' AS state, 'critical' AS severity FROM events WHERE event_id % 4 = 0"""

for _f in (scan_findings, scan_bypasses, scan_rule_pack, workflow_scan, walk_ignore, route_detection, call_extraction, function_extents, callers, parse_errors, walk_status, workflow_triggers, liveness_remap):
    QUERIES[_f.__name__] = _f

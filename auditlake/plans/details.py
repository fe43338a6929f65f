"""Smaller operators over the driver's tables: packs, suppressions, reports and scalars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import scalars as x
from ..operators import aggregates, joins
from ..sources import packs
from ..sources.tables import table
from . import reports
from .projections import F_, findings, query


@query("""WITH r AS (SELECT p_brand AS provider, p_brand || '/' || p_partkey AS rule_id, p_type AS severity, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS size FROM part)
SELECT provider, sha256('[' || string_agg('{"rule_id":"' || rule_id || '","severity":"' || severity || '","size":' || coalesce(size::VARCHAR, 'null') || '}', ',' ORDER BY rule_id) || ']') AS content_hash FROM r GROUP BY provider""")
def rule_content_hash(spark, d):
    p = table(spark, d, "part")
    r = p.select(F.col("p_brand").alias("provider"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_type").alias("severity"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("size"))
    return packs.content_hash(r, ["provider"], ["severity", "size", "rule_id"])


# DuckDB's shortest text of a double in JavaScript's layout: no `.0`, no padding of exponents (values here are below 1e21 or have one)
_js = lambda v: f"regexp_replace(regexp_replace(({v})::VARCHAR, '\\.0$', ''), 'e([+-])0', 'e\\1')"


@query(f"""SELECT l_orderkey, l_linenumber, '{{"big":' || {_js("l_extendedprice * 1e20")} || ',"flags":{{"' || l_returnflag || '":' || l_linenumber || '}},"order":["' || l_orderkey || '",null,"' || (l_orderkey % 2 = 0)::VARCHAR
 || '"],"price":' || {_js("l_extendedprice")} || ',"share":' || {_js("l_discount / l_extendedprice * 1e-4")} || ',"text":"\\u000b\\"' || l_linestatus || '\\\\\\n/"}}' AS value FROM lineitem""")
def canonical_json(spark, d):
    """Nested rows as canonical JSON: prices, tiny and huge numbers, maps, arrays, escapes."""
    price = F.col("l_extendedprice")
    text = F.concat(F.lit('\x0b"'), "l_linestatus", F.lit("\\\n/"))
    order = F.array(F.col("l_orderkey").cast("string"), F.lit(None), (F.col("l_orderkey") % 2 == 0).cast("string"))
    row = F.struct(text.alias("text"), price.alias("price"), (F.col("l_discount") / price * 1e-4).alias("share"), (price * 1e20).alias("big"), F.create_map("l_returnflag", "l_linenumber").alias("flags"), order.alias("order"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", row.alias("row"))
    return rows.select("l_orderkey", "l_linenumber", canonical.value(F.col("row"), rows.schema["row"].dataType).alias("value"))


@query(f"""WITH {F_} SELECT '{{"file_path":"' || file_path || '","finding_id":' || finding_id || ',"handler_id":' || handler_id || ',"line":' || line || ',"line_hash":"' || line_hash || '","rule_id":"' || rule_id || '","severity":"' || severity
 || CASE WHEN finding_id % 3 = 0 THEN '' ELSE '","snippet":"a\\t<' || col || '>' END || '","state":"' || state || '","suppressed":' || suppressed || '}}' AS value FROM f""")
def json_lines(spark, d):
    snippet = F.when(F.col("finding_id") % 3 != 0, F.concat(F.lit("a\t<"), F.col("col").cast("string"), F.lit(">")))
    return reports.json_lines(findings(spark, d).withColumn("snippet", snippet))


@query(f"""WITH {F_} SELECT finding_id, CASE rule_id WHEN 'r/1' THEN 'a,b' WHEN 'r/4' THEN 'c' ELSE '' END AS refs FROM f""")
def finding_references(spark, d):
    rules = spark.sql("SELECT * FROM VALUES ('r/1', array('a', 'b')), ('r/4', array('c')), ('r/99', array('z')) AS t(rule_id, references)")
    return joins.with_references(findings(spark, d), rules).select("finding_id", F.array_join("references", ",").alias("refs"))


@query("SELECT p_partkey AS rule_id, p_brand AS provider FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 2)")
def provider_filter(spark, d):
    """Of all rules those of two providers, as a scan's own filter asks."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("provider"))
    names = [r[0] for r in p.select("provider").distinct().orderBy("provider").limit(2).collect()]
    return packs.for_providers(p, names, p)


@query(rf"""WITH {F_}, i AS (SELECT 'src/f' || (c_custkey % 60) || '.ts' AS file_path, c_custkey % 100 AS line, c_custkey AS comment_line, ['r/' || (c_custkey % 9), 'r/x'] AS rules FROM customer),
p AS (SELECT * FROM (VALUES (0, 'src/f1.ts', '^src/f1\.ts$', false), (1, 'docs', '^docs', false), (2, '!lib', '^lib', true)) AS t(ord, pattern, re, negated)),
b AS (SELECT DISTINCT 'r/' || (c_custkey % 11) AS rule_id, sha256('h' || (c_custkey % 5000)) AS line_hash FROM customer)
SELECT DISTINCT 'inline' AS source, file_path || ':' || comment_line || ':' || rules[1] AS detail FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.file_path = i.file_path AND f.line = i.line AND list_contains(i.rules, f.rule_id))
UNION ALL SELECT 'ignore', pattern FROM p WHERE NOT negated AND NOT EXISTS (SELECT 1 FROM f WHERE regexp_matches(f.file_path, re))
UNION ALL SELECT 'baseline', rule_id || '|' || line_hash FROM b WHERE (rule_id, line_hash) NOT IN (SELECT rule_id, line_hash FROM f)""")
def stale_sources(spark, d):
    """Suppressions of all three sources that nothing needs."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    rule = lambda n: F.concat(F.lit("r/"), (k % n).cast("string"))
    inline = c.select(F.concat(F.lit("src/f"), (k % 60).cast("string"), F.lit(".ts")).alias("file_path"), (k % 100).alias("line"), k.alias("comment_line"), F.array(rule(9), F.lit("r/x")).alias("rule_ids"))
    patterns = spark.createDataFrame([(0, "src/f1.ts", r"^src/f1\.ts$", False), (1, "docs", "^docs", False), (2, "!lib", "^lib", True)], "ord int, pattern string, regex string, negated boolean")
    old = c.select(rule(11).alias("rule_id"), F.sha2(F.concat(F.lit("h"), (k % 5000).cast("string")), 256).alias("line_hash"))
    return joins.stale(findings(spark, d), inline, patterns, old)


@query(f"""WITH {F_}, b AS (SELECT rule_id, line_hash, max_by(file_path, finding_id) AS old FROM f WHERE finding_id % 3 = 0 GROUP BY ALL)
SELECT DISTINCT rule_id, old AS old_path, file_path FROM f JOIN b USING (rule_id, line_hash) WHERE old <> file_path""")
def drift_notes(spark, d):
    f = findings(spark, d)
    return joins.drift_notes(f, f.where("finding_id % 3 = 0").withColumn("ord", F.col("finding_id")))


@query("""WITH s AS (SELECT event_id, ['verified', 'not-verified', NULL][1 + event_id % 3] AS m, ['verified', 'manual-review', 'not-verified', NULL][1 + user_id % 4] AS p FROM events)
SELECT event_id, CASE WHEN m IS NULL THEN p WHEN p IS NULL THEN m WHEN m = p THEN m END AS state FROM s""")
def matcher_agreement(spark, d):
    pick = lambda v, c: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", x.agreed(pick(["verified", "not-verified", None], "event_id"), pick(["verified", "manual-review", "not-verified", None], "user_id")).alias("state"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS liveness FROM events")
def liveness_facets(spark, d):
    rule = F.when(F.col("event_id") % 4 == 0, "stripe/hardcoded-secret-prefix").otherwise("stripe/raw-body-misuse")
    return table(spark, d, "events").select("event_id", x.liveness_facet(rule, F.col("event_type")).alias("liveness"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 3 THEN p_name || '"' ELSE p_name END AS bare FROM part""")
def unquoted_literals(spark, d):
    n, q = F.col("p_name"), F.lit
    text = F.array(F.concat(q("'"), n, q("'")), F.concat(q('rb"'), n, q('"')), F.concat(q('f"""'), n, q('"""')), F.concat(n, q('"')), F.concat(q("`"), n, q("`")), n)
    return table(spark, d, "part").select("p_partkey", x.unquoted(F.element_at(text, (F.col("p_size") % 6 + 1).cast("int"))).alias("bare"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 4) AS go FROM part")
def go_modules(spark, d):
    n = F.col("p_size").cast("string")
    path = F.element_at(F.array(F.concat(F.lit("github.com/x/"), n), F.lit("net/http"), F.lit("Stripe"), F.concat(F.lit("./"), n), F.lit("a-b.io/m")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", x.is_go_module(path).alias("go"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)
SELECT page_id, regexp_extract(u, '([^/]*)$', 1) AS base, regexp_replace(u, '/?[^/]*$', '') AS folder, regexp_replace(u, '/?[^/]*$', '') || '/lib/y.ts' AS joined FROM p""")
def path_parts(spark, d):
    u = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", x.basename(u).alias("base"), x.dirname(u).alias("folder"), x.joined_path(x.dirname(u), F.lit("./a/../lib/b/c/../../y.ts")).alias("joined"))


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id % 20 ORDER BY url, page_id) AS place FROM pages")
def path_order(spark, d):
    """By UTF-16 units, as reports sort paths; within groups, so that no task sorts all."""
    w = Window.partitionBy(F.col("page_id") % 20).orderBy(x.utf16(F.col("url")), "page_id")
    return table(spark, d, "pages").select("page_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {F_}, l AS (SELECT *, NOT suppressed AND rule_id <> 'engine/parse-error' AS live FROM f) SELECT count(*) FILTER (live AND state = 'verified') AS verified, count(*) FILTER (live AND state = 'manual-review') AS manual_review,
 count(*) FILTER (live AND state = 'not-verified') AS not_verified, count(*) FILTER (NOT suppressed AND rule_id = 'engine/parse-error') AS parse_errors FROM l""")
def verdict_buckets(spark, d):
    return aggregates.verdict_summary(findings(spark, d))


@query(f"""WITH {F_} SELECT file_path, line, rpad(upper(severity), 9, ' ') || file_path || ':' || line || '  ' || rule_id || ' [' || state || ']' AS text FROM f WHERE NOT suppressed""")
def text_report(spark, d):
    return reports.text_lines(findings(spark, d))


@query(f"""WITH {F_} SELECT '{{"ruleId":"' || rule_id || '","level":"' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":"' || state || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file_path
 || '"}},"region":{{"startLine":' || line || '}}}}}}],"partialFingerprints":{{"primaryLocationLineHash":"' || line_hash || '"}},"suppressions":[' || CASE WHEN suppressed THEN '{{"kind":"external"}}' ELSE '' END || ']}}' AS value FROM f""")
def sarif_results(spark, d):
    return reports.sarif_results(findings(spark, d))


@query(f"""WITH {F_} SELECT rule_id, line_hash, arg_min(file_path, file_path || '|' || lpad(line::VARCHAR, 5, '0')) AS file_path, arg_min(line, file_path || '|' || lpad(line::VARCHAR, 5, '0')) AS line FROM f WHERE NOT suppressed AND state <> 'verified' GROUP BY rule_id, line_hash""")
def baseline_rows(spark, d):
    return packs.baseline_rows(findings(spark, d)).select("rule_id", "line_hash", "file_path", "line")


# language, text, import, then the provider and call that it is a verification of
NATIVE = [
    ("php", r"$e = \Stripe\Webhook::constructEvent($p);", "", "stripe", r"Stripe\Webhook::constructEvent"),
    ("php", "$v->validate($p);", r"Twilio\Security\RequestValidator", "twilio", r"Twilio\Security\RequestValidator::validate"),
    ("php", "$v->validate($p);", r"Other\Validator", "", ""),
    ("go", "e := wh.ConstructEvent(b)", "github.com/stripe/stripe-go/v76/webhook", "stripe", "webhook.ConstructEvent"),
    ("go", "e := wh.ConstructEvent(b)", "example.com/x", "", ""),
    ("go", "err := w.Verify(b, h)", "github.com/standard-webhooks/go", "standardwebhooks", "Verify"),
    ("js", "stripe.webhooks.constructEvent(a)", "stripe", "", ""),
]


@query("SELECT event_id AS handler_id, provider, call FROM events JOIN (VALUES " + ", ".join(f"({i}, '{n[3]}', '{n[4]}')" for i, n in enumerate(NATIVE) if n[3]) + ") AS t(i, provider, call) ON i = event_id % 7")
def native_verify_calls(spark, d):
    i = (F.col("event_id") % len(NATIVE) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(n[k]) for n in NATIVE]), i)
    e = table(spark, d, "events").select(F.col("event_id").alias("handler_id"), F.col("event_id").cast("string").alias("file_path"), pick(0).alias("language"), pick(1).alias("text"), pick(2).alias("to_module"))
    calls = [("stripe", r"Stripe\Webhook::constructEvent"), ("twilio", r"Twilio\Security\RequestValidator::validate"), ("stripe", "webhook.ConstructEvent"), ("stripe", "webhooks.constructEvent")]
    sdk = [("stripe", "stripe"), ("stripe", "github.com/stripe/stripe-go"), ("standardwebhooks", "github.com/standard-webhooks/go")]
    return joins.native_verify_calls(e, e.select("file_path", "to_module"), spark.createDataFrame(calls, "provider string, call string"), spark.createDataFrame(sdk, "provider string, package string"))

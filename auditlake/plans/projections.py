"""The operators over the driver's tables, each with the SQL that gives the same rows.

The tables hold no source code, so they stand in for it: events are evidence and calls, orders are findings, pages
are paths. Where only rule semantics matter, a few inline rows do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import aggregates, bodies, joins, ordered, predicates, reachability
from ..sources import packs
from ..sources.tables import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- stand-ins: (Spark, SQL) pairs of the same rows

EVIDENCE = """SELECT event_id // 4 AS handler_id, event_id AS ord,
 CASE event_type WHEN 'view' THEN 'stripe' WHEN 'click' THEN 'github' WHEN 'signup' THEN 'shopify' WHEN 'error' THEN 'unknown' ELSE 'slack' END AS provider,
 CASE user_id % 4 WHEN 0 THEN 'sdk_import' WHEN 1 THEN 'sdk_verify_call' WHEN 2 THEN 'signature_header_read' ELSE 'env_var_match' END AS kind,
 CASE WHEN user_id % 8 = 1 THEN 'crypto.createHmac' ELSE 'x' END AS detail FROM events"""
FINDINGS = """SELECT o_orderkey AS finding_id, o_custkey AS handler_id,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
 CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'not-verified' ELSE 'manual-review' END AS state,
 o_custkey % 7 = 0 AS suppressed, CASE WHEN o_orderkey % 50 = 0 THEN 'engine/parse-error' ELSE 'r/' || (o_orderkey % 9) END AS rule_id,
 'src/f' || (o_custkey % 40) || '.ts' AS file_path, o_orderkey % 100 AS line, o_orderkey % 7 AS col, sha256('h' || (o_orderkey % 4000)) AS line_hash FROM orders"""
SPARK_DIALECT = [("event_id // 4", "event_id div 4"), ("sha256(", "sha2_256(")]


def rows(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """A stand-in's rows."""
    for a, b in SPARK_DIALECT[:1]:
        sql = sql.replace(a, b)
    sql = sql.replace("sha256('h' || (o_orderkey % 4000))", "sha2('h' || (o_orderkey % 4000), 256)")
    return spark.sql(sql.replace(f" FROM {name}", " FROM {t}"), t=table(spark, sf_dir, name))


def evidence(spark, d):
    return rows(spark, d, EVIDENCE, "events")


def findings(spark, d):
    return rows(spark, d, FINDINGS, "orders")


def handlers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("handler_id"))


E_, F_ = f"e AS ({EVIDENCE})", f"f AS ({FINDINGS})"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"

# ---- aggregations


@query(f"""WITH {E_}, c AS (SELECT handler_id, provider, count(*) AS n FROM e WHERE provider <> 'unknown' GROUP BY ALL),
m AS (SELECT handler_id, max(n) AS m FROM c GROUP BY ALL)
SELECT handler_id, CASE WHEN count(*) > 1 THEN 'multiple' ELSE min(provider) END AS provider FROM c JOIN m USING (handler_id) WHERE n = m GROUP BY handler_id""")
def provider_attribution(spark, d):
    return aggregates.attribution(evidence(spark, d))


@query(f"""WITH {E_}, c AS (SELECT handler_id, provider, count(*) AS n, count(*) FILTER (NOT (kind = 'sdk_verify_call' AND detail LIKE 'crypto.%')) AS n2
 FROM e WHERE provider <> 'unknown' GROUP BY ALL),
m AS (SELECT handler_id, max(n) AS m, max(n2) AS m2 FROM c GROUP BY ALL),
p AS (SELECT handler_id, CASE WHEN max(m2) = 0 THEN NULL WHEN count(*) FILTER (n2 = m2) > 1 THEN 'multiple' ELSE min(provider) FILTER (n2 = m2) END AS a,
 CASE WHEN count(*) FILTER (n = m) > 1 THEN 'multiple' ELSE min(provider) FILTER (n = m) END AS b FROM c JOIN m USING (handler_id) GROUP BY handler_id)
SELECT h.handler_id, coalesce(a, b, 'unknown') AS provider FROM (SELECT DISTINCT handler_id FROM e) h LEFT JOIN p USING (handler_id)""")
def provider_reattribution(spark, d):
    e = evidence(spark, d)
    return aggregates.attributed(e.select("handler_id").distinct(), e)


@query(f"""WITH {E_}, h AS (SELECT handler_id, min(provider) AS provider, '/api/' || CASE WHEN handler_id % 5 = 0 THEN 'hooks' ELSE 'x' END AS route,
 CASE WHEN handler_id % 11 = 0 THEN 'n8n' ELSE 'express' END AS framework FROM e GROUP BY handler_id)
SELECT handler_id, CASE WHEN provider IN ('unknown', 'multiple') OR framework = 'n8n' OR route LIKE '%/hook%'
 OR EXISTS (SELECT 1 FROM e WHERE e.handler_id = h.handler_id AND e.provider = h.provider AND kind <> 'sdk_import') THEN provider ELSE 'unknown' END AS provider, route, framework FROM h""")
def demotion(spark, d):
    e = evidence(spark, d)
    route = F.concat(F.lit("/api/"), F.when(F.col("handler_id") % 5 == 0, "hooks").otherwise("x"))
    h = e.groupBy("handler_id").agg(F.min("provider").alias("provider"))
    h = h.withColumns({"route": route, "framework": F.when(F.col("handler_id") % 11 == 0, "n8n").otherwise("express")})
    return aggregates.demoted(h, e)


@query(f"""WITH {F_} SELECT c_custkey AS handler_id, coalesce(CASE max(CASE state WHEN 'verified' THEN 0 WHEN 'manual-review' THEN 1 ELSE 2 END)
 WHEN 0 THEN 'verified' WHEN 1 THEN 'manual-review' WHEN 2 THEN 'not-verified' END, 'manual-review') AS verdict, count(f.handler_id) AS n_findings
FROM customer LEFT JOIN f ON f.handler_id = c_custkey AND state IS NOT NULL GROUP BY c_custkey""")
def worst_verdict(spark, d):
    return aggregates.worst_verdict(handlers(spark, d), findings(spark, d))


@query(f"WITH {F_} SELECT handler_id, string_agg(finding_id::VARCHAR, ',' ORDER BY line, finding_id) AS refs FROM f GROUP BY handler_id")
def findings_ref(spark, d):
    return aggregates.findings_ref(findings(spark, d).withColumn("ord", F.col("line")).withColumn("finding_id", F.col("finding_id")))


@query(f"WITH {F_} SELECT severity, count(*) FILTER (NOT suppressed) AS active, count(*) FILTER (suppressed) AS suppressed FROM f GROUP BY severity")
def severity_tally(spark, d):
    return aggregates.severity_tally(findings(spark, d))


@query(f"""WITH {F_}, l AS (SELECT *, NOT suppressed AND rule_id <> 'engine/parse-error' AS live FROM f)
SELECT count(*) FILTER (live AND state = 'not-verified') AS not_verified, count(*) FILTER (live AND state = 'manual-review') AS manual_review,
 count(*) FILTER (live AND state = 'verified') AS verified, count(*) FILTER (rule_id = 'engine/parse-error') AS parse_errors,
 count(*) FILTER (live AND severity IN ('critical', 'high')) AS high_or_worse, count(DISTINCT file_path) FILTER (live) AS files FROM l""")
def summary_tally(spark, d):
    return aggregates.summary(findings(spark, d))


@query(f"""WITH {F_}, t AS (SELECT * FROM (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('info', 4)) AS t(threshold, r))
SELECT threshold, count(*) FILTER (NOT suppressed AND {RANK} <= r AND (rule_id = 'engine/parse-error' OR state = 'not-verified' OR (state = 'manual-review' AND r >= 3))) AS n
FROM f, t GROUP BY threshold""")
def gate_count(spark, d):
    return aggregates.gate_counts(findings(spark, d))


@query("""SELECT count(*) AS candidates, count(*) FILTER (json_valid(props) AND event_id % 10 <> 3) AS parsed,
 count(*) FILTER (json_valid(props) AND event_id % 10 <> 3) / count(*) AS ratio, count(*) FILTER (json_valid(props) AND event_id % 10 <> 3) / count(*) >= 0.95 AS ok FROM events""")
def parse_coverage(spark, d):
    text = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return aggregates.parse_coverage(table(spark, d, "events").select(F.try_parse_json(text).isNotNull().alias("parsed")), 0.95)


@query("""SELECT bad, broken, low, gated, CASE WHEN bad THEN 3 WHEN broken THEN 2 WHEN low THEN 4 WHEN gated THEN 1 ELSE 0 END AS code
FROM (SELECT DISTINCT o_orderkey % 2 = 0 AS bad, o_orderkey % 3 = 0 AS broken, o_orderkey % 5 = 0 AS low, o_orderkey % 7 = 0 AS gated FROM orders)""")
def exit_code(spark, d):
    k = F.col("o_orderkey")
    flags = table(spark, d, "orders").select(*[(k % n == 0).alias(a) for n, a in ((2, "bad"), (3, "broken"), (5, "low"), (7, "gated"))]).distinct()
    return flags.withColumn("code", aggregates.exit_code(*[F.col(c) for c in ("bad", "broken", "low", "gated")]))


@query("SELECT regexp_extract(p_type, '[^ ]*$') AS rule_class, count(*) AS n FROM part GROUP BY ALL")
def class_enum(spark, d):
    return aggregates.class_counts(table(spark, d, "part").select(F.translate("p_type", " ", "/").alias("rule_id")))


COMPLIANCE = "SELECT doc_id, CASE WHEN quality = 1 THEN doc_id % 3 ELSE 0 END AS a, CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS b FROM labels"


def _mapped_rules(spark, d):
    many = lambda n: F.array_repeat(F.lit("c"), n.cast("int"))
    a, b = F.when(F.col("quality") == 1, F.col("doc_id") % 3).otherwise(0), F.when(F.col("toxic") == 1, 2).otherwise(0)
    return table(spark, d, "labels").select(F.col("doc_id").alias("rule_id"), F.create_map(F.lit("pci"), many(a), F.lit("soc2"), many(b)).alias("mappings"))


@query(f"""WITH r AS ({COMPLIANCE}) SELECT 'pci' AS framework, count(*) FILTER (a > 0) AS mapped, count(*) AS total FROM r
UNION ALL SELECT 'soc2', count(*) FILTER (b > 0), count(*) FROM r UNION ALL SELECT 'any', count(*) FILTER (a > 0 OR b > 0), count(*) FROM r""")
def compliance_coverage(spark, d):
    return aggregates.compliance(_mapped_rules(spark, d), ["pci", "soc2"])


@query(f"WITH r AS ({COMPLIANCE}) SELECT 'soc2' AS framework, count(*) FILTER (b > 0) AS current, 1000000::BIGINT AS baseline FROM r")
def coverage_ratchet(spark, d):
    old = spark.sql("SELECT * FROM VALUES ('pci', 0L), ('soc2', 1000000L) AS t(framework, mapped)")
    return aggregates.regressions(aggregates.compliance(_mapped_rules(spark, d), ["pci", "soc2"]), old)


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
h AS (SELECT conv_id, i, sha256('' || '|' || text) AS h FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.i, sha256(h.h || '|' || r.text) FROM h JOIN r ON r.conv_id = h.conv_id AND r.i = h.i + 1)
SELECT conv_id AS chain, max(i) AS n, max_by(h, i) AS head FROM h GROUP BY conv_id""")
def hash_chain(spark, d):
    return aggregates.hash_chain(table(spark, d, "conversations").select(F.col("conv_id").alias("chain"), F.col("turn").alias("seq"), F.col("text").alias("payload")))


CHAIN = """SELECT conv_id AS chain, turn AS seq, text AS payload, CASE WHEN turn = 0 THEN '' ELSE 'p' END AS prev_hash FROM conversations"""


@query("SELECT conv_id AS chain, min(CASE WHEN turn > 0 OR conv_id % 3 = 0 THEN turn END) AS first_broken FROM conversations GROUP BY conv_id")
def broken_chain(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("chain"), F.col("turn").alias("seq"), F.col("text").alias("payload"))
    good = F.sha2(F.concat(F.lit("|"), "payload"), 256)
    c = c.withColumns({"prev_hash": F.when(F.col("seq") == 0, "").otherwise("p"), "hash": F.when(F.col("chain") % 3 == 0, "bad").otherwise(good)})
    return aggregates.broken_links(c)


@query("""SELECT event_id // 4 AS handler_id, min(1 + event_id % 3) AS hops FROM events WHERE event_type IN ('click', 'signup') GROUP BY ALL""")
def min_hops(spark, d):
    e = table(spark, d, "events").select(F.expr("event_id div 4").alias("handler_id"), F.concat(F.lit("app.lib."), "event_type").alias("qualified_name"), (1 + F.col("event_id") % 3).alias("hops"))
    return aggregates.min_hops(e, spark.sql("SELECT * FROM VALUES ('lib.click'), ('signup'), ('ib.view') AS t(call)"))


# ---- joins


@query(f"""WITH {F_}, b AS (SELECT rule_id, line_hash, max_by(file_path, finding_id) AS old FROM f WHERE finding_id % 3 = 0 GROUP BY ALL)
SELECT f.finding_id, old IS NOT NULL AS baselined, coalesce(old <> f.file_path, false) AS drifted FROM f LEFT JOIN b USING (rule_id, line_hash)""")
def baseline_left_join(spark, d):
    f = findings(spark, d)
    return joins.with_baseline(f, f.where("finding_id % 3 = 0").withColumn("ord", F.col("finding_id"))).select("finding_id", "baselined", "drifted")


@query(f"WITH {F_} SELECT finding_id FROM f WHERE line_hash NOT IN (SELECT line_hash FROM f WHERE finding_id % 5 = 0)")
def new_findings(spark, d):
    f = findings(spark, d)
    return joins.new_findings(f, f.where("finding_id % 5 = 0")).select("finding_id")


@query("SELECT c_custkey AS handler_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE substr(o_orderpriority, 1, 1) = '2')")
def stale_suppressions(spark, d):
    return joins.unused(handlers(spark, d), findings(spark, d).where("severity = 'high'"), ["handler_id"])


@query("SELECT min(doc_id) AS first_doc, sha256(text) AS blob, count(*) AS copies FROM documents GROUP BY sha256(text)")
def blob_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("blob"))
    return docs.groupBy("blob").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""SELECT p_partkey, sha256('r/' || p_size || '|' || p_brand || '|call|' || trim(regexp_replace(p_name || '  ' || p_type, '[ \t]+', ' ', 'g'))) AS line_hash,
 sha256(p_brand || '|/' || p_name || '|DELETE,POST|<anonymous>') AS handler_id, sha256('r|<no-handler>|f|' || p_name) AS finding_id FROM part""")
def fingerprint(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        x.line_hash(F.concat(F.lit("r/"), F.col("p_size").cast("string")), F.col("p_brand"), F.lit("call"), F.concat("p_name", F.lit("  "), "p_type")).alias("line_hash"),
        x.handler_id(F.col("p_brand"), F.concat(F.lit("/"), "p_name"), F.array(F.lit("post"), F.lit("delete")), F.lit(None).cast("string")).alias("handler_id"),
        x.finding_id(F.lit("r"), F.lit(None).cast("string"), F.lit("f"), F.col("p_name")).alias("finding_id"),
    )


NEEDLES = "SELECT * FROM (VALUES ('a', 'token'), ('a', 'License'), ('b', 'secret'), ('c', 'absent needle')) AS t(provider, needle)"


@query(f"SELECT doc_id, provider, needle FROM documents, ({NEEDLES}) n WHERE contains(text, needle)")
def literal_prefix_scan(spark, d):
    return joins.contains(table(spark, d, "documents"), "text", spark.sql(NEEDLES), "needle").select("doc_id", "provider", "needle")


@query("SELECT page_id, p AS path FROM pages, (SELECT unnest(['/EN/', '/fr/', '.example.com', '#top']) AS p) WHERE contains(lower(url), lower(p))")
def path_match(spark, d):
    paths = spark.sql("SELECT explode(array('/EN/', '/fr/', '.example.com', '#top')) AS path")
    return joins.contains(table(spark, d, "pages"), "url", paths, "path", fold=True).select("page_id", "path")


HEADERS = "SELECT * FROM (VALUES ('a', 0, 'X-Hub-Sig'), ('b', 1, 'x-hub-sig'), ('c', 2, 'x-own'), ('d', 3, 'x-shared'), ('c', 4, 'X-Shared')) AS t(provider, ord, header)"


@query(f"""WITH t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'get(X_HUB_SIG)' WHEN 1 THEN 'get("x-own")' WHEN 2 THEN 'x_shared' ELSE 'none' END AS text FROM conversations)
SELECT conv_id, turn, provider, header FROM t, ({HEADERS}) h WHERE contains(lower(text), lower(header)) OR contains(lower(text), replace(lower(header), '-', '_'))""")
def header_reads(spark, d):
    k = (F.col("conv_id") + F.col("turn")) % 4
    text = F.when(k == 0, "get(X_HUB_SIG)").when(k == 1, 'get("x-own")').when(k == 2, "x_shared").otherwise("none")
    c = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    return joins.header_reads(c, "text", spark.sql(HEADERS)).select("conv_id", "turn", "provider", "header")


@query(f"""WITH h AS ({HEADERS}), c AS (SELECT lower(header) AS header, provider, min(ord) AS ord FROM h GROUP BY ALL),
e AS (SELECT DISTINCT event_id // 4 AS handler_id, CASE event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' WHEN 'error' THEN 'c' ELSE 'z' END AS provider FROM events),
r AS (SELECT DISTINCT event_id // 4 AS handler_id, ['x-hub-sig', 'x-own', 'x-shared', 'x-none'][1 + (event_id + user_id) % 4] AS header FROM events),
k AS (SELECT r.handler_id, header, c.provider, ord, e.provider IS NOT NULL AS known FROM r JOIN c USING (header) LEFT JOIN e ON e.handler_id = r.handler_id AND e.provider = c.provider)
SELECT handler_id, header, provider FROM (SELECT *, bool_or(known) OVER w AS anyone, min(ord) OVER w AS least FROM k WINDOW w AS (PARTITION BY handler_id, header)) WHERE CASE WHEN anyone THEN known ELSE ord = least END""")
def header_owner(spark, d):
    kind = F.col("event_type")
    p = F.when(kind == "view", "a").when(kind == "click", "b").when(kind == "error", "c").otherwise("z")
    e = table(spark, d, "events").select("event_id", "user_id", F.expr("event_id div 4").alias("handler_id"), p.alias("provider"))
    reads = e.select("handler_id", F.expr("element_at(array('X-Hub-Sig', 'x-own', 'X-Shared', 'x-none'), cast(1 + (event_id + user_id) % 4 as int))").alias("header"))
    return joins.owned_reads(reads, spark.sql(HEADERS), e)


SDK = r"SELECT * FROM (VALUES ('stripe', 'stripe'), ('stripe', 'Stripe\\'), ('github', 'github.com/google/go-github'), ('github', '@octokit/webhooks')) AS t(provider, package)"
MODULES = r"array('stripe', 'stripe-extra', 'Stripe\\Webhook', 'github.com/google/go-github/v62/github', '@octokit/webhooks', '@octokit/webhooks-methods')"


@query(r"""WITH s AS (SELECT * FROM (VALUES ('stripe', 'stripe'), ('stripe', 'Stripe\'), ('github', 'github.com/google/go-github'), ('github', '@octokit/webhooks')) AS t(provider, package)),
i AS (SELECT 'f' || (o_orderkey % 50) AS file_path, ['stripe', 'stripe-extra', 'Stripe\Webhook', 'github.com/google/go-github/v62/github', '@octokit/webhooks', '@octokit/webhooks-methods'][1 + o_orderkey % 6] AS m FROM orders)
SELECT DISTINCT file_path, provider, package FROM i, s WHERE m = package OR (package IN ('Stripe\', 'github.com/google/go-github') AND starts_with(m, package))""")
def package_match(spark, d):
    i = table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string")).alias("file_path"), F.expr(f"element_at({MODULES}, cast(1 + o_orderkey % 6 as int))").alias("to_module"))
    return joins.packages(i, spark.sql(SDK))


CALLS = "SELECT * FROM (VALUES ('steel', 'PROMO'), ('tin', 'lib.SMALL'), ('tin', 'LARGE')) AS t(provider, call)"


@query(f"""WITH p AS (SELECT p_partkey AS handler_id, CASE WHEN p_size % 5 = 0 THEN p_type ELSE 'app.lib.' || p_type END AS q,
 CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'elsewhere' ELSE './local' END AS source FROM part)
SELECT DISTINCT handler_id, provider, call FROM p, ({CALLS}) c WHERE (q = call OR ends_with(q, '.' || call)) AND NOT (NOT contains(q, '.') AND source IS NOT NULL AND source = 'elsewhere' AND provider <> 'tin')""")
def suffix_match(spark, d):
    size = F.col("p_size")
    q = F.when(size % 5 == 0, F.col("p_type")).otherwise(F.concat(F.lit("app.lib."), "p_type"))
    r = table(spark, d, "part").select(F.col("p_partkey").alias("handler_id"), q.alias("qualified_name"), F.when(size % 3 == 0, None).when(size % 3 == 1, "elsewhere").otherwise("./local").alias("import_source"))
    return joins.verify_calls(r, spark.sql(CALLS), spark.sql("SELECT 'tin' AS provider, 'elsewhere' AS package"))


@query("""WITH i AS (SELECT 'f' || (o_custkey % 100) AS file_path, 'n' || (o_orderkey % 7) AS root, min_by('m' || o_orderkey, o_orderkey) AS source FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, source AS import_source FROM lineitem LEFT JOIN i ON file_path = 'f' || (l_partkey % 120) AND root = 'n' || (l_suppkey % 7)""")
def call_import_source(spark, d):
    text = lambda p, c: F.concat(F.lit(p), F.expr(c).cast("string"))
    i = table(spark, d, "orders").select(text("f", "o_custkey % 100").alias("file_path"), text("n", "o_orderkey % 7").alias("local"), text("m", "o_orderkey").alias("to_module"), F.col("o_orderkey").alias("ord"))
    calls = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text("f", "l_partkey % 120").alias("file_path"), F.concat(text("n", "l_suppkey % 7"), F.lit(".call")).alias("qualified_name"))
    return joins.import_sources(calls, i).select("l_orderkey", "l_linenumber", "import_source")


FILES_ = """SELECT DISTINCT 'r' || (p_partkey % 20) || '/' || CASE p_partkey % 2 WHEN 0 THEN 'src' ELSE 'lib' END || '/m' || p_size || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '/index.ts' END AS file_path FROM part"""
IMPORTS_ = """SELECT DISTINCT 'r' || (l_partkey % 25) || '/src/a' || (l_suppkey % 7) || '.ts' AS from_file,
 CASE l_linenumber % 5 WHEN 0 THEN './m' WHEN 1 THEN '../lib/m' WHEN 2 THEN 'lib.m' WHEN 3 THEN '@/src/m' ELSE 'express' END || (l_partkey % 60) AS to_module FROM lineitem"""


@query(f"""WITH f AS ({FILES_}), i AS ({IMPORTS_}),
a AS (SELECT *, starts_with(to_module, '.') AS rel, CASE WHEN starts_with(to_module, './') THEN string_split(from_file, '/')[1] || '/src/' || substr(to_module, 3) WHEN starts_with(to_module, '../') THEN string_split(from_file, '/')[1] || '/' || substr(to_module, 4)
 WHEN starts_with(to_module, '@/') THEN substr(to_module, 3) ELSE replace(to_module, '.', '/') END AS base FROM i),
t AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.py', '/index.ts', '/index.js', '/__init__.py']) AS e, unnest(range(11)) AS k),
h AS (SELECT base, rel, file_path, row_number() OVER (PARTITION BY base, rel ORDER BY CASE WHEN file_path = base || e THEN 0 ELSE 1 END, k, file_path) AS n
 FROM (SELECT DISTINCT base, rel FROM a), t, f WHERE file_path = base || e OR (NOT rel AND ends_with(file_path, '/' || base || e)))
SELECT from_file, to_module, file_path AS to_file FROM a JOIN h USING (base, rel) WHERE n = 1""")
def module_resolution(spark, d):
    """Names that very many files have and import: relative, dotted and rooted imports."""
    return joins.resolve_modules(rows(spark, d, IMPORTS_, "lineitem"), rows(spark, d, FILES_, "part"))


RULES = "SELECT * FROM (VALUES ('all/one', ''), ('s/js', 'express,nextjs'), ('s/py', 'flask')) AS t(rule_id, applies)"


@query(f"""WITH h AS (SELECT event_id AS handler_id, ['express', 'flask', 'remix', 'nextjs', 'chi'][1 + event_id % 5] AS framework FROM events)
SELECT handler_id, framework, rule_id FROM h, ({RULES}) r WHERE applies = '' OR list_contains(string_split(applies, ','), framework) OR (framework = 'remix' AND contains(applies, 'nextjs'))""")
def rule_framework_join(spark, d):
    h = table(spark, d, "events").select(F.col("event_id").alias("handler_id"), F.expr("element_at(array('express', 'flask', 'remix', 'nextjs', 'chi'), cast(1 + event_id % 5 as int))").alias("framework"))
    r = spark.sql(RULES).select("rule_id", F.filter(F.split("applies", ","), lambda a: a != "").alias("applies_to"))
    return joins.rules_for(h, r)


IGNORE = ["*.md", "src/f1?.ts", "!src/f12.ts", "/src/f3*.ts", "docs/", "!src/f35.ts", "src/f35.ts"]


@query(f"""WITH {F_}, p AS (SELECT * FROM (VALUES (1, 'src/f1?.ts', '^src/f1[^/]\\.ts$', false), (2, '!src/f12.ts', '^src/f12\\.ts$', true), (3, '/src/f3*.ts', '^src/f3[^/]*\\.ts$', false),
 (5, '!src/f35.ts', '^src/f35\\.ts$', true), (6, 'src/f35.ts', '^src/f35\\.ts$', false)) AS t(ord, pattern, re, neg)),
m AS (SELECT file_path, max_by(neg, ord) AS gone, max_by(pattern, ord) FILTER (NOT neg) AS ignore_pattern FROM (SELECT DISTINCT file_path FROM f), p WHERE regexp_matches(file_path, re) GROUP BY ALL)
SELECT finding_id, CASE WHEN NOT gone THEN ignore_pattern END AS ignore_pattern FROM f LEFT JOIN m USING (file_path)""")
def ignore_patterns(spark, d):
    p = [(i, s, *x.ignore_regex(s)) for i, s in enumerate(IGNORE)]
    return joins.ignored(findings(spark, d), spark.createDataFrame(p, "ord int, pattern string, regex string, negated boolean")).select("finding_id", "ignore_pattern")


MANY = [(f"src/m{i}/", f"!src/m{i - 1}/*.go", f"*.x{i}")[i % 3] for i in range(5000)]


@query("""WITH o AS (SELECT o_orderkey AS finding_id, o_orderkey % 7000 AS m, o_custkey % 4 AS k, (o_orderkey + 3 * o_custkey) % 6000 AS e FROM orders),
h AS (SELECT *, m % 3 = 0 AND m < 5000 AS folder, k = 2 AND e % 3 = 2 AND e < 5000 AS ending FROM o)
SELECT finding_id, CASE WHEN folder AND k = 0 THEN NULL WHEN ending AND (NOT folder OR e > m) THEN '*.x' || e WHEN folder THEN 'src/m' || m || '/' END AS ignore_pattern FROM h""")
def ignore_patterns_many(spark, d):
    """An ignore file of 5,000 lines: a path meets those that share a folder, a part or an ending with it."""
    place = F.expr("concat('src/m', o_orderkey % 7000, element_at(array('/f.go', '/gen/f.go', concat('/f.x', (o_orderkey + 3 * o_custkey) % 6000), '/f.ts'), cast(o_custkey % 4 + 1 as int)))")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("finding_id"), place.alias("file_path"))
    return joins.ignored(rows, packs.ignore_table(spark, "\n".join(MANY))).select("finding_id", "ignore_pattern")


@query("""WITH b AS (SELECT sha256(text) AS blob, min(doc_id) AS commit FROM documents GROUP BY ALL) SELECT doc_id, commit FROM documents JOIN b ON blob = sha256(text)""")
def history_provenance(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("blob"))
    blobs = docs.select("blob", F.col("doc_id").alias("commit"), F.col("doc_id").alias("ord"), F.lit("p").alias("path"))
    return joins.first_commit(docs, blobs).select("doc_id", "commit")


QUEUE = "array('jobQueue.add', 'items.add', 'sqs.sendMessage', 'kafkaProducer.send', 'mail.send', 'inngest.send', 'x.y', 'q.add')"


@query("""WITH c AS (SELECT DISTINCT event_id // 4 AS handler_id, ['bullmq', NULL, 'sqs', 'kafka', NULL, 'inngest', NULL, 'bullmq'][1 + (event_id * 3 + user_id) % 8] AS backend FROM events)
SELECT handler_id, backend FROM c WHERE backend IN ('bullmq', 'kafka')""")
def queue_deferral(spark, d):
    c = table(spark, d, "events").select(F.expr("event_id div 4").alias("handler_id"), F.expr(f"element_at({QUEUE}, cast(1 + (event_id * 3 + user_id) % 8 as int))").alias("qualified_name"))
    takes = spark.sql("SELECT * FROM VALUES ('Worker', true), ('consumer.run', true), ('app.consume', false), ('x.run', true) AS t(qualified_name, verifies)")
    return joins.deferred_to_queue(c, takes)


@query("""WITH h AS (SELECT o_orderkey AS handler_id, o_custkey // 2 AS f, o_orderkey % 40 AS hl FROM orders), u AS (SELECT DISTINCT user_id // 2 AS f, event_type AS name, event_id % 40 AS line FROM events)
SELECT handler_id, name, row_number() OVER (PARTITION BY handler_id ORDER BY line, name) - 1 AS position FROM h JOIN u USING (f) WHERE line < hl""")
def middleware_before(spark, d):
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("handler_id"), F.expr("o_custkey div 2").alias("file_path"), (F.col("o_orderkey") % 40).alias("line"))
    u = table(spark, d, "events").select(F.expr("user_id div 2").alias("file_path"), F.col("event_type").alias("name"), (F.col("event_id") % 40).alias("line")).distinct()
    return joins.middleware_before(h, u)


@query("""WITH h AS (SELECT o_orderkey AS handler_id, o_custkey AS f, o_orderkey % 90 AS hl FROM orders), u AS (SELECT DISTINCT user_id AS f, event_type AS name, event_id % 90 AS line FROM events)
SELECT handler_id, name, row_number() OVER (PARTITION BY handler_id ORDER BY line, name) - 1 AS position FROM h JOIN u USING (f) WHERE line < hl""")
def middleware_before_all(spark, d):
    """Of every event; the whole user is the file, so that files stay small as the tables grow."""
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("handler_id"), F.col("o_custkey").alias("file_path"), (F.col("o_orderkey") % 90).alias("line"))
    u = table(spark, d, "events").select(F.col("user_id").alias("file_path"), F.col("event_type").alias("name"), (F.col("event_id") % 90).alias("line")).distinct()
    return joins.middleware_before(h, u)


SPANS = "SELECT user_id % 40 AS file_path, (event_id * 37) % 20000 AS start, (event_id * 37) % 20000 + event_id % 50 AS stop, event_id FROM events"


@query(f"""WITH i AS ({SPANS} WHERE event_type = 'view'), o AS ({SPANS} WHERE event_type = 'click')
SELECT i.event_id, o.event_id AS outer_id FROM i JOIN o USING (file_path) WHERE i.start >= o.start AND i.stop <= o.stop + 300""")
def inline_ranges(spark, d):
    e = table(spark, d, "events")
    at = (F.col("event_id") * 37) % 20000
    span = lambda k: e.where(F.col("event_type") == k).select((F.col("user_id") % 40).alias("file_path"), at.alias("start"), (at + F.col("event_id") % 50).alias("end"), "event_id")
    outer = span("click").select("file_path", F.col("start").alias("lo"), (F.col("end") + 300).alias("hi"), F.col("event_id").alias("outer_id"))
    return joins.inside(span("view"), outer).select("event_id", "outer_id")


@query(f"""WITH i AS ({SPANS} WHERE event_type = 'view'), o AS ({SPANS} WHERE event_type = 'click')
SELECT event_id FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file_path = i.file_path AND i.start < o.stop AND o.start < i.stop)""")
def forbidden_ranges(spark, d):
    e = table(spark, d, "events")
    at = (F.col("event_id") * 37) % 20000
    span = lambda k: e.where(F.col("event_type") == k).select((F.col("user_id") % 40).alias("file_path"), at.alias("start"), (at + F.col("event_id") % 50).alias("end"), "event_id")
    return joins.outside(span("view"), span("click").select("file_path", F.col("start").alias("lo"), F.col("end").alias("hi"))).select("event_id")


# ---- closure


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_custkey + o_orderkey % 5 AS dst FROM orders),
r AS (SELECT src AS root, dst AS node, 1 AS hops FROM e UNION SELECT root, dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 4)
SELECT root, node, min(hops)::INT AS hops FROM r GROUP BY root, node""")
def call_closure(spark, d):
    """From every root, over calls to near-by symbols; calls of a symbol to itself are among them."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 5).alias("dst"), F.col("o_orderkey").alias("ord"))
    return reachability.closure(e.select(F.col("src").alias("root"), F.col("dst").alias("node"), "ord"), e.groupBy("src", "dst").agg(F.min("ord").alias("ord")), 4, 10**9)


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_orderkey // 2 AS dst FROM orders UNION SELECT o_orderkey, o_custkey FROM orders),
r AS (SELECT src AS root, dst AS node, 1 AS hops FROM e UNION SELECT root, dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 4)
SELECT root, node, min(hops)::INT AS hops FROM r GROUP BY root, node""")
def call_closure_all(spark, d):
    """From every root, over two calls of each order; ids grow with the table."""
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.explode(F.array(F.expr("o_orderkey div 2"), F.col("o_custkey"))).alias("dst"), F.col("o_orderkey").alias("ord"))
    seeds = e.select(F.col("src").alias("root"), F.col("dst").alias("node"), "ord")
    return reachability.closure(seeds, e.groupBy("src", "dst").agg(F.min("ord").alias("ord")), 4, 10**9)


@query("""WITH q AS (SELECT p_partkey % 500 AS handler_id, 'lib.' || p_type AS q, [p_type, 'this.SMALL', 'lib', 'lib.' || p_type, 'PROMO'][1 + p_size % 5] AS name FROM part), c AS (SELECT unnest(['PROMO', 'lib.SMALL']) AS call),
g AS (SELECT call AS name FROM c UNION SELECT 'this.' || regexp_extract(call, '[^.]*$') FROM c), o AS (SELECT handler_id, unnest([q, string_split(q, '.')[1]]) AS name FROM q, c WHERE q = call OR ends_with(q, '.' || call))
SELECT DISTINCT handler_id, name FROM q WHERE name IN (SELECT name FROM g) OR (handler_id, name) IN (SELECT handler_id, name FROM o)""")
def helper_promotion(spark, d):
    h, size = (F.col("p_partkey") % 500).alias("handler_id"), F.col("p_size") % 5
    q = F.concat(F.lit("lib."), "p_type")
    name = F.when(size == 0, F.col("p_type")).when(size == 1, "this.SMALL").when(size == 2, "lib").when(size == 3, q).otherwise("PROMO")
    p = table(spark, d, "part")
    return reachability.promoted(p.select(h, name.alias("name")), p.select(h, q.alias("qualified_name")), spark.sql("SELECT explode(array('PROMO', 'lib.SMALL')) AS call"))


# ---- ordered


@query("""WITH s AS (SELECT user_id AS handler_id, event_id AS ord, event_type, min(CASE WHEN event_type = 'signup' AND event_id > 2000 THEN event_id END) OVER (PARTITION BY user_id) AS first FROM events)
SELECT handler_id, ord FROM s WHERE event_type = 'purchase' AND (first IS NULL OR ord < first)""")
def verify_order(spark, d):
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") > 2000), "verification").when(F.col("event_type") == "purchase", "side_effect").otherwise("neutral")
    return ordered.before_verify(table(spark, d, "events").select(F.col("user_id").alias("handler_id"), F.col("event_id").alias("ord"), kind.alias("class")))


@query("""SELECT l_suppkey AS handler_id, l_orderkey AS ord, CASE max(CASE l_returnflag || l_linestatus WHEN 'AF' THEN 4 WHEN 'RF' THEN 3 WHEN 'NF' THEN 1 ELSE 0 END)
 WHEN 4 THEN 'verification' WHEN 3 THEN 'side_effect' WHEN 1 THEN 'short_circuit' ELSE 'neutral' END AS class FROM lineitem GROUP BY ALL""")
def statement_class(spark, d):
    sinks = spark.sql("SELECT * FROM VALUES ('AF', 'verification'), ('RF', 'side_effect'), ('NF', 'short_circuit') AS t(name, class)")
    calls = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("handler_id"), F.col("l_orderkey").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    return ordered.statement_class(calls, sinks)


@query("""SELECT user_id AS handler_id, min(event_id) FILTER (event_type = 'view') < min(event_id) FILTER (event_type = 'error') AS in_order FROM events GROUP BY user_id
HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'error') > 0""")
def middleware_order(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("handler_id"), F.col("event_type").alias("name"), F.col("event_id").alias("position"))
    return ordered.in_order(e, "view", "error")


@query("""WITH m AS (SELECT DISTINCT conv_id AS file_path, turn % 3 AS rule_id, turn::INT AS line, CASE WHEN turn % 4 = 0 THEN 'disable' WHEN turn % 4 = 3 THEN 'enable' WHEN turn % 4 = 1 THEN 'line' ELSE 'next-line' END AS form FROM conversations),
b AS (SELECT *, lag(form) OVER w AS before, min(CASE WHEN form = 'enable' THEN line END) OVER (PARTITION BY file_path, rule_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM m WHERE form IN ('disable', 'enable') WINDOW w AS (PARTITION BY file_path, rule_id ORDER BY line))
SELECT file_path, 'r' || rule_id AS rule_id, line + CASE form WHEN 'next-line' THEN 1 ELSE 0 END AS line FROM m WHERE form IN ('line', 'next-line')
UNION SELECT file_path, 'r' || rule_id, unnest(generate_series(line, coalesce(until, 12))) FROM b WHERE form = 'disable' AND coalesce(before, 'enable') = 'enable'""")
def suppression_ranges(spark, d):
    t = F.col("turn")
    form = F.when(t % 4 == 0, "disable").when(t % 4 == 3, "enable").when(t % 4 == 1, "line").otherwise("next-line")
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("file_path"), F.concat(F.lit("r"), (t % 3).cast("string")).alias("rule_id"), t.cast("int").alias("line"), form.alias("form")).distinct()
    return ordered.suppressed_lines(m, m.select("file_path").distinct().withColumn("last_line", F.lit(12)))


OVERRIDES = "(VALUES ('r/1', 0, '**/f1*.ts', 'info'), ('r/1', 1, 'src/*', 'low'), ('r/2', 0, 'lib/**', 'info'))"


@query(f"""WITH {F_} SELECT finding_id, CASE WHEN rule_id = 'r/1' AND regexp_matches(file_path, '/f1[^/]*\\.ts$') THEN 'info' WHEN rule_id = 'r/1' THEN 'low' ELSE severity END AS severity FROM f""")
def path_override(spark, d):
    o = [("r/1", 0, x.glob_regex("**/f1*.ts"), "info"), ("r/1", 1, x.glob_regex("src/*"), "low"), ("r/2", 0, x.glob_regex("lib/**"), "info")]
    return ordered.first_override(findings(spark, d), spark.createDataFrame(o, "rule_id string, ord int, regex string, severity string")).select("finding_id", "severity")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'inline' WHEN event_id % 5 = 0 THEN 'ignore-file' WHEN event_id % 7 = 0 THEN 'baseline' END AS source FROM events""")
def suppression_precedence(spark, d):
    k = F.col("event_id")
    s = ordered.suppression(*[F.when(k % n == 0, "x") for n in (3, 5, 7)])
    return table(spark, d, "events").select("event_id", s["source"].alias("source"))


@query(f"WITH {F_} SELECT finding_id, row_number() OVER (ORDER BY {RANK}, file_path, line, col, rule_id, finding_id) AS place FROM f ORDER BY place LIMIT 5")
def top5(spark, d):
    f = findings(spark, d)
    first = f.orderBy(x.severity_rank(F.col("severity")), "file_path", "line", "col", "rule_id", "finding_id").limit(5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct(x.severity_rank(F.col("severity")).alias("s"), "file_path", "line", "col", "rule_id", "finding_id"))), lambda r: r["finding_id"])
    return first.agg(ids.alias("ids")).select(F.posexplode("ids").alias("p", "finding_id")).select("finding_id", (F.col("p") + 1).cast("long").alias("place"))


@query("""SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1994-01-01' OR l_quantity > 49 OR l_returnflag = 'R'""")
def changed_union(spark, d):
    li = table(spark, d, "lineitem")
    parts = [li.where(c).select(F.col("l_orderkey").alias("k")) for c in ("l_shipdate < TIMESTAMP '1994-01-01'", "l_quantity > 49", "l_returnflag = 'R'")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', '<NUMBER>', 'g') AS redacted FROM documents")
def redact_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", x.redacted_numbers(F.col("text")).alias("redacted"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS file_path, (event_id * 37) % 20000 AS start, (event_id * 37) % 20000 + event_id % 400 AS stop, event_id::VARCHAR AS rule_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start, stop, rule_id) AS i FROM e),
f AS (SELECT file_path, start, stop, rule_id, i, true AS kept, CASE WHEN stop > start THEN stop ELSE -1 END AS until, CASE WHEN stop = start THEN start ELSE -1 END AS bare FROM o WHERE i = 1
 UNION ALL SELECT file_path, start, stop, rule_id, i, kept, CASE WHEN kept AND stop > start THEN stop ELSE until END, CASE WHEN kept AND stop = start THEN start ELSE bare END
 FROM (SELECT o.*, f.until, f.bare, o.start >= f.until AND NOT (o.stop = o.start AND o.start = f.bare) AS kept FROM f JOIN o ON o.file_path = f.file_path AND o.i = f.i + 1))
SELECT file_path, start, stop AS "end", rule_id, kept FROM f""")
def edit_overlap(spark, d):
    at = (F.col("event_id") * 37) % 20000
    e = table(spark, d, "events").select(F.col("user_id").alias("file_path"), at.alias("start"), (at + F.col("event_id") % 400).alias("end"), F.col("event_id").cast("string").alias("rule_id"))
    return ordered.without_overlap(e)


# ---- scans, extraction and scalars


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages""")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link"))


TAILS = ["/WebHook/x", "/api/hook", "/shooks", "/Interactions", "/discord", "/plain"]


@query(f"SELECT page_id, regexp_matches(lower(url || {TAILS}[1 + page_id % 6]), 'webhook|/hook|interaction|discord') AS hook FROM pages")
def webhookish_paths(spark, d):
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", x.webhookish(F.concat("url", tail)).alias("hook"))


PREFIXES = ["whsec_", "sk_", "ghp_", "ghs_", "AKIA"]


@query(f"""WITH c AS (SELECT doc_id, coalesce({", ".join(f"nullif(regexp_extract(text, '{p}[A-Za-z0-9+/=_-]+', 0), '')" for p in PREFIXES)}) AS credential FROM documents)
SELECT doc_id, credential, CASE WHEN regexp_matches(credential, '^whsec_') THEN 'signing-secret' WHEN regexp_matches(credential, '^(rk_|sk_)') THEN 'stripe-key' WHEN regexp_matches(credential, '^(ghs_|ghp_)') THEN 'github-token' ELSE 'unknown' END AS class FROM c""")
def credential_extract(spark, d):
    c = x.credential(F.col("text"), PREFIXES)
    return table(spark, d, "documents").select("doc_id", c.alias("credential"), F.coalesce(x.secret_class(c), F.lit("unknown")).alias("class"))


@query(f"WITH {F_} SELECT finding_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level FROM f")
def sarif_level(spark, d):
    return findings(spark, d).select("finding_id", x.sarif_level(F.col("severity")).alias("level"))


# tokens of a source line: strings, templates, names, numbers, the rest
TOKEN = r"""("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|[^"''`\w$]+|.)"""


@query(f"""WITH d AS (SELECT doc_id, 'k = "AKIA' || doc_id || '"; n = ' || doc_id || '.5; t = `a ' || doc_id || '`; ' || text AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(s, '{TOKEN}', 1), lambda p: CASE WHEN regexp_matches(p, '^["'']AKIA') THEN '<SECRET_LITERAL>'
 WHEN length(p) > 1 AND p[1] = p[-1] AND p[1] IN ('"', '''') THEN '<STRING:' || (length(p) - 2) || '>' WHEN length(p) > 1 AND p[1] = '`' THEN '<TEMPLATE>' WHEN regexp_matches(p, '^[0-9]') THEN '<NUMBER>' ELSE p END), '')) AS redacted FROM d""")
def structural_redaction(spark, d):
    """Of every whole text, with a secret, a number and a template before it."""
    i = F.col("doc_id").cast("string")
    s = F.concat(F.lit('k = "AKIA'), i, F.lit('"; n = '), i, F.lit(".5; t = `a "), i, F.lit("`; "), F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(x.redacted(s, ["AKIA"]), 256).alias("redacted"))


FIRST_SENTENCE = r"""SELECT doc_id, regexp_replace(string_split(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '. ')[1], '\.$', '') AS hint FROM documents"""


@query(FIRST_SENTENCE)
def first_sentence(spark, d):
    """Of the whole text of every document."""
    return table(spark, d, "documents").select("doc_id", x.first_sentence(F.col("text")).alias("hint"))


@query(FIRST_SENTENCE)
def first_sentence_all(spark, d):
    return first_sentence(spark, d)


# ---- rules

NAMES = ["crypto.createHmac", "crypto.sha256", "crypto.md5", "crypto.timingSafeEqual", "Date.now", "stripe.webhooks.constructEvent", "a.compare_digest", "db.insert", "verify", "sig.split", "hmac.new", "crypto.createHash", "req.headers.authorization", "req.ip", "safeCheck", "nacl.sign.detached.verify"]
PROVIDERS = ["stripe", "github", "shopify", "multiple", "bitbucket", "sentry", "zoom", "notion", "intercom", "pagerduty", "calendly", "twilio", "hubspot", "postmark", "standardwebhooks", "paypal", "discord", "n8n", "anthropic-agent-sdk"]
KINDS = ["sdk_import", "sdk_verify_call", "signature_header_read", "body_as_bytes_or_buffer", "side_effect_before_verify", "env_var_match", "path_pattern_match"]
SOURCES = ["stripe", "", "@octokit/webhooks", "other"]
PARSERS = ["express.json", "json", "cors", "bodyParser.json"]
# language, text of a handler; MODEL names the flags that each sets by its place
BODIES = [
    ("js", "const a = 1;\n"),
    ("js", "if (process.env.NODE_ENV === 'test') {\n  return res.json({ ok: true });\n}\nverify(x);\n"),
    ("js", "verify(x);\nif (process.env.NODE_ENV === 'test') {\n  return res.json({});\n}\n"),
    ("js", "try {\n  verify(x);\n} catch (e) {\n  console.log(e);\n}\n"),
    ("js", "try {\n  verify(x);\n} catch (e) {\n  return res.status(400).end();\n}\n"),
    ("js", "if (Math.abs(Date.now() / 1000 - t) > 60 * 60) {\n  throw e;\n}\n"),
    ("js", "if (age > 200) {}\n"),
    ("js", "if (sig !== computed) {}\n"),
    ("go", "mac := hmac.New(sha256.New, key)\nif bytes.Equal(mac.Sum(nil), signature) {}\n"),
    ("go", "mac := hmac.New(sha256.New, key)\nif hmac.Equal(mac.Sum(nil), signature) {}\n"),
    ("php", "$h = hash_hmac('sha256', $b, $k);\nif ($h === $signature) {}\n"),
    ("php", "$h = hash_hmac('sha256', $b, $k);\nif (hash_equals($h, $signature)) {}\n"),
    ("js", "const r = await fetch('/v1/notifications/verify-webhook-signature');\nif (r.verification_status === 'SUCCESS') {}\n"),
    ("js", "await fetch('/v1/notifications/verify-webhook-signature');\n"),
    ("js", "crypto.verify(alg, data, key, raw);\n"),
    ("js", "stripe.webhooks.constructEvent(body, head, key, 900);\n"),
    ("js", "if (delay > Number(process.env.TOLERANCE)) { Date.now(); }\n"),
    ("php", "sodium_crypto_sign_verify_detached($s, $m, $k);\n"),
]
_list = lambda v: ", ".join(f"'{s}'" for s in v)


def _model(spark, d):
    e = table(spark, d, "events")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    h, i, u = F.expr("event_id div 4"), F.col("event_id"), F.col("user_id")
    handlers = e.select(h.alias("handler_id")).distinct().withColumns({"provider": pick(PROVIDERS, F.col("handler_id")), "framework": pick(["express", "fastify"], F.col("handler_id"))})
    reached = e.select(h.alias("handler_id"), pick(NAMES, i * 5 + u).alias("qualified_name"), F.nullif(pick(SOURCES, i + u), F.lit("")).alias("import_source"), (1 + i % 3).alias("hops"))
    seen = e.where(u % 3 > 0).select(h.alias("handler_id"), pick(KINDS, i * 3 + u).alias("kind"), F.lit("unknown").alias("provider"))
    known = spark.sql("SELECT * FROM VALUES ('stripe', array('stripe'), array('webhooks.constructEvent'), 'sha256', 300), ('github', array('@octokit/webhooks'), array('verify'), 'sha256', NULL), ('shopify', array('x'), array('validate'), 'sha256', NULL) AS t(provider, packages, calls, algorithm, replay_seconds)")
    chain = e.select(h.alias("handler_id"), pick(PARSERS, i + u * 3).alias("name"), F.when(u % 2 == 0, "express").otherwise("x").alias("import_source"), (i % 3 == 0).alias("preserves_raw_body"))
    texts = handlers.select("handler_id", "provider", pick([b[0] for b in BODIES], F.col("handler_id") * 7).alias("language"), pick([b[1] for b in BODIES], F.col("handler_id") * 7).alias("text"))
    shown = bodies.flags(texts, known.select("provider", "calls"))
    return predicates.features(handlers, reached, seen, known.withColumn("input_format", F.lit("raw_body")), chain, shown)


MODEL = f"""e AS (SELECT event_id // 4 AS h, [{_list(NAMES)}][1 + (event_id * 5 + user_id) % {len(NAMES)}] AS q, nullif([{_list(SOURCES)}][1 + (event_id + user_id) % 4], '') AS src, 1 + event_id % 3 AS hops,
 CASE WHEN user_id % 3 > 0 THEN [{_list(KINDS)}][1 + (event_id * 3 + user_id) % 7] END AS k,
 [{_list(PARSERS)}][1 + (event_id + user_id * 3) % 4] AS mw, user_id % 2 = 0 AS own, event_id % 3 = 0 AS raw FROM events),
x AS (SELECT *, [{_list(PROVIDERS)}][1 + h % {len(PROVIDERS)}] AS p, (h * 7) % {len(BODIES)} AS b FROM e),
y AS (SELECT *, (p = 'stripe' AND ends_with(q, '.webhooks.constructEvent')) OR (p = 'github' AND (q = 'verify' OR ends_with(q, '.verify'))) AS isverify FROM x),
z AS (SELECT h, p, b,
 bool_or(isverify AND coalesce(src, 'own') IN ('own', CASE p WHEN 'stripe' THEN 'stripe' ELSE '@octokit/webhooks' END)) AS sdk, bool_or(isverify) AS anycall, min(hops) FILTER (isverify) AS ch,
 bool_or(q IN ('crypto.createHmac', 'hmac.new')) AS hmac, bool_or(q = 'crypto.createHash') AS hash, bool_or(q IN ('crypto.timingSafeEqual', 'a.compare_digest')) AS ct, bool_or(q = 'Date.now') AS clock,
 bool_or(q = 'crypto.sha256' AND p IN ('stripe', 'github', 'shopify')) AS good, bool_or(q = 'crypto.md5' AND p IN ('stripe', 'github', 'shopify')) AS wrong, bool_or(q = 'sig.split') AS split, bool_or(coalesce(src = '@octokit/webhooks', false)) AS octo,
 bool_or(q = 'req.headers.authorization') AS basic, bool_or(q = 'req.ip') AS ip, bool_or(q IN ('verify', 'safeCheck', 'nacl.sign.detached.verify')) AS shaped, bool_or(q = 'nacl.sign.detached.verify') AS asym,
 coalesce(bool_or(k = 'sdk_import'), false) AS ei, coalesce(bool_or(k = 'sdk_verify_call'), false) AS ev, coalesce(bool_or(k = 'signature_header_read'), false) AS eh,
 coalesce(bool_or(k = 'body_as_bytes_or_buffer'), false) AS eb, coalesce(bool_or(k = 'side_effect_before_verify'), false) AS es, p <> 'multiple' AS r,
 bool_or((mw IN ('express.json', 'bodyParser.json') OR (mw = 'json' AND own)) AND NOT raw) AS parser FROM y GROUP BY h, p, b),
m AS (SELECT *, hmac OR b IN (8, 9, 10, 11) AS hm, sdk OR ev OR b IN (12, 13) AS asked, asym OR ev OR b = 17 AS ed,
 sdk OR ev OR ((hmac OR b IN (8, 9, 10, 11)) AND (ct OR b IN (7, 8, 9, 10, 11))) AS signed FROM z)"""
_compared = ", ".join(str(i) for i, (_, t) in enumerate(BODIES) if any(mark in t for mark in ("==", "!=", ".equals(", ".compare(")))
CASES = {
    "missing-signature-verification": """CASE p WHEN 'twilio' THEN CASE WHEN NOT sdk AND NOT hm THEN 'not-verified' END WHEN 'hubspot' THEN CASE WHEN NOT (sdk OR hm OR ev) THEN 'not-verified' END
 WHEN 'notion' THEN CASE WHEN NOT (hm OR eh) THEN 'not-verified' END WHEN 'postmark' THEN CASE WHEN NOT (ev OR basic OR ip) THEN 'not-verified' END
 WHEN 'standardwebhooks' THEN CASE WHEN hm AND NOT signed AND shaped THEN 'manual-review' WHEN NOT signed THEN 'not-verified' END
 WHEN 'paypal' THEN CASE WHEN asked AND b = 12 THEN NULL WHEN asked OR b = 14 THEN 'manual-review' ELSE 'not-verified' END WHEN 'discord' THEN CASE WHEN NOT ed THEN 'not-verified' END
 ELSE CASE WHEN r AND NOT (sdk OR hm OR ev) THEN CASE WHEN hash AND b IN ({_compared}) THEN 'manual-review' ELSE 'not-verified' END END END""".replace("{_compared}", _compared),
    "timing-unsafe-comparison": "CASE WHEN r AND b IN (8, 10) AND NOT ev THEN 'not-verified' WHEN r AND NOT sdk AND hmac AND NOT ct THEN 'not-verified' END",
    "missing-timing-safe-equal": "CASE WHEN p = 'github' AND b IN (8, 9, 10, 11) THEN CASE WHEN (b = 8 AND NOT ev) OR b = 10 THEN 'not-verified' END WHEN p = 'github' AND NOT ct AND NOT octo THEN 'not-verified' END",
    "raw-body-misuse": "CASE WHEN r AND NOT eb AND eh THEN 'not-verified' WHEN r AND NOT eb AND anycall THEN CASE WHEN ch > 1 THEN 'manual-review' ELSE 'not-verified' END END",
    "missing-timestamp-check": "CASE WHEN r AND NOT sdk AND hmac AND NOT clock THEN 'manual-review' END",
    "wrong-hmac-algorithm": "CASE WHEN NOT (r AND hmac) OR (good AND NOT wrong) THEN NULL WHEN wrong AND NOT good THEN 'not-verified' ELSE 'manual-review' END",
    "unreachable-verification": "CASE WHEN r AND ei AND NOT sdk AND NOT ev THEN 'manual-review' END",
    "library-verified": "CASE WHEN p = 'paypal' THEN CASE WHEN asked AND b = 12 THEN 'verified' END WHEN p = 'discord' THEN CASE WHEN ed THEN 'verified' END WHEN r AND (anycall OR ev) THEN 'verified' END",
    "verify-after-side-effect": "CASE WHEN r AND es AND NOT (p = 'paypal' AND b IN (12, 13)) THEN 'manual-review' END",
    "agent-tool-acts-on-unverified-payload": "CASE WHEN p = 'n8n' AND es THEN 'manual-review' END",
    "tool-callback-no-verification": "CASE WHEN p = 'anthropic-agent-sdk' AND es THEN 'manual-review' END",
    "test-mode-bypass": "CASE WHEN r AND (b = 1 OR (b = 2 AND p <> 'github')) THEN 'not-verified' END",
    "verification-error-swallowed": "CASE WHEN b = 3 AND p = 'github' THEN 'not-verified' END",
    "replay-window-too-permissive": "CASE WHEN p = 'stripe' AND b IN (5, 15) THEN 'not-verified' WHEN p = 'stripe' AND b = 16 THEN 'manual-review' END",
    "express-middleware-ordering": "CASE WHEN p = 'stripe' AND h % 2 = 0 AND parser THEN 'not-verified' END",
    "missing-basic-auth": "CASE WHEN p = 'postmark' AND ip AND NOT basic THEN 'manual-review' END",
    "missing-ip-allowlist": "CASE WHEN p = 'postmark' AND basic AND NOT ip THEN 'manual-review' END",
    "signature-prefix-not-stripped": "CASE WHEN p = 'bitbucket' AND hmac AND eh AND NOT split THEN 'manual-review' END",
    "signature-header-parse-mishandled": "CASE WHEN p = 'calendly' AND hmac AND eh AND NOT split THEN 'manual-review' END",
    "multi-signature-rotation-mishandled": "CASE WHEN p IN ('pagerduty', 'standardwebhooks') AND hmac AND NOT split THEN 'manual-review' END",
    "header-confusion": "CASE WHEN p = 'sentry' AND hmac AND NOT eh THEN 'manual-review' END",
    "octokit-cross-attribution": "CASE WHEN p = 'intercom' AND octo THEN 'not-verified' END",
    "url-validation-only": "CASE WHEN p = 'zoom' AND eh AND NOT hmac THEN 'manual-review' END",
    "verification-token-only": "CASE WHEN p = 'notion' AND eh AND NOT hmac THEN 'manual-review' END",
}


def _rule(name: str):
    def run(spark, d):
        return predicates.verdicts(_model(spark, d), [name])

    run.__name__ = "rule_" + name.replace("-", "_")
    return query(f"WITH {MODEL}, v AS (SELECT h, p, {CASES[name]} AS state FROM m) SELECT h AS handler_id, p AS provider, '{name}' AS rule_class, state FROM v WHERE state IS NOT NULL")(run)


for _name in CASES:
    _rule(_name)


@query("WITH " + MODEL + ", v AS (" + " UNION ALL ".join(f"SELECT h, p, '{n}' AS c, {s} AS state FROM m" for n, s in CASES.items()) + ") SELECT h AS handler_id, p AS provider, c AS rule_class, state FROM v WHERE state IS NOT NULL")
def rule_verdicts(spark, d):
    return predicates.verdicts(_model(spark, d))


@query("WITH " + MODEL + f", v AS (SELECT h, p, {CASES['missing-signature-verification']} AS state FROM m) SELECT h AS handler_id, CASE WHEN h % 6 = 0 AND state = 'not-verified' THEN 'manual-review' ELSE state END AS state FROM v WHERE state IS NOT NULL")
def queue_downgrade(spark, d):
    found = predicates.verdicts(_model(spark, d), ["missing-signature-verification"])
    late = found.where("handler_id % 6 = 0").select("handler_id")
    return predicates.downgraded(found, late).select("handler_id", "state")

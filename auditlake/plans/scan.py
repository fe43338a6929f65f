"""The scan: source files to handlers, evidence, verdicts and findings, as one chain of joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as cat
from ..functions import scalars as x
from ..operators import aggregates, bodies, extract, joins, ordered, predicates, reachability, structure
from ..sources import packs, workflow
from ..sources.tables import dealt, written

# How the languages read a body's bytes.
BYTES = (
    r"(?i)Buffer|Uint8Array|\braw\b|\bbytes\b|raw_?body|c\.req\.raw|request\.get_data\(\)|request\.body|php://input|->getContent\(\)|->getBody\(\)|\$_POST|->all\(\)|->input\(\)"
    r"|\b\w*req\w*\.(?:text|arrayBuffer)\(\s*\)|\b(?:io|ioutil)\.ReadAll\s*\(|\.GetRawData\(\)"
)


@dataclass
class Scan:
    handlers: DataFrame  # handler_id, file_path, framework, route, method, line, end_line, provider, verdict
    evidence: DataFrame  # handler_id, kind, provider, detail
    reachable: DataFrame  # handler_id, qualified_name, import_source, hops
    findings: DataFrame  # finding_id, rule_id, handler_id, file_path, line, severity, state, line_hash, suppressed, references, ...
    files: DataFrame  # file_path, parsed


def scan(
    files: DataFrame,
    providers: DataFrame | None = None,
    depth: int = 4,
    ignore: DataFrame | None = None,
    baseline: DataFrame | None = None,
    rules: DataFrame | None = None,
    only: list[str] | None = None,
    workflows: DataFrame | None = None,
) -> Scan:
    """Scan (file_path, language, text). Suppressed findings stay, with their source.

    rules: a pack (`packs.rules`) that decides which classes apply to which frameworks, their severities, overrides by
    path and references; without one all classes do. only: providers whose rules count. workflows: (file_path, text).
    """
    spark = files.sparkSession
    providers = cat.catalog(spark) if providers is None else providers
    if only:
        packs.for_providers(providers, only, providers)
    errors = dealt(extract.parse_errors(files), "errors")
    parsed = files.join(errors, "file_path", "left_anti")
    text = extract.texts(parsed, dealt)
    imported = dealt(extract.imports(text.rows), "imports")
    key = x.handler_id(F.col("file_path"), F.col("route"), F.array("method"), F.lit(None).cast("string"))
    handlers = extract.routes(text.rows, text.toks, text.functions, imported).withColumn("handler_id", key).dropDuplicates(["handler_id"])
    handlers = dealt(handlers, "handlers")
    rows = dealt(extract.placed(text.rows, handlers), "lines")  # each line with its handler: nothing joins lines by range
    handlers = dealt(handlers.join(rows.select("file_path", "line", "code"), ["file_path", "line"]), "handlers")
    called = extract.calls(text.toks, text.functions).join(rows.select("file_path", "line", "handler_id"), ["file_path", "line"])
    calls = dealt(joins.import_sources(called, imported), "calls")

    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda s: s["code"])
    body = rows.where("handler_id IS NOT NULL").groupBy("handler_id", "file_path").agg(F.first("language").alias("language"), F.array_join(lines, "\n").alias("text"))
    body = dealt(body, "bodies")
    # each step is written by itself: the driver plans, compiles and tracks a step's stages at a time, not a whole scan's
    evidence = written(_evidence(handlers, body, imported, providers), "evidence")
    own = calls.where("handler_id IS NOT NULL")
    taken = written(_consumed(text, calls), "consumers")  # callbacks of queue consumers, roots of their own beside the handlers
    roots = own.unionByName(taken.drop("backend"))
    reached = written(_reachable(roots, calls, extract.symbols(text.functions), imported, files, depth), "reachable")
    sdk = cat.dimension(providers, "packages", "package").select("provider", "package")
    named = cat.dimension(providers, "calls", "call").select("provider", "call")
    dotted = written(joins.verify_calls(reached, named, sdk), "verify_calls")
    verified = dotted.unionByName(written(joins.native_verify_calls(body, imported, named, sdk), "verify_calls"))
    early = written(_early(text, handlers, own, reached, named), "early")
    kinds = [(verified.distinct(), "sdk_verify_call", F.col("call")), (early.withColumn("provider", F.lit("unknown")), "side_effect_before_verify", F.col("ord").cast("string"))]
    for df, kind, detail in kinds:
        evidence = evidence.unionByName(df.select("handler_id", F.lit(kind).alias("kind"), "provider", detail.alias("detail")))
    evidence = written(evidence.join(handlers.select("handler_id"), "handler_id", "left_semi"), "evidence")
    provider = aggregates.attributed(handlers, evidence)
    handlers = written(aggregates.demoted(handlers.join(provider, "handler_id"), evidence), "handlers")

    table = providers.select("provider", "packages", "calls", "algorithm", "input_format", "replay_seconds")
    shown = bodies.flags(body.drop("file_path").join(handlers.select("handler_id", "provider"), "handler_id"), table.select("provider", "calls"))
    shown = written(shown, "flags")
    handed = extract.delegates(text.toks, own).select("handler_id", F.lit(True).alias("delegates")).distinct()
    shown = shown.join(written(handed, "delegates"), "handler_id", "left").withColumn("delegates", F.coalesce("delegates", F.lit(False)))
    chain = written(joins.middleware_before(handlers, extract.middleware(rows, imported)), "middleware")
    verdicts = written(predicates.verdicts(predicates.features(handlers, reached, evidence, table, chain, shown)), "verdicts")
    sends = extract.with_raw_body(text.toks, own.where(x.queue_call(F.col("qualified_name"))["role"] == "enqueue"))
    takes = taken.select("handler_id", "backend").distinct().join(dotted.select("handler_id").distinct(), "handler_id", "left_semi")
    verdicts = predicates.downgraded(verdicts, written(joins.backends_met(sends, takes), "deferred"))
    found = verdicts.join(handlers.select("handler_id", "file_path", "line", "framework", "code"), "handler_id")
    if workflows is not None:
        handlers, found = _with_workflows(handlers, found, workflows)
    found = found.where(F.col("provider").isin(*only)) if only else found
    found = _by_rules(found.withColumn("rule_id", F.concat_ws("/", "provider", "rule_class")), rules)
    broken = errors.select(F.lit("engine/parse-error").alias("rule_id"), "file_path", F.coalesce("line", F.lit(1)).alias("line"), F.lit("high").alias("severity"), F.lit("manual-review").alias("state"), F.col("message").alias("code"))
    found = found.unionByName(broken, allowMissingColumns=True)
    hashed = x.line_hash(F.col("rule_id"), F.col("file_path"), F.lit("handler"), F.col("code"))
    found = found.withColumn("line_hash", hashed).withColumn("finding_id", x.finding_id(F.col("rule_id"), F.col("handler_id"), F.col("file_path"), F.col("line_hash")))
    found = found.withColumn("snippet", x.redacted(x.first_line(F.col("code")), ["whsec_", "sk_", "ghp_", "ghs_", "github_pat_"])).drop("code").withColumn("col", F.lit(1))
    found = _suppressed(found, rows, extract.lines(parsed.where(F.contains("text", F.lit("audit-")))), ignore, baseline)
    parsed = files.select("file_path").join(errors.select("file_path", F.lit(False).alias("p")), "file_path", "left").select("file_path", F.coalesce("p", F.lit(True)).alias("parsed"))
    findings = written(found, "findings")
    worst = aggregates.worst_verdict(handlers, findings.where("rule_id <> 'engine/parse-error'")).select("handler_id", "verdict")
    reached = reached.join(handlers.select("handler_id"), "handler_id", "left_semi")
    return Scan(handlers.drop("code", "k").join(worst, "handler_id"), evidence, reached, findings, parsed)


def _by_rules(found: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Findings (rule_id, handler_id, file_path, line, severity, state, code, references) that a pack has rules for."""
    columns = ["rule_id", "handler_id", "file_path", "line", "severity", "state", "code"]
    none = F.array().cast("array<string>")
    if rules is None:
        severity = F.coalesce(F.create_map(*[F.lit(v) for kv in cat.SEVERITY.items() for v in kv])[F.col("rule_class")], F.lit("high"))
        return found.withColumn("severity", severity).select(*columns, none.alias("references"))
    pack = joins.few(rules.select("rule_id", "severity", "applies_to"))
    fits = (F.size("applies_to") == 0) | F.array_contains("applies_to", F.when(F.col("framework") == "remix", "nextjs").otherwise(F.col("framework"))) | F.array_contains("applies_to", F.col("framework"))
    kept = dealt(found.join(pack, "rule_id").where(F.coalesce(fits, F.lit(True))).select(*columns), "kept")  # overrides read it several times, by file
    return joins.with_references(ordered.first_override(kept, packs.override_table(rules)), rules).select(*columns, "references")


def _early(text: extract.Texts, handlers: DataFrame, own: DataFrame, reached: DataFrame, named: DataFrame) -> DataFrame:
    """(handler_id, ord): statements of JavaScript handlers with a side effect before the first that verifies."""
    spark = own.sparkSession
    sinks = spark.createDataFrame([(n, "side_effect") for n in cat.SIDE_EFFECTS] + [(n, "side_effect_t2") for n in cat.NOTIFICATIONS], "name string, class string")
    effects = own.join(F.broadcast(sinks.select(F.col("name").alias("qualified_name"))), "qualified_name", "left_semi").select("handler_id").distinct()
    some = dealt(handlers.join(effects, "handler_id", "left_semi").select("handler_id", "file_path", "line", "k"), "effects")
    toks = dealt(text.toks.where("language = 'js'").join(some.select("file_path").distinct(), "file_path", "left_semi"), "effect_tokens")
    called = structure.last_bodies(toks, some.where("k IS NOT NULL")).join(some.select("handler_id", "file_path", "k"), ["file_path", "k"]).select("handler_id", "file_path", "body_k", "end_k")
    lines = some.where("k IS NULL").join(structure.blocks(toks).groupBy("file_path", "line").agg(F.min("k").alias("body_k"), F.min_by("end_k", "k").alias("end_k")), ["file_path", "line"])
    bodies_ = dealt(called.unionByName(lines.select("handler_id", "file_path", "body_k", "end_k")), "handler_bodies")
    found = structure.statements(toks, bodies_, dealt).join(bodies_.select("handler_id", "file_path", "body_k"), ["file_path", "body_k"])
    found = dealt(found, "statements")
    verify = reachability.promoted(found.where("name IS NOT NULL").select("handler_id", "name"), reached, named.select("call").distinct()).withColumn("verifies", F.lit(True))
    each = found.join(verify, ["handler_id", "name"], "left").withColumn("name", F.when(F.col("verifies"), F.lit("<verify>")).otherwise(F.col("name")))
    classes = ordered.classified(each.drop("verifies"), sinks.union(spark.sql("SELECT '<verify>', 'verification'")))
    return ordered.before_verify(classes.join(bodies_.select("handler_id", "file_path", "body_k"), ["file_path", "body_k"]))


def _consumed(text: extract.Texts, calls: DataFrame) -> DataFrame:
    """``calls`` in the callbacks of queue consumers, with `backend` and the consumer in the place of the handler."""
    kind = x.queue_call(F.col("qualified_name"))
    takes = calls.withColumn("q", kind).where("q.role = 'consume'").select("file_path", "k", F.col("q.backend").alias("backend"))
    inner = extract.callbacks(text.toks, takes, calls)
    found = inner.join(takes.withColumnRenamed("k", "around"), ["file_path", "around"])
    return found.withColumn("handler_id", F.concat_ws("#", F.lit("consumer"), "file_path", F.col("around").cast("string"))).select(*calls.columns, "backend")


def _with_workflows(handlers: DataFrame, found: DataFrame, workflows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Webhook nodes as handlers, and as findings where anyone may call them."""
    nodes = workflow.handlers(workflows)
    key = x.handler_id(F.col("file_path"), F.col("route"), F.array("method"), F.col("node"))
    nodes = nodes.select(key.alias("handler_id"), "file_path", F.lit("n8n").alias("framework"), "route", "method", F.lit(1).alias("line"), F.lit(1).alias("end_line"), F.col("node").alias("code"), F.lit("n8n").alias("provider"), F.lit(None).cast("int").alias("k"), "authentication")
    nodes = written(nodes, "nodes")
    free = nodes.where("authentication = 'none'").select("handler_id", "provider", F.lit("webhook-trigger-no-authentication").alias("rule_class"), F.lit(predicates.MISSING).alias("state"), "file_path", "line", "framework", "code")
    return handlers.unionByName(nodes.drop("authentication")), found.unionByName(free)


def _evidence(handlers: DataFrame, body: DataFrame, imported: DataFrame, providers: DataFrame) -> DataFrame:
    def of(df: DataFrame, kind: str, detail: Column) -> DataFrame:
        return df.select("handler_id", F.lit(kind).alias("kind"), "provider", detail.alias("detail"))

    dim = lambda c, n: cat.dimension(providers, c, n)
    paths = of(joins.contains(handlers, "route", dim("paths", "path"), "path", fold=True), "path_pattern_match", F.col("path"))
    own = joins.packages(imported.select("file_path", "to_module"), dim("packages", "package").select("provider", "package"))
    sdk = of(handlers.select("handler_id", "file_path").join(own, "file_path"), "sdk_import", F.col("package"))
    env = of(joins.contains(body, "text", dim("env", "needle"), "needle"), "env_var_match", F.col("needle"))
    literal = of(joins.contains(body, "text", dim("literals", "needle"), "needle"), "secret_literal", F.col("needle"))
    headers = dim("headers", "header")
    named = written(paths.unionByName(sdk).unionByName(env).unionByName(literal), "evidence")
    reads = joins.header_reads(body, "text", headers).select("handler_id", "header")
    reads = joins.owned_reads(reads, headers, named)
    generic = F.col("header").isin(*cat.GENERIC_HEADERS)
    reads = of(reads.withColumn("provider", F.when(generic, "unknown").otherwise(F.col("provider"))), "signature_header_read", F.col("header"))
    raw = of(body.where(F.col("text").rlike(BYTES)).withColumn("provider", F.lit("unknown")), "body_as_bytes_or_buffer", F.lit("heuristic"))
    return named.unionByName(reads).unionByName(raw).distinct()


def _reachable(own: DataFrame, calls: DataFrame, symbols: DataFrame, imported: DataFrame, files: DataFrame, depth: int) -> DataFrame:
    """(handler_id, qualified_name, import_source, hops): calls in the handler, and in what those lead to."""
    direct = own.select("handler_id", "qualified_name", "import_source", "import_name", "ord", "file_path")
    modules = imported.select(F.col("file_path").alias("from_file"), "to_module").distinct()
    resolved = written(joins.resolve_modules(modules, files), "modules")
    symbols = dealt(symbols, "symbols")
    edges = written(reachability.call_edges(calls, symbols, resolved), "edges")
    target = resolved.select(F.col("from_file").alias("file_path"), F.col("to_module").alias("import_source"), "to_file")
    first = direct.join(target, ["file_path", "import_source"], "left")
    known = symbols.groupBy(F.col("file_path").alias("in_file"), F.col("name").alias("callee")).agg(F.max_by("real", "start").alias("real"))
    seeds = first.select(F.col("handler_id").alias("root"), F.coalesce("to_file", "file_path").alias("in_file"), reachability.callee(direct).alias("callee"), "ord")
    seeds = seeds.join(known, ["in_file", "callee"]).select("root", F.concat("in_file", F.lit("#"), "real").alias("node"), "ord")
    closed = reachability.closure(seeds, edges, depth - 1)
    later = closed.join(calls.withColumn("node", F.concat("file_path", F.lit("#"), "caller")), "node")
    every = direct.select("handler_id", "qualified_name", "import_source", F.lit(1).alias("hops")).unionByName(
        later.select(F.col("root").alias("handler_id"), "qualified_name", "import_source", (F.col("hops") + 1).alias("hops"))
    )
    return every.groupBy("handler_id", "qualified_name").agg(F.min_by("import_source", "hops").alias("import_source"), F.min("hops").alias("hops"))


def _suppressed(found: DataFrame, rows: DataFrame, marked: DataFrame, ignore: DataFrame | None, baseline: DataFrame | None) -> DataFrame:
    last = rows.groupBy("file_path").agg(F.max("line").alias("last_line"))
    inline = ordered.suppressed_lines(extract.suppressions(marked), last).withColumn("inline", F.lit("comment"))
    found = found.join(inline, ["file_path", "rule_id", "line"], "left")
    found = joins.ignored(found, ignore) if ignore is not None else found.withColumn("ignore_pattern", F.lit(None).cast("string"))
    found = joins.with_baseline(found, baseline) if baseline is not None else found.withColumns({"baselined": F.lit(False), "drifted": F.lit(False)})
    source = ordered.suppression(F.col("inline"), F.col("ignore_pattern"), F.when(F.col("baselined"), F.lit("known")))
    return found.withColumn("suppression", source).withColumn("suppressed", F.col("suppression").isNotNull()).drop("inline", "ignore_pattern", "baselined")

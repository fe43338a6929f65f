"""Aggregations over evidence, findings and rules. Each is one shuffle on its grouping key, combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x


def attribution(evidence: DataFrame, where: Column | None = None) -> DataFrame:
    """(handler_id, provider): the provider with most evidence; a tie is `multiple`. Handlers without any have no row."""
    known = evidence.where("provider <> 'unknown'")
    counts = (known if where is None else known.where(where)).groupBy("handler_id", "provider").count()
    best = counts.groupBy("handler_id").agg(F.max("count").alias("most"), F.max_by("provider", "count").alias("p"), F.collect_list("count").alias("all"))
    tied = F.size(F.filter("all", lambda c: c == F.col("most"))) > 1
    return best.select("handler_id", F.when(tied, "multiple").otherwise(F.col("p")).alias("provider"))


def attributed(handlers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(handler_id, provider) of all handlers: evidence without generic-crypto verify calls first, then all of it."""
    again = attribution(evidence, ~((F.col("kind") == "sdk_verify_call") & F.col("detail").rlike("^(crypto|hmac|hashlib)\\.")))
    out = handlers.select("handler_id").join(again.withColumnRenamed("provider", "p1"), "handler_id", "left")
    out = out.join(attribution(evidence).withColumnRenamed("provider", "p2"), "handler_id", "left")
    return out.select("handler_id", F.coalesce("p1", "p2", F.lit("unknown")).alias("provider"))


def demoted(handlers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``handlers`` (handler_id, provider, route, framework) whose provider rests on an import alone, on a plain path,
    as `unknown`."""
    firm = evidence.where("kind <> 'sdk_import'").select("handler_id", "provider").distinct().withColumn("firm", F.lit(True))
    out = handlers.join(firm, ["handler_id", "provider"], "left")
    keep = F.coalesce("firm", F.lit(False)) | x.webhookish(F.col("route")) | (F.col("framework") == "n8n") | F.col("provider").isin("unknown", "multiple")
    return out.withColumn("provider", F.when(keep, F.col("provider")).otherwise("unknown")).select(*handlers.columns)


def worst_verdict(handlers: DataFrame, findings: DataFrame) -> DataFrame:
    """(handler_id, verdict, n_findings): handlers without findings need a manual review."""
    worst = findings.groupBy("handler_id").agg(F.max_by("state", x.verdict_rank(F.col("state"))).alias("v"), F.count("*").alias("n"))
    out = handlers.select("handler_id").join(worst, "handler_id", "left")
    return out.select("handler_id", F.coalesce("v", F.lit("manual-review")).alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_findings"))


def findings_ref(findings: DataFrame) -> DataFrame:
    """(handler_id, refs): ids of a handler's findings in the order of the rules."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "finding_id"))), lambda s: s["finding_id"])
    return findings.groupBy("handler_id").agg(F.array_join(refs, ",").alias("refs"))


def severity_tally(findings: DataFrame) -> DataFrame:
    """(severity, active, suppressed)."""
    return findings.groupBy("severity").agg(F.count_if(~F.col("suppressed")).alias("active"), F.count_if("suppressed").alias("suppressed"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: counts of live findings by verdict, by severity at least high, and of files."""
    live = ~F.col("suppressed") & (F.col("rule_id") != "engine/parse-error")
    state = F.col("state")
    return findings.agg(
        F.count_if(live & (state == "not-verified")).alias("not_verified"),
        F.count_if(live & (state == "manual-review")).alias("manual_review"),
        F.count_if(live & (state == "verified")).alias("verified"),
        F.count_if(F.col("rule_id") == "engine/parse-error").alias("parse_errors"),
        F.count_if(live & x.at_or_above(F.col("severity"), "high")).alias("high_or_worse"),
        F.count_distinct(F.when(live, F.col("file_path"))).alias("files"),
    )


def verdict_summary(findings: DataFrame) -> DataFrame:
    """One row in four buckets: live findings by verdict, and parse errors beside them."""
    parse, live = F.col("rule_id") == "engine/parse-error", ~F.col("suppressed")
    each = [F.count_if(live & ~parse & (F.col("state") == v)).alias(v.replace("-", "_")) for v in x.VERDICTS]
    return findings.agg(*each, F.count_if(live & parse).alias("parse_errors"))


def gates(threshold: str) -> Column:
    """Whether a finding counts at a threshold: verified never, a manual review at low and info only, parse errors by severity."""
    weak = (F.col("state") == "manual-review") & F.lit(threshold not in ("low", "info"))
    plain = (F.col("state") != "verified") & ~weak
    return ~F.col("suppressed") & x.at_or_above(F.col("severity"), threshold) & (plain | (F.col("rule_id") == "engine/parse-error"))


def gate_counts(findings: DataFrame) -> DataFrame:
    """(threshold, n) for each severity as a threshold."""
    row = findings.agg(*[F.count_if(gates(s)).alias(s) for s in x.SEVERITIES])
    return row.select(F.explode(F.array(*[F.struct(F.lit(s).alias("threshold"), F.col(s).alias("n")) for s in x.SEVERITIES])).alias("g")).select("g.*")


def parse_coverage(files: DataFrame, least: float) -> DataFrame:
    """One row (candidates, parsed, ratio, ok) of (parsed boolean); no candidates are full coverage, least <= 0 always passes."""
    row = files.agg(F.count("*").alias("candidates"), F.count_if("parsed").alias("parsed"))
    row = row.withColumn("ratio", F.when(F.col("candidates") == 0, 1.0).otherwise(F.col("parsed") / F.nullif("candidates", F.lit(0))))
    return row.withColumn("ok", F.lit(least <= 0) | (F.col("ratio") >= least))


def exit_code(bad_usage: Column, engine_error: Column, low_coverage: Column, gated: Column) -> Column:
    return F.when(bad_usage, 3).when(engine_error, 2).when(low_coverage, 4).when(gated, 1).otherwise(0)


def class_counts(rules: DataFrame) -> DataFrame:
    """(rule_class, n), most frequent first."""
    return rules.groupBy(F.substring_index("rule_id", "/", -1).alias("rule_class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_class")


def compliance(rules: DataFrame, frameworks: list[str]) -> DataFrame:
    """(framework, mapped, total) of rules (rule_id, mappings map<string, array<string>>), and `any`."""
    size = lambda f: F.coalesce(F.size(F.try_element_at("mappings", F.lit(f))), F.lit(0))
    some = F.greatest(*[size(f) for f in frameworks], F.lit(0))
    row = rules.agg(F.count("*").alias("total"), *[F.count_if(size(f) > 0).alias(f) for f in frameworks], F.count_if(some > 0).alias("any"))
    names = [*frameworks, "any"]
    return row.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("framework"), F.col(f).alias("mapped")) for f in names])).alias("m")).select("m.*", "total")


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Frameworks that fewer rules map now than in the baseline."""
    old = baseline.select("framework", F.col("mapped").alias("baseline"))
    return current.join(old, "framework").where("mapped < baseline").select("framework", F.col("mapped").alias("current"), "baseline")


def min_hops(reachable: DataFrame, calls: DataFrame) -> DataFrame:
    """(handler_id, hops): the nearest call that ends with one of ``calls`` (call)."""
    each = reachable.withColumn("call", F.explode(x.dotted_suffixes(F.col("qualified_name"))))
    return each.join(calls, "call", "left_semi").groupBy("handler_id").agg(F.min("hops").alias("hops"))


def hash_chain(rows: DataFrame) -> DataFrame:
    """(chain, n, head) of rows (chain, seq, payload): h = sha256(previous h, payload), in the order of seq.

    A chain is folded in one row, as each step needs the one before; chains are independent of each other.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "payload")))
    head = F.aggregate(ordered, F.lit(""), lambda h, r: F.sha2(F.concat(h, F.lit("|"), r["payload"]), 256))
    return rows.groupBy("chain").agg(F.count("*").alias("n"), head.alias("head"))


def broken_links(rows: DataFrame) -> DataFrame:
    """(chain, first_broken): the first row of (chain, seq, hash, prev_hash, payload) that does not follow the one before it."""
    w = Window.partitionBy("chain").orderBy("seq")
    ok = (F.col("hash") == F.sha2(F.concat("prev_hash", F.lit("|"), "payload"), 256)) & (F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit("")))
    return rows.withColumn("ok", ok).groupBy("chain").agg(F.min(F.when(~F.col("ok"), F.col("seq"))).alias("first_broken"))

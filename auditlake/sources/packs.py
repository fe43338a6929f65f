"""Rule packs, baselines and ignore files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import scalars as x

RULES = "rule_id string, provider string, severity string, applies_to array<string>, predicate string, mappings map<string,array<string>>, overrides array<struct<patterns:array<string>,severity:string>>, references array<string>"
BASELINE = "rule_id string, line_hash string, file_path string, line int, severity string, state string, ord int"


def rules(spark: SparkSession, path: str, providers: DataFrame, known: list[str]) -> DataFrame:
    """A pack of JSON lines. Unknown providers or predicates, unknown severities and an empty pack are errors."""
    pack = spark.read.schema(RULES).option("mode", "FAILFAST").json(path)
    bad = (
        pack.join(providers.select("provider"), "provider", "left_anti")
        .unionByName(pack.where(~F.coalesce(F.col("predicate").isin(*known), F.lit(False))))
        .unionByName(pack.where(x.severity_rank(F.col("severity")).isNull()))
        .select("rule_id")
        .distinct()
        .limit(20)
    )
    if found := [r[0] for r in bad.collect()]:
        raise ValueError(f"invalid rules: {found}")
    if pack.isEmpty():
        raise ValueError(f"no rules in {path}")
    return pack


MATCHERS = (
    "rule_id string, provider string, emits_state string, predicate string, matcher struct<name:string,args:struct<module:string,qualified_name:string,prefix:string,"
    "header:string,before:string,after:string,call:string,arg_index:int,equals:string>>"
)


def matchers(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A pack's matchers (MATCHERS, and `numeric`: whether the value to equal is a number), JSON lines; an unknown kind of
    matcher, a rule without any condition, and an empty pack are errors."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    pack = lines.select(F.from_json("value", MATCHERS, {"mode": "FAILFAST"}).alias("r"), F.col("value").rlike(r'"equals"\s*:\s*-?\d').alias("numeric")).select("r.*", "numeric")
    known = F.coalesce(F.col("matcher.name").isin(*names), F.col("predicate").isNotNull())
    bad = pack.where(~F.coalesce(known, F.lit(False)) | F.col("rule_id").isNull()).select("rule_id").limit(20).collect()
    if bad:
        raise ValueError(f"invalid matchers: {[r[0] for r in bad]}")
    if pack.isEmpty():
        raise ValueError(f"no rules in {path}")
    return pack


def for_providers(rules: DataFrame, wanted: list[str], providers: DataFrame) -> DataFrame:
    """The rules of some providers; a name that the catalog lacks is an error."""
    known = {r[0] for r in providers.select("provider").distinct().toLocalIterator()}  # a catalog's names
    if unknown := set(wanted) - known:
        raise ValueError(f"unknown providers: {sorted(unknown)}")
    return rules.where(F.col("provider").isin(*wanted))


def override_table(rules: DataFrame) -> DataFrame:
    """(rule_id, ord, regex, severity, key) of a pack's overrides by path, in their order."""
    rows = rules.where("size(overrides) > 0").select("rule_id", "overrides").toLocalIterator()  # of a pack
    flat = [(r["rule_id"], i, x.glob_regex(p), o["severity"], x.glob_key(p)) for r in rows for i, (o, p) in enumerate((o, p) for o in r["overrides"] for p in o["patterns"])]
    return rules.sparkSession.createDataFrame(flat, "rule_id string, ord int, regex string, severity string, key string")


def content_hash(rules: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(by..., content_hash): SHA-256 of a pack's rules as canonical JSON, in the order of their ids.

    fields: columns of any type that JSON has, in any order; nulls are `null`. A pack is small; what is hashed for one group
    is its rules.
    """
    each = F.struct(*fields)
    json = canonical.value(each, rules.select(each.alias("v")).schema["v"].dataType)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rule_id", json.alias("json")))), lambda s: s["json"])
    return rules.groupBy(*by).agg(F.sha2(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 256).alias("content_hash"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """None where there is none; a malformed one is an error."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    return spark.read.schema(BASELINE).option("mode", "FAILFAST").json(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    """The live findings, sorted by line hash."""
    baseline_rows(findings).orderBy("line_hash", "rule_id").write.mode("overwrite").json(path)


def baseline_rows(findings: DataFrame) -> DataFrame:
    """What a baseline holds: of the live findings of one rule and line hash the one of the smallest path and line."""
    live = findings.where("NOT suppressed AND state <> 'verified'")
    first = F.min_by(F.struct("file_path", "line", "severity", "state"), F.struct("file_path", "line", "severity", "state"))
    return live.groupBy("rule_id", "line_hash").agg(first.alias("f")).select("rule_id", "line_hash", "f.*", F.lit(0).alias("ord"))


def ignore_table(spark: SparkSession, text: str) -> DataFrame:
    """(ord, pattern, regex, negated, key) of the lines of an ignore file."""
    lines = [p.strip() for p in text.splitlines() if p.strip() and not p.startswith("#")]
    return spark.createDataFrame([(i, p, *x.ignore_regex(p), x.ignore_key(p)) for i, p in enumerate(lines)], "ord int, pattern string, regex string, negated boolean, key string")


def config(command_line: dict, env: dict, file_text: str | None, defaults: dict) -> dict:
    """Settings: command line before environment before file before defaults; unknown keys in the file are errors."""
    from_file = json.loads(file_text) if file_text else {}
    if unknown := set(from_file) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    layers = [defaults, from_file, env, command_line]
    return {k: next(layer[k] for layer in reversed(layers) if layer.get(k) is not None or layer is defaults) for k in defaults}

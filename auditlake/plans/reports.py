"""Reports of a scan. Aggregates and sorted findings come from Spark; a report holds what a person or a code host reads."""

from __future__ import annotations

import json
import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import scalars as x
from ..operators import aggregates, ordered


def canonical_json(value) -> str:
    """RFC 8785: keys by UTF-16 units, shortest numbers, no white space."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return _number(float(value))
    if isinstance(value, str):
        value.encode("utf-8")  # lone surrogates are errors
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in keys) + "}"
    raise TypeError(f"not JSON: {type(value).__name__}")


def _number(v: float) -> str:
    if v == 0:
        return "0"
    digits, _, exponent = repr(v).replace("-", "", v < 0).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        e = point - 1
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + ("e+" if e > 0 else "e-") + str(abs(e))
    return ("-" if struct.pack(">d", v)[0] & 0x80 else "") + out


FIELDS = ["finding_id", "rule_id", "severity", "state", "file_path", "line", "snippet", "handler_id", "line_hash", "suppressed"]


def rows_of(findings: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in ordered.by_severity(findings).select(*FIELDS).collect()]


def json_report(findings: DataFrame) -> str:
    """For a pull request's size of findings; a corpus' findings are written with ``findings.write.json``."""
    return json.dumps({"schema": 1, "findings": rows_of(findings), "summary": aggregates.summary(findings).first().asDict()}, sort_keys=True, indent=2)


def json_lines(findings: DataFrame) -> DataFrame:
    """(value): each finding as canonical JSON (RFC 8785), made where the finding is; what it has no value for is left out."""
    each = findings.select(F.struct(*FIELDS).alias("f"))
    return each.select(canonical.value(F.col("f"), each.schema["f"].dataType, drop_nulls=True).alias("value"))


def write_json(findings: DataFrame, folder: str) -> None:
    """A corpus' findings as canonical JSON lines by part under ``folder``/findings, and schema and summary beside them."""
    json_lines(findings).write.mode("overwrite").text(f"{folder}/findings")
    whole = aggregates.summary(findings).select(F.struct(F.lit(1).alias("schema"), F.struct("*").alias("summary")).alias("v"))
    whole.select(canonical.value(F.col("v"), whole.schema["v"].dataType).alias("value")).write.mode("overwrite").text(f"{folder}/envelope")


def sarif(findings: DataFrame, version: str = "0") -> str:
    found = rows_of(findings)
    results = [
        {
            "ruleId": f["rule_id"],
            "level": x.SARIF_LEVELS[f["severity"]],
            "message": {"text": f["state"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["file_path"]}, "region": {"startLine": f["line"]}}}],
            "partialFingerprints": {"primaryLocationLineHash": f["line_hash"]},
            "suppressions": [{"kind": "external"}] if f["suppressed"] else [],
        }
        for f in found
    ]
    driver = {"name": "auditlake", "version": version, "rules": [{"id": r} for r in sorted({f["rule_id"] for f in found})]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, sort_keys=True, indent=2)


def text_lines(findings: DataFrame) -> DataFrame:
    """(file_path, line, text): the live findings as lines of a terminal's report, without colours."""
    live = findings.where("NOT suppressed")
    place = F.concat_ws(":", "file_path", F.col("line").cast("string"))
    text = F.concat(F.rpad(F.upper("severity"), 9, " "), place, F.lit("  "), F.col("rule_id"), F.lit(" ["), F.col("state"), F.lit("]"))
    return live.select("file_path", "line", text.alias("text"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(value): a SARIF result of each finding as JSON, made where the finding is."""
    region = F.struct(F.col("line").alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    muted = F.when(F.col("suppressed"), F.array(F.struct(F.lit("external").alias("kind")))).otherwise(F.array().cast("array<struct<kind:string>>"))
    return findings.select(
        F.to_json(
            F.struct(
                F.col("rule_id").alias("ruleId"),
                x.sarif_level(F.col("severity")).alias("level"),
                F.struct(F.col("state").alias("text")).alias("message"),
                F.array(place).alias("locations"),
                F.struct(F.col("line_hash").alias("primaryLocationLineHash")).alias("partialFingerprints"),
                muted.alias("suppressions"),
            )
        ).alias("value")
    )


def write_sarif(findings: DataFrame, folder: str, version: str = "0") -> None:
    """A corpus' results as JSON lines by part under ``folder``/results, and the log's envelope with its rules beside them."""
    sarif_results(findings).write.mode("overwrite").text(f"{folder}/results")
    rules = findings.select(F.col("rule_id").alias("id")).distinct().agg(F.array_sort(F.collect_list(F.struct("id"))).alias("rules"))  # a pack's ids
    driver = F.struct(F.lit("auditlake").alias("name"), F.lit(version).alias("version"), F.col("rules"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"))).alias("runs"))
    rules.select(F.to_json(log).alias("value")).write.mode("overwrite").text(f"{folder}/envelope")


def comment(findings: DataFrame, most: int = 5) -> str:
    """Markdown of the worst live findings and the number of the others."""
    live = findings.where("NOT suppressed AND state <> 'verified'")
    top = ordered.by_severity(live).limit(most).collect()
    rest = live.count() - len(top)
    lines = [f"- **{r['severity']}** `{r['rule_id']}` {r['file_path']}:{r['line']} ({r['state']})" for r in top]
    return "\n".join(lines + [f"and {rest} more"] * (rest > 0)) or "no findings"


def inventory(handlers: DataFrame, evidence: DataFrame, everything: bool = False) -> DataFrame:
    """Handlers by path and route; those without evidence only on request."""
    n = evidence.groupBy("handler_id").count()
    out = handlers.join(n, "handler_id", "left").fillna(0, ["count"])
    return (out if everything else out.where("count > 0")).orderBy("file_path", "route")

"""Operators over ordered rows, as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions import scalars as x


def before_verify(statements: DataFrame) -> DataFrame:
    """(handler_id, ord): side effects before the first verification; all of them where nothing verifies.

    statements: (handler_id, ord, class).
    """
    first = F.min(F.when(F.col("class") == "verification", F.col("ord"))).over(Window.partitionBy("handler_id"))
    return statements.withColumn("first", first).where("class IN ('side_effect', 'side_effect_t2') AND (first IS NULL OR ord < first)").select("handler_id", "ord")


CLASSES = ["neutral", "short_circuit", "side_effect_t2", "side_effect", "verification"]


def statement_class(calls: DataFrame, sinks: DataFrame) -> DataFrame:
    """(handler_id, ord, class): a statement's strongest class by the literal names that it calls; sinks: (name, class)."""
    from .joins import few

    each = calls.join(few(sinks), "name", "left").withColumn("class", F.coalesce("class", F.lit("neutral")))
    return each.groupBy("handler_id", "ord").agg(F.max_by("class", x.rank(CLASSES, F.col("class"))).alias("class"))


def classified(calls: DataFrame, sinks: DataFrame) -> DataFrame:
    """(file_path, body_k, ord, class) of what `structure.statements` returns; sinks: (name, class).

    An `if` whose test verifies is a verification, another one that returns at once a short circuit; else the strongest class of the
    calls in the statement: verification, then effects on stores and other systems, then notifications.
    """
    from .joins import few

    each = calls.join(few(sinks), "name", "left").withColumn("class", F.coalesce("class", F.lit("neutral")))
    best = F.max_by("class", x.rank(CLASSES, F.col("class")))
    tested = F.bool_or(F.col("tested") & (F.col("class") == "verification"))
    found = each.groupBy("file_path", "body_k", F.col("statement").alias("ord")).agg(best.alias("class"), tested.alias("tested"), F.bool_or("returns").alias("returns"))
    state = F.when(F.col("tested"), "verification").when(F.col("returns"), "short_circuit").otherwise(F.col("class"))
    return found.select("file_path", "body_k", "ord", state.alias("class"))


def in_order(middleware: DataFrame, before: str, after: str) -> DataFrame:
    """(handler_id, in_order) of handlers that have both: whether the first `before` is ahead of the first `after`."""
    at = lambda n: F.min(F.when(F.col("name") == n, F.col("position")))
    both = middleware.groupBy("handler_id").agg(at(before).alias("b"), at(after).alias("a"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select("handler_id", (F.col("b") < F.col("a")).alias("in_order"))


def suppressed_lines(marks: DataFrame, last_lines: DataFrame) -> DataFrame:
    """(file_path, rule_id, line) that comments suppress; marks: (file_path, rule_id, line, form).

    Forms: next-line, line, disable, enable. A block runs from `disable` to the next `enable`, or to the end of the
    file (last_lines: file_path, last_line).
    """
    w = Window.partitionBy("file_path", "rule_id").orderBy("line")
    single = marks.where("form IN ('next-line', 'line')")
    single = single.select("file_path", "rule_id", (F.col("line") + F.when(F.col("form") == "next-line", 1).otherwise(0)).alias("line"))
    block = marks.where("form IN ('disable', 'enable')").withColumns({"before": F.lag("form").over(w), "until": F.min(F.when(F.col("form") == "enable", F.col("line"))).over(w.rowsBetween(1, Window.unboundedFollowing))})
    block = block.where("form = 'disable' AND coalesce(before, 'enable') = 'enable'").join(last_lines, "file_path")
    end = F.coalesce("until", F.col("last_line"))
    block = block.where(end >= F.col("line")).select("file_path", "rule_id", F.explode(F.sequence(F.col("line"), end)).alias("line"))
    return single.unionByName(block).distinct()


def first_override(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings with the severity of the first override (rule_id, ord, regex, severity, and `key` or not) whose expression fits the path."""
    from .joins import fitting

    rules = overrides.withColumnRenamed("severity", "s")
    hits = fitting(findings.select("rule_id", "file_path").distinct(), rules, "rule_id")
    best = hits.groupBy("rule_id", "file_path").agg(F.min_by("s", "ord").alias("s"))
    out = findings.join(best, ["rule_id", "file_path"], "left")
    return out.withColumn("severity", F.coalesce("s", "severity")).drop("s")


def suppression(inline, ignore, baseline):
    """Source of a suppression, of three columns that are null where there is none: inline before ignore before baseline."""
    each = [F.when(c.isNotNull(), F.struct(F.lit(n).alias("source"), c.cast("string").alias("detail"))) for n, c in (("inline", inline), ("ignore-file", ignore), ("baseline", baseline))]
    return F.coalesce(*each)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(x.severity_rank(F.col("severity")), "file_path", "line", "col", "rule_id")


def without_overlap(edits: DataFrame) -> DataFrame:
    """(file_path, start, end, rule_id, kept): a file's edits in order of start; one that overlaps a kept one is dropped.

    Two empty edits at one offset overlap. Greedy, so a file's edits are taken in order: partitions are sorted and read as a
    stream, which remembers where the last kept edit ends and where the last kept empty one is. No file is ever held whole.
    """
    rows = edits.select("file_path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "rule_id")
    rows = rows.repartition("file_path").sortWithinPartitions("file_path", "start", "end", "rule_id")

    def fold(batches):
        file, until, bare, first = None, 0, 0, True
        for batch in batches:
            kept = []
            for f, a, b in zip(batch["file_path"], batch["start"], batch["end"]):
                if first or f != file:
                    file, until, bare, first = f, -(2**63), -(2**63), False
                kept.append(a >= until and not (a == b == bare))
                if kept[-1]:
                    until, bare = (until, a) if a == b else (b, bare)
            yield batch.assign(kept=kept)

    return rows.mapInPandas(fold, StructType([*rows.schema.fields, StructField("kept", BooleanType())]))

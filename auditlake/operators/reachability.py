"""Bounded closure over calls, hop by hop.

Each hop is an equi-join with the call edges and an anti-join with what was reached before, so a name keeps
its fewest hops and, among those, the first place in the source. Hops are few and fixed; each one's result is
written, so the plan does not grow and executors may go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def closure(seeds: DataFrame, edges: DataFrame, depth: int = 4, most: int = 1000) -> DataFrame:
    """(root, node, hops): what each root reaches in at most ``depth`` hops, its seeds (root, node, ord) at the first.

    edges: (src, dst, ord). most: symbols kept for a root, nearest first (the contract of a bounded scan, which counts
    qualified names: here each symbol, of a file, counts once under whatever names it is called).
    """
    first = Window.partitionBy("root", "node").orderBy("ord")
    hop = seeds.withColumn("n", F.row_number().over(first)).where("n = 1").select("root", "node", F.lit(1).alias("hops"), "ord")
    reached = written(hop, "hop")
    front = begun = reached
    for hops in range(2, depth + 1):
        ahead = front.select("root", F.col("node").alias("src"), F.col("ord").alias("o")).join(edges, "src")
        ahead = ahead.groupBy("root", F.col("dst").alias("node")).agg(F.min("ord").alias("ord"))
        front = written(ahead.join(reached, ["root", "node"], "left_anti").select("root", "node", F.lit(hops).alias("hops"), "ord"), "hop")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    if _bound(begun, edges, depth) <= most:  # nothing to cut, so no need to bring each root's symbols together
        return reached.select("root", "node", "hops")
    nearest = Window.partitionBy("root").orderBy("hops", "ord", "node")
    return reached.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= most).select("root", "node", "hops")


def _bound(seeds: DataFrame, edges: DataFrame, depth: int) -> int:
    """No root reaches more than this: the most seeds of a root, each with as many calls a hop as the symbol that has most."""
    most = lambda df, by: df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    wide = most(edges, "src")
    return most(seeds, "root") * sum(wide**i for i in range(depth))


def callee(calls: DataFrame):
    """The name that a call has in the file it leads to: the imported one for a call of an import itself, else its last part."""
    last = F.substring_index("qualified_name", ".", -1)
    if "import_name" not in calls.columns:
        return last
    itself = F.col("import_name").isNotNull() & (F.col("import_name") != "*") & ~F.contains("qualified_name", F.lit("."))
    return F.when(itself, F.col("import_name")).otherwise(last)


def call_edges(calls: DataFrame, symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, dst, ord) between symbols, keyed `file#name`, of calls (file_path, caller, qualified_name, import_source, ord).

    A call of an imported name leads to the symbol of the file that its module resolves to, any other to a symbol of
    the same file. The last definition of a name counts. Symbols have no owners here, so a method call leads to the file's
    symbol of that last part whatever its receiver: `a.b.check()` to `check`.
    """
    last = symbols.groupBy("file_path", "name").agg(F.max_by("real" if "real" in symbols.columns else "name", "start").alias("real"))
    target = resolved.select(F.col("from_file").alias("file_path"), F.col("to_module").alias("import_source"), "to_file")
    each = calls.join(target, ["file_path", "import_source"], "left")
    each = each.withColumn("in_file", F.coalesce("to_file", "file_path")).withColumn("callee", callee(calls))
    hit = each.join(last.toDF("in_file", "callee", "real"), ["in_file", "callee"])
    key = lambda f, n: F.concat(F.col(f), F.lit("#"), F.col(n))
    return hit.select(key("file_path", "caller").alias("src"), key("in_file", "real").alias("dst"), "ord")


def promoted(statements: DataFrame, names: DataFrame, calls: DataFrame) -> DataFrame:
    """(handler_id, name) of the statements (handler_id, name) that count as verification: verify calls, `this.` and their
    last part, whoever calls them; and for each handler its reachable names that end with a call, and their first parts.

    names: (handler_id, qualified_name); calls: (call). The names that count for all are a table of their own beside the
    handlers'; nothing pairs every handler with every call.
    """
    from ..functions.scalars import dotted_suffixes
    from .joins import few

    matched = names.withColumn("call", F.explode(dotted_suffixes(F.col("qualified_name")))).join(few(calls), "call", "left_semi")
    own = matched.select("handler_id", F.explode(F.array("qualified_name", F.substring_index("qualified_name", ".", 1))).alias("name")).distinct()
    every = calls.select(F.explode(F.array("call", F.concat(F.lit("this."), F.substring_index("call", ".", -1)))).alias("name")).distinct()
    asked = statements.select("handler_id", "name").distinct()
    return asked.join(few(every), "name", "left_semi").unionByName(asked.join(own, ["handler_id", "name"], "left_semi")).distinct()

"""Line dedup: drop lines that several documents hold, except in the first of them.

Built-in functions only. The lines' texts never shuffle: what moves is a 128-bit hash of each
normalised line with its document's id. Lines over the document threshold come back as a list of
positions per document, and one join on the document reassembles the text.

A line held by a third of all rows is pre-aggregated before the first shuffle (min, max and count
combine on the map side). The repeated lines are then a written table, so the join that finds their places
is one of two plain scans: broadcast where the table is small, else a shuffled join whose skewed keys
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, hash128, materialize, on_row, row_keyed

SPACE = " \t\n\x0b\f\r"


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, r1, r2, pos, h1, h2) of each line that counts."""
    lines = rows.where("doc_id IS NOT NULL").select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.octet_length("line") >= min_chars).withColumn("line", F.trim(F.col("line"), F.lit(SPACE)))
    h1, h2 = hash128(F.col("key"))
    return (
        lines.where(F.char_length("line") >= min_chars)
        .withColumn("key", ascii_lower(F.col("line")))
        .select("doc_id", "r1", "r2", "pos", h1.alias("h1"), h2.alias("h2"))
    )


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """(h1, h2, keep): the hash of each line found in at least ``min_docs`` documents, and the smallest of their ids."""
    keys = _keys(row_keyed(documents(docs)), min_chars)
    if min_docs <= 2:  # two documents differ exactly when the smallest and the largest id do
        found = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"))
        return (found.where("keep < last") if min_docs == 2 else found).drop("last")
    once = keys.select("h1", "h2", "doc_id").distinct()
    found = once.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))
    return found.where(F.col("n") >= min_docs).drop("n")


def _dedup(docs: DataFrame, rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """``rows``, which hold (doc_id, text, r1, r2) and maybe more, with n_lines, n_dropped and kept."""
    drops = (
        _keys(rows, min_chars)
        .join(materialize(repeated_lines(docs, min_docs, min_chars), "lines"), ["h1", "h2"])
        .where("doc_id <> keep")
        .groupBy("doc_id", "r1", "r2")
        .agg(F.collect_set("pos").alias("gone"))
    )
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    none = F.col("gone").isNull()
    return (
        on_row(rows, drops)
        .withColumn("lines", lines)
        .withColumns(
            {
                "n_lines": F.size("lines").cast("long"),
                "n_dropped": F.when(none, 0).otherwise(F.size("gone")).cast("long"),
                "kept": F.when(none, F.col("text")).otherwise(text),
            }
        )
        .drop("lines", "gone")
    )


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), a row for each row of ``docs``.

    A line's key is the line without ASCII space at both ends, A-Z lowered. Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the
    smallest doc_id holding them. Null or empty text is one empty line. Rows of one doc_id are one
    document, so lines they share stay. Rows without a doc_id neither count nor lose lines. An empty table
    gives no rows; other columns are ignored.
    """
    found = _dedup(docs, row_keyed(documents(docs)), min_docs, min_chars)
    return found.select("doc_id", "n_lines", "n_dropped", "kept")


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``docs`` with repeated lines gone from ``text`` and, where there is one, ``n_chars`` counted anew."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = row_keyed(documents(docs, more=more))
    found = _dedup(docs, rows, min_docs, min_chars)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("more")[f.name]).alias(f.name) for f in docs.schema])


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(g.keep <> k.doc_id, false) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""

"""Labelled rows for the classifiers: who is held out, and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5. Rows of fold 0 are held out; a null id has none and is not."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(5))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(text, y, fold) of labelled rows outside fold 0: all of them, or about ``most`` by a hash of the id.

    Of several labels of a document the largest counts. The labels that join are at most about ``most`` rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col(column).cast("double").alias("y"))
    known = known.where("y IN (0, 1)").where(fold(F.col("labelled")) > 0).groupBy("labelled").agg(F.max("y").alias("y"))
    step = -(-known.count() // most) or 1
    known = known.where(F.pmod(F.xxhash64("labelled"), F.lit(step)) == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("labelled"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), "labelled").select("text", "y", fold(F.col("labelled")).cast("int").alias("fold"))

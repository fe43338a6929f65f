"""Scanning files as they arrive: a file source, and a scan of each micro-batch.

The per-file operators are stateless; handlers are kept by id in the sink, so a batch that is run again
overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract
from ..sources import files as source
from ..sources.tables import written


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (file_path, language, text)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    path = source._relative("path", root)
    found = found.where(F.col("length") <= source.MOST_BYTES).withColumn("file_path", path).where(source.status(path, F.col("length")) == "ok")
    return found.select("file_path", source.language(F.col("file_path")).alias("language"), F.col("content").cast("string").alias("text"))


def watch(files: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write the handlers of each micro-batch of files to ``sink``/batch=N."""

    def batch(df: DataFrame, number: int) -> None:
        text = extract.texts(df, written)
        extract.routes(text.rows, text.toks, text.functions, extract.imports(text.rows)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

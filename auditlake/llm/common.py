"""What the operators of this subpackage share: table access, row identity and lineage cuts."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
#: Spark deletes a query's shuffle files as it ends; without this they stay until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="auditlake-")
    return _own_dirs[sc.applicationId]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/auditlake-llm-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not written before are lost."""
    delete(spark, _own_folder(spark))


_writes: dict[int, list] = {}  # by session: writes that run, the setting before them
_lock = threading.Lock()


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession):
    """The setting for as long as one of these writes runs in the session, from whatever thread."""
    with _lock:
        own = _writes.setdefault(id(spark), [0, None])
        if not own[0]:
            own[1] = spark.conf.get(DROP_SHUFFLES, None)
            spark.conf.set(DROP_SHUFFLES, "true")
        own[0] += 1
    try:
        yield
    finally:
        with _lock:
            own[0] -= 1
            if not own[0]:
                spark.conf.set(DROP_SHUFFLES, own[1]) if own[1] else spark.conf.unset(DROP_SHUFFLES)
                del _writes[id(spark)]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that outlives executors, and gives the planner the
    true size of the table, so that it broadcasts it only when it is small. The shuffles of the write go with its end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing will read it any more."""
    delete(df.sparkSession, df._written_to)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with unlike seeds: together an identity that does not collide at corpus scale."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)]


#: Rows of a few numbers that are broadcast at most; tables beyond are joined by shuffling.
BROADCAST_ROWS = 2_000_000


def beside(small: DataFrame) -> DataFrame:
    """A table of a few numbers a row, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Only ``doc_id`` and ``text``, so that no extra column can clash; a null text is empty.

    more: columns to carry along in a struct of that name.
    """
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    if more is not None:
        cols.append(F.struct(*[quoted(c) for c in more] or [F.lit(0).alias("none")]).alias("more"))
    return docs.select(*cols)


def row_keyed(docs: DataFrame) -> DataFrame:
    """Adds (r1, r2), a hash of the text: with ``doc_id`` it identifies a row, and equal rows share it."""
    r1, r2 = hash128(F.col("text"))
    return docs.withColumns({"r1": r1, "r2": r2})


def on_row(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on (doc_id, r1, r2), null ids included; the right side's keys go."""
    r = right.withColumnsRenamed({"doc_id": "_i", "r1": "_r1", "r2": "_r2"})
    cond = left["doc_id"].eqNullSafe(r["_i"]) & (left["r1"] == r["_r1"]) & (left["r2"] == r["_r2"])
    return left.join(r, cond, how).drop("_i", "_r1", "_r2")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lowered and nothing else; pure ASCII takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of a text's words: runs without ASCII space, A-Z lowered."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def prepare(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it, if their environment names no place."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


BATCH_ROWS = 1000


def map_batches(df: DataFrame, task: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows, so that very long texts don't fill a worker's memory.

    Spark bounds its own batches by bytes.
    """
    prepare(df.sparkSession)

    def sliced(batches):
        return task(batch.slice(i, BATCH_ROWS) for batch in batches for i in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(sliced, schema)

"""Reading tables by name, and writing intermediate ones where all executors see them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_named: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only a local session without it gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="auditlake-")
    return _own[sc.applicationId]


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/auditlake-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not written before are lost."""
    for name in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# what is made of whole files within the tasks that hold them, and lies where it belongs without another exchange
IN_PLACE = {"tokens"}
# joins on a file and more meet where the files are; a task writes its one bucket without a sort
_WHERE_FILES_ARE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "4"}


@contextmanager
def _where_files_are(spark: SparkSession) -> Iterator[None]:
    """Settings for the planning of a step over tables that are dealt out by file; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in _WHERE_FILES_ARE}
    for k, v in _WHERE_FILES_ARE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(df: DataFrame, tag: str) -> DataFrame:
    """`written`, in buckets by file_path: windows within files and joins by file and more read them without an exchange."""
    spark, path, name = df.sparkSession, fresh_path(df.sparkSession, tag), f"auditlake_{tag}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _where_files_are(spark):
        rows = df if tag in IN_PLACE else df.repartition(n, "file_path")
        rows.write.bucketBy(n, "file_path").format("parquet").option("path", path).saveAsTable(name)
    _named.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name).toDF(*df.columns).hint("merge")  # without the table's name in front, which a union's partitioning does not survive


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors.

    Repetitive rows shrink to a hundredth on disk, and the planner takes a file's size for the rows'. The hint keeps it from
    broadcasting what only looks small, which the driver would have to hold; an explicit broadcast of a catalog goes before it.
    """
    path = fresh_path(df.sparkSession, tag)
    with _where_files_are(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")

"""Source files as a table: which are read, and why the others are not."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as x

# Fixed values.
SKIPPED_FOLDERS = ["node_modules", "dist", "build", "out", ".next", ".nuxt", "coverage", ".venv", "venv", "__pycache__", ".pytest_cache", "vendor", "target", ".git"]
LANGUAGES = {".js": "js", ".cjs": "js", ".mjs": "js", ".jsx": "js", ".ts": "js", ".cts": "js", ".mts": "js", ".tsx": "js", ".py": "py", ".pyi": "py", ".php": "php", ".go": "go"}
TEST_FOLDERS = ["test", "tests", "__tests__", "__test__", "spec", "specs", "__spec__", "__specs__", "e2e", "fixtures", "__fixtures__", "mocks", "__mocks__"]
TEST_NAMES = r"\.(test|spec)\.([cm]?[jt]s|[jt]sx)$|(^|/)test_[^/]*\.py$|_test\.py$"
MOST_BYTES = 1 << 20


def _any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(x.glob_regex(g) for g in globs)) if globs else F.lit(False)


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether lines of ignore files leave a path out; the last line that fits it decides."""
    out = F.lit(False)
    for line in lines:
        if line.strip() and not line.startswith("#"):
            regex, negated = x.ignore_regex(line.strip())
            out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def status(path: Column, size: Column, include_tests: bool = False, exclude: list[str] | None = None, include: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """Why a file is left out, in this order, or `ok`. ignore: lines of ignore files."""
    folders = lambda names: path.rlike("(^|/)(" + "|".join(n.replace(".", r"\.") for n in names) + ")/")
    tests = F.lit(not include_tests) & (folders(TEST_FOLDERS) | path.rlike(TEST_NAMES))
    return (
        F.when(folders(SKIPPED_FOLDERS), "skipped")
        .when(ignored(path, ignore or []), "ignored")
        .when(_any(path, exclude or []), "excluded")
        .when(~_any(path, include) if include else F.lit(False), "excluded")
        .when(~x.extension(path).isin(*LANGUAGES), "extension")
        .when(size > MOST_BYTES, "oversize")
        .when(tests, "test")
        .otherwise("ok")
    )


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])[x.extension(path)]


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """Lines of the root's own ignore files, in their order."""
    out: list[str] = []
    for name in (".gitignore", ".git/info/exclude"):
        fs, p = _hadoop(spark, f"{root.rstrip('/')}/{name}")
        if fs.exists(p):
            stream = fs.open(p)  # one small file, whose name Spark's own readers pass over
            try:
                out += spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            finally:
                stream.close()
    return out


def _relative(path: str, root: str) -> Column:
    return F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")


def listed(spark: SparkSession, root: str, **options) -> DataFrame:
    """(file_path, size, status) of all files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = _relative("path", root)
    options = {"ignore": ignore_lines(spark, root)} | options
    return files.select(path.alias("file_path"), F.col("length").alias("size"), "path").withColumn("status", status(F.col("file_path"), F.col("size"), **options))


def counters(files: DataFrame) -> DataFrame:
    return files.groupBy("status").count()


def walk(spark: SparkSession, root: str, **options) -> DataFrame:
    """(file_path, language, text) of the files that are read. Size and path filters come before the contents.

    A root that is a file is read whatever ignore files, patterns or test rules say, if its size and ending allow it.
    """
    fs, p = _hadoop(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        own = files.withColumn("file_path", x.basename(F.col("path"))).where(x.extension(F.col("path")).isin(*LANGUAGES))
        return own.select("file_path", language(F.col("file_path")).alias("language"), F.col("content").cast("string").alias("text"))
    path = _relative("path", root)
    options = {"ignore": ignore_lines(spark, root)} | options
    kept = files.withColumn("file_path", path).where(status(path, F.col("length"), **options) == "ok")
    return kept.select("file_path", language(F.col("file_path")).alias("language"), F.col("content").cast("string").alias("text"))


def given(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Files from memory: path to text."""
    df = spark.createDataFrame(list(files.items()), "file_path string, text string")
    return df.select("file_path", language(F.col("file_path")).alias("language"), "text")


def submitted(spark: SparkSession, code: str | None = None, files: dict[str, str] | None = None, file_path: str = "handler.ts") -> DataFrame:
    """Either one text or a map of paths to texts, as a request may hold them; both or none is an error."""
    if (code is None) == (files is None):
        raise ValueError("give either code or files")
    return given(spark, {file_path: code} if files is None else files)


def only(files: DataFrame, paths: list[str]) -> DataFrame:
    """The files of an explicit list, whose paths must stay below the root."""
    if bad := [p for p in paths if p.startswith("/") or ".." in p.split("/")]:
        raise ValueError(f"outside the root: {bad}")
    return files.join(files.sparkSession.createDataFrame([(p,) for p in paths], "file_path string"), "file_path", "left_semi")

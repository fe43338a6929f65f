"""Blobs of a git history, and the files that a branch changes."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES = 1_000_000


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def blobs(spark: SparkSession, repo: str, revisions: list[str] | None = None) -> DataFrame:
    """(blob, commit, path, ord, text): each blob once, under the first path that had it, newest commit first.

    Names come from one log; the contents are read by tasks, in batches. Blobs that are large or hold NUL are left out.
    """
    log = _git(repo, "log", *(revisions or ["-n", "1000"]), "--raw", "--no-abbrev", "--no-renames", "--format=%x00%H")
    found, commit = [], ""
    for line in log.splitlines():
        if line.startswith("\0"):
            commit = line[1:]
        elif line.startswith(":") and not line.split()[4].startswith("D"):
            found.append((line.split()[3], commit, line.split("\t", 1)[1], len(found)))
    names = spark.createDataFrame(found, "blob string, commit string, path string, ord long")
    w = Window.partitionBy("blob").orderBy("ord")
    first = names.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

    def read(batches):
        for batch in batches:
            asked = "".join(b + "\n" for b in batch["blob"]).encode()
            out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=asked, check=True, capture_output=True).stdout
            at, texts = 0, []
            for _ in range(len(batch)):
                end = out.index(b"\n", at)
                size = int(out[at:end].split()[-1])
                data = out[end + 1 : end + 1 + size]
                at = end + size + 2
                texts.append(None if size > MOST_BYTES or b"\0" in data else data.decode("utf-8", "replace"))
            yield pd.DataFrame(batch.assign(text=texts))

    return first.mapInPandas(read, "blob string, commit string, path string, ord long, text string").where("text IS NOT NULL")


def changed(spark: SparkSession, repo: str, base: str) -> DataFrame:
    """Paths that are added, copied, modified or renamed since ``base``: committed, staged or neither."""
    names = [_git(repo, "diff", "--name-only", "--diff-filter=ACMR", *a).split("\n") for a in ([f"{base}...HEAD"], ["--cached"], [])]
    parts = [spark.createDataFrame([(n,) for n in ns if n], "file_path string") for ns in names]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def base_ref(flag: str | None, env: dict[str, str], merge_base: str | None) -> str:
    """What to compare with: the flag, the pull request's base, the merge base, or the commit before."""
    for name in ("GITHUB_BASE_REF", "BUILDKITE_PULL_REQUEST_BASE_BRANCH", "CI_MERGE_REQUEST_TARGET_BRANCH_NAME"):
        if not flag and env.get(name) not in (None, "", "false"):
            return f"origin/{env[name]}"
    return flag or merge_base or "HEAD~1"

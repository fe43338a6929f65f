import itertools
import re

from pyspark.sql import functions as F

from auditlake.functions import scalars as x
from auditlake.operators import joins, ordered
from auditlake.plans import registry
from auditlake.sources import packs

from .oracle import both, views

PARTS = ["a", "b.ts", "ab", "a.b.ts", "", "a[", "x.go\n", "é.ts"]
GLOBS = [
    "a/*", "a/**", "**/b.ts", "*.ts", "**/*.b.ts", "a**/b.ts", "***/ab", "a/[!x]/ab", "a[!x]b.ts", "{a,b}/ab", "{a/b.ts,ab}", "a/?b", "a", "/a", "a/", "**", "*", "?[a-z]*", "a[/*", "[ab]/**/ab",
    "a/**/ab", "**/a/**", "*.{ts,go}", "x.go", "é.*", "**/é.ts", "{a", "a.b.*",
]


def paths():
    return ["/".join(p) for n in (1, 2, 3) for p in itertools.product(PARTS, repeat=n)]


def test_keys_lose_no_path(spark):
    rows = spark.createDataFrame([(p,) for p in paths()], "file_path string")
    keys = {r[0]: set(r[1]) for r in rows.select("file_path", x.path_keys(F.col("file_path"))).collect()}
    fits = 0
    for regex, key in [(x.glob_regex(g), x.glob_key(g)) for g in GLOBS] + [(x.ignore_regex(g)[0], x.ignore_key(g)) for g in GLOBS]:
        hits = [r[0] for r in rows.where(F.col("file_path").rlike(regex)).collect()]
        fits += len(hits)
        assert key is None or all(key in keys[p] for p in hits), regex
    assert fits > 1000 and sum(x.glob_key(g) is None for g in GLOBS) < 12


def test_keyed_patterns_as_all_pairs(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths())] + [(-1, None)], "finding_id int, file_path string")
    lines = [g for i, g in enumerate(GLOBS)] + ["!a/b.ts", "!**/ab", "!*.ts/"]
    keyed = packs.ignore_table(spark, "\n".join(lines))
    both_ways = [sorted(map(tuple, joins.ignored(rows, t).select("finding_id", "ignore_pattern").collect())) for t in (keyed, keyed.drop("key"))]
    assert both_ways[0] == both_ways[1] and len(both_ways[0]) == len(paths()) + 1
    assert joins.ignored(rows, keyed.limit(0)).where("ignore_pattern IS NOT NULL").count() == 0


def test_overrides_by_key(spark):
    rule = [("r", "p", "low", [], None, {}, [(["src/**", "*.go"], "info"), (["**/gen/*"], "high"), (["*"], "critical")], [])]
    over = packs.override_table(spark.createDataFrame(rule, packs.RULES))
    found = spark.createDataFrame([("r", "src/a/b"), ("r", "x.go"), ("r", "y/gen/z"), ("r", "top"), ("r", "y/z"), ("s", "src/a")], "rule_id string, file_path string").withColumn("severity", F.lit("low"))
    got = {(r[0], r[1]): r[2] for r in ordered.first_override(found, over).select("rule_id", "file_path", "severity").collect()}
    assert list(got[k] for k in (("r", "src/a/b"), ("r", "x.go"), ("r", "y/gen/z"), ("r", "top"), ("r", "y/z"), ("s", "src/a"))) == ["info", "info", "high", "critical", "low", "low"]


def test_many_patterns_meet_by_key(spark):
    """All lines have keys, so expressions run on rows that met by equality."""
    folder = "/root/testdata/sf0.01"
    name = "ignore_patterns_many"
    got, want = both(spark, views(folder), folder, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert got == want and sum(r[1] is not None for r in got) > 1000
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[key#\d+\], \[key#\d+\]", plan)

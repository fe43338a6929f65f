"""Secret scans over a trigram inverted index, with built-in functions only.

Each rule's expression gives a Boolean trigram query (:mod:`.trigrams`). The index holds, for the
trigrams that any query names, the postings (trigram, document). Postings are intersected per clause
by counting a clause's trigrams per document; only documents that satisfy a clause are verified with
the rule's expression. A rule without mandatory trigrams (runs of hexadecimal digits) scans all texts.

Every posting of one trigram never meets in one task: intersection groups by document. Texts stay where they are:
the candidates, a few numbers each, are written and counted, and go to the texts; only above `common.BROADCAST_ROWS` of
them are they joined by shuffling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams
from .common import beside, documents, materialize, on_row, row_keyed


@dataclass(frozen=True)
class Rule:
    """pattern: in the common syntax of Java, RE2 and Python. value: its group that has to hold
    ``least`` code points; 0 is the whole match."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("basic_auth_url", r"[a-z]{2,12}://[A-Za-z0-9._~-]{1,64}:[A-Za-z0-9._~%!-]{6,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE


def postings(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id, r1, r2): the inverted index over the trigrams that the rules' queries name."""
    words = sorted({t for r in rules for c in trigrams.query(r.pattern) or [] for t in c})
    if not words:
        return rows.select(F.lit("").alias("trigram"), "doc_id", "r1", "r2").limit(0)
    folded = rows.select("doc_id", "r1", "r2", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in words]))
    return folded.select("doc_id", "r1", "r2", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, r1, r2, kinds): the rules whose trigram query a document satisfies."""
    spark = index.sparkSession
    clauses = [(r.kind, i, len(c), t) for r in rules for i, c in enumerate(trigrams.query(r.pattern) or []) for t in sorted(c)]
    asked = spark.createDataFrame(clauses or [("", 0, 0, "")], "kind string, clause int, least int, trigram string")
    return (
        index.join(F.broadcast(asked), "trigram")  # a few rows for each rule
        .groupBy("doc_id", "r1", "r2", "kind", "clause", "least")
        .agg(F.count_distinct("trigram").alias("n"))
        .where("n = least")
        .groupBy("doc_id", "r1", "r2")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


STEP = 128


def _before(sizes: Column) -> Column:
    """Of an array of numbers, the sum of those before each: of whole steps before it, then of its own step."""
    count = F.ceil(F.size(sizes) / STEP).cast("int")
    add = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)
    every = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array().cast("array<long>"))
    steps = every(count, lambda i: add(F.slice(sizes, (i - 1) * STEP + 1, F.lit(STEP))))
    place = lambda whole: F.transform(sizes, lambda _, i: F.element_at(whole, F.floor(i / STEP).cast("int") + 1) + add(F.slice(sizes, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP)))
    return _bound(steps, lambda s: _bound(every(F.size(s), lambda i: add(F.slice(s, F.lit(1), i - 1))), place))


def _spans(rule: Rule, rank: int) -> Column:
    """Of ``text``: array of (start, rank, end) in code points. The gaps between the matches give their places."""
    pattern, text = F.lit(rule.pattern), F.col("text")
    parts = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern, F.lit(rule.value)).alias("v"),
        F.split(text, rule.pattern, -1).alias("g"),
    )
    each = F.transform(parts, lambda p: F.struct(F.char_length(p["g"]).cast("long").alias("gap"), F.coalesce(F.char_length(p["m"]), F.lit(0)).cast("long").alias("size"), F.coalesce(F.char_length(p["v"]) >= rule.least, F.lit(False)).alias("kept")))

    def placed(all_: Column) -> Column:
        at = _bound(F.transform(all_, lambda p: p["gap"] + p["size"]), _before)
        rows = lambda before: F.zip_with(all_, before, lambda p, b: F.struct((b + p["gap"]).alias("start"), F.lit(rank).alias("rank"), (b + p["gap"] + p["size"]).alias("end"), p["kept"].alias("kept")))
        found = F.filter(_bound(at, rows), lambda r: r["kept"])
        return F.transform(found, lambda r: F.struct(r["start"].alias("start"), r["rank"].alias("rank"), r["end"].alias("end")))

    return _bound(each, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): for each row of ``docs`` its secrets as (start, rank, end), sorted; rank is the rule's place.

    Matches are leftmost and do not overlap within a kind; those whose value is shorter than the rule asks
    are dropped after matching. Offsets count code points, the end is exclusive. Null text is empty and has
    no spans. Equal rows get equal results; an empty table gives none; other columns are ignored.
    """
    rows = row_keyed(documents(docs))
    found = on_row(rows, beside(materialize(candidates(postings(rows, rules), rules), "candidates")))
    none = F.expr("CAST(array() AS array<struct<start:long,rank:int,end:long>>)")
    each = []
    for rank, rule in enumerate(rules):
        if trigrams.query(rule.pattern) is not None:
            ask = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        else:  # scans fully; the cheap test spares texts without a match long enough
            ask = F.col("text").rlike(rule.pattern.removesuffix("+") + f"{{{rule.least}}}" if rule.pattern.endswith("]+") else rule.pattern)
        each.append(F.when(ask, _spans(rule, rank)).otherwise(none))
    return found.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of what :func:`scan` returns."""
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(_joined(base, rules), 256).alias("base_sha256"),
        _joined(F.col("spans"), rules).alias("spans"),
    )


def _oracle() -> str:
    """Matches and the gaps between them, as lists; a match starts after all gaps and matches before it."""
    each = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        each.append(
            f"SELECT rid, {rank} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, '{p}', 0) AS m, "
            f"regexp_extract_all(t, '{p}', {r.value}) AS v, string_split_regex(t, '{p}') AS g, {r.least} AS least FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(each)}),
b AS (SELECT rid, rank, kind, least, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i
      FROM a WHERE len(m) > 0),
c AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid, rank ORDER BY i) AS stop FROM b),
s AS (SELECT rid, rank, stop - length(m) AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS x
      FROM c WHERE length(v) >= least),
j AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
      coalesce(string_agg(x, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base, string_agg(x, ',' ORDER BY start, rank) AS spans
      FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (rid)
"""


ORACLE_SQL = _oracle()

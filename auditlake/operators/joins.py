"""The joins behind evidence, reachability and suppression.

Containment has no equi-key: its needles come from a catalog or a pattern list, whose rows are counted
before they are broadcast. All other joins are hash or sort-merge joins on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x

MOST_NEEDLES = 10_000


def few(small: DataFrame, most: int = MOST_NEEDLES) -> DataFrame:
    """Broadcast a catalog-sized table; a larger one is left to the planner."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def contains(texts: DataFrame, text: str, needles: DataFrame, needle: str, fold: bool = False) -> DataFrame:
    """Rows of both where the text contains the needle."""
    a, b = (F.lower(text), F.lower(needle)) if fold else (F.col(text), F.col(needle))
    return texts.join(few(needles), F.contains(a, b))


def header_reads(texts: DataFrame, text: str, headers: DataFrame) -> DataFrame:
    """Reads of signature headers, in their hyphen or underscore form whatever the case."""
    body = F.lower(text)
    name = F.lower("header")
    return texts.join(few(headers), F.contains(body, name) | F.contains(body, F.translate(name, "-", "_")))


def owned_reads(reads: DataFrame, headers: DataFrame, evidenced: DataFrame) -> DataFrame:
    """Of header reads (handler_id, header) the owners (handler_id, header, provider): of the providers that claim the
    header those that evidence (handler_id, provider) names, else the first to declare it.

    headers: (provider, ord, header). A read meets its header's claims only, never all handlers all claims.
    """
    claims = headers.groupBy(F.lower("header").alias("header"), "provider").agg(F.min("ord").alias("ord"))
    each = reads.select("handler_id", F.lower("header").alias("header")).distinct().join(few(claims), "header")
    known = evidenced.select("handler_id", "provider").distinct().withColumn("known", F.lit(True))
    each = each.join(known, ["handler_id", "provider"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    owner = each.groupBy("handler_id", "header").agg(F.bool_or("known").alias("any"), F.min_by("provider", "ord").alias("first"))
    both = each.join(owner, ["handler_id", "header"])
    return both.where(F.when(F.col("any"), F.col("known")).otherwise(F.col("provider") == F.col("first"))).select("handler_id", "header", "provider")


def packages(imports: DataFrame, sdk: DataFrame) -> DataFrame:
    """(file_path, provider, package): imports of a provider's packages; namespaces and module paths match as prefixes."""
    prefix = F.col("package").rlike(r"\\$|^[a-z0-9-]+(\.[a-z0-9-]+)+/")
    exact = imports.join(few(sdk.where(~prefix)), F.col("to_module") == F.col("package"))
    begins = imports.join(few(sdk.where(prefix)), F.startswith("to_module", "package"))
    return exact.unionByName(begins).select("file_path", "provider", "package").distinct()


def verify_calls(reachable: DataFrame, calls: DataFrame, sdk: DataFrame) -> DataFrame:
    """(handler_id, provider, call): reachable names that end with a provider's verify call.

    The suffixes of a name are exploded, so this is an equi-join. A bare name that was imported from
    elsewhere than a package of the provider, a relative path or the crypto module does not count.
    """
    each = reachable.withColumn("call", F.explode(x.dotted_suffixes(F.col("qualified_name"))))
    hits = each.join(few(calls), "call")
    source = F.col("import_source")
    foreign = ~F.contains("qualified_name", F.lit(".")) & source.isNotNull() & ~source.rlike(r"^[./@~]|^(node:)?crypto$")
    own = sdk.select("provider", F.col("package").alias("import_source")).distinct().withColumn("own", F.lit(True))
    hits = hits.join(few(own), ["provider", "import_source"], "left")
    return hits.where(~(F.coalesce(foreign, F.lit(False)) & F.col("own").isNull())).select("handler_id", "provider", "call").distinct()


def import_sources(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` (file_path, qualified_name, ...) with import_source, the module that the name's root was first imported from,
    and import_name, what that module calls it (where ``imports`` has a name)."""
    name = F.min_by("name", "ord") if "name" in imports.columns else F.lit(None).cast("string")
    first = imports.groupBy("file_path", F.col("local").alias("root")).agg(F.min_by("to_module", "ord").alias("import_source"), name.alias("import_name"))
    return calls.withColumn("root", F.substring_index("qualified_name", ".", 1)).join(first, ["file_path", "root"], "left").drop("root")


TRIES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", "/index.ts", "/index.js", "/__init__.py"]


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_file, to_module, to_file): relative modules by exact path with the usual endings, then any by path suffix.

    Paths are resolved once for each distinct name, and of the files that end in a path only the smallest counts, before
    anything joins: a name that very many files have, or import, is one row on either side.
    """
    relative = F.startswith("to_module", F.lit("."))
    base = F.when(relative, x.joined_path(x.dirname(F.col("from_file")), F.col("to_module"))).otherwise(F.translate(F.regexp_replace("to_module", "^@/", ""), ".", "/"))
    tries = F.posexplode(F.array(*map(F.lit, TRIES))).alias("try", "end")
    asked = imports.select("from_file", "to_module", relative.alias("relative"), base.alias("base")).distinct()
    paths = asked.groupBy("base").agg(F.bool_and("relative").alias("relative")).select("base", "relative", tries)
    paths = paths.withColumn("path", F.concat("base", "end"))
    names = files.select(F.col("file_path").alias("to_file")).distinct()
    exact = paths.join(names, F.col("path") == F.col("to_file")).groupBy("base").agg(F.min_by("to_file", "try").alias("exact"))
    tails = names.select("to_file", F.explode(_tails(F.col("to_file"))).alias("tail")).groupBy("tail").agg(F.min("to_file").alias("to_file"))
    loose = paths.where("NOT relative").join(tails, F.col("path") == F.col("tail")).groupBy("base").agg(F.min_by("to_file", "try").alias("loose"))
    found = exact.join(loose, "base", "full")
    hit = asked.join(found, "base")
    to_file = F.coalesce("exact", F.when(~F.col("relative"), F.col("loose")))
    return hit.select("from_file", "to_module", to_file.alias("to_file")).where("to_file IS NOT NULL")


def _tails(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def rules_for(handlers: DataFrame, rules: DataFrame) -> DataFrame:
    """Handlers with the rules for their framework; rules (rule_id, applies_to array, empty for all)."""
    each = rules.withColumn("f", F.explode(F.when(F.size("applies_to") == 0, F.array(F.lit("*"))).otherwise(F.col("applies_to"))))
    alias = each.where("f = 'nextjs'").withColumn("f", F.lit("remix"))
    each = each.unionByName(alias).select("rule_id", "f").distinct()
    own = handlers.withColumn("f", F.explode(F.array(F.col("framework"), F.lit("*"))))
    return own.join(few(each), "f").drop("f").distinct()


def with_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings with `baselined`, and `drifted` where the baseline has another path; the key is rule and line hash."""
    known = baseline.groupBy("rule_id", "line_hash").agg(F.max_by("file_path", "ord").alias("old_path"))
    out = findings.join(known, ["rule_id", "line_hash"], "left")
    found = F.col("old_path").isNotNull()
    return out.withColumns({"baselined": found, "drifted": found & (F.col("old_path") != F.col("file_path"))}).drop("old_path")


def new_findings(head: DataFrame, base: DataFrame) -> DataFrame:
    return head.join(base.select("line_hash").distinct(), "line_hash", "left_anti")


def fitting(paths: DataFrame, patterns: DataFrame, *on: str) -> DataFrame:
    """Rows of both, equal in ``on``, where the file_path fits the pattern's regex.

    patterns: (regex, key, ...); key: `scalars.glob_key`, which a path that fits has among its own keys, so the two meet on it and the
    expression runs on those only. Patterns without a key, or all where there is no such column, meet every path.
    """
    if "key" not in patterns.columns:
        patterns = patterns.withColumn("key", F.lit(None).cast("string"))
    each = paths.withColumn("key", F.explode(x.path_keys(F.col("file_path"))))
    keyed = each.join(few(patterns.where("key IS NOT NULL")), [*on, "key"]).where("file_path rlike regex").drop("key")
    loose = few(patterns.where("key IS NULL").drop("key"))
    loose = paths.join(loose, list(on)).where("file_path rlike regex") if on else paths.join(loose, F.expr("file_path rlike regex"))
    return keyed.unionByName(loose)


def ignored(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Findings with ignore_pattern: the last positive pattern that fits, if the last that fits at all is positive.

    patterns: (ord, pattern, regex, negated), with `key` or not, as `fitting` takes them.
    """
    paths = findings.select("file_path").distinct()
    hits = fitting(paths, patterns)
    last = hits.groupBy("file_path").agg(F.max_by("negated", "ord").alias("out"), F.max_by("pattern", F.when(~F.col("negated"), F.col("ord"))).alias("p"))
    return findings.join(last.where("NOT out").select("file_path", F.col("p").alias("ignore_pattern")), "file_path", "left")


def unused(entries: DataFrame, findings: DataFrame, on: list[str]) -> DataFrame:
    """Suppressions that no finding matched."""
    return entries.join(findings.select(*on).distinct(), on, "left_anti")


def first_commit(findings: DataFrame, blobs: DataFrame) -> DataFrame:
    """Findings in history with the commit that first had the blob."""
    w = Window.partitionBy("blob").orderBy("ord")
    first = blobs.withColumn("n", F.row_number().over(w)).where("n = 1").select("blob", "commit", "path")
    return findings.join(first, "blob", "left")


def deferred_to_queue(calls: DataFrame, consumers: DataFrame) -> DataFrame:
    """(handler_id, backend) of handlers that enqueue to a backend of which some consumer verifies.

    calls: (handler_id, qualified_name); consumers: (qualified_name, verifies).
    """
    kind = x.queue_call(F.col("qualified_name"))
    sends = calls.select("handler_id", kind.alias("q")).where("q.role = 'enqueue'").select("handler_id", "q.backend").distinct()
    takes = consumers.where("verifies").select(kind.alias("q")).where("q.role = 'consume'").select("q.backend").distinct()
    return sends.join(F.broadcast(takes), "backend", "left_semi").select("handler_id", "backend")  # four backends


def backends_met(sends: DataFrame, takes: DataFrame) -> DataFrame:
    """(handler_id, backend): sends (handler_id, qualified_name) to a backend of which some consumer (backend) verifies."""
    sent = sends.select("handler_id", x.queue_call(F.col("qualified_name"))["backend"].alias("backend")).distinct()
    return sent.join(F.broadcast(takes.select("backend").distinct()), "backend", "left_semi").select("handler_id", "backend")  # four backends


def middleware_before(handlers: DataFrame, uses: DataFrame) -> DataFrame:
    """(handler_id, name, position, ...): a file's middleware above the handler in order, numbered from 0, with what else
    ``uses`` (file_path, name, line, ...) says of it."""
    each = handlers.select("handler_id", "file_path", F.col("line").alias("at")).join(uses, "file_path").where("line < at")
    w = Window.partitionBy("handler_id").orderBy("line", "name")
    more = [c for c in uses.columns if c not in ("file_path", "name", "line")]
    return each.select("handler_id", "name", (F.row_number().over(w) - 1).alias("position"), *more)


def inside(inner: DataFrame, outer: DataFrame, size: int = 4096) -> DataFrame:
    """Range join: inner (file_path, start, end) within outer (file_path, lo, hi, ...), by pages of offsets.

    An outer range is on each page it touches, an inner one on the page of its start: an equi-join, no product.
    """
    page = lambda c: F.floor(F.col(c) / size)
    left = inner.withColumn("page", page("start"))
    right = outer.withColumn("page", F.explode(F.sequence(page("lo"), page("hi"))))
    return left.join(right, ["file_path", "page"]).where("start >= lo AND end <= hi").drop("page")


def outside(edits: DataFrame, masked: DataFrame, size: int = 4096) -> DataFrame:
    """Edits (file_path, start, end) that touch none of the masked ranges (file_path, lo, hi), by pages of offsets as `inside`."""
    pages = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    left = edits.select("file_path", "start", "end").distinct().withColumn("page", pages("start", "end"))
    right = masked.where("hi >= lo").withColumn("page", pages("lo", "hi"))
    hit = left.join(right, ["file_path", "page"]).where("start < hi AND lo < end").select("file_path", "start", "end").distinct()
    return edits.join(hit, ["file_path", "start", "end"], "left_anti").select(*edits.columns)


def with_references(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with their rule's references (rule_id, references); a rule that the pack lacks has none."""
    out = findings.join(few(rules.select("rule_id", F.col("references").alias("refs"))), "rule_id", "left")
    return out.withColumn("references", F.coalesce("refs", F.array().cast("array<string>"))).drop("refs")


def stale(findings: DataFrame, inline: DataFrame, patterns: DataFrame, baseline: DataFrame) -> DataFrame:
    """(source, detail): suppressions that no finding needs, of all three sources.

    inline: (file_path, line, comment_line, rule_ids), needed if a finding of any of its rules is on that line; patterns: as
    for `ignored`, needed if any finding's path fits, negations left out; baseline: (rule_id, line_hash).
    """
    keys = findings.select("file_path", "line", F.col("rule_id").alias("rule")).distinct().withColumn("hit", F.lit(True))
    each = inline.withColumn("rule", F.explode_outer("rule_ids")).join(keys, ["file_path", "line", "rule"], "left")
    each = each.groupBy("file_path", "comment_line", "rule_ids").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit")).where("NOT hit")
    comment = F.concat_ws(":", "file_path", F.col("comment_line").cast("string"), F.get("rule_ids", F.lit(0)))
    used = fitting(findings.select("file_path").distinct(), patterns).select("ord").distinct()
    unfit = patterns.where("NOT negated").join(used, "ord", "left_anti")
    old = unused(baseline.select("rule_id", "line_hash").distinct(), findings, ["rule_id", "line_hash"])
    source = lambda df, name, detail: df.select(F.lit(name).alias("source"), detail.alias("detail"))
    parts = source(each, "inline", comment).unionByName(source(unfit, "ignore", F.col("pattern")))
    return parts.unionByName(source(old, "baseline", F.concat_ws("|", "rule_id", "line_hash")))


def drift_notes(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(rule_id, old_path, file_path), each once: known findings whose file has another path now."""
    known = baseline.groupBy("rule_id", "line_hash").agg(F.max_by("file_path", "ord").alias("old_path"))
    return findings.join(known, ["rule_id", "line_hash"]).where("old_path <> file_path").select("rule_id", "old_path", "file_path").distinct()


def native_verify_calls(bodies: DataFrame, imports: DataFrame, calls: DataFrame, sdk: DataFrame) -> DataFrame:
    """(handler_id, provider, call): verify calls in PHP and Go handlers, which have no dotted names to follow.

    bodies: (handler_id, file_path, language, text); calls: (provider, call); sdk: (provider, package). PHP: the qualified
    name is in the text, or its class is imported and `->method(` is. Go: a package of the provider is imported and an
    exported function's `.Name(` is in the text, whatever the package's alias. Needles are a catalog's calls.
    """
    bodies = bodies.select("handler_id", "file_path", "language", "text")
    php = bodies.where("language = 'php'").join(few(calls.where(F.col("call").rlike(r"::|\\"))), _php_text("text", "call"))
    owner, method = F.substring_index("call", "::", 1), F.substring_index("call", "::", -1)
    own = imports.select("file_path", "to_module").distinct()
    named = F.contains(F.col("text"), F.ltrim(F.col("call"), F.lit("\\")))
    php = php.withColumns({"named": named, "owner": F.ltrim(owner, F.lit("\\")), "method": method})
    imported = php.where("NOT named").join(own, "file_path").where((F.col("to_module") == F.col("owner")) | F.startswith("to_module", F.concat("owner", F.lit("\\"))))
    found = php.where("named").select("handler_id", "provider", "call").unionByName(imported.select("handler_id", "provider", "call"))
    package = F.col("package").rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+/")
    gate = own.join(few(sdk.where(package)), F.startswith("to_module", "package")).select("file_path", "provider").distinct()
    exported = calls.where(~F.col("call").rlike(r"::|\\")).withColumn("name", F.substring_index("call", ".", -1)).where(F.contains("call", F.lit(".")) & F.col("name").rlike("^[A-Z]"))
    go = bodies.where("language = 'go'").join(gate, "file_path").join(few(exported), "provider").where(F.regexp_like(F.col("text"), F.concat(F.lit(r"\."), "name", F.lit(r"\s*\("))))
    svix = bodies.where("language = 'go'").join(gate.where("provider = 'standardwebhooks'"), "file_path").where(F.col("text").rlike(r"\.Verify\s*\("))
    return found.unionByName(go.select("handler_id", "provider", "call")).unionByName(svix.select("handler_id", "provider", F.lit("Verify").alias("call"))).distinct()


def _php_text(text: str, call: str) -> Column:
    """The text has the qualified name or, for a method, `->method(`."""
    method = F.concat(F.lit("->"), F.substring_index(call, "::", -1), F.lit("("))
    return F.contains(F.col(text), F.ltrim(F.col(call), F.lit("\\"))) | (F.contains(F.col(call), F.lit("::")) & F.contains(F.col(text), method))

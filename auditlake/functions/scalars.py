"""Column builders for the scalar functions that findings, handlers and reports use. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
VERDICTS = ["verified", "manual-review", "not-verified"]
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SECRET_CLASSES = {
    "signing-secret": ["whsec_"],
    "stripe-key": ["rk_", "sk_"],
    "github-token": ["ghs_", "ghp_", "gho_", "ghu_", "ghr_", "github_pat_"],
}
# method, what the receiver has to match (lower case), backend, role; the first that fits counts
QUEUE_CALLS = [
    ("add", "queue|bull|^q$", "bullmq", "enqueue"),
    ("sendMessage", "", "sqs", "enqueue"),
    ("sendMessageBatch", "", "sqs", "enqueue"),
    ("send", "inngest", "inngest", "enqueue"),
    ("produce", "", "kafka", "enqueue"),
    ("send", "producer|kafka", "kafka", "enqueue"),
    ("Worker", "", "bullmq", "consume"),
    ("process", "queue|bull|^q$", "bullmq", "consume"),
    ("consume", "", "sqs", "consume"),
    ("receiveMessage", "", "sqs", "consume"),
    ("createFunction", "inngest", "inngest", "consume"),
    ("run", "consumer|kafka", "kafka", "consume"),
    ("subscribe", "consumer|kafka", "kafka", "consume"),
]


def rank(names: list[str], c: Column) -> Column:
    """Place of a name in a list; null for other names."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), c).cast("int") - 1, F.lit(-1))


def severity_rank(c: Column) -> Column:
    return rank(SEVERITIES, c)


def at_or_above(c: Column, threshold: str) -> Column:
    return severity_rank(c) <= SEVERITIES.index(threshold)


def verdict_rank(c: Column) -> Column:
    return rank(VERDICTS, c)


def sarif_level(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SARIF_LEVELS.items() for x in kv])[c]


def normal_line(c: Column) -> Column:
    """Runs of spaces and tabs as one space, without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), r"(?U)^\s+|\s+$", "")


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def first_sentence(c: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.regexp_replace(c, r"\s+", " "), ". ", 1), r"\.$", "")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def line_hash(rule_id: Column, file_path: Column, node_kind: Column, line: Column) -> Column:
    return digest(rule_id, file_path, node_kind, normal_line(line))


def finding_id(rule_id: Column, handler_id: Column, file_path: Column, hashed: Column) -> Column:
    return digest(rule_id, F.coalesce(handler_id, F.lit("<no-handler>")), file_path, hashed)


def handler_id(file_path: Column, route: Column, methods: Column, name: Column) -> Column:
    verbs = F.array_join(F.array_sort(F.transform(methods, F.upper)), ",")
    return digest(file_path, route, verbs, F.coalesce(name, F.lit("<anonymous>")))


def suffix_of(name: Column, call: Column) -> Column:
    """The dotted name is the call or ends with a dot and the call."""
    return (name == call) | F.endswith(name, F.concat(F.lit("."), call))


def dotted_suffixes(name: Column) -> Column:
    """a.b.c: [a.b.c, b.c, c]: turns a suffix join into an equi-join."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def webhookish(route: Column) -> Column:
    return F.lower(route).rlike("webhook|/hook|interaction|discord")


def secret_class(value: Column) -> Column:
    out = F.lit("unknown")
    for name, prefixes in reversed(SECRET_CLASSES.items()):
        out = F.when(value.rlike("^(" + "|".join(prefixes) + ")"), name).otherwise(out)
    return out


def unquoted(literal: Column) -> Column:
    """A string literal of Python, PHP or JavaScript without its prefix letters and quotes."""
    bare = F.regexp_extract(literal, r"""(?s)^[A-Za-z]{0,2}("{3}|'{3}|["'`])(.*)\1$""", 2)
    return F.when(literal.rlike(r"""(?s)^[A-Za-z]{0,2}("{3}|'{3}|["'`]).*\1$"""), bare).otherwise(literal)


def is_go_module(path: Column) -> Column:
    """An import path whose first part is a host name."""
    return path.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+/")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def joined_path(folder: Column, path: Column) -> Column:
    """A relative path from a folder, without `./`; each `x/..` goes, as deep as there are any."""
    parts = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), path), "/")

    def step(kept: Column, part: Column) -> Column:
        last = F.coalesce(F.get(kept, F.size(kept) - 1), F.lit(""))
        up = (part == "..") & ~last.isin("", "..")
        return F.when(part == ".", kept).when(up, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def utf16(c: Column) -> Column:
    """Sorts as UTF-16 units do, where Spark's own order of strings is that of code points."""
    return F.encode(c, "UTF-16BE")


def agreed(matcher: Column, predicate: Column) -> Column:
    """State of a rule with a matcher, a predicate or both, which then have to agree; null where it does not fire."""
    return F.when(matcher.isNull(), predicate).when(predicate.isNull(), matcher).when(matcher == predicate, matcher)


def liveness_facet(rule_id: Column, liveness: Column) -> Column:
    """What a probe found, for rules about hard-coded secrets only."""
    return F.when(F.endswith(rule_id, F.lit("/hardcoded-secret-prefix")), liveness)


def credential(text: Column, prefixes: list[str]) -> Column:
    """Of the first prefix that occurs: it and the run of credential characters after it."""
    found = [F.nullif(F.regexp_extract(text, re.escape(p) + "[A-Za-z0-9+/=_-]+", 0), F.lit("")) for p in prefixes]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def sanitised(message: Column, limit: int = 200) -> Column:
    """An error message without credentials or urls, cut for display."""
    bare = F.regexp_replace(message, r"https?://\S+|(?:whsec|[rs]k|gh[a-z]|github_pat)_\S+", "<redacted>")
    return F.substring(bare, 1, limit)


def redacted_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9]+", "<NUMBER>")


def redacted(text: Column, prefixes: list[str]) -> Column:
    """Quoted strings by their length, or as secrets where they begin with a prefix; then numbers."""
    secret = "|".join(map(re.escape, prefixes)) or r"(?!)"
    parts = F.transform(
        F.regexp_extract_all(text, F.lit(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|[^"'`\w$]+|.)"""), F.lit(1)),
        lambda p: F.when(p.rlike(rf"""^["']({secret})"""), "<SECRET_LITERAL>")
        .when(p.rlike(r"""^(["']).*\1$""") & (F.length(p) > 1), F.concat(F.lit("<STRING:"), (F.length(p) - 2).cast("string"), F.lit(">")))
        .when(F.startswith(p, F.lit("`")) & (F.length(p) > 1), "<TEMPLATE>")
        .when(p.rlike(r"^\d"), "<NUMBER>")
        .otherwise(p),
    )
    return F.array_join(parts, "")


def queue_call(name: Column) -> Column:
    """Struct (backend, role) of a dotted call name, or null."""
    method, receiver = F.substring_index(name, ".", -1), F.lower(F.regexp_replace(name, r"\.?[^.]*$", ""))
    out = F.lit(None).cast("struct<backend:string,role:string>")
    for verb, guard, backend, role in reversed(QUEUE_CALLS):
        hit = (method == verb) & (receiver.rlike(guard) if guard else F.lit(True))
        out = F.when(hit, F.struct(F.lit(backend).alias("backend"), F.lit(role).alias("role"))).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression for Java and RE2: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            inner = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" and inner else inner) + "]", end + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(g)[1:-1] for g in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def glob_key(glob: str) -> str | None:
    """What every path that fits a glob has among its `path_keys`: the folders that the glob begins with (`d:`), else its longest
    part without wildcards (`p:`), else the ending of a part (`e:`); None if wildcards leave nothing of the kind."""
    bare = re.sub(r"\{[^}]*\}|\[[^\]]*\]", "*", glob)  # both may hold or match slashes
    parts = re.sub(r"(?<=[^/])\*\*/", "*", bare).split("/")  # `a**/b` fits `ab`: no border between the two
    whole = [p != "" and not re.search(r"[*?]", p) for p in parts]
    lead = whole.index(False) if False in whole else len(whole)
    if lead:
        return "d:" + "/".join(parts[:lead])
    if any(whole):
        return "p:" + max((p for p, w in zip(parts, whole) if w), key=len)
    ends = [m[1] for p in parts if (m := re.search(r"\.([^.*?]+)$", p))]
    return "e:" + max(ends, key=len) if ends else None


def path_keys(path: Column) -> Column:
    """Array of a path's keys, each once, for `glob_key`: what it begins with up to each border, its parts, and their endings."""
    parts = F.split(F.regexp_replace(path, "(?:\r\n|[\n\r\u0085\u2028\u2029])\\z", ""), "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    each = F.transform(parts, lambda p: F.concat(F.lit("p:"), p))
    ends = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("."))), lambda p: F.concat(F.lit("e:"), F.substring_index(p, ".", -1)))
    return F.array_distinct(F.concat(starts, each, ends))


def ignore_glob(pattern: str) -> tuple[str, bool, bool]:
    """A line of an ignore file: its glob from the root, whether it is of folders only, whether it takes back."""
    negated = pattern.startswith("!")
    p = pattern[negated:].strip()
    folder = p.endswith("/")
    p = p.rstrip("/")
    if p.startswith("/"):
        p = p[1:]
    elif "/" not in p:
        p = "**/" + p
    return p, folder, negated


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """A line of an ignore file: its expression, and whether it takes back."""
    p, folder, negated = ignore_glob(pattern)
    inner = glob_regex(p)[1:-1]
    return f"^{inner}{'/.*' if folder else '(?:/.*)?'}$", negated


def ignore_key(pattern: str) -> str | None:
    """`glob_key` of a line of an ignore file."""
    return glob_key(ignore_glob(pattern)[0])


# Rule classes with which a forged or replayed request would pass in production.
PRODUCTION_BYPASS = [
    "missing-signature-verification", "unreachable-verification", "verification-token-only", "url-validation-only", "missing-basic-auth", "missing-ip-allowlist",
    "webhook-trigger-no-authentication", "tool-callback-no-verification", "raw-body-misuse", "express-middleware-ordering", "verify-after-side-effect",
    "verification-error-swallowed", "test-mode-bypass", "agent-tool-acts-on-unverified-payload", "timing-unsafe-comparison", "missing-timing-safe-equal",
    "wrong-hmac-algorithm", "empty-secret-bypass", "signature-prefix-not-stripped", "signature-header-parse-mishandled", "header-confusion",
    "octokit-cross-attribution", "multi-signature-rotation-mishandled", "url-secret-in-path", "missing-timestamp-check", "missing-replay-defense",
    "replay-window-too-permissive",
]


def rule_class(rule_id: Column) -> Column:
    return F.substring_index(rule_id, "/", -1)


def in_production_bypass(rule_id: Column) -> Column:
    return rule_class(rule_id).isin(*PRODUCTION_BYPASS)


def after_probe(severity: Column, liveness: Column) -> Column:
    """Severity of a leaked credential once it is known to be live or dead."""
    return F.when(liveness == "live", "critical").when(liveness == "dead", "info").otherwise(severity)

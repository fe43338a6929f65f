"""Facts from source text with built-in functions.

Comments are masked first (`structure`). Imports are expressions over lines, by language; calls and most routes are brackets with a
name before them and their group after, whatever lines they stand on. A call belongs to the innermost function around it, a
handler ends where its brackets or its function do. Only the syntax check of Python files runs Python.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, webhookish
from . import structure

IMPORT = {
    "js": [r"^\s*import\s+(.*?)\s*from\s+['\"]([^'\"]+)['\"]", r"(?:const|let|var)\s+(\{[^}]*\}|\w+)\s*=\s*(?:await\s+)?(?:require|import)\(\s*['\"]([^'\"]+)['\"]"],
    "py": [r"^\s*from\s+(?<m>[\w.]+)\s+import\s+([^#]+)", r"^\s*import\s+([\w.]+)()"],
    "php": [r"^\s*use\s+()([\w\\]+)"],
    "go": [r"^\s*(?:import\s+)?(\w*)\s*\"([\w./-]+)\"\s*$"],
}
# framework, language, what a file must import (or else None), expression of the callee with the verb, only webhook paths
ROUTES = [
    ("express", "js", None, r"\.(post|put|patch|delete|all)$", True),
    ("fastapi", "py", "fastapi", r"^@[\w.]+\.(post|put|patch|delete)$", False),
    ("django", "py", None, r"^(?:re_)?path()$", False),
    ("laravel", "php", "Illuminate\\", r"^Route::(\w+)$", True),
    ("slim", "php", "Slim\\", r"^\$app->(post|put|patch|delete|get)$", True),
    ("symfony", "php", "Symfony\\", r"^#\[Route()$", False),
    ("chi", "go", "github.com/go-chi/chi", r"\.(Post|Put|Patch|Delete)$", False),
    ("gin", "go", "github.com/gin-gonic/gin", r"\.(POST|PUT|PATCH|DELETE)$", False),
    ("echo", "go", "github.com/labstack/echo", r"\.(POST|PUT|PATCH|DELETE)$", False),
    ("net/http", "go", "net/http", r"(?:^|\.)HandleFunc()$", False),
]
VERBS = "POST|PUT|PATCH|DELETE"
LITERAL = r"(?s)^\s*r?(['\"`])(.*)\1\s*$"
# what may stand before the name of a statement that is a call
STATEMENT = r"(?:^|\n)\s*(?:[A-Za-z_$][\w$]*|\?|\.|\s)*$"
# methods of workflow nodes, which the framework calls at a path of its own
NODE = ("express", "n8n-workflow", r"^\s*(?:async\s+)?webhook\s*\([^)]*\)[^;]*\{")
# PHP files without a framework are handlers if a line reads a request or signs one
PHP_FRAMEWORKS = ["Illuminate\\", "Symfony\\", "Slim\\"]
PHP_SIGNALS = r"file_get_contents\(\s*['\"]php://input|\bhash_hmac\(|\bgetallheaders\(|\$_SERVER\[\s*['\"]HTTP_\w*SIGNATURE"
# framework, expression of the path, expression of a line, group of the verb
FILE_ROUTES = [
    ("nextjs", r"(^|/)app/(.*/)?route\.(ts|tsx|js|jsx)$", r"^\s*export\s+(?:async\s+)?(?:function|const)\s+(POST|PUT|PATCH|DELETE)\b"),
    ("nextjs-pages", r"(^|/)pages/api/", r"^\s*export\s+default()"),
    ("remix", r"(^|/)app/routes/(?!(.*/)?route\.tsx?$)", r"^\s*export\s+(?:async\s+)?(?:function|const)\s+action\b()"),
    ("deno", r"\.(ts|js|mjs)$", r"^\s*Deno\.serve\(()"),
    ("cloudflare-workers", r"\.(ts|js|mjs)$", r"^\s*export\s+default\s*\{\s*(?:async\s+)?fetch()"),
]
# of files whose exported `config` has the edge runtime
EDGE = ("vercel-edge", r"^\s*export\s+(?:(?:async\s+)?(?:function|const|let|var)\s+(?:(POST|PUT|PATCH|DELETE)|handler)\b|default\s+(?:async\b|function\b|\(|\w+\s*=>))")
SUPPRESS = r"(?://|#|/\*)\s*audit-(disable-next-line|disable-line|disable|enable)\s+([\w/, -]+/[\w/, -]+)"


@dataclass
class Texts:
    """Source files taken apart: masked lines, brackets, functions (`structure`)."""

    rows: DataFrame
    toks: DataFrame
    functions: DataFrame


def texts(files: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> Texts:
    """``files`` (file_path, language, text) without what comments hide. keep: what to do with tables that are read several times."""
    plain = files.select("file_path", "language", structure.masked(F.col("text"), F.col("language")).alias("text"))
    plain = keep(plain, "masked")
    rows, toks = lines(plain), keep(structure.tokens(plain), "tokens")
    return Texts(rows, toks, keep(structure.functions(toks, rows), "functions"))


def lines(files: DataFrame) -> DataFrame:
    """(file_path, language, line, code) of (file_path, language, text), from line 1."""
    return files.select("file_path", "language", F.posexplode(F.split("text", "\r?\n", -1)).alias("p", "code")).select("file_path", "language", (F.col("p") + 1).alias("line"), "code")


def _by_language(language: Column, each: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in each.items():
        out = F.when(language == name, value).otherwise(out)
    return out


# by language: the first line of an import over several lines, its lines of names, its last line
OPEN_IMPORT = {
    "js": (r"^\s*import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{[^}]*$", r"^\s*+(?:(?:type\s++)?[\w$]++(?:\s++as\s++[\w$]++)?\s*+,?\s*+)++$", r"^[^{}'\"]*\}\s*from\s*['\"]([^'\"]+)['\"]"),
    "py": (r"^\s*from\s+([\w.]+)\s+import\s*\([^)]*$", r"^\s*+(?:\w++(?:\s++as\s++\w++)?\s*+,?\s*+)++(?:#.*)?$", r"^[^()]*\)"),
}


def _joined_imports(rows: DataFrame) -> DataFrame:
    """Imports over several lines as one line of code each, in the place of their first line."""
    of = lambda k: F.coalesce(_by_language(F.col("language"), {n: F.col("code").rlike(p[k]) for n, p in OPEN_IMPORT.items()}).cast("boolean"), F.lit(False))
    each = rows.select("file_path", "language", "line", "code", of(0).alias("opens"), of(1).alias("names"), of(2).alias("closes")).where("opens OR names OR closes")
    w = Window.partitionBy("file_path").orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"block": F.last(F.when(F.col("opens"), F.col("line")), True).over(w), "closed": F.last(F.when(F.col("closes"), F.col("line")), True).over(before)})
    each = each.where("block IS NOT NULL AND coalesce(closed, 0) < block")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda s: F.regexp_replace(s["code"], "#.*$", "")), " ")
    whole = each.groupBy("file_path", "language", "block").agg(F.bool_or("closes").alias("done"), text.alias("code")).where("done")
    code = F.when(F.col("language") == "py", F.translate("code", "()", "")).otherwise(F.col("code"))
    return whole.select("file_path", "language", F.col("block").alias("line"), code.alias("code"))


def _bound(names: Column) -> Column:
    """Array of (local, name) that a list of names binds: `b as c` and `b: c` are c of b, a name before the braces is the default."""
    kind = "array<struct<local:string,name:string>>"
    inner = F.when(F.contains(names, F.lit("{")), F.regexp_extract(names, r"\{([^}]*)\}", 1)).otherwise(names)
    inner = F.regexp_replace(inner, r"\btype\s+(?=[\w$])", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^[A-Za-z_$]"))
    own = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"([A-Za-z_$][\w$]*)\s*$", 1).alias("local"), F.regexp_extract(p, r"^([A-Za-z_$][\w$]*)", 1).alias("name")))
    outer = F.regexp_replace(names, r"\{[^}]*\}", "")
    star = F.regexp_extract(outer, r"\*\s*as\s+([\w$]+)", 1)
    first = F.regexp_extract(outer, r"^\s*([A-Za-z_$][\w$]*)", 1)
    default = F.array(F.struct(first.alias("local"), F.lit("default").alias("name")), F.struct(star.alias("local"), F.lit("*").alias("name"))).cast(kind)
    return F.concat(F.when(F.contains(names, F.lit("{")) | (star != ""), F.filter(default, lambda d: d["local"] != "")).otherwise(F.array().cast(kind)), F.when(star != "", F.array().cast(kind)).otherwise(own.cast(kind)))


def imports(rows: DataFrame) -> DataFrame:
    """(file_path, local, to_module, ord, name): a row for each name that an import binds, of one line or of several.

    name: what the module calls it, `default` for its default export, `*` for the module itself or a package.
    """
    rows = rows.select("file_path", "language", "line", "code").unionByName(_joined_imports(rows))
    found = []
    for language, patterns in IMPORT.items():
        module, names = (1, 2) if language == "py" else (2, 1)
        for p in patterns:
            p = p.replace("?<m>", "")
            value = F.struct(
                F.regexp_extract("code", p, module).alias("to_module"),
                F.regexp_extract("code", p, names).alias("names"),
                F.lit(language == "js").alias("js"),
                F.lit(language == "js" and p.startswith("^")).alias("esm"),
            )
            found.append((F.when((F.col("language") == language) & F.col("code").rlike(p), value)))
    hits = rows.where(F.col("code").rlike(r"import|require|\buse\b|^\s*\w*\s*\"")).select("file_path", "line", F.explode(F.array_compact(F.array(*found))).alias("i"))
    hits = hits.select("file_path", "line", "i.*")
    last = F.regexp_extract("to_module", r"([A-Za-z_]\w*)\W*$", 1)
    whole = F.when(F.contains("to_module", F.lit(".")) & ~F.contains("to_module", F.lit("/")), F.substring_index("to_module", ".", 1)).otherwise(last)
    esm = F.col("esm") & ~F.contains("names", F.lit("{")) & ~F.contains("names", F.lit("*"))  # `import a from`: the default
    bound = F.when(F.col("names") == "", F.array(F.struct(whole.alias("local"), F.lit("*").alias("name")))).otherwise(_bound(F.col("names")))
    bound = F.when(esm, F.transform(bound, lambda b: F.struct(b["local"].alias("local"), F.lit("default").alias("name")))).otherwise(bound)
    required = F.col("js") & ~F.col("esm") & ~F.contains("names", F.lit("{"))  # `const a = require(...)`: the module
    bound = F.when(required, F.transform(bound, lambda b: F.struct(b["local"].alias("local"), F.lit("*").alias("name")))).otherwise(bound)
    return hits.select("file_path", F.explode(bound).alias("b"), "to_module", F.col("line").alias("ord")).select("file_path", "b.local", "to_module", "ord", "b.name")


def symbols(functions: DataFrame) -> DataFrame:
    """(file_path, name, start, end, exported, real): functions by name; a method is also `Class.method`, and a file's default export also
    `default`, both with their own name as the real one.

    exported: with `export` in JavaScript, capitalised in Go, all others.
    """
    own = F.array_compact(F.array(F.col("name"), F.concat("owner", F.lit("."), "name"), F.when(F.col("default"), F.lit("default"))))
    found = functions.where("kind <> 'class'").select("file_path", F.explode(F.array_distinct(own)).alias("name"), "start", "end", "exported", F.col("name").alias("real"))
    return found


def calls(toks: DataFrame, functions: DataFrame) -> DataFrame:
    """(file_path, line, k, ord, caller, qualified_name): calls by place, each within the innermost named function around it.

    toks, functions: as `structure` returns. Definitions are no calls. `createHmac('sha256', ...)` is one of `crypto.sha256` as well.
    """
    words = F.contains("gap", F.lit("func")) | F.contains("gap", F.lit("def")) | F.contains("gap", F.lit("fn")) | F.contains("gap", F.lit("class"))  # cheaper than the expression
    defines = words & F.col("gap").rlike(r"\b(?:function|def|func|fn|class)\b[\s*&]*[\w$]*\s*(?:<[^<>()]*>)?\s*$")
    received = (F.col("language") == "go") & (F.col("prev_ch") == ")") & F.col("gap").rlike(r"^\s+\w+\s*$")
    algorithm = F.nullif(F.regexp_extract("next_gap", r"^\s*['\"](\w+)['\"]\s*$", 1), F.lit(""))
    bare = F.when(~defines & ~F.coalesce(received, F.lit(False)), F.regexp_replace(structure.callee(), r"^(@|#\[)", ""))
    each = F.transform(F.array(bare), lambda n: F.when(~n.isin(*structure.KEYWORDS), F.array_compact(F.array(n, F.when(F.endswith(n, F.lit("createHmac")) & n.rlike(r"(^|\.)createHmac$"), F.concat(F.lit("crypto."), algorithm))))))
    method = (F.col("language") == "js") & (F.col("then_ch") == "{") & F.col("then_gap").rlike(r"^\s*(?::[^=;{]*)?$")
    found = toks.where((F.col("ch") == "(") & ~F.coalesce(method, F.lit(False))).select("file_path", "line", "k", "pos", F.explode(F.flatten(each)).alias("qualified_name"))
    placed = structure.enclosing(found, functions.where("kind <> 'class'"), F.col("name"))
    return placed.select("file_path", "line", "k", F.col("pos").alias("ord"), F.coalesce("around", F.lit("<module>")).alias("caller"), "qualified_name")


def middleware(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """(file_path, name, import_source, line, preserves_raw_body): what `app.use(...)` puts before the routes below it.

    A parser whose options have a `verify` hook keeps the raw body.
    """
    used = r"\.use\((?:\s*['\"][^'\"]*['\"]\s*,)?\s*([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)"
    hits = rows.where((F.col("language") == "js") & F.col("code").rlike(used))
    hits = hits.select("file_path", "line", F.regexp_extract("code", used, 1).alias("name"), F.col("code").rlike(r"\bverify\s*[:(]").alias("preserves_raw_body"))
    source = imported.groupBy("file_path", F.col("local").alias("root")).agg(F.min_by("to_module", "ord").alias("import_source"))
    out = hits.withColumn("root", F.substring_index("name", ".", 1)).join(source, ["file_path", "root"], "left")
    return out.select("file_path", "name", "import_source", "line", "preserves_raw_body")


def _called_routes(toks: DataFrame) -> DataFrame:
    """(file_path, line, k, end_line, decorates, router, rank, framework, route, method, needs): routes that are calls with a path, over any lines."""
    name = F.col("name")
    cheap = F.col("gap").rlike(r"(?i)(?:post|put|patch|delete|all|get|route|path|HandleFunc|Route::\w+)\s*(?:<[^<>()]*>)?\s*$")
    found = toks.where((F.col("ch") == "(") & cheap).withColumn("name", structure.callee()).where("name IS NOT NULL")
    literal = F.when(F.col("next_ch").isin(",", ")"), F.regexp_extract("next_gap", LITERAL, 2))
    # calls whose value is used are no routes of JavaScript
    alone = (F.col("language") != "js") | (F.col("gap").rlike(STATEMENT) & ~F.regexp_like("gap", F.lit(r"\b(?:await|return|yield|new|throw|typeof)\b")) & (F.contains("gap", F.lit("\n")) | ~F.coalesce(F.col("prev_ch").isin("(", ",", "["), F.lit(False))))
    found = found.where(alone).withColumn("literal", literal)
    member = r"(?s)^\s*['\"]?(method|url)['\"]?\s*:\s*['\"`]([^'\"`]*)['\"`]\s*$"
    own = toks.where(F.col("ch").isin(",", "}") & F.col("gap").rlike(member)).select("file_path", F.col("group").alias("o"), F.regexp_extract("gap", member, 1).alias("key"), F.regexp_extract("gap", member, 2).alias("value"))
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value"))).alias(key)
    own = own.groupBy("file_path", "o").agg(of("method"), of("url"))
    lists = toks.where(F.col("ch").isin("[", "(") & F.col("gap").rlike(r"\bmethods\s*=\s*$")).select("file_path", F.col("group").alias("k"), F.col("k").alias("l"))
    verb = rf"^\s*['\"]({VERBS})['\"]\s*$"
    verbs = toks.where(F.col("ch").isin(",", "]", ")") & F.col("gap").rlike(verb)).select("file_path", F.col("group").alias("l"), F.col("k").alias("at"), F.regexp_extract("gap", verb, 1).alias("verb"))
    verbs = lists.join(verbs, ["file_path", "l"]).groupBy("file_path", "k").agg(F.min_by("verb", "at").alias("verb"))
    routed = F.endswith(name, F.lit(".route"))
    found = found.withColumn("o", F.when(routed & (F.col("next_ch") == "{"), F.col("k") + 1)).join(own, ["file_path", "o"], "left").join(verbs, ["file_path", "k"], "left")
    kind = lambda framework, route, method, needs: F.struct(F.lit(framework).alias("framework"), route.alias("route"), method.alias("method"), F.lit(needs).cast("string").alias("needs"))
    hits = []
    for framework, language, needs, p, gated in ROUTES:
        route = F.col("literal")
        fits = (F.col("language") == language) & name.rlike(p) & (route != "")
        fits = fits & webhookish(route) if gated else fits
        if framework == "django":  # a view by its path, in the files that map paths
            fits = fits & F.lower(route).contains("hook") & F.endswith("file_path", F.lit("urls.py")) & (F.col("next_ch") == ",")
            route = F.concat(F.lit("/"), F.ltrim(route, F.lit("/")))
        hits.append(F.when(fits, kind(framework, route, F.regexp_extract(name, p, 1), needs)))
    flask = (F.col("language") == "py") & F.startswith(name, F.lit("@")) & routed & F.col("verb").isNotNull() & webhookish(F.col("literal"))
    hits.append(F.when(flask, kind("flask", F.col("literal"), F.col("verb"), "flask")))
    fastify = (F.col("language") == "js") & routed & F.col("method").rlike(f"^({VERBS})$") & webhookish(F.col("url"))
    hits.append(F.when(fastify, kind("fastify", F.col("url"), F.col("method"), "fastify")))
    more = [name.rlike("^[@#]").alias("decorates"), F.regexp_replace(name, r"^@|\.\w+$", "").alias("router")]
    return found.select("file_path", "line", "k", "end_line", *more, F.posexplode(F.array_compact(F.array(*hits))).alias("rank", "r")).select("file_path", "line", "k", "end_line", "decorates", "router", "rank", "r.*")


def router_prefixes(toks: DataFrame) -> DataFrame:
    """(router, prefix): what `include_router(router, prefix='...')` of any file puts before a router's paths; the last one wins, by file and place."""
    calls = toks.where((F.col("language") == "py") & (F.col("ch") == "(") & F.col("gap").rlike(r"\.\s*include_router\s*$")).select("file_path", "k")
    args = structure.parts(toks.where("language = 'py' AND group_ch = '('").join(calls.select("file_path").distinct(), "file_path", "left_semi")).join(calls, ["file_path", "k"])
    named = F.col("text").rlike(r"^\w+\s*=(?!=)")
    prefix = F.nullif(F.regexp_extract("text", r"(?s)^prefix\s*=\s*[rf]?(['\"])(.*)\1$", 2), F.lit(""))
    each = args.groupBy("file_path", "k").agg(F.min_by("text", F.when(~named, F.col("index"))).alias("router"), F.max(prefix).alias("prefix"))
    return each.where("router IS NOT NULL AND prefix IS NOT NULL").groupBy("router").agg(F.max_by("prefix", F.struct("file_path", "k")).alias("prefix"))


def _class_views(toks: DataFrame, functions: DataFrame, imported: DataFrame) -> DataFrame:
    """(file_path, line, rank, framework, route, method, end_line): methods of Django's class views, at the first path that any `urls.py` gives the class."""
    maps = toks.where((F.col("language") == "py") & (F.col("ch") == "(") & F.endswith("file_path", F.lit("urls.py")))
    literal = F.regexp_extract("next_gap", LITERAL, 2)
    paths = maps.where(F.col("gap").rlike(r"(?:^|[^\w.])(?:re_)?path\s*$") & (F.col("next_ch") == ",") & (literal != "")).select("file_path", "k", F.concat(F.lit("/"), F.ltrim(literal, F.lit("/"))).alias("route"))
    view = F.regexp_extract("gap", r"^\s*([\w.]+)\.as_view\s*$", 1)
    views = maps.where((view != "") & (F.col("prev_ch") == ",") & (F.col("next_ch") == ")") & F.col("next_gap").rlike(r"^\s*$")).select("file_path", (F.col("k") - 2).alias("k"), view.alias("owner"))
    routed = paths.join(views, ["file_path", "k"]).groupBy("owner").agg(F.min_by("route", F.struct("file_path", "k")).alias("route"))
    django = imported.where(F.col("to_module").rlike(r"^django(\.|$)")).select("file_path").distinct()
    methods = functions.where((F.col("language") == "py") & (F.col("kind") == "method") & F.upper("name").rlike(f"^({VERBS})$")).join(django, "file_path", "left_semi")
    found = methods.join(routed, "owner", "left")
    return found.select("file_path", F.col("start").alias("line"), F.lit(-1).alias("rank"), F.lit("django").alias("framework"), F.coalesce("route", F.lit("/")).alias("route"), F.upper("name").alias("method"), F.col("end").alias("end_line"))


# by language, what is on the line of every other route
PLAUSIBLE = {"js": r"^\s*export\s|^\s*Deno\.|\bwebhook\s*\(", "php": r"php://input|hash_hmac\(|getallheaders\(|\$_SERVER"}


def _members(toks: DataFrame, opened: str, member: str) -> DataFrame:
    """(file_path, o, gap): members whose text fits of JavaScript's braces after text that fits, by the place of the brace."""
    opens = toks.where((F.col("language") == "js") & (F.col("ch") == "{") & F.col("gap").rlike(opened)).select("file_path", F.col("k").alias("o"))
    each = toks.where(F.col("ch").isin(",", "}") & F.col("gap").rlike(member)).select("file_path", F.col("group").alias("o"), "gap")
    return each.join(opens, ["file_path", "o"])


def _exported_routes(toks: DataFrame, functions: DataFrame) -> DataFrame:
    """(file_path, line, rank, framework, route, method, end_line): functions of an app router's file that `export { a as POST }` names;
    names that come from another module do not count."""
    framework, path, _ = FILE_ROUTES[0]
    member = rf"^\s*([\w$]+)\s+as\s+({VERBS})\s*$"
    named = _members(toks.where(F.col("file_path").rlike(path)), r"\bexport\s*$", member)
    other = toks.where((F.col("ch") == "}") & F.col("next_gap").rlike(r"^\s*from\b")).select("file_path", F.col("group").alias("o"))
    named = named.join(other, ["file_path", "o"], "left_anti").select("file_path", F.regexp_extract("gap", member, 1).alias("name"), F.regexp_extract("gap", member, 2).alias("method")).distinct()
    own = functions.where("kind = 'function'").groupBy("file_path", "name").agg(F.min("start").alias("line"), F.min_by("end", "start").alias("end_line"))
    return named.join(own, ["file_path", "name"]).select("file_path", "line", F.lit(-2).alias("rank"), F.lit(framework).alias("framework"), _file_route().alias("route"), "method", "end_line")


def _file_route() -> Column:
    """The path that a file's place gives it."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("file_path", r"^.*?(app/routes|pages|app)/", ""), r"(/route|/index)?\.\w+$", ""))


def _line_routes(rows: DataFrame, toks: DataFrame) -> DataFrame:
    """(file_path, line, rank, framework, route, method, needs): routes by a file's place or a line of it."""
    plausible = F.coalesce(_by_language(F.col("language"), {n: F.col("code").rlike(p) for n, p in PLAUSIBLE.items()}).cast("boolean"), F.lit(False))
    kind = lambda framework, route, method, needs=None: F.struct(F.lit(framework).alias("framework"), route.alias("route"), method.alias("method"), F.lit(needs).cast("string").alias("needs"))
    js, code = F.col("language") == "js", F.col("code")
    found = [F.when(js & code.rlike(NODE[2]), kind(NODE[0], F.lit("/webhook"), F.lit(""), NODE[1]))]
    for framework, path, p in FILE_ROUTES:
        found.append(F.when(js & F.col("file_path").rlike(path) & code.rlike(p), kind(framework, _file_route(), F.regexp_extract("code", p, 1))))
    found.append(F.when(js & F.coalesce("edge", F.lit(False)) & code.rlike(EDGE[1]), kind(EDGE[0], _file_route(), F.regexp_extract("code", EDGE[1], 1))))
    found.append(F.when((F.col("language") == "php") & code.rlike(PHP_SIGNALS), kind("vanilla-php", F.concat(F.lit("/"), basename(F.col("file_path"))), F.lit(""))))
    edge = _members(toks, r"\bexport\s+(?:const|let|var)\s+config\s*(?::[^=]*)?=\s*$", r"^\s*['\"]?runtime['\"]?\s*:\s*['\"]edge['\"]\s*$")
    rows = rows.where(plausible).join(edge.select("file_path", F.lit(True).alias("edge")).distinct(), "file_path", "left")
    hits = rows.select("file_path", "line", F.posexplode(F.array_compact(F.array(*found))).alias("rank", "r"))
    return hits.select("file_path", "line", (F.col("rank") + len(ROUTES) + 2).alias("rank"), "r.*")


def routes(rows: DataFrame, toks: DataFrame, functions: DataFrame, imported: DataFrame) -> DataFrame:
    """(file_path, framework, route, method, line, end_line, k): handlers, each to the end of its brackets or of its function, else up
    to the next one in its file. k: the place of the call that is one, or null.

    A FastAPI router's path follows the prefix that any file includes the router with.
    """
    called, other = _called_routes(toks), _line_routes(rows, toks)
    # a decorated function is the next one; one that a line exports begins there
    next_one = F.last("end", True).over(Window.partitionBy("file_path").orderBy(F.desc("line"), "own"))
    begun = functions.where("kind <> 'class'").groupBy("file_path", F.col("start").alias("line")).agg(F.max("end").alias("end"))
    both = called.withColumns({"own": F.lit(1), "end": F.lit(None).cast("int")}).unionByName(begun.withColumn("own", F.lit(0)), allowMissingColumns=True)
    called = both.withColumn("next_end", next_one).where("own = 1").withColumn("end_line", F.when(F.col("decorates"), F.coalesce("next_end", "end_line")).otherwise(F.col("end_line")))
    top = toks.where(F.col("ch").isin("(", "{")).groupBy("file_path", "line").agg(F.min_by("end_line", "k").alias("end_line"))
    other = other.join(begun, ["file_path", "line"], "left").join(top, ["file_path", "line"], "left").withColumn("end_line", F.coalesce("end", "end_line")).drop("end")
    prefixes = router_prefixes(toks)
    prefixed = (F.col("framework") == "fastapi") & F.col("prefix").isNotNull()
    called = called.join(prefixes, "router", "left").withColumn("route", F.when(prefixed, F.concat("prefix", "route")).otherwise(F.col("route")))
    hits = called.drop("decorates", "router", "prefix", "own", "end", "next_end").unionByName(other.withColumn("k", F.lit(None).cast("int")))
    hits = hits.unionByName(_class_views(toks, functions, imported).unionByName(_exported_routes(toks, functions)).withColumns({"needs": F.lit(None).cast("string"), "k": F.lit(None).cast("int")}))
    modules = imported.groupBy("file_path").agg(F.collect_set("to_module").alias("modules"))  # of one file
    hits = hits.join(modules, "file_path", "left").withColumn("modules", F.coalesce("modules", F.array().cast("array<string>")))
    hits = hits.where(F.col("needs").isNull() | F.exists("modules", lambda m: F.startswith(m, F.col("needs"))))
    framed = F.exists("modules", lambda m: m.rlike("^(" + "|".join(p.replace("\\", "\\\\") for p in PHP_FRAMEWORKS) + ")"))
    plain = F.col("framework") == "vanilla-php"
    hits = hits.where(~plain | ~framed)
    # hono and fastify routes look like express; the import tells
    own = F.filter("modules", lambda m: m.isin("hono", "fastify"))
    framework = F.when((F.col("framework") == "express") & (F.size(own) > 0), F.array_max(own)).otherwise(F.col("framework"))
    again = F.when(F.col("rank") == -2, F.col("method"))  # a function may be exported for several methods
    first = Window.partitionBy("file_path", F.when(plain, 0).otherwise(F.col("line")), again).orderBy("line", "rank")
    hits = hits.withColumns({"framework": framework, "n": F.row_number().over(first)}).where("n = 1")  # one of a line, or of a plain PHP file
    w = Window.partitionBy("file_path").orderBy("line")
    method = F.upper(F.when(F.col("method").isin("", "all"), "post").otherwise(F.col("method")))
    end = F.coalesce(F.when(~F.col("framework").isin("vanilla-php"), F.col("end_line")), F.lead("line").over(w) - 1, F.lit(2**31 - 1))
    return hits.select("file_path", "framework", "route", method.alias("method"), "line", end.alias("end_line"), "k")


def inline_middleware(toks: DataFrame, routes_: DataFrame, calls_: DataFrame) -> DataFrame:
    """(file_path, k, index, qualified_name): calls within the inline functions that stand between a route's path and its handler.

    routes_: (file_path, k); calls_: (file_path, k, qualified_name).
    """
    own = toks.where("group_ch = '('").join(routes_.select("file_path", F.col("k").alias("group")).distinct(), ["file_path", "group"], "left_semi")  # by group, as the windows are
    args = structure.parts(own).join(routes_.select("file_path", "k"), ["file_path", "k"]).where("index > 0 AND index < n - 1")
    heads = own.where(F.col("gap").rlike(r"=>") | ((F.col("ch") == "(") & F.col("gap").rlike(r"^\s*(?:async\s+)?function\b"))).select("file_path", F.col("group").alias("k"), F.col("k").alias("at"))
    args = args.join(heads, ["file_path", "k"]).where("at > after_k AND at <= end_k").select("file_path", "k", "index", "after_k", "end_k").distinct()
    inner = structure.within(calls_.select("file_path", "k", "qualified_name").join(args.select("file_path").distinct(), "file_path", "left_semi"), args, F.struct("k", "index"))
    return inner.where("around IS NOT NULL").select("file_path", "around.k", "around.index", "qualified_name").distinct()


# Names, and last parts of names, by which a handler hands on what it was sent.
RAW_BODY = ["req", "request", "rawbody", "rawpayload", "body", "payload"]
RAW_PARTS = ["body", "rawbody", "text", "arraybuffer", "rawbuffer", "buffer"]


def with_raw_body(toks: DataFrame, calls_: DataFrame) -> DataFrame:
    """Those of ``calls_`` (file_path, k, ...) whose arguments name the request or its body, at any depth, strings aside."""
    spans = calls_.select("file_path", F.col("k").alias("after_k")).distinct().join(structure.ends(toks).select("file_path", F.col("k").alias("after_k"), "end_k"), ["file_path", "after_k"])
    code = F.regexp_replace("gap", r"(?s)'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "")
    names = code.rlike(rf"(?i)(?<![\w$.])(?:{'|'.join(RAW_BODY)})(?![\w$])|\.\s*(?:{'|'.join(RAW_PARTS)})(?![\w$])")
    hits = structure.within(toks.join(spans.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "k", names.alias("names")), spans, F.struct(F.col("after_k").alias("call")))
    hits = hits.where("names AND around IS NOT NULL").select("file_path", F.col("around.call").alias("k")).distinct()
    return calls_.join(hits, ["file_path", "k"], "left_semi")


def callbacks(toks: DataFrame, outer: DataFrame, calls_: DataFrame) -> DataFrame:
    """``calls_`` (file_path, k, ...) that stand within the arguments of one of ``outer`` (file_path, k), with `around`: that one's place."""
    spans = outer.select("file_path", F.col("k").alias("after_k")).distinct().join(structure.ends(toks).select("file_path", F.col("k").alias("after_k"), "end_k"), ["file_path", "after_k"])
    inner = structure.within(calls_.join(spans.select("file_path").distinct(), "file_path", "left_semi"), spans, F.struct(F.col("after_k").alias("k")))
    return inner.where("around IS NOT NULL").withColumn("around", F.col("around.k"))


def delegates(toks: DataFrame, calls_: DataFrame) -> DataFrame:
    """``calls_`` (file_path, k, import_source, ...) of imported functions whose first argument is the request itself."""
    first = toks.where((F.col("ch") == "(") & F.col("next_ch").isin(",", ")") & F.col("next_gap").rlike(r"^\s*(?:req|request)\s*$")).select("file_path", "k")
    return calls_.where("import_source IS NOT NULL").join(first, ["file_path", "k"], "left_semi")


def placed(rows: DataFrame, handlers: DataFrame) -> DataFrame:
    """``rows`` (file_path, line, ...) with handler_id: the handler (handler_id, file_path, line, end_line) that a line is in, or null.

    A handler begins at one line, so it joins that line alone; a window hands it on to the lines below.
    """
    begins = handlers.select("file_path", "line", F.struct("handler_id", "end_line").alias("h"))
    w = Window.partitionBy("file_path").orderBy("line")
    out = rows.join(begins, ["file_path", "line"], "left").withColumn("h", F.last("h", True).over(w))
    return out.withColumn("handler_id", F.when(F.col("line") <= F.col("h.end_line"), F.col("h.handler_id"))).drop("h")


def suppressions(rows: DataFrame) -> DataFrame:
    """(file_path, rule_id, line, form) of suppression comments; ids have a slash."""
    hit = rows.where(F.col("code").rlike(SUPPRESS))
    form = F.regexp_replace(F.regexp_extract("code", SUPPRESS, 1), "^disable-(next-line|line)$", "$1")
    ids = F.regexp_extract_all(F.regexp_extract("code", SUPPRESS, 2), F.lit(r"([\w-]+/[\w-]+)"), F.lit(1))
    return hit.select("file_path", F.explode(ids).alias("rule_id"), "line", form.alias("form"))


def parse_errors(files: DataFrame) -> DataFrame:
    """(file_path, message, line) of Python files that do not parse; no rules run on them."""
    kind = "struct<message:string,line:int>"

    def check(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            try:
                ast.parse(t or "")
                out.append((None, None))
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                out.append((str(getattr(e, "msg", e)), getattr(e, "lineno", None)))
        return pd.DataFrame(out, columns=["message", "line"]).astype({"line": "Int32"})

    bad = files.where("language = 'py'").select("file_path", F.pandas_udf(check, kind)("text").alias("e"))
    return bad.where("e.message IS NOT NULL").select("file_path", "e.message", "e.line")

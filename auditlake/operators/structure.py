"""Structure of source text without a parser: what comments hide, which brackets match, where functions end.

A text is cut at brackets, commas and semicolons that stand outside strings and comments; the pieces are rows. A running
sum over a file's pieces gives depth; the pieces of one depth, in order, begin anew with each opening bracket, which finds
the bracket around each piece, and a closing bracket is a row of the group that it ends; a small helper does so for a
batch of files in NumPy, since windows sorted every piece twice. Calls, arguments, object members and bodies are then
joins on a group, whatever lines they stand on. Python's blocks end at the next line that is not indented further: a
window by file and indent. All else runs in the JVM.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SINGLE, _DOUBLE, _BACK = r"'(?:[^'\\\n]++|\\.)*+'", r'"(?:[^"\\\n]++|\\.)*+"', r"`(?:[^`\\]++|\\.)*+`"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
# a slash opens a regular expression where no value can have ended
_SLASHED = r"(?<=[(,=:!&|?;\[{}]\s{0,4})/(?![*/])(?:[^/\\\n\[]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-z]*+"
_TRIPLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+(?:"""|\z)|' + r"'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\z)"
COMMENTS = {"js": rf"//[^\n]*+|{_BLOCK}", "go": rf"//[^\n]*+|{_BLOCK}", "php": rf"//[^\n]*+|#(?!\[)[^\n]*+|{_BLOCK}", "py": rf"#[^\n]*+|{_TRIPLE}"}
STRINGS = {"js": f"{_SINGLE}|{_DOUBLE}|{_BACK}|{_SLASHED}", "go": f"{_SINGLE}|{_DOUBLE}|{_BACK}", "php": "'(?:[^'\\\\]++|\\\\.)*+'|\"(?:[^\"\\\\]++|\\\\.)*+\"", "py": f"{_SINGLE}|{_DOUBLE}"}
_MARK = "\u0001"
NAME = r"((?:[A-Za-z_$\\][\w$]*+)(?:\s*(?:\?\.|\.|->|::|\\)\s*[A-Za-z_$][\w$]*+)*+)(?:<[^<>()]*>)?\s*$"
KEYWORDS = ["if", "for", "foreach", "while", "switch", "match", "catch", "function", "fn", "return", "def", "func", "elif", "elseif", "and", "or", "not", "in", "print", "require", "require_once", "include", "import", "array", "isset", "empty", "class", "with", "await", "async", "new", "typeof", "yield", "lambda", "assert", "except", "do", "else", "constructor", "super"]


def _by_language(language: Column, each: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for name, value in each.items():
        out = F.when(language == name, value).otherwise(out)
    return out


def masked(text: Column, language: Column) -> Column:
    """The text with comments and docstrings as spaces: lines and places stay, strings too. Whichever opens first wins."""
    plain = F.translate(text, _MARK, " ")
    marked = _by_language(language, {k: F.regexp_replace(plain, f"(?s){c}|{STRINGS[k]}", f"{_MARK}$0{_MARK}") for k, c in COMMENTS.items()}, plain)
    blank = lambda s, i: F.when((i % 2 == 1) & s.rlike(r"^(?://|/\*|#|\"\"\"|''')"), F.regexp_replace(s, r"[^\r\n]", " ")).otherwise(s)
    hides = text.rlike(r"//|/\*|#|\"\"\"|'''")
    return F.when(hides, F.array_join(F.transform(F.split(marked, _MARK, -1), blank), "")).otherwise(text)


TOKENS = (
    "file_path string, language string, k int, ch string, gap string, line int, pos long, group int, group_ch string, prev_ch string, prev_gap string, next_ch string, next_gap string, "
    "end_k int, end_line int, end_pos long, then_ch string, then_gap string, "
    "body_k int, body_ch string, body_line int, body_pos long, body_end_k int, body_end_line int, body_end_pos long"
)
FILES = 1000


def tokens(files: DataFrame) -> DataFrame:
    """(file_path, language, k, ch, gap, line, pos, group, group_ch, prev_ch, prev_gap, next_ch, next_gap, end_k, end_line, end_pos, then_ch, then_gap,
    body_k, body_ch, body_line, body_pos, body_end_k, body_end_line, body_end_pos): the brackets, commas and semicolons of masked texts (file_path, language, text), each with the text before it.

    k: place among a file's; pos: offset in code points; group, group_ch: k and kind of the innermost bracket around it, for a closing
    bracket of the one it closes, null outside all. prev_gap is there after `[`, next_gap after parentheses and what closes. end_k,
    end_line, end_pos, then_ch, then_gap: of an opening bracket, where its group ends, and what comes after it. body_*: of a parenthesis
    that opens, the next brace or semicolon beside it, and where that brace's group ends; Python has none.
    """
    def cut(language: str) -> Column:
        return F.regexp_extract_all("text", F.lit(rf"(?s)(?:{STRINGS[language]}|[^()\[\]{{}},;'\"`/]++|['\"`/])*+(?:[()\[\]{{}},;]|\z)"), F.lit(0))

    def placed(part: pa.RecordBatch) -> pa.RecordBatch:
        """The pieces of some files, a row each; sums and matching brackets of all files at once."""
        lists = part.column("p")
        size, pieces = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        n, of = len(pieces), np.repeat(np.arange(len(size)), size)
        first, i = np.repeat(np.cumsum(size) - size, size), np.arange(n)

        def running(each: np.ndarray) -> np.ndarray:
            sums = np.cumsum(each, dtype=np.int64)
            return sums - (sums - each)[first]

        def taken(values: pa.Array, at: np.ndarray, ok: np.ndarray) -> pa.Array:
            return values.take(pa.array(at, mask=~ok))

        length, breaks = (f(pieces).to_numpy(zero_copy_only=False) for f in (pc.utf8_length, lambda p: pc.count_substring(p, "\n")))
        ch, gap = pc.utf8_slice_codeunits(pieces, -1), pc.utf8_slice_codeunits(pieces, 0, -1)
        opens, closes = (pc.is_in(ch, pa.array(list(x))).to_numpy(zero_copy_only=False) for x in ("([{", ")]}"))
        pos, line, depth = running(length) - 1, running(breaks) + 1, running(opens.astype(np.int64) - closes)
        # an opening bracket begins a group at its depth and is itself within the group around it
        level = depth - opens + closes
        begun = np.nonzero(opens)[0]
        base = level.min(initial=0)
        width = depth.max(initial=0) - base + 2
        key = np.concatenate([of[begun] * width + depth[begun] - base, of * width + level - base])
        token, begins = np.concatenate([begun, i]), np.arange(len(begun) + n) < len(begun)
        order = np.lexsort((token, key))
        last = np.maximum.accumulate(np.where(begins[order], np.arange(len(order)), -1))
        around = np.full(n, -1, np.int64)
        known = (last >= 0) & ~begins[order]
        known[known] = key[order[last[known]]] == key[order[known]]
        around[token[order[known]]] = token[order[last[known]]]
        around[level <= 0] = -1
        inside = around >= 0
        end = np.full(n, -1, np.int64)
        shut = np.nonzero(closes & inside)[0]
        end[around[shut]] = shut
        ended = end >= 0
        # the next brace or semicolon of the same group
        beside = of * (n + 1) + around + 1
        order = np.argsort(beside, kind="stable")
        stops = pc.is_in(ch, pa.array(["{", ";"])).to_numpy(zero_copy_only=False)[order]
        later = np.append(np.minimum.accumulate(np.where(stops, i, n)[::-1])[::-1][1:], n)[:n]
        there = later < n
        there[there] = beside[order[later[there]]] == beside[order[there]]
        body = np.full(n, -1, np.int64)
        body[order[there]] = order[later[there]]
        heads = pc.and_(pc.equal(ch, "("), pc.not_equal(part.column("language").take(pa.array(of)), "py")).fill_null(False).to_numpy(zero_copy_only=False)
        has_body = (body >= 0) & heads
        body_ended = has_body & (end[body] >= 0) if n else has_body
        before, after = i > first, np.append(of[1:] == of[:-1], False)[:n]
        kind = lambda x: pc.is_in(ch, pa.array(list(x))).to_numpy(zero_copy_only=False)
        k = i - first
        prev_ch, next_ch = taken(ch, i - 1, before), taken(ch, i + 1, after)
        prev_gap = taken(gap, i - 1, before & np.append(False, kind("[")[:-1])[:n])
        next_gap = taken(gap, i + 1, after & kind("()]}"))
        number = lambda x, to, ok=None: pa.array(x.astype(to), mask=None if ok is None else ~ok)
        found = [part.column("file_path").take(pa.array(of)), part.column("language").take(pa.array(of)), number(k, np.int32), ch, gap, number(line, np.int32), number(pos, np.int64)]
        found += [number(k[around] if n else k, np.int32, inside), taken(ch, around, inside), prev_ch, prev_gap, next_ch, next_gap]
        found += [number(x[end] if n else x, to, ended) for x, to in ((k, np.int32), (line, np.int32), (pos, np.int64))] + [taken(next_ch, end, ended), taken(next_gap, end, ended)]
        found += [number(k[body] if n else k, np.int32, has_body), taken(ch, body, has_body), number(line[body] if n else line, np.int32, has_body), number(pos[body] if n else pos, np.int64, has_body)]
        found += [number(x[end[body]] if n else x, to, body_ended) for x, to in ((k, np.int32), (line, np.int32), (pos, np.int64))]
        return pa.RecordBatch.from_arrays(found, names=names)

    def each_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (placed(batch.slice(at, most)) for batch in batches for at in range(0, batch.num_rows, most))

    names, most = [c.split()[0] for c in TOKENS.split(", ")], FILES
    none = F.array().cast("array<string>")
    pieces = _by_language(F.col("language"), {k: cut(k) for k in STRINGS}, none)
    # whole files are dealt out, once: what follows is within a file
    dealt = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_path")
    each = dealt.select("file_path", "language", F.coalesce(pieces, none).alias("p"))
    return each.select("file_path", "language", F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))).alias("p")).mapInArrow(each_batch, TOKENS)


def ends(toks: DataFrame) -> DataFrame:
    """(file_path, k, end_k, end_line, end_pos, then_ch, then_gap): where each opening bracket's group ends, and what comes after it."""
    return toks.where("end_k IS NOT NULL").select("file_path", "k", "end_k", "end_line", "end_pos", "then_ch", "then_gap")


def callee() -> Column:
    """What stands before an opening parenthesis as a dotted name; `@` of a decorator and `#[` of an attribute stay in front."""
    name = F.regexp_replace(F.regexp_extract("gap", NAME, 1), r"\s+|\?(?=\.)", "")
    mark = F.when(F.col("gap").rlike(r"@\s*[\w.]+\s*$"), "@").when((F.col("prev_ch") == "[") & F.col("prev_gap").rlike(r"#\s*$"), "#[").otherwise("")
    return F.when((F.col("ch") == "(") & (name != ""), F.concat(mark, name))


DEFINES = {
    "js": r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)?\s*(?:<[^<>()]*>)?\s*$|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\s*\*?\s*\w*\s*)?(?:<[^<>()]*>)?\s*$",
    "php": r"\bfunction\s+&?(\w+)\s*$()",
    "go": r"\bfunc\s+(\w+)\s*(?:\[[^\]]*\])?\s*$()",
    "py": r"\bdef\s+(\w+)\s*(?:\[[^\]]*\])?\s*$()",
}
_ARROW = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?[\w$]+\s*=>\s*$"
_CLASS = r"\bclass\s+([A-Za-z_$][\w$]*)[^;]*$"
_METHOD = r"(?:^|[\s;}*#])([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\s*$"
_EXPORTED = r"\bexport\b[^;\n]*$"


def functions(toks: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_path, language, name, owner, kind, start, start_pos, end, end_pos, exported, default): functions, methods and classes with their extent.

    owner: the class that a method stands in. toks: as `tokens` returns; rows: masked lines (file_path, language, line, code). A
    definition without a body ends with its own line.
    """
    braces = _braced(toks.where("language <> 'py'"))
    return braces.unionByName(_indented(toks.where("language = 'py'"), rows.where("language = 'py'")))


def _braced(toks: DataFrame) -> DataFrame:
    opens, brace = F.col("ch") == "(", F.col("ch") == "{"
    js, go = F.col("language") == "js", F.col("language") == "go"
    some = lambda p, i: F.nullif(F.regexp_extract("gap", p, i), F.lit(""))
    # most gaps have none of the words that the expressions need: those are looked for first
    has = lambda *words: functools.reduce(Column.__or__, [F.contains("gap", F.lit(w)) for w in words])
    found = F.when(opens & has("func", "const", "let", "var"), _by_language(F.col("language"), {k: F.coalesce(some(p, 1), some(p, 2)) for k, p in DEFINES.items() if k != "py"}, F.lit(None).cast("string")))
    default = js & has("default") & F.col("gap").rlike(r"\bexport\s+default\s+(?:async\s+)?function\s*\*?\s*$")
    # a receiver stands between `func` and the method's name
    received = go & (F.col("prev_ch") == ")") & F.col("gap").rlike(r"^\s+\w+\s*$")
    arrow, class_ = F.when(brace & js & has("=>"), some(_ARROW, 1)), F.when(brace & ~go & has("class"), some(_CLASS, 1))
    define = lambda f: F.struct(
        F.when(opens, F.when(f.isNotNull(), f).when(default, "default").when(received, F.trim("gap"))).otherwise(arrow).alias("name"), class_.alias("class"), F.when(opens & js & f.isNull(), some(_METHOD, 1)).alias("method"),
        (js & has("export") & F.col("gap").rlike(_EXPORTED)).alias("exported"), (js & has("default") & F.col("gap").rlike(r"\bexport\s+default\b[^;\n]*$")).alias("default"),
    )
    here = F.struct("k", "ch", "line", "pos", "end_line", "end_pos")
    nxt = F.struct(*[F.col(f"body_{c}").alias(c) for c in ("k", "ch", "line", "pos", "end_line", "end_pos")])
    # each expression once: what is exploded is not computed again by the filters that follow
    each = toks.where(brace | opens).select("file_path", "language", "k", "line", "pos", "group", F.when(brace, here).otherwise(nxt).alias("body"), F.explode(F.transform(F.array(found), define)).alias("d"))
    method = F.when((F.col("body.ch") == "{") & ~F.col("d.method").isin(*[k for k in KEYWORDS if k != "constructor"]), F.col("d.method"))
    each = each.withColumn("own", method).where("d.name IS NOT NULL OR d.class IS NOT NULL OR own IS NOT NULL")
    # a class is also a row of the group that its brace opens
    member = F.struct("group", F.lit(False).alias("opener"))
    each = each.withColumn("m", F.explode(F.when(F.col("d.class").isNotNull(), F.array(member, F.struct(F.col("k").alias("group"), F.lit(True).alias("opener")))).otherwise(F.array(member))))
    each = each.withColumn("owner", F.max(F.when(F.col("m.opener"), F.col("d.class"))).over(Window.partitionBy("file_path", "m.group"))).where("NOT m.opener")
    closed = lambda c: F.when(F.col("body.ch") == "{", F.col(f"body.{c}"))
    each = each.withColumns({"end_line": closed("end_line"), "end_pos": closed("end_pos")}).select("*", "d.*")
    named = F.coalesce("name", "class", F.when(F.col("owner").isNotNull(), F.col("own")))
    kind = F.when(F.col("class").isNotNull() & F.col("name").isNull(), "class").when(F.col("owner").isNotNull(), "method").otherwise("function")
    exported = F.when(js, F.col("exported")).when(go, named.rlike("^[A-Z]")).otherwise(True)
    short = F.when(F.col("body.ch") == ";", F.col("body.pos"))
    return each.where(named.isNotNull()).select(
        "file_path", "language", named.alias("name"), "owner", kind.alias("kind"), F.col("line").alias("start"), F.col("pos").alias("start_pos"),
        F.coalesce("end_line", F.when(short.isNotNull(), F.col("body.line")), "line").alias("end"), F.coalesce("end_pos", short, "pos").alias("end_pos"), exported.alias("exported"), F.col("default"),
    )


END = 2**31 - 1


def _indented(toks: DataFrame, rows: DataFrame) -> DataFrame:
    """Python: a definition ends before the next line that is not indented further, lines within brackets aside."""
    spans = toks.where(F.col("group").isNull() & (F.col("end_line") > F.col("line"))).select("file_path", "line", "end_line")
    head = r"^\s*(?:async\s+)?(def|class)\s+(\w+)"
    indent = F.char_length(F.regexp_extract(F.replace("code", F.lit("\t"), F.lit(" " * 8)), "^( *)", 1))
    code = rows.where(F.col("code").rlike(r"\S")).select("file_path", "language", "line", F.lit(0).alias("step"), indent.alias("indent"), F.regexp_extract("code", head, 1).alias("what"), F.regexp_extract("code", head, 2).alias("name"))
    # where lines begin and cease to be within brackets; one exchange by file serves this and the windows that follow, and no code is in it
    step = lambda line, n: F.struct(line.cast("int").alias("line"), F.lit(n).alias("step"))
    marks = spans.select("file_path", F.explode(F.array(step(F.col("line") + 1, 1), step(F.col("end_line") + 1, -1))).alias("m")).select("file_path", "m.*")
    depth = F.sum("step").over(Window.partitionBy("file_path").orderBy("line", F.abs("step").desc()).rowsBetween(Window.unboundedPreceding, 0))
    code = code.unionByName(marks, allowMissingColumns=True).withColumn("depth", depth).where("step = 0 AND depth = 0").drop("step", "depth")
    every = Window.partitionBy("file_path")
    code = code.withColumns({"levels": F.collect_set(F.when(F.col("name") != "", F.col("indent"))).over(every), "last": F.max("line").over(every)})  # few, of one file
    # a line ends the definitions of its own and of deeper levels
    ended = code.withColumn("level", F.explode(F.filter("levels", lambda i: i >= F.col("indent"))))
    following = F.lead("line").over(Window.partitionBy("file_path", "level").orderBy("line"))
    found = ended.withColumn("following", following).where("name <> '' AND level = indent")
    found = found.select("file_path", "language", "name", "what", F.col("line").alias("start"), F.lit(-1).alias("start_pos"), F.coalesce(F.col("following") - 1, "last").cast("int").alias("end"), F.lit(END).alias("end_pos"))
    # each definition is a span and, just before it, a point
    what = F.struct("what", "name")
    own = found.select(what.alias("around")).schema["around"].dataType
    point = _step(F.col("start"), F.lit(-2), 0, F.lit(None).cast(own))
    around = _innermost(found.withColumn("e", F.explode(F.array(*_edges(what, own), point))).select("*", "e.*"))
    owner = F.when(F.col("around.what") == "class", F.col("around.name"))
    kind = F.when(F.col("what") == "class", "class").when(owner.isNotNull(), "method").otherwise("function")
    return around.select("file_path", "language", "name", owner.alias("owner"), kind.alias("kind"), "start", "start_pos", "end", "end_pos", F.lit(True).alias("exported"), F.lit(False).alias("default"))


def enclosing(points: DataFrame, spans: DataFrame, what: Column) -> DataFrame:
    """``points`` (file_path, line, pos, ...) with `around`: ``what`` of the innermost span around each, or null.

    spans: (file_path, start, start_pos, end, end_pos, ...), one within the other or apart. Running sums of beginnings and ends
    give each point's depth; the last span that began at a depth is the one around the points of it.
    """
    # the file stands beside the point, not in it again: a union whose parts agree on their files needs no exchange
    point = F.struct(*[F.col(f"`{c}`") for c in points.columns if c != "file_path"])
    none, own = points.select(point.alias("point")).schema["point"].dataType, spans.select(what.alias("around")).schema["around"].dataType
    edges = spans.select("file_path", F.explode(F.array(*_edges(what, own))).alias("e")).select("file_path", "e.*", F.lit(None).cast(none).alias("point"))
    asked = points.select("file_path", _step(F.col("line"), F.col("pos"), 0, F.lit(None).cast(own)).alias("e"), point.alias("point")).select("file_path", "e.*", "point")
    return _innermost(edges.unionByName(asked)).select(*["file_path" if c == "file_path" else f"point.`{c}`" for c in points.columns], "around")


def _step(l: Column, p: Column, step: int, around: Column) -> Column:
    return F.struct(l.cast("long").alias("l"), p.cast("long").alias("p"), F.lit(step).alias("step"), around.alias("around"))


def _edges(what: Column, own) -> list[Column]:
    """Where a span begins and ends."""
    return [_step(F.col("start"), F.col("start_pos"), 1, what), _step(F.col("end"), F.col("end_pos"), -1, F.lit(None).cast(own))]


def _innermost(every: DataFrame) -> DataFrame:
    """The points among ``every`` (file_path, l, p, step, around, ...) with what is around them; a span's beginning has 1 as step, its end -1, a point 0."""
    order = ["l", "p", F.desc("step")]
    before = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("depth", F.sum("step").over(before("file_path")))
    around = F.last("around", True).over(before("file_path", "depth"))
    return every.withColumn("around", F.when(F.col("depth") > 0, around)).where("step = 0")


def parts(toks: DataFrame) -> DataFrame:
    """(file_path, k, index, n, after_k, end_k, text): what the commas of a group part, such as the arguments of a call, in order from 0.

    k: of the opening bracket; n: how many; the part's tokens are those with after_k < k <= end_k; text: null where it has brackets.
    """
    closes = F.col("ch").isin(")", "]", "}")
    w = Window.partitionBy("file_path", "group").orderBy("k")
    each = toks.where((closes | (F.col("ch") == ",")) & F.col("group").isNotNull()).withColumn("after_k", F.coalesce(F.lag("k").over(w), "group"))
    text = F.when(F.col("k") == F.col("after_k") + 1, F.btrim("gap", F.lit(" \t\n\x0b\f\r")))
    each = each.withColumn("text", text).where(~(closes & F.coalesce(F.col("text") == "", F.lit(False))))  # none, or a trailing comma
    every = Window.partitionBy("file_path", "group")
    return each.select(
        "file_path", F.col("group").alias("k"), (F.row_number().over(w) - 1).alias("index"), F.count("*").over(every).cast("int").alias("n"), "after_k", F.col("k").alias("end_k"), "text"
    )


def within(points: DataFrame, spans: DataFrame, what: Column) -> DataFrame:
    """`enclosing` by place among a file's tokens: points (file_path, k, ...) in spans (file_path, after_k, end_k, ...) with after_k < k <= end_k."""
    at = points.withColumns({"line": F.lit(0), "pos": 2 * F.col("k")}) if "line" not in points.columns else points.withColumns({"_line": F.col("line"), "line": F.lit(0), "pos": 2 * F.col("k")})
    spans = spans.withColumns({"start": F.lit(0), "start_pos": 2 * F.col("after_k") + 1, "end": F.lit(0), "end_pos": 2 * F.col("end_k")})
    found = enclosing(at, spans, what).drop("pos", "line")
    return found.withColumnRenamed("_line", "line") if "_line" in found.columns else found


def scopes(toks: DataFrame) -> DataFrame:
    """(file_path, k, after_k, end_k): bodies of functions of any kind, by the bracket that opens them; of an arrow without braces, by its first token."""
    ending = F.when(F.col("ch").isin(",", ";", ")", "]", "}"), F.col("k"))
    w = Window.partitionBy("file_path", "group").orderBy(F.desc("k"))
    short = toks.withColumn("end_k", F.last(ending, True).over(w)).where(F.col("gap").rlike(r"=>\s*[^\s{]") | (F.col("gap").rlike(r"=>\s*$") & F.col("ch").isin("(", "[")))
    short = short.where("end_k IS NOT NULL").select("file_path", "k", (F.col("k") - 1).alias("after_k"), "end_k")
    return blocks(toks).select("file_path", "k", F.col("k").alias("after_k"), "end_k").unionByName(short)


def blocks(toks: DataFrame) -> DataFrame:
    """(file_path, line, group, k, end_k): bodies of functions of any kind in braces, by the brace; line: the brace's."""
    arrow = (F.col("ch") == "{") & F.col("gap").rlike(r"=>\s*$")
    name = F.regexp_extract("gap", r"([\w$]+)\s*$", 1)
    head = (F.col("ch") == "(") & (F.col("then_ch") == "{") & F.col("then_gap").rlike(r"^\s*(?::[^=;{]*)?$") & (F.col("gap").rlike(r"\bfunction\b[\s*\w$]*$") | ~name.isin("", *KEYWORDS))
    # the brace that comes after a parenthesis is the next one beside it
    at = lambda line, k, end: F.struct(F.col(line).alias("line"), F.col(k).alias("k"), F.col(end).alias("end_k"))
    found = toks.select("file_path", "group", F.explode(F.array_compact(F.array(F.when(arrow, at("line", "k", "end_k")).when(head, at("body_line", "body_k", "body_end_k"))))).alias("b"))
    return found.where("b.end_k IS NOT NULL").select("file_path", "b.line", "group", "b.k", "b.end_k")


def last_bodies(toks: DataFrame, calls: DataFrame) -> DataFrame:
    """(file_path, k, body_k, end_k) of calls (file_path, k) whose last function argument has a body in braces."""
    found = blocks(toks).withColumnRenamed("k", "body_k").join(calls.select("file_path", F.col("k").alias("group")), ["file_path", "group"])
    return found.groupBy("file_path", F.col("group").alias("k")).agg(F.max("body_k").alias("body_k"), F.max_by("end_k", "body_k").alias("end_k"))


_ANSWERS = r"\.(?:json|send|end|status)\s*$"


def statements(toks: DataFrame, bodies: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """(file_path, body_k, statement, ord, name, tested, returns): calls of a body's own statements, numbered from 0, and where a statement has none one row without
    a name.

    bodies: (file_path, body_k, end_k). Calls in functions within the body belong to those. tested: the call is in the test of an `if`
    that is the statement; returns: the statement is an `if` that answers or returns at once. keep: what to do with tables that are
    read several times.
    """
    fresh = F.coalesce(F.col("prev_ch").isin(";", "{"), F.lit(True)) & ~F.col("gap").rlike(r"^\s*(?:else|catch|finally)\b")
    broken = F.col("prev_ch").isin(")", "}", "]") & F.col("gap").rlike(r"^[ \t]*\r?\n\s*(?!(?:else|catch|finally|instanceof|in)\b)[\w$@({\[]")
    block = (F.col("prev_ch") == "}") & F.col("gap").rlike(r"^[ \t]*(?!(?:else|catch|finally|while)\b)[A-Za-z_$][\w$]*\b(?![ \t]*[=:])")
    tests = (F.col("ch") == "(") & F.col("gap").rlike(r"(?:^|\s)if\s*$")
    # what the windows carry are answers, not texts; the end of a test is there only for what may be one
    test = F.when(tests, F.struct(F.col("end_k").alias("test_end"), "then_ch", "then_gap"))
    points = toks.select("file_path", "k", "group", (F.col("ch") == "}").alias("shuts"), (fresh | broken | block).alias("starts"), ((F.col("ch") == ";") & F.col("gap").rlike(r"^\s*$")).alias("bare"), test.alias("test"), callee().alias("name"))
    mine = within(points, bodies.withColumn("after_k", F.col("body_k")), F.struct("body_k")).where("around IS NOT NULL").withColumn("body_k", F.col("around.body_k"))
    own = F.col("group") == F.col("body_k")
    mine = mine.where(~(F.col("shuts") & F.coalesce(own, F.lit(False)))).withColumn("starts", F.coalesce(own & F.col("starts"), F.lit(False)))
    w = Window.partitionBy("file_path", "body_k").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    mine = mine.withColumn("statement", (F.sum(F.col("starts").cast("int")).over(w) - 1).cast("int")).where("statement >= 0 AND NOT (starts AND bare)")
    tested = F.col("starts") & F.col("test").isNotNull()
    mine = keep(mine.select("file_path", "body_k", "statement", "k", tested.alias("tests"), F.when(tested, F.col("test")).alias("test"), "name"), "body_tokens")
    heads = mine.where("tests").select("file_path", "body_k", "statement", F.col("k").alias("if_k"), "test.*").where("test_end IS NOT NULL")
    # the block after the test, or the one statement
    inside = toks.select("file_path", F.col("group").alias("block"), (F.col("gap").rlike(r"(?:^|[\s;}])return\b") | ((F.col("ch") == "(") & F.col("gap").rlike(_ANSWERS))).alias("answers"))
    inside = inside.where("answers").select("file_path", "block").distinct().withColumn("answers", F.lit(True))
    heads = heads.withColumn("block", F.when((F.col("then_ch") == "{") & F.col("then_gap").rlike(r"^\s*$"), F.col("test_end") + 1)).join(inside, ["file_path", "block"], "left")
    at_once = F.col("then_gap").rlike(r"^\s*return\b") | ((F.col("then_ch") == "(") & F.col("then_gap").rlike(_ANSWERS))
    heads = heads.select("file_path", "body_k", "statement", "if_k", "test_end", F.when(F.col("block").isNotNull(), F.coalesce("answers", F.lit(False))).otherwise(at_once).alias("returns"))
    around = within(mine.where(F.col("name").isNotNull() & ~F.col("name").isin(*KEYWORDS)).drop("tests", "test"), scopes(toks), F.struct(F.col("k").alias("k")))
    named = around.where("around.k = body_k")
    every = mine.select("file_path", "body_k", "statement").distinct().join(named.select("file_path", "body_k", "statement", F.col("k").alias("ord"), "name"), ["file_path", "body_k", "statement"], "left")
    found = every.join(heads.hint("merge"), ["file_path", "body_k", "statement"], "left")
    tested = F.coalesce((F.col("ord") > F.col("if_k")) & (F.col("ord") < F.col("test_end")), F.lit(False))
    return found.select("file_path", "body_k", "statement", "ord", "name", tested.alias("tested"), F.coalesce("returns", F.lit(False)).alias("returns"))

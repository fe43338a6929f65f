"""Canonical JSON (RFC 8785) of columns: keys in UTF-16 order, shortest numbers, no white space. All of it is built-in functions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import utf16

# Control characters with a short form.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
EXACT = 2**53


def string(c: Column) -> Column:
    """A JSON string: only quotes, backslashes and control characters are escaped, the latter in their short form or in lower case."""
    escapes = [("\\", "\\\\"), ('"', '\\"')] + [(chr(k), SHORT.get(chr(k), f"\\u{k:04x}")) for k in range(32)]
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in escapes])
    escaped = F.aggregate(pairs, c, lambda s, e: F.replace(s, e["a"], e["b"]))
    return F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(c), F.lit('"'))


def _shorter(v: Column, digits: Column, point: Column) -> Column:
    """Struct (digits, point) of the fewest digits that are still the same number, which is not negative; Java's own text has one too many at times."""
    n = F.length(digits)
    powers = F.array(*[F.lit(10**k) for k in range(19)]).cast("array<long>")
    exact = digits.cast("long")

    def cut(p: Column) -> Column:
        """Both neighbours with p digits, the nearer first: where doubles lie unevenly the other one may be the only one that fits."""
        both = F.transform(F.array(F.get(powers, n - p)), lambda u: F.struct(F.call_function("div", exact, u).alias("down"), F.when(F.pmod(exact, u) * 2 >= u, 1).otherwise(0).alias("near")))
        each = F.flatten(F.transform(both, lambda d: F.array(d["down"] + d["near"], d["down"] + 1 - d["near"])))
        return F.transform(each.cast("array<string>"), lambda w: F.struct(w.alias("digits"), (point - p + F.length(w)).cast("int").alias("point")))

    same = lambda s: F.concat(s["digits"], F.lit("e"), (s["point"] - F.length(s["digits"])).cast("string")).cast("double") == v
    fits = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), cut)), same)
    as_is = F.struct(digits.alias("digits"), point.cast("int").alias("point"))
    # up to 15 digits are the only ones of their length for a number, but for the tiniest
    # what fits with fewer digits has a neighbour that fits with one digit less
    some = (n > 1) & ((n > 15) | (v < 1e-300)) & F.exists(cut(n - 1), same)
    return F.when(some, F.coalesce(F.get(fits, F.lit(0)), as_is)).otherwise(as_is)


def _laid_out(digits: Column, point: Column) -> Column:
    """Digits with the decimal point after the ``point``-th of them, or with an exponent where it is far off."""
    n, e = F.length(digits), point - 1
    zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)))
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""))
    return (
        F.when((n <= point) & (point <= 21), F.concat(digits, zeros(point - n)))
        .when((point > 0) & (point <= 21), F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
        .otherwise(F.concat(mantissa, F.lit("e"), F.when(e > 0, "+").otherwise("-"), F.abs(e).cast("string")))
    )


def number(c: Column) -> Column:
    """A double as JavaScript writes it; NaN and infinities are errors."""
    v = c.cast("double")
    # as arguments of one-element lambdas, each step is worked out once
    steps = F.transform(F.array(F.abs(v)), lambda a: F.struct(a.alias("a"), a.cast("string").alias("text")))
    exponent = lambda t: F.when(F.contains(t, F.lit("E")), F.substring_index(t, "E", -1).try_cast("int")).otherwise(0)
    steps = F.transform(steps, lambda s: F.struct(s["a"].alias("a"), F.substring_index(s["text"], "E", 1).alias("m"), exponent(s["text"]).alias("e")))
    steps = F.transform(steps, lambda s: F.struct(s["a"].alias("a"), F.replace(s["m"], F.lit("."), F.lit("")).alias("all"), (F.length(F.substring_index(s["m"], ".", 1)) + s["e"]).alias("e")))
    steps = F.transform(steps, lambda s: F.struct(s["a"].alias("a"), F.ltrim(s["all"], F.lit("0")).alias("bare"), F.length(s["all"]).alias("n"), s["e"].alias("e")))
    # above 2**53 all are whole, and Java's text may miss the last digit
    whole = lambda s: (s["a"] >= float(EXACT)) & (s["a"] < float(2**63))
    digits = lambda s: F.when(whole(s), s["a"].cast("long").cast("string")).otherwise(s["bare"])
    point = lambda s: F.when(whole(s), F.length(s["a"].cast("long").cast("string"))).otherwise(s["e"] - s["n"] + F.length(s["bare"]))
    steps = F.transform(steps, lambda s: F.struct(s["a"].alias("a"), F.rtrim(digits(s), F.lit("0")).alias("digits"), point(s).alias("point")))
    steps = F.transform(steps, lambda s: _shorter(s["a"], s["digits"], s["point"]))
    out = F.get(F.transform(steps, lambda s: _laid_out(F.rtrim(s["digits"], F.lit("0")), s["point"])), F.lit(0))
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    text = v.cast("string")
    plain = (F.length(text) <= 16) & ~F.contains(text, F.lit("E"))  # up to 15 digits, laid out alike but for `.0`
    return F.when(v == 0, "0").when(bad, F.raise_error("not a JSON number")).when(plain, F.regexp_replace(text, r"\.0$", "")).otherwise(F.concat(F.when(v < 0, "-").otherwise(""), out))


def value(c: Column, kind: T.DataType, drop_nulls: bool = False) -> Column:
    """Canonical JSON of a column of any type that JSON has: nested structs, arrays, and maps with string keys.

    Nulls are `null`, or with ``drop_nulls`` no members of structs and maps. Whole numbers beyond 2**53 are rounded to a
    double, as JSON numbers are. Dates, binaries and maps with other keys are errors.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        each = [(f.name, c.getField(f.name), f.dataType) for f in fields]
        pairs = [F.when(v.isNotNull() | F.lit(not drop_nulls), F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), value(v, t, drop_nulls))) for n, v, t in each]
        out = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: value(v, kind.elementType, drop_nulls)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(utf16(e["key"]).alias("k"), e["key"].alias("key"), e["value"].alias("value")))
        entries = F.filter(entries, lambda e: e["value"].isNotNull()) if drop_nulls else entries
        ordered = F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        pairs = F.transform(ordered, lambda e: F.concat(string(e["key"]), F.lit(":"), value(e["value"], kind.valueType, drop_nulls)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = string(c)
    elif isinstance(kind, T.BooleanType):
        out = c.cast("string")
    elif isinstance(kind, T.NullType):
        out = F.lit(None).cast("string")
    elif isinstance(kind, T.IntegralType):
        whole = c.cast("long")
        out = F.when(whole.between(-EXACT, EXACT), whole.cast("string")).otherwise(number(whole)) if isinstance(kind, T.LongType) else c.cast("string")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        out = number(c)
    else:
        raise TypeError(f"not JSON: {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))

"""What a handler's text shows without a syntax tree: one row of flags for each handler, all of them JVM expressions.

Comparisons, short-circuits and catch blocks are regular expressions over the handler's lines as one text, which a
file's size limit bounds. Blocks may hold one more level of braces; deeper ones can be missed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import MOST_NEEDLES

# What marks development modes, signature material and a provider's postback.
DEV_MODES = ["NODE_ENV", "SKIP_VERIFICATION", "SKIP_WEBHOOK_VERIFICATION", "BYPASS_WEBHOOK", "DISABLE_WEBHOOK_VERIFICATION", "STAGE", "ENVIRONMENT", "ENV"]
SIGNATURE = r"\b(?:sig|signature|hmac|digest|expected|computed|provided)\b"
GO_SIGNATURE = r"(?:sig|hmac|mac|digest|expected|computed|provided)"
POSTBACK = r"verify-webhook-signature|VerifyWebhookSignature"
LOCAL_RSA = r"createVerify\s*\(|crypto\.verify\s*\(|openssl_verify\s*\(|load_pem_x509_certificate"
STATUS, SUCCESS, IN_CONDITION = r"verification_?[sS]tatus", "SUCCESS", r"(?i)\bif\b[^\n]*\bverify\w*\s*\("
ED25519_MARKS = r"sodium_crypto_sign_verify_detached\(|detached\.verify\(|VerifyKey\("

INNER = r"(?:[^{}]++|\{[^{}]*+\})*+"
ANSWER = r"(?:return\b|\w+(?:\.(?:status|code)\(\s*[123]\d\d\s*\))?\.(?:json|send|end)\()"
DEV_IF = rf"\bif\s*\([^\n]*process\.env\.(?:{'|'.join(DEV_MODES)})\b[^\n]*?\)\s*"
ENDS = r"\b(?:return|throw)\b|\bprocess\.(?:exit|abort)\(|\bnext\(|\.(?:status|code)\(\s*[45]\d\d|,\s*[45]\d\d\s*\)"
NUMBER = r"\d+(?:\s*\*\s*\d+)*"


def _verify_at(text: Column, calls: dict[str, list[str]]) -> Column:
    """Place of the first verify call of the row's `provider`, from 1; null where there is none. An expression for each set of
    calls, compiled once."""
    out = F.lit(None).cast("int")
    for pattern, providers in calls.items():
        out = F.when(F.col("provider").isin(*providers), F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0))).otherwise(out)
    return out


def _patterns(calls: DataFrame) -> dict[str, list[str]]:
    """Providers by the expression of their verify calls; (provider, calls array) is a catalog, of as many rows as `joins.few` takes."""
    rows = calls.limit(MOST_NEEDLES + 1).collect()
    if len(rows) > MOST_NEEDLES:
        raise ValueError("a catalog has too many providers")
    out: dict[str, list[str]] = {}
    for r in rows:
        if r["calls"]:
            body = "|".join(re.escape(c) for c in r["calls"])
            out.setdefault(rf"(?<!\w)(?:{body})\s*\(", []).append(r["provider"])
    return out


def _top(block: Column) -> Column:
    """A block's own statements: what is in braces within it goes."""
    return F.regexp_replace(block, r"\{[^{}]*+\}", "{}")


def _seconds(product: Column) -> Column:
    """A product of whole numbers, taken for milliseconds where it is above a day or whole thousands."""
    value = F.aggregate(F.split(F.regexp_replace(product, r"\s", ""), r"\*"), F.lit(1.0), lambda a, x: a * x.cast("double"))
    return F.when((value > 86400) | ((value >= 1000) & (value % 1000 == 0)), value / 1000).otherwise(value)


def flags(bodies: DataFrame, calls: DataFrame) -> DataFrame:
    """(handler_id, go_hmac, go_equal, go_compares, php_hmac, php_equals, php_compares, js_compares, bypasses, swallows,
    window, env_window, equality, postback, rsa, checked, ed25519), a row for each of ``bodies`` (handler_id, provider, language, text).

    calls: (provider, calls array), the verify calls of each provider. window: the largest tolerance that a comparison or
    a fourth argument of a verify call names, in seconds; null where there is none.
    """
    text = F.col("text")
    js, php, go = (F.col("language") == n for n in ("js", "php", "go"))
    has = lambda p: text.rlike(p)
    own = _patterns(calls)
    rows = bodies.withColumn("at", _verify_at(text, own))
    before = F.when(F.col("at").isNull(), text).otherwise(F.substr(text, F.lit(1), F.col("at") - 1))
    blocks = F.regexp_extract_all(before, F.lit(rf"{DEV_IF}\{{({INNER})\}}"), F.lit(1))
    answers = F.exists(blocks, lambda b: _top(b).rlike(rf"(?m)(?:^|;)\s*{ANSWER}")) | before.rlike(DEV_IF + ANSWER)
    tries = F.regexp_extract_all(text, F.lit(rf"\btry\s*\{{({INNER})\}}\s*catch\s*(?:\([^)]*\))?\s*\{{{INNER}\}}"), F.lit(1))
    catches = F.regexp_extract_all(text, F.lit(rf"\btry\s*\{{{INNER}\}}\s*catch\s*(?:\([^)]*\))?\s*\{{({INNER})\}}"), F.lit(1))
    swallowed = F.exists(F.arrays_zip(tries.alias("t"), catches.alias("c")), lambda z: _verify_at(z["t"], own).isNotNull() & ~_top(z["c"]).rlike(ENDS))
    compared = F.transform(F.regexp_extract_all(text, F.lit(rf">=?\s*({NUMBER})(?![\w.])"), F.lit(1)), _seconds)
    given = F.transform(F.regexp_extract_all(text, F.lit(rf"\w\([^(),]++,[^(),]++(?:\([^()]*+\))?\s*+,[^(),]++,\s*+({NUMBER})\s*+\)"), F.lit(1)), lambda x: F.when(F.col("at").isNotNull(), _seconds(x)))
    return rows.select(
        "handler_id",
        (go & has(r"\bhmac\.New\(")).alias("go_hmac"),
        (go & has(r"\bhmac\.Equal\(")).alias("go_equal"),
        (go & has(rf"(?i)bytes\.Equal\([^\n]*{GO_SIGNATURE}|{GO_SIGNATURE}\w*\s*[=!]=|[=!]=\s*\w*{GO_SIGNATURE}")).alias("go_compares"),
        (php & has(r"(?<!\w)hash_hmac\(")).alias("php_hmac"),
        (php & has(r"(?<!\w)hash_equals\(")).alias("php_equals"),
        (php & has(rf"(?i){SIGNATURE}[^\n;&|]*[^!=<>]={{2,3}}(?!=)|[^!=<>]={{2,3}}(?!=)[^\n;&|]*{SIGNATURE}|str(?:case)?cmp\([^\n]*={{2,3}}\s*0")).alias("php_compares"),
        (js & has(rf"(?i){SIGNATURE}[^\n;&|]*[!=]==?(?!=)|[!=]==?(?!=)[^\n;&|]*{SIGNATURE}")).alias("js_compares"),
        F.when(js & F.contains(text, F.lit("process.env")), answers).otherwise(False).alias("bypasses"),
        F.when(js & F.contains(text, F.lit("catch")), swallowed).otherwise(False).alias("swallows"),
        F.when(js, F.array_max(F.concat(compared, given))).alias("window"),
        (js & has(r"process\.env[^\n]*>|>[^\n]*process\.env") & has(r"\bDate\.now\b")).alias("env_window"),
        has(r"[!=]==?|\.(?:equals|compare)\s*\(").alias("equality"),
        has(POSTBACK).alias("postback"),
        has(LOCAL_RSA).alias("rsa"),
        ((has(STATUS) & has(SUCCESS)) | has(IN_CONDITION)).alias("checked"),
        has(ED25519_MARKS).alias("ed25519"),
    )

"""Rule classes as column expressions over one row of features per handler.

Features are aggregated once (one shuffle for reachable names, one for evidence, joined on the handler);
every class is then a `when` chain in the same stage. Null means that a class does not apply: no finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Call names that mark what a handler does. A name fits if it equals one or ends with a dot and one.
HMAC = ["createHmac", "hmac.new"]
HASH = ["createHash"]
CONSTANT_TIME = ["timingSafeEqual", "compare_digest"]
CLOCK = ["Date.now", "Date.parse", "time.time", "time.monotonic", "datetime.utcnow", "datetime.now"]
ALGORITHMS = ["md5", "sha1", "sha256", "sha512"]
PREFIX_STRIP = ["replace", "slice", "substring", "substr", "removeprefix", "split", "startsWith"]
PARSE = ["split", "parse", "match", "exec"]
ITERATE = ["split", "some", "map", "filter", "find", "forEach", "any", "every"]
COMPARE = ["equals", "compare"]
ED25519 = ["verifyKey", "nacl.sign.detached.verify", "VerifyKey.verify", "sodium_crypto_sign_verify_detached"]
# Parts of lower-case names that read credentials or the sender's address.
BASIC_READS = [".authorization", "headers.get.authorization", "express.basicauth", "fastify.basicauth"]
IP_READS = [".ip", ".socket.remoteaddress", "request.client.host", "request.remote_addr", ".getclientip", "x-forwarded-for"]
JSON_PARSERS = ["express.json", "bodyParser.json", "body-parser.json"]


def ends_with_any(name: Column, calls: list[str]) -> Column:
    body = "|".join(c.replace(".", r"\.") for c in calls)
    return name.rlike(rf"(^|\.)({body})$")


def features(handlers: DataFrame, reachable: DataFrame, evidence: DataFrame, providers: DataFrame, middleware: DataFrame | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """A row for each handler (handler_id, provider[, framework]) with Boolean features.

    reachable: (handler_id, qualified_name, import_source, hops); evidence: (handler_id, kind, provider);
    providers: (provider, packages array, calls array, algorithm, input_format[, replay_seconds]). middleware: (handler_id,
    name, import_source, preserves_raw_body); bodies: what `bodies.flags` returns. Without those their features are false.
    """
    from .joins import few

    providers = providers if "replay_seconds" in providers.columns else providers.withColumn("replay_seconds", F.lit(None).cast("int"))
    framework = F.col("framework") if "framework" in handlers.columns else F.lit(None).cast("string")
    own = handlers.select("handler_id", "provider", framework.alias("framework")).join(few(providers), "provider", "left")
    name = F.col("qualified_name")
    call = F.exists(F.coalesce("calls", F.array().cast("array<string>")), lambda c: (name == c) | F.endswith(name, F.concat(F.lit("."), c)))
    sdk = call & (F.col("import_source").isNull() | (F.size("packages") == 0) | F.array_contains("packages", F.col("import_source")))
    compares = ends_with_any(name, CONSTANT_TIME + COMPARE)
    algorithm = F.regexp_extract(name, r"(?:^|\.)(" + "|".join(ALGORITHMS) + ")$", 1)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    reached = (
        reachable.join(own, "handler_id")
        .groupBy("handler_id")
        .agg(
            some(sdk).alias("sdk"),
            some(call).alias("any_call"),
            F.min(F.when(call, F.col("hops"))).alias("call_hops"),
            some(ends_with_any(name, HMAC)).alias("hmac"),
            some(ends_with_any(name, HASH)).alias("hash"),
            some(ends_with_any(name, CONSTANT_TIME)).alias("constant_time"),
            some(ends_with_any(name, CLOCK)).alias("clock"),
            some((algorithm != "") & (algorithm == F.col("algorithm"))).alias("right_algorithm"),
            some((algorithm != "") & (algorithm != F.col("algorithm"))).alias("wrong_algorithm"),
            some(ends_with_any(name, PREFIX_STRIP)).alias("strips"),
            some(ends_with_any(name, PARSE)).alias("parses"),
            some(ends_with_any(name, ITERATE)).alias("iterates"),
            some(F.startswith("import_source", F.lit("@octokit/webhooks"))).alias("octokit"),
            some(F.lower(name).rlike(_any_of(BASIC_READS))).alias("basic"),
            some(F.lower(name).rlike(_any_of(IP_READS))).alias("ip"),
            some(compares).alias("compares"),
            some(~compares & name.rlike("(?i)verify|valid|check|compare|equal")).alias("compare_shaped"),
            some(ends_with_any(name, ED25519)).alias("asymmetric"),
        )
    )
    kind = F.col("kind")
    mine = F.col("provider").isin("unknown") | (F.col("provider") == F.col("p"))
    seen = evidence.join(own.select("handler_id", F.col("provider").alias("p")), "handler_id").groupBy("handler_id")
    seen = seen.agg(
        *[
            some((kind == k) & mine).alias("ev_" + a)
            for k, a in (
                ("sdk_import", "import"),
                ("sdk_verify_call", "verify"),
                ("signature_header_read", "header"),
                ("body_as_bytes_or_buffer", "bytes"),
                ("side_effect_before_verify", "early"),
                ("queue_verification_reachable", "queue"),
            )
        ]
    )
    flags = [c for c in reached.columns + seen.columns if c not in ("handler_id", "call_hops")]
    out = own.select("handler_id", "provider", "input_format", "framework", "replay_seconds").join(reached, "handler_id", "left").join(seen, "handler_id", "left")
    if middleware is not None:
        parses = F.col("name").isin(*JSON_PARSERS) | ((F.col("name") == "json") & F.col("import_source").isin("express", "body-parser"))
        chain = middleware.groupBy("handler_id").agg(some(parses & ~F.coalesce("preserves_raw_body", F.lit(False))).alias("json_parser"))
        out = out.join(chain, "handler_id", "left")
    if bodies is not None:
        out = out.join(bodies, "handler_id", "left")
    missing = [c for c in ["json_parser", *BODY_FLAGS] if c not in out.columns]
    out = out.withColumns({c: F.lit(False) for c in missing})
    out = out if "window" in out.columns else out.withColumn("window", F.lit(None).cast("double"))
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in dict.fromkeys(flags + ["json_parser", *BODY_FLAGS])})


BODY_FLAGS = ["go_hmac", "go_equal", "go_compares", "php_hmac", "php_equals", "php_compares", "js_compares", "bypasses", "swallows", "env_window", "postback", "rsa", "checked", "ed25519", "equality", "delegates"]


def _any_of(parts: list[str]) -> str:
    return "|".join(p.replace(".", r"\.") for p in parts)


VERIFIED, UNSURE, MISSING = "verified", "manual-review", "not-verified"


def classes() -> dict[str, Column]:
    """Verdict of each class, null where it does not apply."""
    f = F.col
    when, not_verified, unsure, verified = F.when, F.lit(MISSING), F.lit(UNSURE), F.lit(VERIFIED)
    real = ~f("provider").isin("unknown", "multiple")
    only = lambda *p: f("provider").isin(*p)
    hmac = f("hmac") | f("go_hmac") | f("php_hmac")
    none = f("sdk") | hmac | f("ev_verify")
    ed25519 = f("asymmetric") | f("ev_verify") | f("ed25519")
    asked = f("sdk") | f("ev_verify") | f("postback")
    signed = f("sdk") | f("ev_verify") | (hmac & (f("compares") | f("php_equals") | f("go_equal") | f("js_compares") | f("php_compares") | f("go_compares")))
    # providers whose signing is their own; the others share one decision
    slots = {
        "twilio": when(~f("sdk") & ~hmac, not_verified),
        "hubspot": when(~f("sdk") & ~hmac & ~f("ev_verify"), not_verified),
        "notion": when(~hmac & ~f("ev_header"), not_verified),
        "postmark": when(~f("ev_verify") & ~f("basic") & ~f("ip"), not_verified),
        "standardwebhooks": when(hmac & ~signed & f("compare_shaped"), unsure).when(~signed, not_verified),
        "paypal": when(asked & f("checked"), None).when(asked | f("rsa"), unsure).otherwise(not_verified),
        "discord": when(~ed25519, not_verified),
    }
    by_slot = when(real & ~none & f("delegates"), unsure).when(real & ~none & f("hash") & f("equality"), unsure).when(real & ~none, not_verified)
    for provider, verdict in slots.items():
        by_slot = when(only(provider), verdict).otherwise(by_slot)
    unsafe_go = f("go_hmac") & ~f("go_equal") & f("go_compares")
    unsafe_php = f("php_compares") & ~f("php_equals")
    return {
        "missing-signature-verification": by_slot,
        "timing-unsafe-comparison": when(real & (unsafe_go | (unsafe_php & f("php_hmac"))) & ~f("ev_verify"), not_verified).when(real & ~f("sdk") & f("hmac") & ~f("constant_time"), not_verified),
        "missing-timing-safe-equal": when(only("github") & (f("go_hmac") | f("php_hmac")), when(unsafe_go & ~f("ev_verify") | unsafe_php, not_verified)).when(
            only("github") & ~f("constant_time") & ~f("octokit"), not_verified
        ),
        "raw-body-misuse": when(real & ~f("ev_bytes") & ~f("ev_header") & f("any_call") & (f("call_hops") > 1), unsure).when(
            real & ~f("ev_bytes") & (f("ev_header") | f("any_call")), not_verified
        ),
        "missing-timestamp-check": when(real & ~f("sdk") & f("hmac") & ~f("clock"), unsure),
        "wrong-hmac-algorithm": when(real & f("hmac") & f("wrong_algorithm") & ~f("right_algorithm"), not_verified).when(
            real & f("hmac") & (f("wrong_algorithm") == f("right_algorithm")), unsure
        ),
        "unreachable-verification": when(real & f("ev_import") & ~f("sdk") & ~f("ev_verify"), unsure),
        "library-verified": when(only("paypal"), when(asked & f("checked"), verified)).when(only("discord"), when(ed25519, verified)).when(real & (f("any_call") | f("ev_verify")), verified),
        "verify-after-side-effect": when(real & f("ev_early") & ~(only("paypal") & f("postback")), unsure),
        "agent-tool-acts-on-unverified-payload": when(only("n8n") & f("ev_early"), unsure),
        "tool-callback-no-verification": when(only("anthropic-agent-sdk") & f("ev_early"), unsure),
        "test-mode-bypass": when(real & f("bypasses"), not_verified),
        "verification-error-swallowed": when(real & f("swallows"), not_verified),
        "replay-window-too-permissive": when(real & (f("window") > f("replay_seconds")), not_verified).when(real & f("replay_seconds").isNotNull() & f("env_window"), unsure),
        "express-middleware-ordering": when(only("stripe") & (f("framework") == "express") & f("json_parser"), not_verified),
        "missing-basic-auth": when(only("postmark") & f("ip") & ~f("basic"), unsure),
        "missing-ip-allowlist": when(only("postmark") & f("basic") & ~f("ip"), unsure),
        "signature-prefix-not-stripped": when(only("bitbucket") & f("hmac") & f("ev_header") & ~f("strips"), unsure),
        "signature-header-parse-mishandled": when(only("calendly") & f("hmac") & f("ev_header") & ~f("parses"), unsure),
        "multi-signature-rotation-mishandled": when(only("pagerduty", "standardwebhooks") & f("hmac") & ~f("iterates"), unsure),
        "header-confusion": when(only("sentry") & f("hmac") & ~f("ev_header"), unsure),
        "octokit-cross-attribution": when(only("intercom") & f("octokit"), not_verified),
        "url-validation-only": when(only("zoom") & f("ev_header") & ~f("hmac"), unsure),
        "verification-token-only": when(only("notion") & f("ev_header") & ~f("hmac"), unsure),
    }


def verdicts(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(handler_id, provider, rule_class, state): a row for each class that applies; one pass, no shuffle."""
    every = classes()
    chosen = F.array(*[F.struct(F.lit(n).alias("rule_class"), every[n].alias("state")) for n in names or every])
    out = rows.select("handler_id", "provider", F.explode(F.filter(chosen, lambda s: s["state"].isNotNull())).alias("s"))
    return out.select("handler_id", "provider", "s.*")


def downgraded(findings: DataFrame, deferred: DataFrame) -> DataFrame:
    """Findings of handlers whose verification is deferred to a queue: not-verified becomes manual-review."""
    late = deferred.select("handler_id").distinct().withColumn("late", F.lit(True))
    out = findings.join(late, "handler_id", "left")
    return out.withColumn("state", F.when(F.col("late") & (F.col("state") == MISSING), UNSURE).otherwise(F.col("state"))).drop("late")

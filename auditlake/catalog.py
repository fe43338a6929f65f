"""The signing-provider catalog as tables. Four providers come along; a full catalog is a JSON file of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "provider string, ord int, headers array<string>, packages array<string>, calls array<string>, env array<string>, literals array<string>, "
    "paths array<string>, algorithm string, input_format string, replay_seconds int"
)

# Public names of the providers' headers, packages, calls and conventions.
PROVIDERS = [
    (
        "stripe", 0, ["stripe-signature"],
        ["stripe", "@stripe/stripe-js", "Stripe\\", "github.com/stripe/stripe-go"],
        ["webhooks.constructEvent", "webhooks.constructEventAsync", "parseThinEvent", "Webhook.constructEvent", "Webhook.construct_event", "Webhook::constructEvent", "webhook.ConstructEvent"],
        ["STRIPE_WEBHOOK", "STRIPE_SIGNING"], ["whsec_"],
        ["/webhooks/stripe", "/api/webhooks/stripe", "/stripe/webhook", "/stripe/webhooks"],
        "sha256", "raw_body", 300,
    ),
    (
        "github", 1, ["x-hub-signature-256", "x-hub-signature"],
        ["@octokit/webhooks", "@octokit/webhooks-methods", "github.com/google/go-github"],
        ["verify", "verifyRequest", "github.ValidatePayload", "github.ValidateSignature"],
        ["GITHUB_WEBHOOK", "GH_WEBHOOK"], ["ghs_", "github_pat_"],
        ["/webhooks/github", "/api/webhooks/github", "/github/webhook", "/github/webhooks"],
        "sha256", "raw_body", None,
    ),
    (
        "shopify", 4, ["x-shopify-hmac-sha256"],
        ["@shopify/shopify-api", "@shopify/shopify-app-express", "Shopify\\"],
        ["verifyHmac", "webhookRegistry.process", "shopify.webhooks.validate", "verify", "Utils::validateHmac", "Webhooks\\Validator::validate"],
        ["SHOPIFY_WEBHOOK", "SHOPIFY_API_SECRET", "SHOPIFY_SIGNING"], [],
        ["/webhooks/shopify", "/api/webhooks/shopify", "/shopify/webhook", "/shopify/webhooks"],
        "sha256", "raw_body", 300,
    ),
    (
        "slack", 5, ["x-slack-signature"],
        ["@slack/bolt", "@slack/events-api", "@slack/webhook"],
        ["verifyRequestSignature", "isValidSlackRequest", "verify", "is_valid_request"],
        ["SLACK_SIGNING", "SLACK_WEBHOOK"], [],
        ["/webhooks/slack", "/api/webhooks/slack", "/slack/events", "/slack/commands"],
        "sha256", "timestamp_dot_body", 300,
    ),
]
# Headers that any authenticated route reads; they name no provider.
GENERIC_HEADERS = ["authorization", "content-type", "accept", "user-agent", "host", "cookie"]
# Calls with effects that a forged request must not reach: stores, other hosts, events.
SIDE_EFFECTS = [
    "prisma.user.create", "prisma.user.update", "prisma.user.delete", "prisma.event.create", "prisma.event.update", "knex.insert", "knex.update",
    "knex.delete", "db.query", "pool.query", "client.query", "drizzle.insert", "drizzle.update", "drizzle.delete", "fetch", "axios.post",
    "axios.put", "axios.delete", "axios.patch", "got.post", "got.put", "got.delete", "emitter.emit", "eventEmitter.emit", "sqs.send", "sns.publish",
    "kafka.send", "pubsub.publish",
]
# Calls that notify somebody.
NOTIFICATIONS = ["nodemailer.sendMail", "transporter.sendMail", "twilio.messages.create", "sendgrid.send", "mail.send"]
# Severities of rule classes where no rule pack says otherwise.
SEVERITY = {
    "missing-signature-verification": "critical",
    "timing-unsafe-comparison": "critical",
    "missing-timing-safe-equal": "critical",
    "raw-body-misuse": "critical",
    "wrong-hmac-algorithm": "critical",
    "webhook-trigger-no-authentication": "critical",
    "library-verified": "info",
}  # others: high


def catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The providers, from a JSON-lines file of SCHEMA or those that come along."""
    if path:
        return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    return spark.createDataFrame(PROVIDERS, SCHEMA)


def dimension(providers: DataFrame, column: str, name: str) -> DataFrame:
    """(provider, ord, name): one of the array columns, exploded."""
    return providers.select("provider", "ord", F.explode(column).alias(name))

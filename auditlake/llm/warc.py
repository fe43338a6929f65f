"""WARC archives: write records from a table of pages and read them back by boundary-chain verification.

Writing is Spark's text writer with the blank lines after a record as its line separator. Reading is the
text reader with the magic line as its separator, so tasks share a file's blocks. Each task turns its
segments into candidates: a magic's offset, and the offset of the record after it as the header's length
says. Candidates that lead to their neighbour form runs; pointer jumping over the runs, from the start of
the file, keeps those that the chain reaches. A magic inside a payload is not on the chain; the payload is
put together again from its segments.

An archive of one huge file is no hot spot: offsets, runs and owners are found in each block of a file by itself,
and what a block hands on to the next is one row. Built-in functions only. Whole payloads shuffle only where one
holds the magic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, fresh_path, materialize

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: five digits make four characters."""
    out = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(bits, by).bitwiseAND(31) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to uncompressed archives under ``path``.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is a
    response, the others are revisits without the payload. Equal rows are all responses or all revisits. A null
    html is an empty payload; a page without a page_id is a response that none refers to.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "sha1": F.sha1("html"), "h": F.xxhash64("html")})
    small = rows.where(F.col("page_id").isNotNull() & (F.col("n") >= least_bytes)).select("page_id", "sha1", "h", "n")
    small = materialize(small, "payloads")
    last = small.groupBy("sha1", "h", "n").agg(F.max("page_id").alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    again = small.join(last, ["sha1", "h", "n"]).where("page_id < keep").select(F.col("page_id").alias("p"), F.col("h").alias("h2"), "keep").distinct()
    again = materialize(again, "revisits")  # with its size known, the planner broadcasts it only when small
    rows = rows.join(again, (F.col("page_id") == F.col("p")) & (F.col("h") == F.col("h2")), "left").withColumn("digest", base32(F.col("sha1")))
    crlf = "\r\n"
    new = F.col("keep").isNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("n").cast("string"), F.lit(BLANK))
    block = F.concat(http, F.when(new, F.col("html")).otherwise(""))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(new, "response").otherwise("revisit"),
        F.lit(f"{crlf}WARC-Date: {date}{crlf}WARC-Record-ID: "),
        uri(F.col("page_id")),
        F.when(new, "").otherwise(F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: "), uri(F.col("keep")))),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "))),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(f"{crlf}Content-Type: application/http;msgtype=response{crlf}Content-Length: "),
        (F.octet_length(http) + F.when(new, F.col("n")).otherwise(0)).cast("string"),
    )
    rows.select(F.concat(head, F.lit(BLANK), block).alias("value")).write.option("lineSep", BLANK).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magics: (value, file, block, mid); in a file they follow each other by block, then mid."""
    found = spark.read.option("lineSep", MAGIC).text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))


def _parsed(segments: DataFrame, keep_payload: bool) -> DataFrame:
    """Segments (value, ...) with `used`, the bytes of the record that begins there, and the record's fields.

    In steps, so that what several fields use is computed once.
    """
    kept = [c for c in segments.columns if c != "value"]
    field = lambda name: F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    df = segments.withColumn("head", F.substring_index("value", BLANK, 1))
    df = df.withColumns({"length": field("Content-Length").try_cast("long"), "record_type": field("WARC-Type"), "at_block": F.octet_length("head") + 5})
    df = df.withColumn("body", F.substring(F.col("value").cast("binary"), F.col("at_block"), F.col("length").cast("int")))
    df = df.withColumn("http", F.substring_index(F.col("body").cast("string"), BLANK, 1))
    new = F.col("record_type") == "response"
    df = df.withColumn("payload", F.when(new, F.substring("body", F.octet_length("http") + 5, F.lit(2**31 - 1))))
    df = df.withColumns({"sha1": F.sha1("payload"), "stored": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")})
    df = df.withColumn("own", base32(F.col("sha1")))
    said = F.regexp_extract("http", r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).try_cast("long")
    return df.select(
        *kept,
        (F.col("at_block") + 3 + F.col("length")).cast("long").alias("used"),
        "record_type",
        page("WARC-Record-ID").alias("page_id"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        page("WARC-Refers-To").alias("refers_to"),
        F.when(new, F.octet_length("payload").cast("long")).otherwise(said).alias("payload_bytes"),
        F.coalesce("own", "stored").alias("payload_digest"),
        F.coalesce(F.col("own") == F.col("stored"), F.lit(True)).alias("intact"),
        *["payload"] * keep_payload,
    )


FIELDS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"]


def _reached(found: DataFrame) -> DataFrame:
    """Of candidates (file, block, at, next): those on the chain from offset 0. A run stays in its block; its first offset names it."""
    order = Window.partitionBy("file", "block").orderBy("at")
    found = found.withColumn("first", F.when(F.coalesce(F.lag("next").over(order) != F.col("at"), F.lit(True)), F.col("at")))
    found = materialize(found.select("file", "at", "next", F.last("first", True).over(order).alias("run")), "candidates")
    runs = found.groupBy("file", "run").agg(F.min("at").alias("first"), F.max_by("next", "at").alias("exit"))
    jump = runs.select("file", "run", F.col("exit").alias("to_at")).join(found.select("file", F.col("at").alias("to_at"), F.col("run").alias("to")), ["file", "to_at"])
    jump = materialize(jump.select("file", "run", "to", "to_at"), "jumps")
    reach = found.where("at = 0").select("file", "run", F.col("at").alias("entry"))
    n = reach.count()
    while not jump.isEmpty():
        ahead = reach.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), F.col("to_at").alias("entry"))
        reach = materialize(reach.unionByName(ahead).distinct(), "reached")
        if (now := reach.count()) == n:
            break
        n = now
        far = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"), F.col("to_at").alias("far_at"))
        jump = materialize(jump.join(far, ["file", "to"]).select("file", "run", F.col("far").alias("to"), F.col("far_at").alias("to_at")), "jumps")
    return found.join(reach, ["file", "run"]).where("at >= entry").select("file", "at", "next")


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact[, payload]): a row for each record.

    Only records that the chain of declared lengths reaches from the start of their file count. intact: the
    payload's digest is the stored one. An archive without records gives none.
    """
    fields = FIELDS + ["payload"] * keep_payload
    seg = _segments(spark, path).withColumns({"size": F.octet_length("value").cast("long"), "h": F.xxhash64("value")})
    seg = _parsed(seg, keep_payload)
    seg = materialize(seg, "segments")
    blocks, own = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file", "block").orderBy("mid")
    sizes = seg.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    sizes = sizes.withColumn("base", F.coalesce(F.sum("bytes").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seg = seg.join(sizes.select("file", "block", "base"), ["file", "block"]).withColumn("at", F.col("base") + before - len(MAGIC))
    seg = seg.where("at >= 0").withColumn("next", F.col("at") + len(MAGIC) + F.col("used"))  # the first segment is what precedes all magics
    reached = _reached(seg.where("used IS NOT NULL").select("file", "block", "at", "next")).select("file", "at", F.lit(True).alias("real"))
    seg = seg.join(reached, ["file", "at"], "left")
    whole = seg.where("real AND used = size").select(*fields)
    seg = seg.withColumn("record", F.when(F.col("real"), F.struct("at", "next", (F.col("used") != F.col("size")).alias("torn"))))
    carried = seg.groupBy("file", "block").agg(F.max("record").alias("record"))
    carried = carried.select("file", "block", F.last("record", True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    owner = F.last("record", True).over(Window.partitionBy("file", "block").orderBy("at"))
    owned = seg.withColumn("owner", owner).join(carried, ["file", "block"]).withColumn("owner", F.coalesce("owner", "carried"))
    parts = owned.where("owner.torn AND at < owner.next").select("file", "block", "h", "size", "at", F.col("owner.at").alias("owner"))
    parts = materialize(parts, "parts")
    if parts.isEmpty():
        return whole
    text = _segments(spark, path).select("file", "block", F.xxhash64("value").alias("h"), F.octet_length("value").cast("long").alias("size"), "value")
    asked = materialize(parts.select("file", "block", "h", "size").distinct(), "asked")
    text = text.join(beside(asked), ["file", "block", "h", "size"], "left_semi").distinct()  # only texts of torn records shuffle
    text = text.join(parts, ["file", "block", "h", "size"]).groupBy("file", "owner")
    joined = text.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    return whole.unionByName(_parsed(joined, keep_payload).select(*fields))


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives and return what :func:`read_archives` finds there."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html),
r AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS s, CASE WHEN page_id < keep THEN keep END AS refers_to
      FROM p JOIN k USING (html))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""

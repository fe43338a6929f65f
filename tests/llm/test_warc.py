import base64
import hashlib

from auditlake.llm import warc

from .conftest import table_of

INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
HTML = ["<p>é</p>", "", None, "x\r\n\r\ny", INNER * 3, f"a{INNER}b WARC/1.1\r\n", "WARC/1.1\r\n", "<p>é</p>", "same" * 500, "same" * 500, "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n"]


def rows():
    out = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h) for i, h in enumerate(HTML)]
    return out + [(100 + i, "u", f"page {i} " * 40 + (INNER if i % 7 == 0 else "")) for i in range(120)] + [(8, "u", "same" * 500), (None, "u", "same" * 500), (None, None, None)]


def want(rows, least=0):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = last.get(h or "") if i is not None and len(b) >= least and last[h or ""] != i else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(4)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (keep, "1000b"):  # the latter cuts files within headers, payloads and magics
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for least in (0, 50):
                got = warc.round_trip(pages, least_bytes=least)
                assert table_of(got, *COLS) == want(rows(), least)
                assert got.where("NOT intact").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_payload_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame(rows()[:7], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    got = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, f"{tmp_path}/w", True).where("record_type = 'response'").collect()}
    assert {i: bytes(p) for i, p in got.items()} == {i: (h or "").encode() for i, _, h in rows()[:7] if i != 1}
    assert warc.round_trip(pages.limit(0)).count() == 0

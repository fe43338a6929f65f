from auditlake.llm.line_dedup import SPACE, dedup_lines, line_dedup

from .conftest import nasty, table_of


def brute(rows):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))
    held = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(docs):
    want = brute([r[:2] for r in nasty()])
    assert table_of(line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept") == want
    assert sum(r[2] for r in want) > 5


def test_filter_keeps_columns(docs, no_docs):
    out = dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert dedup_lines(no_docs).count() == 0 and line_dedup(no_docs).count() == 0


def test_threshold(spark):
    rows = [(i, "the same long line" + ("\nanother long line" if i < 2 else "")) for i in range(3)]
    out = table_of(line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3), "doc_id", "n_dropped")
    assert out == [(0, 0), (1, 1), (2, 1)]

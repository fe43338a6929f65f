"""Spelling variants: words one edit apart, found by Aho-Corasick automata over their halves.

An edit leaves one half of a word as it is: the first half at the other word's beginning or the second one at its
end. Each word deals its two halves, and every word the beginnings and ends that a half of a word of a length within
one of its own can be, to automaton shards by the half's hash: linear in the words. A shard's automaton finds
the halves in each word that came; offsets and lengths are checked; then the rests are looked up by what one edit leaves
in common, so the words of a frequent half are not compared with each other. A half with very many words is
cut by those same keys. A pair shares exactly one key, and shows in one shard for each of its words as the owner of the
halves. Shards emit a sum and a best word for each word, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, map_batches, materialize, release

RUN = re.compile("[a-zÀ-ÿ]+")
FLUSH = 200_000
SHARD = 60_000
HOT = 20_000
PART = 5_000


def misspelt(doc_id: int | None, run: str) -> str:
    """The lower-cased run, without one code point where 31 divides the hash; without a doc_id as it is."""
    if doc_id is not None:
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % 31 == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def words(docs: DataFrame, least_chars: int = 7, least: int = 2) -> DataFrame:
    """(word, n): runs of letters over whole texts, A-Z lowered, of enough code points and occurrences."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                runs = Counter(r for r in RUN.findall(text.encode().lower().decode()) if len(r) >= least_chars)
                for run, n in runs.items():
                    word = misspelt(doc, run)
                    if len(word) >= least_chars:
                        found[word] += n
                if len(found) > FLUSH:
                    yield _counts(found)
                    found.clear()
        yield _counts(found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = map_batches(rows, count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def _keys(rest: str) -> dict[str, list[str]]:
    """What a rest has in common with one an edit away: by place without a code point, itself, and shortened."""
    cut = [rest[:i] + rest[i + 1 :] for i in range(len(rest))]
    return {"same": [f"{i}={c}" for i, c in enumerate(cut)], "whole": [f"+{rest}"], "cut": list(dict.fromkeys(f"+{c}" for c in cut))}


def _owned(rest: str) -> list[str]:
    """Keys under which a word lies: by replacement, of longer words that shorten to it, and of what it shortens to."""
    k = _keys(rest)
    return k["same"] + k["whole"] + [f"-{c[1:]}" for c in k["cut"]]


def _asked(rest: str) -> list[str]:
    k = _keys(rest)
    return k["same"] + k["cut"] + [f"-{rest}"]


def _salts(keys: list[str], parts: int) -> set[int]:
    return {zlib.crc32(k.encode()) % parts for k in keys}


def _rest(word: str, half: str, front: bool) -> str:
    return word[len(half) :] if front else word[: len(word) - len(half)]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def _searched(part: pa.Table) -> pa.Table:
    """Of a shard's owners: their near words in it by number, and the most frequent one."""
    rows = list(zip(*(part[c].to_pylist() for c in ("owner", "front", "half", "parts", "salt", "word", "n"))))
    index: dict[tuple, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    parts: dict[tuple, int] = {}
    automaton = ahocorasick.Automaton()
    for owner, front, half, of, salt, word, _ in rows:
        if owner:
            parts[front, half] = of
            automaton.add_word(half, half)
            at = index[front, half, salt]
            for key in _owned(_rest(word, half, front)):
                if of == 1 or zlib.crc32(key.encode()) % of == salt:
                    at[key].append(word)
    found: dict[str, list] = {}
    if len(automaton):
        automaton.make_automaton()
        for word, n in {(word, n) for owner, _, _, _, _, word, n in rows if not owner}:
            for last, half in automaton.iter(word):
                for front, fits in ((True, last + 1 == len(half)), (False, last + 1 == len(word))):
                    if fits and (front, half) in parts:
                        _note(found, index, parts[front, half], front, half, word, n)
    names = ("word", "n_near", "form", "form_n")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    cols = zip(*((w, *v) for w, v in found.items())) if found else ((),) * 4
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, cols, kinds)})


def _note(found: dict[str, list], index: dict, of: int, front: bool, half: str, word: str, n: int) -> None:
    for key in _asked(_rest(word, half, front)):
        for own in index.get((front, half, zlib.crc32(key.encode()) % of if of > 1 else 0), {}).get(key, ()):
            size = len(own) // 2
            mine = half == (own[:size] if front else own[size:])
            if not mine or not one_edit(own, word) or (not front and word.startswith(own[:size])):
                continue  # a pair that shares the first half counts there
            now = found.setdefault(own, [0, word, n])
            now[0] += 1
            if (-n, word) < (-now[2], now[1]):
                now[1:] = word, n


def _dealt(vocabulary: DataFrame) -> DataFrame:
    """(owner, front, half, word, n): each word's own halves, and the beginnings and ends that others' halves may be."""
    size = F.char_length("word")
    kind = "array<struct<owner:boolean,front:boolean,half:string>>"
    first, last = lambda n: F.substring("word", F.lit(1), n), lambda n: F.substring("word", size - n + 1, n)
    lower, upper = lambda n: F.floor(n / 2).cast("int"), lambda n: F.ceil(n / 2).cast("int")
    row = lambda owner, front, half: F.struct(F.lit(owner).alias("owner"), F.lit(front).alias("front"), half.alias("half"))
    rows = [row(True, True, first(lower(size))), row(True, False, last(upper(size)))]
    for off in (-1, 0, 1):
        rows += [row(False, True, first(lower(size + off))), row(False, False, last(upper(size + off)))]
    return vocabulary.select("word", "n", F.explode(F.array_distinct(F.array(*rows).cast(kind))).alias("d")).select("d.*", "word", "n")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): of each word with any, the number of words one edit away and the most frequent of them."""
    dealt = materialize(_dealt(vocabulary), "halves")
    hot = dealt.groupBy("front", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT)
    hot = materialize(hot.select("front", "half", F.ceil(F.col("rows") / PART).cast("int").alias("parts")), "hot")
    each = dealt.join(beside(hot), ["front", "half"], "left")
    cols = ["owner", "front", "half", "parts", "salt", "word", "n"]

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rest = _rest(r["word"], r["half"], r["front"])
                out += [r | {"salt": s} for s in _salts((_owned if r["owner"] else _asked)(rest), r["parts"])]
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("owner", pa.bool_()), ("front", pa.bool_()), ("half", pa.string()), ("parts", pa.int32()), ("salt", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    plain = each.where("parts IS NULL").withColumns({"parts": F.lit(1), "salt": F.lit(0)}).select(*cols)
    many = each.where("parts IS NOT NULL").withColumn("salt", F.lit(0)).select(*cols)
    split = map_batches(many, cut, "owner boolean, front boolean, half string, parts int, salt int, word string, n long")
    shards = max(1, dealt.count() // SHARD)
    shard = F.pmod(F.xxhash64("front", "half", "salt"), F.lit(shards))
    found = plain.unionByName(split).withColumn("shard", shard).groupBy("shard").applyInArrow(_searched, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    found = materialize(found.select("word", "n_near", "best.form", (-F.col("best.n")).alias("form_n")), "near")
    release(dealt)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far with each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialize(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        release(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, least_chars: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word (:func:`words`) of all texts.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least ``times`` its own, else
    null; its root is where forms lead, itself without one. A null text has no words; a row without a doc_id keeps its runs
    whole; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    vocabulary = materialize(words(docs, least_chars, least), "words")
    both = vocabulary.join(near_words(vocabulary), "word", "left")
    fits: Column = F.col("form_n") >= F.col("n") * times
    both = materialize(both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(fits, F.col(c)).alias(c) for c in ("form", "form_n")]), "forms")
    found = both.join(roots(both.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes FROM u),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) AS h FROM b, tab),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
      UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.cut UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.cut),
f AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS form, max(w.n) AS form_n FROM p JOIN w ON w.word = b GROUP BY a),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN f USING (word)),
s(word, root) AS (SELECT word, form FROM g WHERE form IS NOT NULL UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL),
e AS (SELECT s.word, s.root FROM s JOIN g ON g.word = s.root WHERE g.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM g LEFT JOIN e USING (word)
"""

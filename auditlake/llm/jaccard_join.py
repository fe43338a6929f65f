"""N-gram Jaccard join by signature trees: exact groups of documents with alike shingle sets.

1. Equal sets become one entry. 2. Candidates: two sets with Jaccard similarity t or more differ in few
tokens for their size, so when tokens are dealt to more segments than that, some segment is the same
in both. Each entry gives a key for each of its segments; entries that share no key cannot link. 3. Of
the entries that share a key, each is first verified against the pivot that it shares most keys with; a
key's pivot is another for each key. This settles large groups of near copies in linear time. 4. Keys whose
entries are still in several components get signature trees, traversed in pairs: nodes hold OR-combined
token bitmaps and size ranges, and a pair of nodes is left when its largest possible overlap is too small
or all its entries are in one component already. 5. The pairs of entries that remain are verified by
exact intersection: first the best few of each entry, then, with the components found so far, all. A block with
more such pairs than DENSE to an entry (many sets just below the threshold) emits none of them: its task gets the
sets, counts the intersections and emits a spanning forest of the links.

A key that a third of all entries share is only ever aggregated (map-side) or joined with one row. The
entries of a key above the size of a block are cut into blocks, and pairs of blocks become tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, beside, documents, map_batches, materialize, release
from .components import components

BLOCK = 512
LEAF = 8
BITS = 2048
FIRST = 4  # pairs of an entry and key that are verified first
DENSE = 32  # pairs to an entry of a block that are verified one by one; sets go to blocks with more
SMALL = 1000  # entries of small keys in a task
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, k: int, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words are one shingle, no words are none."""
    h = known.of(text)
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    total = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        total = _mix(total + h[j : j + n])
    return np.unique(total)


class Segments:
    """How many segments sets of a size have: classes of sizes such that sets that can link are in one or two
    neighbouring classes, and for each two neighbours more segments than linked sets can differ in.

    Empty segments say nothing and would join everything. A few segments are spare: a set with no more empty
    segments than those gives keys for the others only, and still shares one of them with each set that it links
    with. Only sets with more empty segments give keys for these too; two of them may need those.
    """

    def __init__(self, p: int, q: int):
        self.p, self.q, self.starts, self.known = p, q, [1], {}

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(class, number of segments, spare ones) for the pairs of classes that a set of n tokens takes part in."""
        if n not in self.known:
            while self.starts[-1] <= n or len(self.starts) < 3 or self.starts[-2] <= n or self.starts[-3] <= n:
                self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * self.q // self.p + 1))
            c = int(np.searchsorted(self.starts, n, "right")) - 1
            self.known[n] = [self._pair(lower) for lower in (c - 1, c) if lower >= 0]
        return self.known[n]

    def _pair(self, lower: int) -> tuple[int, int, int]:
        least = (self.q - self.p) * (self.starts[lower + 1] + self.starts[lower + 2] - 2) // (self.q + self.p) + 1
        empty = least * np.exp(-self.starts[lower] / least) if least > 1 else 0.0
        spare = int(np.ceil(empty + 4 * np.sqrt(empty)))
        return lower, least + spare, spare

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """A key for each segment of a set that has tokens, or for all."""
        mixed = _mix(tokens + _A)
        high, low = (tokens >> np.uint64(32)), mixed & np.uint64(0xFFFFFFFF)
        out = []
        for lower, m, spare in self.of(len(tokens)):
            at = ((high * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            a = np.bincount(at, low, m).astype(np.uint64)
            b = np.bincount(at, (mixed >> np.uint64(32)), m).astype(np.uint64)
            key = _mix(_mix(a + b * _B) + _mix(np.arange(m, dtype=np.uint64) + np.uint64((lower << 32) * int(_A) % 2**64)))
            full = np.bincount(at, minlength=m) > 0
            out.append(key[full] if m - full.sum() <= spare else key)
        return np.concatenate(out)


def _entries(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(doc_id, n, s1, s2, keys) of each row."""

    def task(batches):
        known, segments = WordHashes(), Segments(p, q)
        for batch in batches:
            n, s1, s2, keys = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                tokens = shingles(text, k, known)
                n.append(len(tokens))
                raw = tokens.tobytes()
                s1.append(xxhash.xxh3_64_intdigest(raw))
                s2.append(xxhash.xxh3_64_intdigest(raw, 1))
                keys.append(segments.keys(tokens).astype(np.int64) if len(tokens) else np.zeros(0, np.int64))
            ends = np.cumsum([0] + [len(x) for x in keys]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys or [np.zeros(0, np.int64)])))
            longs = [pa.array(np.array(x, np.uint64).astype(np.int64)) for x in (n, s1, s2)]
            yield pa.record_batch([batch.column("doc_id"), *longs, arrays], ["doc_id", "n", "s1", "s2", "keys"])

    return map_batches(docs, task, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[(tokens % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, s1, n, bits, tokens) of the wanted documents (id): an entry for each set of one."""
    rows = docs.join(beside(wanted.select(F.col("id").alias("doc_id"))), ["doc_id"], "left_semi")

    def task(batches):
        known = WordHashes()
        for batch in batches:
            sets = [shingles(t, k, known) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            s1 = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            cols = [
                batch.column("doc_id"),
                pa.array(np.array(s1, np.uint64).astype(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.record_batch(cols, ["id", "s1", "n", "bits", "tokens"])

    found = map_batches(rows, task, "id long, s1 long, n long, bits binary, tokens array<long>")
    return found.where("n > 0").dropDuplicates(["id", "s1"])


class Tree:
    """Entries in the order of their groups, sizes and bitmaps; above them leaves of LEAF entries, and nodes of two below.

    A level has for each node: sizes from and to, fewest bits of an entry, least and greatest group, and the bits ORed.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, groups: np.ndarray):
        packed = np.ascontiguousarray(bits).view(np.uint64)
        self.order = np.lexsort((packed[:, 0], n, groups))
        n, packed, groups = n[self.order], packed[self.order], groups[self.order]
        self.levels = [(n, n, np.bitwise_count(packed).sum(1).astype(np.int64), groups, groups, packed)]
        step = LEAF
        while len(self.levels[-1][0]) > 1 or len(self.levels) == 1:
            low, high, few, first, last, ors = self.levels[-1]
            at = np.arange(0, len(low), step)
            least, most = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((least(low, at), most(high, at), least(few, at), least(first, at), most(last, at), np.bitwise_or.reduceat(ors, at, 0)))
            step = 2

    def below(self, level: int, node: int) -> np.ndarray:
        step = LEAF if level == 1 else 2
        return np.arange(node * step, min((node + 1) * step, len(self.levels[level - 1][0])))


def overlap(a: tuple, b: tuple) -> np.ndarray:
    """By node of a and of b: the largest overlap that an entry of one can have with an entry of the other.

    Each bit of an entry that the other side lacks is a token at least that the two don't share.
    """
    (_, ahigh, afew, _, _, aor), (_, bhigh, bfew, _, _, bor) = a, b
    common = np.bitwise_count(aor[:, None] & bor[None]).sum(2).astype(np.int64)
    return np.minimum(ahigh[:, None] - np.maximum(afew[:, None] - common, 0), bhigh[None] - np.maximum(bfew[None] - common, 0))


def may_link(a: tuple, b: tuple, most: np.ndarray, p: int, q: int) -> np.ndarray:
    """By node of a and of b: whether groups, sizes and the largest overlap allow a link that joins two groups."""
    (alow, ahigh, _, afirst, alast, _), (blow, bhigh, _, bfirst, blast, _) = a, b
    one = (afirst == alast)[:, None] & (bfirst == blast)[None] & (afirst[:, None] == bfirst[None])
    fits = (q * bhigh[None] >= p * alow[:, None]) & (q * ahigh[:, None] >= p * blow[None])
    return ~one & fits & ((p + q) * most >= p * (alow[:, None] + blow[None]))


def pairs(left: Tree, right: Tree, p: int, q: int) -> np.ndarray:
    """Columns (place in left, place in right, largest overlap) of the entries that may link, by dual traversal from the roots."""
    found = [np.zeros((0, 3), np.int64)]
    stack = [(len(left.levels) - 1, np.array([0]), len(right.levels) - 1, np.array([0]))]
    while stack:
        i, u, j, v = stack.pop()
        a, b = tuple(c[u] for c in left.levels[i]), tuple(c[v] for c in right.levels[j])
        most = overlap(a, b)
        ok = may_link(a, b, most, p, q)
        if left is right:  # each pair once
            ok &= u[:, None] < v[None] if i == 0 else u[:, None] <= v[None]
        x, y = np.nonzero(ok)
        if i == j == 0:
            found.append(np.stack([left.order[u[x]], right.order[v[y]], most[x, y]], 1))
            continue
        for m, n in zip(u[x].tolist(), v[y].tolist()):
            stack.append((i - (i >= j), left.below(i, m) if i >= j else np.array([m]), j - (j >= i), right.below(j, n) if j >= i else np.array([n])))
    return np.concatenate(found)


def best(found: np.ndarray, most: int) -> np.ndarray:
    """For each left entry the pairs of the largest overlap, at most ``most``."""
    found = found[np.lexsort((-found[:, 2], found[:, 0]))]
    first = np.searchsorted(found[:, 0], found[:, 0])
    return found[np.arange(len(found)) - first < most]


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both)


def _sketched(pairs_: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """Of pairs (a, b): those that may link by their sizes and bitmaps (id, n, bits)."""
    joined = pairs_.join(sketches.toDF("a", "na", "x"), "a").join(sketches.toDF("b", "nb", "y"), "b")

    def look(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint64).reshape(len(batch), -1) for c in "xy")
            m, n = batch["na"].to_numpy(), batch["nb"].to_numpy()
            lost = [np.bitwise_count(u & ~v).sum(1).astype(np.int64) for u, v in ((x, y), (y, x))]
            most = np.minimum(m - lost[0], n - lost[1])
            yield batch.loc[(p + q) * most >= p * (m + n), ["a", "b"]]

    return joined.mapInPandas(look, "a long, b long").distinct()


def _verified(pairs_: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Of written pairs (a, b): those with sets that link. Only the sets in a pair shuffle."""
    ids = materialize(pairs_.select("a").union(pairs_.select("b")).distinct().toDF("id"), "ids")
    sets = sets.select("id", "tokens").join(beside(ids), ["id"], "left_semi")
    one, two = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs_.join(one, "a").join(two, "b")
    return joined.where(q * both >= p * (F.size("x") + F.size("y") - both)).select("a", "b")


def groups(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``.

    Words are runs without ASCII space, A-Z lowered; a document's set are its distinct k-word shingles, or all
    its words as one where they are fewer. Documents link when q * intersection >= p * union. A document
    without words, or a null text, has an empty set and links with nothing; so does a row without a doc_id, whose
    component is null. Rows of one doc_id are one document. An empty table gives no rows; other columns are
    ignored.
    """
    rows = documents(docs)
    entries = materialize(_entries(rows, k, p, q), "entries")
    slim = materialize(entries.select("doc_id", "n", "s1", "s2"), "slim")
    full = slim.where("n > 0 AND doc_id IS NOT NULL")
    same = materialize(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("id")), "same")
    copies = materialize(full.join(same, ["s1", "s2"]).where("doc_id > id").select("doc_id", "s1").distinct(), "copies")

    keyed = entries.where("n > 0 AND doc_id IS NOT NULL").join(beside(copies), ["doc_id", "s1"], "left_anti")
    keyed = keyed.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    order = F.col("id").bitwiseXOR(F.col("key"))  # puts the entries in another order for each key
    pivots = keyed.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high")).where("low < high")
    pivots = materialize(pivots.select("key", F.col("low").bitwiseXOR(F.col("key")).alias("b")), "pivots")
    hits = materialize(keyed.join(pivots, "key"), "hits")
    release(entries)

    stars = hits.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("shared"))
    wanted = materialize(hits.select("id").distinct(), "wanted")
    sets = materialize(_sets(rows, wanted, k), "sets")
    near = stars.where("a <> b").groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    sketches = sets.select("id", "n", "bits")
    links = materialize(_verified(materialize(_sketched(near, sketches, p, q), "pairs"), sets, p, q), "links")
    for most in (FIRST, None):
        group = components(links).toDF("id", "own")
        found, sure = _may_link(hits, group, sets, p, q, most)  # each id with all its sets
        links = links.union(materialize(_verified(found, sets, p, q), "links"))
        links = links if sure is None else links.union(sure)
    several = full.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low < high").select("doc_id")
    of_one = full.join(several, "doc_id", "left_semi").join(same, ["s1", "s2"]).select("doc_id", "id")  # texts of one doc_id
    final = components(links.union(of_one)).toDF("id", "component")
    same = same.join(final, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return slim.join(same, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _may_link(hits: DataFrame, group: DataFrame, sets: DataFrame, p: int, q: int, most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Distinct (a, b): entries of unlike components that share a key and may link by their bitmaps; and links (a, b).

    hits: (key, id); group: (id, own); sets: (id, n, bits, tokens). most: for each entry of a key so many at most. The
    links span those of blocks with more pairs than DENSE to an entry, which give no pairs; None where there are none.
    """
    sketches = sets.select("id", "n", "bits")
    placed = hits.select("key", "id").join(group, "id", "left").withColumn("own", F.coalesce("own", "id"))
    placed = materialize(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x")).where("low < high")
    # keys with the same entries are looked at once
    open_ = materialize(open_.groupBy("low", "high", "c", "x").agg(F.min("key").alias("key")).select("key", "c"), "open")
    members = materialize(placed.join(open_, "key"), "members")

    small = members.where(F.col("c") <= BLOCK).select("key", "id", "own")
    tasks = max(1, small.count() // SMALL)
    zero = F.lit(0).cast("long")
    one = small.select(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("g"), zero.alias("bi"), zero.alias("bj"), "key", F.lit(0).alias("side"), "id", "own")
    large = members.where(F.col("c") > BLOCK)
    big = large.groupBy("key", "own").agg(F.count("*").alias("c2")).where(F.col("c2") > BLOCK)
    large = large.join(beside(materialize(big, "big")), ["key", "own"], "left")
    # a component larger than a block has blocks of its own; pairs of those need no look
    cut = F.when(F.col("c2") > BLOCK, F.xxhash64("own", F.pmod(F.xxhash64("id"), F.ceil(F.col("c2") / BLOCK)))).otherwise(F.pmod(F.xxhash64("own"), F.ceil(F.col("c") / BLOCK)))
    large = large.select("key", "id", "own", cut.alias("block"), F.when(F.col("c2") > BLOCK, F.col("own")).alias("whole"))
    large = materialize(large, "large")
    blocks = large.groupBy("key", "block").agg(F.first("whole").alias("whole"))
    twos = blocks.toDF("key", "bi", "wi").join(blocks.toDF("key", "bj", "wj"), "key").where("bi <= bj AND NOT coalesce(wi = wj, false)").select("key", "bi", "bj")
    twos = materialize(twos, "blocks")
    side = lambda n, of, on: large.withColumnRenamed("block", on).join(of, ["key", on]).select(F.col("key").alias("g"), "bi", "bj", "key", F.lit(n).alias("side"), "id", "own")
    placed = one.union(side(0, twos, "bi")).union(side(1, twos.where("bi < bj"), "bj"))
    dealt = placed.join(sketches, "id")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "side"], kind="stable", ignore_index=True)
        ids, n, own = (part[c].to_numpy() for c in ("id", "n", "own"))
        bits = np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1)
        keys, sides = part["key"].to_numpy(), part["side"].to_numpy()
        out, dense = [np.zeros((0, 2), np.int64)], []
        starts = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
        for lo, hi in zip(starts, [*starts[1:], len(part)]):
            mid = lo + int((sides[lo:hi] == 0).sum())
            if lo == mid:
                continue
            left = Tree(n[lo:mid], bits[lo:mid], own[lo:mid])
            right, shift = (left, lo) if mid == hi else (Tree(n[mid:hi], bits[mid:hi], own[mid:hi]), mid)
            found = pairs(left, right, p, q)
            if most is not None:
                found = best(found, most)
            elif len(found) > DENSE * (hi - lo):
                dense.append((keys[lo], part["bi"].iloc[lo], part["bj"].iloc[lo]))
                continue
            out.append(np.stack([found[:, 0] + lo, found[:, 1] + shift], 1))
        at = np.concatenate(out)
        a, b = ids[at[:, 0]], ids[at[:, 1]]
        pairs_ = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "c": 0, "dense": False}).drop_duplicates()
        return pd.concat([pairs_, pd.DataFrame(dense, columns=["a", "b", "c"], dtype="int64").assign(dense=True)])

    found = dealt.groupBy("g", "bi", "bj").applyInPandas(search, "a long, b long, c long, dense boolean")
    if most is not None:
        return materialize(found.select("a", "b").distinct(), "pairs"), None
    found = materialize(found, "found")
    pairs_ = materialize(found.where("NOT dense").select("a", "b").distinct(), "pairs")
    blocks = found.where("dense").select(F.col("a").alias("key"), F.col("b").alias("bi"), F.col("c").alias("bj"))
    if blocks.isEmpty():
        return pairs_, None
    whole = placed.drop("g").join(blocks, ["key", "bi", "bj"]).join(sets.select("id", "n", "tokens"), "id")
    sure = whole.groupBy("key", "bi", "bj").applyInPandas(lambda part: _spanning(part, p, q), "a long, b long")
    return pairs_, materialize(sure.distinct(), "links")


def _spanning(part: pd.DataFrame, p: int, q: int) -> pd.DataFrame:
    """(a, b): a forest that spans the links between a block's sides, or within its only side, by exact intersections."""
    left, right = part[part["side"] == 0], part[part["side"] == 1]
    right = right if len(right) else left
    sizes = right["n"].to_numpy()
    flat = np.concatenate(right["tokens"].to_list())
    begins = np.cumsum(sizes) - sizes
    known, flat = np.unique(flat, return_inverse=True)
    ids = np.concatenate([left["id"], right["id"]])
    owns, root = np.unique(np.concatenate([left["own"], right["own"]]), return_inverse=True)  # what is one component already
    a, b = [], []
    for i, (n, tokens) in enumerate(zip(left["n"], left["tokens"])):
        open_ = np.flatnonzero(root[len(left) :] != root[i])
        if not len(open_):
            continue
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        mark = np.zeros(len(known), np.int64)
        mark[at[known[at] == tokens]] = 1
        both = np.add.reduceat(mark[flat], begins)
        for j in open_[(q * both >= p * (n + sizes - both))[open_]]:
            x, y = root[i], root[len(left) + j]
            if x != y:
                root[root == y] = x
                a.append(ids[i])
                b.append(ids[len(left) + j])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def keep_one(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id. Rows without a doc_id stay."""
    gone = groups(docs, k, p, q).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = materialize(gone, "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT rid, doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM
      (SELECT rid, doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS ra, b.rid AS rb, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS common
      FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT DISTINCT a, b FROM c JOIN n x ON x.rid = ra JOIN n y ON y.rid = rb WHERE 100 * common >= 90 * (x.n + y.n - common)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN m ON m.a = doc_id
"""

"""Embedding near-dedup with a product-quantised inverted index.

Unit vectors are dealt to coarse cells; what is left after the cell's centre is coded by subspace. The
centres and codebooks are fitted on a bounded sample, every vector is indexed. A query probes each cell whose
bisector with the query's own cell is within reach, so their number follows from geometry and not from a count. With the
whole radius as the reach no link can be lost. A neighbour at the radius is on the far side of a bisector only as far
as its offset points there, so less may do; how much is measured: some QUERIES vectors meet all others by brute
force, and the reach is the largest that any of their links needs, with a margin, and never below SPREAD standard deviations of
one component of an offset that is spread over the residuals' dimensions. Where fewer than SURE links are seen it is the
whole radius. A link that one of its two sides finds counts for both. In a cell, table look-ups give asymmetric distances;
they err by at most the code's own reconstruction error, which the index stores, so no link is lost there. Survivors
are ranked again by exact cosine in double precision. With as many cells as the root of the vectors, the share
of cells that a query probes falls as the table grows.

Identical vectors are one entry with a count. A cell with very many entries is cut into blocks of queries
times blocks of entries, so that no task holds it whole; a task emits counts and a spanning forest, never
all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, hash128, map_batches, materialize
from .components import components

BLOCK = 4096
BUCKET = 16_384
SPREAD = 4.0
QUERIES = 2000
SURE = 300
MARGIN = 1.1
MOST_CELLS = 4096


@dataclass
class Index:
    """Centres of the cells and, by subspace, the codewords of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    dims: float  # effective dimensions of the residuals
    share: float = 1.0  # the reach as a part of the radius

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between the centres."""
        return np.sqrt(np.maximum(_squares(self.centres, self.centres), 0))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and reconstruction error of unit vectors."""
        cell = _nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return cell, codes, np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Boolean, by vector and cell: whether the cell is within reach for vectors within the radius."""
        d = _squares(x, self.centres)
        own = d.argmin(1)
        return d - d[np.arange(len(x)), own][:, None] <= 2 * self.share * radius * self.apart[own] + 1e-9

    def asks(self, x: np.ndarray, own: np.ndarray, cell: np.ndarray, radius: float) -> np.ndarray:
        """Of the radius, what a vector of one cell needs as its reach to probe another: by rows of vectors and cells."""
        to = ((x - self.centres[cell]) ** 2).sum(1) - ((x - self.centres[own]) ** 2).sum(1)
        apart = self.apart[own, cell]
        return np.where(own == cell, 0.0, to / np.maximum(2 * radius * apart, 1e-300))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None]


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 2048], y).argmin(1) for i in range(0, len(x), 2048)])


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    means = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, means)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(means)
        np.add.at(sums, own, x)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return means


def fit(sample: np.ndarray, cells: int, subspaces: int = 8, codewords: int = 64, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    centres = _means(sample, cells, rng)
    rest = sample - centres[_nearest(sample, centres)]
    cuts = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int).tolist()
    spectrum = np.linalg.eigvalsh(np.atleast_2d(np.cov(rest.T, bias=True)))
    dims = float(spectrum.sum() ** 2 / np.maximum((spectrum**2).sum(), 1e-300)) if len(rest) > dim else 1.0
    return Index(centres, [_means(rest[:, a:b], min(codewords, 256), rng) for a, b in zip(cuts, cuts[1:])], cuts, max(dims, 1.0))


def _unit(col: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of a list column whose rows have one length and no nulls."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = np.asarray(col.flatten(), np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By node, the least node of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new[new]]
        if (new == root).all():
            return root
        root = new


def _search(part: pa.Table, index: Index, least: float, radius: float) -> pa.Table:
    """Links within some blocks: of queries with entries of one cell each. Vectors are read once for all blocks."""
    x = _unit(part["v"])
    ids, n, err, role, cell, home = (part[c].to_numpy() for c in ("id", "n", "err", "role", "cell", "home"))
    codes = np.zeros((len(x), len(index.books)), np.uint8)
    codes[role == 0] = np.frombuffer(b"".join(part["code"].drop_null().to_pylist()), np.uint8).reshape(-1, len(index.books))
    keys = part.select(["label", "cell", "ab", "ob"]).to_pandas()
    found = [[np.zeros(0, np.int64)] * 3]
    for at in keys.groupby(["label", "cell", "ab", "ob"], sort=False).indices.values():
        ask, own = at[role[at] == 1], at[role[at] == 0]
        if len(ask) and len(own):
            found.append(_links(x[ask], ids[ask], n[ask], home[ask], x[own], ids[own], n[own], codes[own], err[own], index, cell[own[0]], least, radius))
    return pa.table(dict(zip(("a", "b", "links"), map(np.concatenate, zip(*found)))))


def _links(q: np.ndarray, qid: np.ndarray, qn: np.ndarray, home: np.ndarray, y: np.ndarray, yid: np.ndarray, n: np.ndarray, codes: np.ndarray, err: np.ndarray, index: Index, cell: int, least: float, radius: float) -> list[np.ndarray]:
    """Columns (a, b, links) of a block: a forest that spans its links, and the number of links of each query, and of each entry
    that does not ask the query's own cell."""
    ids, at = np.unique(np.concatenate([qid, yid]), return_inverse=True)
    qat, yat = at[: len(qid)], at[len(qid) :]
    rest = q - index.centres[cell]
    links, back = np.zeros(len(q), np.int64), np.zeros(len(y), np.int64)
    root = np.arange(len(ids))
    for lo in range(0, len(q), 256):
        r, x = rest[lo : lo + 256], q[lo : lo + 256]
        far = np.zeros((len(r), len(y)))
        for m, book in enumerate(index.books):
            far += _squares(r[:, index.cuts[m] : index.cuts[m + 1]], book)[:, codes[:, m]]
        near = np.sqrt(np.maximum(far, 0)) <= radius + err[None] + 1e-9
        i, j = np.nonzero(near)
        if len(i) > 0.05 * near.size:
            linked = (x @ y.T >= least) & near
            i, j = np.nonzero(linked)
        else:
            ok = np.einsum("ij,ij->i", x[i], y[j]) >= least
            i, j = i[ok], j[ok]
        other = qid[lo + i] != yid[j]
        i, j = i[other], j[other]
        np.add.at(links, lo + i, n[j])
        deaf = index.asks(y[j], np.full(len(j), cell), home[lo + i], radius) > index.share + 1e-9
        np.add.at(back, j[deaf], qn[lo + i[deaf]])
        if len(i):
            root = _forest(len(ids), np.concatenate([np.arange(len(ids)), qat[lo + i]]), np.concatenate([root, yat[j]]))
    at_q = np.zeros(len(ids), np.int64)
    np.add.at(at_q, qat, links)
    np.add.at(at_q, yat, back)
    kept = (ids != ids[root]) | (at_q > 0)
    return [ids[kept], ids[root][kept], at_q[kept]]


def _measured(own: DataFrame, index: Index, least: float, radius: float) -> float:
    """Of the radius, the reach that links of some QUERIES vectors to all others need; 1 where fewer than SURE are seen."""
    spark = own.sparkSession
    step = max(1, own.count() // QUERIES)
    asked = own.where(F.pmod("h2", F.lit(step)) == 0).select("id", "label", "v").limit(2 * QUERIES).toArrow()
    q = _unit(asked["v"]) if len(asked) else np.zeros((0, index.centres.shape[1]))
    labels = asked["label"].to_pylist()
    sent = spark.sparkContext.broadcast((index, q, asked["id"].to_numpy(), labels))  # at most 2 * QUERIES vectors

    def meet(batches):
        at, y, ids, names = sent.value
        code = {name: i for i, name in enumerate(dict.fromkeys(names))}
        theirs, home = np.array([code[name] for name in names], np.int64), _nearest(y, at.centres)
        n, most = 0, 0.0
        for batch in batches:
            x = _unit(batch.column("v"))
            mine = np.array([code.get(name, -1) for name in batch.column("label").to_pylist()], np.int64)
            i, j = np.nonzero((x @ y.T >= least) & (mine[:, None] == theirs[None]) & (batch.column("id").to_numpy()[:, None] != ids[None]))
            own = _nearest(x, at.centres)
            need = np.minimum(at.asks(x[i], own[i], home[j], radius), at.asks(y[j], home[j], own[i], radius))
            n, most = n + len(need), max(most, float(need.max(initial=0)))
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "most": pa.array([most], pa.float64())})

    seen = map_batches(own.select("id", "label", "v"), meet, "n long, most double").agg(F.sum("n"), F.max("most")).first() if len(asked) else (0, 0.0)
    return min(1.0, MARGIN * seen[1]) if (seen[0] or 0) >= SURE else 1.0


def near_duplicates(vectors: DataFrame, least: float = 0.98, sample: int = 20_000, seed: int = 7, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine is ``least`` or more. Vectors that
    are null or zero, or hold null or non-finite components, and rows without a vec_id link with nothing, nor do
    vectors of unlike length. Repeated rows are vectors of their own that link with each other. sample: at most
    about so many distinct vectors fit the index, whatever their labels. An empty table gives no rows; other columns
    are ignored. Of n measured links none needs more than the reach, so about one in n of all can; ``exact``: the whole radius is the
    reach and none is lost, at the cost of probing up to half of the cells in tens of dimensions, most of them in hundreds.
    """
    number = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # floats travel as floats
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{number}>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", fine) & F.exists("v", lambda x: x != 0), F.lit(False))
    h1, h2 = hash128(F.col("label"), F.col("v"))
    rows = rows.withColumn("good", good).withColumns({"h1": h1, "h2": h2})
    same = rows.where("good").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    same = materialize(same.withColumn("dim", F.size("v")), "vectors")
    edges, links = None, None
    radius = float(np.sqrt(2 - 2 * least))
    for dim, count in same.groupBy("dim").count().collect():  # lengths in use: one, as a rule
        own = same.where(F.col("dim") == dim)
        step = -(-count // sample)
        fitted = own.where(F.pmod("h1", F.lit(step)) == 0).select("v").limit(2 * sample).toArrow()["v"]
        fitted = fitted if len(fitted) else own.select("v").limit(1).toArrow()["v"]
        index = fit(_unit(fitted), max(1, min(MOST_CELLS, round(count**0.5))), seed=seed)
        index.share = 1.0 if exact else max(min(1.0, SPREAD / np.sqrt(index.dims)), _measured(own, index, least, radius))
        found = materialize(_linked(own, index, least, radius, number), "links")
        edges = found.select("a", "b") if edges is None else edges.union(found.select("a", "b"))
        links = found if links is None else links.union(found)
    if edges is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    links = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of = components(edges).toDF("rep", "component")
    same = same.select("h1", "h2", F.col("id").alias("rep"), "n").join(links, "rep", "left").join(of, "rep", "left")
    same = same.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    found = rows.select("id", "good", "h1", "h2").join(same, F.col("good") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _linked(own: DataFrame, index: Index, least: float, radius: float, number: str) -> DataFrame:
    """(a, b, links): spanning edges of the linked vectors; links adds up over the rows of one a."""
    spark = own.sparkSession
    sent = spark.sparkContext.broadcast((index.centres, index.books, index.cuts, index.dims, index.share))  # at most MOST_CELLS centres
    schema = f"id long, n long, label string, v array<{number}>, role int, cell int, home int, code binary, err double"

    def deal(batches):
        at = Index(*sent.value)
        for batch in batches:
            x = _unit(batch.column("v"))
            cell, codes, err = at.encode(x)
            for role, rows, c in ((0, np.arange(len(x)), cell), (1, *np.nonzero(at.probes(x, radius)))):
                own = [batch.column(k).take(pa.array(rows)) for k in ("id", "n", "label", "v")]
                code = pa.array([codes[i].tobytes() for i in rows], pa.binary()) if role == 0 else pa.nulls(len(rows), pa.binary())
                kinds = [pa.array(np.full(len(rows), role, np.int32)), pa.array(c.astype(np.int32)), pa.array(cell[rows].astype(np.int32)), code, pa.array(err[rows] if role == 0 else np.zeros(len(rows)))]
                yield pa.record_batch([*own, *kinds], ["id", "n", "label", "v", "role", "cell", "home", "code", "err"])

    dealt = materialize(map_batches(own.select("id", "n", "label", "v"), deal, schema), "dealt")
    size = dealt.groupBy("label", "cell").agg(*[F.ceil(F.count_if(F.col("role") == r) / BLOCK).cast("int").alias(k) for r, k in ((0, "nown"), (1, "nask"))])
    size = materialize(size.where("nown > 0 AND nask > 0"), "sizes")  # a row for each label and cell
    placed = dealt.join(beside(size), ["label", "cell"])
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    ask = F.col("role") == 1
    placed = placed.withColumn("ab", F.explode(F.when(ask, F.array(mine("nask"))).otherwise(every("nask"))))
    placed = placed.withColumn("ob", F.explode(F.when(ask, every("nown")).otherwise(F.array(mine("nown")))))
    placed = placed.select("id", "n", "label", "v", "role", "cell", "home", "code", "err", "ab", "ob")
    search = lambda part: _search(part, Index(*sent.value), least, radius)
    buckets = max(1, dealt.count() // BUCKET)  # many small blocks to a task's call, whole ones each
    return placed.groupBy(F.pmod(F.xxhash64("label", "cell", "ab", "ob"), F.lit(buckets)).alias("bucket")).applyInArrow(search, "a long, b long, links long")


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.rid, a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT rid, count(*) AS n FROM p GROUP BY rid),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM v LEFT JOIN n USING (rid) LEFT JOIN c ON c.a = v.vec_id
"""

"""Exact top-k inner products by best-first search in M-trees.

Inner product is no metric, but with one more coordinate, sqrt(M^2 - |x|^2) where M is the
largest norm in a tree (0 for the query), the nearest neighbours by Euclidean distance are
those of the largest inner product: d^2 = |q|^2 + M^2 - 2 q.x.

Vectors are dealt to trees by their nearest pivot (a bounded sample); cells over ``PER_TREE``
vectors are split, so a tree has a bounded size whatever the skew. Inner nodes are pages of
entries with a routing vector, covering radius and distance to the parent; leaves are pages
of vectors with their distances to the parent. A search goes best first for a block of queries
at once: a page waits under the least bound of the queries that still want it, each page is
opened once a block, and an entry is computed only for those queries whose stored distances
don't exclude it by the triangle inequality. Scores are exact whole numbers: products of doubles
where no sum can pass 2^53, Python's integers otherwise; bounds in floating point have slack. A tree
or query with components beyond 2^400 is scanned: scaled estimates with error bounds choose what is
multiplied as integers. Between tasks a score travels as a text that sorts as the number does.
Trees lie in the shared folder; queries come in blocks of bounded size, each sent to all trees,
and the best of each tree are merged. With few trees a block's queries are parted as well.
"""

from __future__ import annotations

import heapq
import io
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

FANOUT = 16
LEAF = 256
PER_TREE = 20_000
PIVOTS = 64
QUERY_BLOCK = 16_384
#: Queries that search a tree together.
GROUP = 64
#: Beyond this, squares could overflow, and a tree is read row by row.
WILD = 2.0**400
_COMPLEMENT = str.maketrans("0123456789", "9876543210")


def dyadic(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) / scale of each component, for vectors without null or non-finite ones.

    ``scale`` is a power of two, so these are exact doubles for any finite component, even where
    scale * x is beyond the largest double: from 2^44 on a double is a multiple of 1/256 already.
    """
    if scale < 1 or scale & (scale - 1) or scale > 256:
        raise ValueError("scale must be a power of two up to 256")
    x = F.col("embedding")
    wide = F.transform(x, lambda y: y.cast("double"))
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(wide, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    cut_off = F.transform(wide, lambda y: F.when(F.abs(y) < 2.0**44, F.floor(y * scale).cast("double") / scale).otherwise(y))
    return vectors.select("vec_id", F.when(fine, cut_off).alias("v")).where("v is not null and vec_id is not null")


def _distance(points: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = points - p
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _whole(x: np.ndarray, scale: int) -> list[list[int]]:
    """scale * x of each component, as Python's integers."""
    return [[int(v * scale) if abs(v) < 2.0**52 else int(v) * scale for v in r] for r in x.tolist()]


def _scores(rows: np.ndarray, queries: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of scale * rows and scale * queries, exact: doubles if no partial sum can pass 2^53, else Python's integers."""
    most = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1] * scale * scale
    if most < 2.0**53:
        return (rows @ queries.T) * (scale * scale)
    asked = _whole(queries, scale)
    return np.array([[sum(map(operator.mul, r, q)) for q in asked] for r in _whole(rows, scale)], dtype=object).reshape(len(rows), len(queries))


def _paired(rows: np.ndarray, queries: np.ndarray, scale: int) -> np.ndarray:
    """The same for pairs: row i with query i."""
    most = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1] * scale * scale
    if most < 2.0**53:
        return np.einsum("ij,ij->i", rows, queries) * (scale * scale)
    return np.array([sum(map(operator.mul, r, q)) for r, q in zip(_whole(rows, scale), _whole(queries, scale), strict=True)], dtype=object)


def sortable(score: int) -> str:
    """A text that sorts as the number does, whatever its length."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(_COMPLEMENT)


class MTree:
    """Bulk-loaded tree; ``entries[i]`` is a page: routing rows, radii, parent distances, children or a leaf's rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.computed = self.skipped = self.products = 0
        self.pages: list[tuple] = []
        if np.abs(self.vectors).max(initial=0) > WILD:
            self.points, self.root_point, self.top, self.root = self.vectors[:, :0], np.zeros(0), math.inf, 0
            return
        norms = (self.vectors**2).sum(axis=1)
        self.top = float(norms.max())
        self.points = np.hstack([self.vectors, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        root = self.points.mean(axis=0)
        self.root_point = root
        self.root = self._build(np.arange(len(ids)), root)

    def _build(self, rows: np.ndarray, parent: np.ndarray) -> int:
        """Number of the page that holds these rows under the routing vector ``parent``."""
        at = len(self.pages)
        self.pages.append(())
        if len(rows) > LEAF:
            # routing vectors: one far from those taken before, again and again
            near = _distance(self.points[rows], parent)
            picked = [int(near.argmax())]
            owner, near = np.zeros(len(rows), dtype=np.int64), _distance(self.points[rows], self.points[rows[picked[0]]])
            while len(picked) < min(FANOUT, math.ceil(len(rows) / LEAF) + 1) and near.max() > 0:
                picked.append(int(near.argmax()))
                d = _distance(self.points[rows], self.points[rows[picked[-1]]])
                owner, near = np.where(d < near, len(picked) - 1, owner), np.minimum(d, near)
            if len(picked) > 1:
                routing = self.points[rows[picked]]
                radii = np.array([near[owner == k].max() for k in range(len(picked))])
                children = [self._build(rows[owner == k], routing[k]) for k in range(len(picked))]
                self.pages[at] = (False, routing, radii, _distance(routing, parent), np.array(children))
                return at
        # a leaf; equal vectors, which no routing can tell apart, share one whatever their number
        self.pages[at] = (True, rows, _distance(self.points[rows], parent))
        return at

    def scan(self, queries: np.ndarray, own: np.ndarray, k: int, scale: int) -> list[list[tuple[int, int]]]:
        """``search`` for components of any size: estimates of scaled vectors with bounds on their error, then exact integers for what may count."""
        down = lambda x: np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0))[1]))
        rows, asked, out = down(self.vectors), down(queries), []
        size = np.sqrt((rows**2).sum(axis=1))
        for q in range(len(queries)):
            # rounding of n products and sums, and of what scaling made vanish
            rough, radius = rows @ asked[q], 1e-12 * rows.shape[1] * size * math.sqrt((asked[q] ** 2).sum()) + 1e-290
            other = np.flatnonzero(self.ids != own[q])
            if len(other) > k:
                low = (rough - radius)[other]
                other = other[(rough + radius)[other] >= np.partition(low, len(low) - k)[len(low) - k]]
            exact = _scores(self.vectors[other], queries[q : q + 1], scale)[:, 0] if len(other) else []
            self.products += len(other)
            out.append(heapq.nlargest(k, [(int(s), -int(i)) for s, i in zip(exact, self.ids[other], strict=True)]))
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, scale: int = 1) -> list[list[tuple[int, int]]]:
        """For each query the ``k`` best ``(score, -id)``, largest first, without rows of its ``own`` id."""
        n, unit = len(queries), float(scale * scale)
        if self.top == math.inf or np.abs(queries).max(initial=0) > WILD:
            return self.scan(queries, own, k, scale)
        square = (queries**2).sum(axis=1) + self.top
        slack = 1e-6 * (1 + np.sqrt(square))
        asked = np.hstack([queries, np.zeros((n, 1))])
        best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        #: Largest distance at which a row can still count; ties go to smaller ids, so they count.
        reach = np.full(n, np.inf)
        low = np.full(n, -np.inf)  # scores below can't count

        def offer(at: np.ndarray, rows: np.ndarray, scores: np.ndarray, may: np.ndarray) -> None:
            """Merge scores (rows by queries ``at``) where ``may`` holds."""
            may = may & (scores >= low[at][None, :])
            for j in np.flatnonzero(may.any(axis=0)).tolist():
                q, of = int(at[j]), scores[:, j]
                fit = np.flatnonzero(may[:, j])
                if len(fit) > 4 * k and of.dtype != object:
                    # far more than can count: what is below the k-th besides the query's own goes
                    fit = fit[self.ids[rows[fit]] != own[q]]
                    if len(fit) > k:
                        fit = fit[of[fit] >= np.partition(of[fit], len(fit) - k)[len(fit) - k]]
                met = [(int(x), -i) for x, i in zip(of[fit].tolist(), self.ids[rows[fit]].tolist(), strict=True) if i != own[q]]
                best[q] = heapq.nlargest(k, best[q] + met)
                if len(best[q]) == k:
                    worst = best[q][-1][0]
                    low[q] = np.nextafter(float(worst), -np.inf)
                    reach[q] = math.sqrt(max(0.0, square[q] - 2.0 * (float(worst) / unit))) + slack[q]

        first = _distance(asked, self.root_point)
        queue: list[tuple] = [(0.0, self.root, np.arange(n), first, np.zeros(n))]
        while queue:
            _, page, at, d, bound = heapq.heappop(queue)
            live = bound <= reach[at]
            if not live.any():
                continue
            at, d = at[live], d[live]
            entry = self.pages[page]
            if entry[0]:
                may = np.abs(d[None, :] - entry[2][:, None]) <= reach[at][None, :]
                self.skipped += int(may.size - may.sum())
                self.computed += int(may.sum())
                some = np.flatnonzero(may.any(axis=1))
                if len(some):
                    rows, may = entry[1][some], may[some]
                    wanted = int(may.sum())
                    if 4 * wanted < may.size:
                        # few pairs are left: only these are multiplied
                        r, c = np.nonzero(may)
                        found = _paired(self.vectors[rows[r]], queries[at[c]], scale)
                        scores = np.zeros(may.shape, dtype=found.dtype)
                        scores[r, c] = found
                        self.products += wanted
                    else:
                        scores = _scores(self.vectors[rows], queries[at], scale)
                        self.products += may.size
                    offer(at, rows, scores, may)
            else:
                _, routing, radii, parent, children = entry
                may = np.abs(d[None, :] - parent[:, None]) - radii[:, None] <= reach[at][None, :]
                self.skipped += int(may.size - may.sum())
                self.computed += int(may.sum())
                for e in np.flatnonzero(may.any(axis=1)).tolist():
                    who = at[may[e]]
                    found = _distance(asked[who], routing[e])
                    bound = np.maximum(found - radii[e], 0)
                    heapq.heappush(queue, (float(bound.min()), int(children[e]), who, found, bound))
        return best

    def dump(self) -> bytes:
        out = io.BytesIO()
        flat = {"ids": self.ids, "vectors": self.vectors, "points": self.points, "root_point": self.root_point, "top": np.array([self.top])}
        for i, p in enumerate(self.pages):
            for j, x in enumerate(p[1:]):
                flat[f"p{i}_{int(p[0])}_{j}"] = x
        np.savez(out, **flat)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> MTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as flat:
            tree.ids, tree.vectors, tree.points, tree.root_point = (flat[c] for c in ("ids", "vectors", "points", "root_point"))
            tree.top = float(flat["top"][0])
            pages: dict[int, dict[int, np.ndarray]] = {}
            leaf: dict[int, bool] = {}
            for name in flat.files:
                if name[0] == "p" and name[1].isdigit():
                    i, kind, j = map(int, name[1:].split("_"))
                    pages.setdefault(i, {})[j] = flat[name]
                    leaf[i] = bool(kind)
        tree.pages = [(leaf[i], *[pages[i][j] for j in range(len(pages[i]))]) for i in range(len(pages))]
        tree.root = tree.computed = tree.skipped = tree.products = 0
        return tree


def build(vectors: DataFrame, path: str) -> None:
    """Write the trees over ``vec_id, v`` to ``path``, a row a tree: ``dims, tree``."""
    pivots = {}
    for r in vectors.orderBy(F.xxhash64("vec_id", "v")).limit(PIVOTS).collect():  # a bounded sample
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    cells = {n: np.array(p, dtype=np.float64) for n, p in pivots.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).to_pylist()
            cell = []
            for x in v:
                p = cells.get(len(x))
                cell.append(-1 if p is None else int((((p - np.array(x, dtype=np.float64)) ** 2).sum(axis=1)).argmin()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, type=pa.int32()), pa.array([len(x) for x in v], type=pa.int32())], names=["vec_id", "v", "cell", "dims"])

    placed = cut(vectors.mapInArrow(assign, "vec_id long, v array<double>, cell int, dims int"))
    # small cells share a tree, large ones are split by hash: about PER_TREE vectors each
    sizes = {(r["dims"], r["cell"]): r["count"] for r in placed.groupBy("dims", "cell").count().collect()}  # PIVOTS rows
    first, tree_of, number = 0, {}, 0
    for key, n in sorted(sizes.items()):
        parts = math.ceil(n / PER_TREE)
        if parts == 1 and first and first + n <= PER_TREE and tree_of and last[0] == key[0]:
            first += n
        else:
            number += 1 if tree_of else 0
            first = n if parts == 1 else 0
        tree_of[key] = (number, parts)
        number += parts - 1
        last = key
    base, split = F.lit(0), F.lit(1)
    for (dims, cell), (start, parts) in tree_of.items():
        here = (F.col("dims") == dims) & (F.col("cell") == cell)
        base, split = F.when(here, start).otherwise(base), F.when(here, parts).otherwise(split)
    dealt = placed.withColumn("tree", base + F.pmod(F.xxhash64("vec_id", "v"), split))

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        v = table.column("v").combine_chunks()
        flat = (v.flatten() if isinstance(v, pa.ListArray) else pa.concat_arrays([c.flatten() for c in v.chunks])).to_numpy(zero_copy_only=False)
        tree = MTree(table.column("vec_id").to_numpy(), flat.reshape(-1, dims))
        return pa.table({"dims": pa.array([dims], type=pa.int32()), "tree": pa.array([tree.dump()], type=pa.binary())})

    dealt.groupBy("tree").applyInArrow(grow, "dims int, tree binary").write.parquet(path)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``.

    Defined results: vectors that are null, empty or hold a null or non-finite component take
    no part, nor do rows without an id; a vector is compared with those of its own length; all
    rows of the query's id are its own and no candidates; repeated query rows are answered
    once, repeated candidate rows count each; ties go to the smaller id; fewer candidates give
    fewer rows; an empty table gives an empty result; other columns are not read. Ranks follow
    the exact scores; a score that a long can't hold is shown as the nearest long.
    """
    spark, path = vectors.sparkSession, shared_dir(vectors.sparkSession)
    schema = "query_id long, vec_id long, score long, sort string"
    valid = cut(dyadic(vectors, scale))
    queries = valid.where(F.col("vec_id") % every == 0).distinct()
    blocks = math.ceil(queries.count() / QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    build(valid, f"{path}/trees")
    trees = spark.read.parquet(f"{path}/trees")
    # with fewer trees than cores, a block's queries are parted: a task is a tree and a part
    parts = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, trees.count())))
    asks = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(F.xxhash64("tree", "part")) if parts > 1 else trees.withColumn("part", F.lit(0))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()  # about QUERY_BLOCK rows
        ids = rows.column("vec_id").to_numpy()
        asked = spark.sparkContext.broadcast((ids, [np.array(x, dtype=np.float64) for x in rows.column("v").to_pylist()]))

        def search(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            ids, asks = asked.value
            sizes = np.array([len(q) for q in asks])
            for batch in batches:
                for dims, data, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    mine = np.flatnonzero((sizes == dims) & (np.arange(len(ids)) % parts == part))
                    tree = MTree.load(data.as_py()) if len(mine) else None
                    for lo in range(0, len(mine), GROUP):
                        some = mine[lo : lo + GROUP]
                        out = [(i, -n, s) for i, found in zip(ids[some].tolist(), tree.search(np.array([asks[q] for q in some]), ids[some], k, scale), strict=True) for s, n in found]
                        if out:
                            shown = [max(-(2**63), min(2**63 - 1, s)) for _, _, s in out]
                            columns = [pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), pa.array(shown, pa.int64()), pa.array([sortable(s) for _, _, s in out])]
                            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "sort"])

        asks.select("dims", "tree", "part").mapInArrow(search, schema).write.parquet(f"{path}/found/{b}")
        asked.unpersist()
    found = spark.read.schema(schema).parquet(*[f"{path}/found/{b}" for b in range(blocks)])
    order = Window.partitionBy("query_id").orderBy(F.desc("sort"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 5
"""

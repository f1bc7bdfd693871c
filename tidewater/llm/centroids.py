"""Centroid clustering by a float32 screen with rigorous rounding-error intervals.

Components are whole numbers, floor(256 x). The nearest centroid has the least
|c|^2 - 2 x.c. A task computes x.c for a block of vectors and all centroids as one float32
matrix product. In whatever order the n products are added, with or without fused steps, and
with x and c rounded to float32 first, the result differs from x.c by at most
(n + 2) u / (1 - (n + 2) u) |x| |c|, u = 2^-24 (Cauchy-Schwarz bounds the sum of absolute
products). So each distance lies in a known interval. A centroid whose interval begins above
the least upper end can't be nearest; where one is left, it is the answer. Overlapping
intervals are computed anew in exact integers, ties go to the lowest number.

Float32 overflow makes an interval infinite, which only sends the vector to the exact part.
There, 64-bit integers serve while no sum can pass 2^62, Python's integers beyond.

Spark deals the vectors; a task sends for each centroid and component its exact partial sum as
base-2^32 digits, added up by Spark, so that k * n digits of bounded number reach the driver a
round, however many vectors there are. No task ever holds a cluster. Every round reads the
table anew; nothing is cached.

Defined results: vectors that are null, of another length, or hold null or non-finite
components take no part; repeated rows each count and give a row; among equal hashes (repeated
ids) the smaller vector, component by component, comes first; a null id is kept, but is a seed
only after all others; fewer vectors than ``k`` give fewer centroids; an empty table gives no
rows; distances and sums beyond 2^63 - 1 are given as 2^63 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

BLOCK = 8192
#: Below this, 64 squares of differences can't pass 2^62.
SMALL = 2.0**27
TOP = 2**63 - 1
_U = 2.0**-24


def whole(column: pa.Array, size: int, scale: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that take part, and floor(scale * x) of their components as whole doubles."""
    column = column.cast(pa.list_(pa.float64())) if not pa.types.is_float64(column.type.value_type) else column
    length = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(length == size)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = flat.astype(np.float64).reshape(-1, size) * scale
    fine = np.isfinite(x).all(axis=1)
    return rows[fine], np.floor(x[fine])


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


class Screen:
    """Nearest of fixed centroids, given as whole doubles or Python integers, one list each."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.k, self.n = len(centroids), len(centroids[0])
        with np.errstate(over="ignore"):
            self.double = np.array([[float(v) if abs(v) < 2**1023 else np.inf for v in c] for c in centroids])
            self.small = np.abs(self.double).max(axis=1) < SMALL
            self.whole = np.where(self.small[:, None], self.double, 0).astype(np.int64)
            self.single = self.double.astype(np.float32).T.copy()
            self.square = (self.double**2).sum(axis=1)
        g = (self.n + 2) * _U
        # norms, squares and the last sums are doubles; 2^-40 covers their rounding many times over
        self.slack = 2 * g / (1 - g) * (1 + 2.0**-30)
        self.norm = np.sqrt(self.square) * (1 + 2.0**-40)
        #: Pairs of vector and centroid computed exactly, and all pairs.
        self.recomputed = self.pairs = 0

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """True for each centroid whose interval reaches down to the least upper end."""
        with np.errstate(over="ignore", invalid="ignore"):
            dots = (x.astype(np.float32) @ self.single).astype(np.float64)
            norm = np.sqrt((x**2).sum(axis=1)) * (1 + 2.0**-40)
            middle = self.square - 2 * dots
            radius = self.slack * norm[:, None] * self.norm + 2.0**-40 * (self.square + 2 * np.abs(dots))
            low, high = middle - radius, middle + radius
            wild = ~(np.isfinite(low) & np.isfinite(high))
            low, high = np.where(wild, -np.inf, low), np.where(wild, np.inf, high)
        return low <= high.min(axis=1, keepdims=True)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and its exact squared distance (long, or integers as objects)."""
        row, number = np.nonzero(self.shortlist(x))
        several = (np.bincount(row, minlength=len(x)) > 1)[row]
        self.pairs += len(x) * self.k
        self.recomputed += int(several.sum())
        small = (np.abs(x).max(axis=1) < SMALL)[row] & self.small[number]
        # the winner's distance is wanted exactly, too; whole squares are cheap beside the screen
        d = np.empty(len(row), dtype=np.int64 if small.all() else object)
        for at in np.array_split(np.flatnonzero(small), max(1, len(row) * self.n >> 22)):
            d[at] = ((x[row[at]].astype(np.int64) - self.whole[number[at]]) ** 2).sum(axis=1)
        for i in np.flatnonzero(~small).tolist():
            d[i] = sum((int(a) - b) ** 2 for a, b in zip(x[row[i]].tolist(), self.exact[number[i]], strict=True))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if not several.any():
            return number, d
        best = np.minimum.reduceat(d, first) if d.dtype != object else np.array([min(d[a:b]) for a, b in zip(first, [*first[1:], len(d)], strict=True)], dtype=object)
        hit = np.flatnonzero(d == best[row])
        hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        return number[hit], best


def _digits(s: int) -> Iterator[tuple[int, int]]:
    """Base-2^32 digits of an integer, each with its sign."""
    sign, s, place = (-1 if s < 0 else 1), abs(s), 0
    while s:
        if digit := s & 0xFFFFFFFF:
            yield place, sign * digit
        s, place = s >> 32, place + 1


def _blocks(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            rows, x = whole(part.column(1), size, scale)
            if len(rows):
                yield part.column(0).take(pa.array(rows)), x


def _sums(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: the exact floor of each cluster's mean; an empty cluster keeps its centroid."""
    n = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, total = Screen(centroids), {}
        for _, x in _blocks(batches, n, scale):
            cluster, _ = screen.nearest(x)
            tame = np.abs(x).max() < 2.0**47
            whole_x = x.astype(np.int64) if tame else _integers(x)
            for c in np.unique(cluster).tolist():
                mine = whole_x[cluster == c]
                count, sums = total.get(c, (0, [0] * n))
                total[c] = (count + len(mine), [a + int(b) for a, b in zip(sums, mine.sum(axis=0).tolist(), strict=True)])
        out = [(c, j, place, digit) for c, (count, sums) in total.items() for j, s in enumerate([*sums, count]) for place, digit in _digits(s)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "j", "place", "digit"])

    summed = vectors.mapInArrow(run, "cluster int, j int, place int, digit long").groupBy("cluster", "j", "place").agg(F.sum("digit").alias("digit"))
    sums: dict[int, list[int]] = {}
    for c, j, place, digit in summed.collect():
        sums.setdefault(c, [0] * (n + 1))[j] += digit << 32 * place
    return [[s // sums[c][n] for s in sums[c][:n]] if c in sums else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))

    id_type = rows.schema["vec_id"].dataType.simpleString()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, size, scale):
            yield pa.RecordBatch.from_arrays([ids, pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "x"])

    named = rows.mapInArrow(fit, f"vec_id {id_type}, x array<double>")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = named.orderBy(hashed.asc_nulls_last(), "x").limit(k)
    centroids = [[int(v) for v in r.x] for r in first.collect()]
    schema = f"vec_id {id_type}, cluster int, distance long"
    if not centroids:
        empty = spark.createDataFrame([], schema)
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = _sums(rows, centroids, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for ids, x in _blocks(batches, size, scale):
            number, d = screen.nearest(x)
            if d.dtype == object:
                d = [min(v, TOP) for v in d]
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    path = shared_dir(spark)
    rows.mapInArrow(assign, schema).write.parquet(path)
    done = spark.read.schema(schema).parquet(path)
    per = {c: int(s) for c, s in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    every = min(sum(per.values()), TOP)
    table = [(c, min(s, TOP), every, sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(per.items())]
    # at most k rows
    clusters = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """The same in exact SQL: 128-bit products and floor divisions."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2])::HUGEINT * (p[1] - p[2])))"
    ctes = [f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT {k}))"]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'d': {distance}, 'c': c.cluster}}) AS best FROM kept v, c{i} c GROUP BY v.r)""")
        if i < rounds:
            ctes.append(f"""m{i} AS MATERIALIZED (SELECT cluster, list(m ORDER BY j) AS x FROM (SELECT cluster, j, (s - ((s % n) + n) % n) // n AS m FROM (
  SELECT best.c AS cluster, j, sum(x[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {size + 1}) t(j) GROUP BY ALL)) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda y: y::VARCHAR), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.cluster = best.c"""


ORACLE_SQL = _oracle()

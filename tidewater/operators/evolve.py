"""Selection of strategies: dominance ranks, crowding, survivors, quarantine, life-cycle."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import written


#: Objectives of a genome, all better when larger (a drawdown is negative).
OBJECTIVES = ("sharpe", "calmar", "win_rate", "max_drawdown", "thrift")

#: Most points that are peeled at once, and the most in a block of larger sets.
SMALL, BLOCK = 20_000, 4096


def _values(pdf: pd.DataFrame, objectives: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Objectives (missing ones are -inf), which rows have all, and an order in which no row follows one that it dominates."""
    x = pdf[list(objectives)].to_numpy(dtype=float)
    x = np.where(np.isfinite(x), x, -np.inf)
    return x, np.isfinite(x).all(axis=1), np.lexsort(x.T[::-1])[::-1]


def _peeled(x: np.ndarray, whole: np.ndarray, order: np.ndarray, known: np.ndarray, fronts: np.ndarray) -> np.ndarray:
    """Fronts of the points ``x``, beside points ``known`` (whole ones) whose ``fronts`` are given."""
    n = len(known)
    seen, best = np.empty((x.shape[1], n + len(x))), np.empty(n + len(x), dtype=np.int32)  # a row for each objective
    seen[:, :n], best[:n] = known.T, fronts
    out = np.zeros(len(x), dtype=np.int32)
    for i in order:
        least, more = seen[0, :n] >= x[i, 0], seen[0, :n] > x[i, 0]
        for column, v in zip(seen[1:, :n], x[i, 1:], strict=True):
            least &= column >= v
            more |= column > v
        out[i] = 1 + best[:n][least & more].max(initial=0)
        if whole[i]:
            seen[:, n], best[n], n = x[i], out[i], n + 1
    return out


def _enough(x: np.ndarray, front: np.ndarray, among: np.ndarray, which: list[int]) -> np.ndarray:
    """Those of the points ``among`` that no other one covers: as good in the objectives ``which``, in a front as late; one of equals stays."""
    y = np.vstack([front[among].astype(float), x[among][:, which].T])
    order = np.lexsort(y[::-1])[::-1]  # no point follows one that it covers, but for equals
    y, kept = y[:, order], np.zeros(0, dtype=np.int64)
    for k in range(0, len(order), 256):
        new = np.arange(k, min(k + 256, len(order)))
        for old in (kept, None):
            left = new if old is None else old
            covers = np.ones((len(left), len(new)), dtype=bool)
            for column in y:
                covers &= column[left][:, None] >= column[new]
            new = new[~(np.triu(covers, 1) if old is None else covers).any(axis=0)]
        kept = np.concatenate([kept, new])
    return among[order[kept]]


def _shadows(x: np.ndarray, front: np.ndarray, whole: np.ndarray) -> dict[int, np.ndarray]:
    """For every set of objectives (as bits, but for all of them) the points that decide what the block does to one behind it in all others."""
    d = x.shape[1]
    found = {(1 << d) - 1: np.flatnonzero(whole)}
    for bits in sorted(range((1 << d) - 1), key=int.bit_count, reverse=True):
        more = next(bits | 1 << j for j in range(d) if not bits >> j & 1)
        found[bits] = _enough(x, front, found[more], [j for j in range(d) if bits >> j & 1])
    del found[(1 << d) - 1]
    return found


def _blocks(points: DataFrame, n: int, objectives: tuple[str, ...]) -> tuple[DataFrame, pd.DataFrame]:
    """The points with ``_b``, and the blocks: ``_b``, their ``cell`` (a rank for each objective), ``part`` and ``level``.

    Cells lie between quantiles; a cell of more than ``BLOCK`` points is cut in an order in which no
    row follows one that it dominates. Points of equal level in different blocks can't dominate each other.
    """
    d = len(objectives)
    grid = int(np.clip(round((8 * n / BLOCK) ** (1 / d)), 2, 6))
    real = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")) for c in objectives}
    cuts = points.agg(*[F.percentile_approx(x, F.array(*[F.lit(k / grid) for k in range(1, grid)])).alias(c) for c, x in real.items()]).first()
    rank = {c: sum((F.coalesce((x >= F.lit(v)).cast("long"), F.lit(0)) for v in sorted(set(cuts[c] or []))), F.lit(0).cast("long")) for c, x in real.items()}
    cell = sum((r * F.lit(grid**j) for j, r in enumerate(rank.values())), F.lit(0).cast("long"))
    w = Window.partitionBy("_cell").orderBy(*[x.desc_nulls_last() for x in real.values()], "id")
    out = written(points.withColumn("_cell", cell).withColumn("_part", F.floor((F.row_number().over(w) - 1) / BLOCK)).withColumn("_b", F.col("_cell") + F.col("_part") * F.lit(grid**d)).drop("_cell", "_part"))
    b = out.groupBy("_b").count().toPandas()
    b["part"] = b["_b"] // grid**d
    cells = b["_b"].to_numpy()[:, None] // grid ** np.arange(d) % grid
    b["cell"] = list(cells)
    b = b.assign(level=cells.sum(axis=1)).sort_values(["level", "part"], ascending=[False, True], ignore_index=True)
    cells, parts, level = np.stack(b["cell"]), b["part"].to_numpy(), np.zeros(len(b), dtype=np.int64)
    for i in range(1, len(b)):
        before = (cells[:i] >= cells[i]).all(axis=1)
        level[i] = level[:i][before].max(initial=-1) + 1
    return out, b.assign(level=level)


def _ahead(b: pd.DataFrame, level: int, d: int) -> pd.DataFrame:
    """Which shadows (``_b``, ``bits``) fall on which blocks ``_to`` of the level."""
    old, new = b[b["level"] < level], b[b["level"] == level]
    if old.empty:
        return pd.DataFrame({"_b": [], "bits": [], "_to": []}).astype({"_b": "int64", "bits": "int32", "_to": "int64"})
    x, found = np.stack(old["cell"]), []
    for to, cell in zip(new["_b"], new["cell"], strict=True):
        on = (x >= cell).all(axis=1)
        found.append(pd.DataFrame({"_b": old["_b"].to_numpy()[on], "bits": ((x[on] == cell) << np.arange(d)).sum(axis=1).astype("int32"), "_to": to}))
    return pd.concat(found)


def dominance_fronts(points: DataFrame, objectives: tuple[str, ...] = OBJECTIVES, small: int = SMALL) -> DataFrame:
    """Pareto front of every point (unique ``id``), from 1: what only fronts before it dominate.

    A point dominates another if it is at least as good in every objective and better in one; a
    missing objective is worse than any, and its point dominates none. Up to ``small`` points are
    peeled in one task. More are dealt to blocks by quantiles of the objectives. Blocks that no other
    one is ahead of come first, all at once, then those behind them, and so on: as many jobs as a way
    through the grid has steps, however many points or fronts there are. Of a block ahead a task needs
    only its shadow: where the block is better as a whole in some objectives, the points that are
    covered in the others by points of a front as late are left out.
    """
    d, spark = len(objectives), points.sparkSession
    schema = StructType([*points.schema.fields, StructField("front", IntegerType())])

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        x, whole, order = _values(pdf, objectives)
        return pdf.assign(front=_peeled(x, whole, order, np.empty((0, d)), np.empty(0)))

    n = points.count()
    if n <= small:
        return points.groupBy().applyInPandas(peel, schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["front"].notna().to_numpy()
        mine, ahead = pdf[~known], pdf[known]
        x, whole, order = _values(mine, objectives)
        front = _peeled(x, whole, order, ahead[list(objectives)].to_numpy(dtype=float), ahead["front"].to_numpy(dtype=np.int32))
        mine = mine.assign(front=front, bits=(1 << d) - 1, whole=whole)
        return pd.concat([mine, *[mine.iloc[k].assign(bits=bits) for bits, k in _shadows(x, front, whole).items()]])

    dealt, blocks = _blocks(points, n, objectives)
    fields = StructType([*dealt.schema.fields, *StructType.fromDDL("front int, bits int, whole boolean").fields])
    table = lambda pdf: spark.createDataFrame(pa.Table.from_pandas(pdf, preserve_index=False))
    done: list[DataFrame] = []
    for level in range(int(blocks["level"].max()) + 1):
        now = blocks[blocks["level"] == level]
        rows = dealt.withColumn("front", F.lit(None).cast("int")).join(F.broadcast(table(now[["_b"]])), "_b").withColumn("_to", F.col("_b"))
        if done:
            falls = F.broadcast(table(_ahead(blocks, level, d)))
            for before in done:
                rows = rows.unionByName(before.where("whole").join(falls, ["_b", "bits"]).select(*dealt.columns, "front", "_to"))
        tasks = min(len(now), 4 * spark.sparkContext.defaultParallelism)
        rows = rows.withColumn("_b", F.col("_to")).repartition(tasks, "_to")
        done.append(written(rows.groupBy("_to").applyInPandas(lambda pdf: solve(pdf.drop(columns="_to")), fields)))
    return reduce(DataFrame.unionByName, [x.where(F.col("bits") == (1 << d) - 1).select(*points.columns, "front") for x in done])


def crowding(ranked: DataFrame, objectives: tuple[str, ...] = OBJECTIVES) -> DataFrame:
    """Crowding distance within each front: for every objective the span of a point's neighbours as a share of the front's.

    The ends of a front, and fronts of one or two, are infinitely far.
    """
    out, whole, total, end = ranked, Window.partitionBy("front"), F.lit(0.0), F.count("*").over(Window.partitionBy("front")) <= 2
    for c in objectives:
        w = whole.orderBy(c, "id")
        span = F.nullif(F.max(c).over(whole) - F.min(c).over(whole), F.lit(0.0))
        out = out.withColumn(f"_g_{c}", F.lead(c).over(w) - F.lag(c).over(w)).withColumn(f"_s_{c}", span).withColumn(f"_e_{c}", F.lead("id").over(w).isNull() | F.lag("id").over(w).isNull())
        total, end = total + F.coalesce(F.try_divide(F.col(f"_g_{c}"), F.col(f"_s_{c}")), F.lit(0.0)), end | F.col(f"_e_{c}")
    return out.withColumn("_end", end).withColumn("crowding", F.when(F.col("_end"), float("inf")).otherwise(total)).drop("_end", *[f"_{k}_{c}" for k in "gse" for c in objectives])


def survivors(ranked: DataFrame, n: int, objectives: tuple[str, ...] = OBJECTIVES) -> DataFrame:
    """The next generation: whole fronts first, then the most isolated points of the front that fits in part."""
    return crowding(ranked, objectives).orderBy("front", F.desc("crowding"), "id").limit(n)


def quarantine(trades: DataFrame, least: int = 30) -> DataFrame:
    """Promotion, demotion or waiting by realised trades."""
    a = trades.groupBy("genome_id").agg(F.count("*").alias("trades"), F.avg("pnl").alias("mean"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    state = F.when(F.col("trades") < least, "WAITING").when((F.col("mean") > 0) & (F.col("win_rate") >= 0.5), "PROMOTED").otherwise("DEMOTED")
    return a.withColumn("state", state)


def lifecycle(events: DataFrame) -> DataFrame:
    """Current state of each model from its ordered transitions; transitions that skip a step are ignored."""
    allowed = {"REGISTER": "CANDIDATE", "CHALLENGE": "CHALLENGER", "PROMOTE": "PRODUCTION", "ROLLBACK": "CHALLENGER", "RETIRE": "RETIRED"}
    needs = {"REGISTER": ("NONE",), "CHALLENGE": ("CANDIDATE",), "PROMOTE": ("CHALLENGER",), "ROLLBACK": ("PRODUCTION",), "RETIRE": ("CANDIDATE", "CHALLENGER", "PRODUCTION")}
    ordered = F.sort_array(F.collect_list(F.struct("at", "event")))
    step = lambda s, x: _step(s, x["event"], allowed, needs)
    return events.groupBy("model_id").agg(ordered.alias("log")).select("model_id", F.aggregate("log", F.lit("NONE"), step).alias("state"))


def _step(state, event, allowed, needs):
    out = state
    for name, to in allowed.items():
        out = F.when((event == name) & state.isin(*needs[name]), to).otherwise(out)
    return out

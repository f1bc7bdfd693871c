"""Greedy cooldown of long series: next-jump maps per block of rows, composed by pointer doubling.

A row counts if it is ``wait`` or more after the last one that counted. From any row the next that
counts is a jump; where jumps leave a block depends only on the row at which it is entered, and
entries soon fall into the same track, so a block has few ways out. These ways are the nodes of a
small graph, each with one edge, to the way out of the block that it leads into. Which nodes lie on
the track from the first row is found by doubling: edges over 1, 2, 4, ... blocks, then marks from
the longest edges down. Blocks hold equal numbers of rows whatever the key, so no task has a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import numbered
from ..sources.shared import written

#: Before any time.
START = -(2**62)
SIZE = 8192


def _ways(us: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row in time order: the next that counts after it (n: outside), and the earliest time outside the block that may count."""
    n = len(us)
    after = np.searchsorted(us, us + wait, side="left")
    last = np.where(after < n, after, np.arange(n))
    while not np.array_equal(further := last[last], last):
        last = further
    return after, us[last] + wait


def cooldown(rows: DataFrame, by: str, tie: str, seconds: float, size: int = SIZE) -> DataFrame:
    """The rows of each key ``by`` that are ``seconds`` or more after the last one kept, the first included.

    Ordered by ``ts`` and ``tie``; rows without a time are never kept; null keys are a key.
    """
    wait, names = int(seconds * 1e6), rows.columns
    keyed = rows.where("ts is not null").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "ts", F.col(tie).alias("_tie"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("_key"), F.col(by).isNull().alias("_none"))
    key = ["_key", "_none"]
    dealt = written(numbered(keyed, key, "_tie").withColumn("_block", F.floor(F.col("_rn") / size).cast("long")).drop("ts", "_tie"))
    times, at = dealt.select(*key, "_block", "_us"), [*key, "_block"]
    types = "_key string, _none boolean, "

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["_us"].to_numpy())
        out = np.unique(_ways(us, wait)[1])
        return pd.DataFrame({"_key": pdf["_key"].iloc[0], "_none": pdf["_none"].iloc[0], "_block": pdf["_block"].iloc[0], "u": out, "end": us[-1]})

    ways = written(times.groupBy(*at).applyInPandas(leaves, types + "_block long, u long, end long"))
    # the block a way leads into: the first that ends at or after it; a window over ways and blocks, not rows
    blocks = ways.groupBy(*at).agg(F.max("end").alias("end"))
    mixed = ways.select(*key, F.col("u").alias("t"), F.lit(None).cast("long").alias("b")).distinct().unionByName(blocks.select(*key, F.col("end").alias("t"), F.col("_block").alias("b")))
    ahead = Window.partitionBy(*key).orderBy(F.col("t").desc(), F.col("b").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    into = mixed.withColumn("_block", F.min("b").over(ahead)).where("b is null and _block is not null").select(*at, F.col("t").alias("u"))
    starts = blocks.where("_block = 0").select(*at, F.lit(START).cast("long").alias("u"))
    entries = written(into.unionByName(starts))

    def leads(entry: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["_us"].to_numpy())
        u = entry["u"].to_numpy()
        return entry.assign(to=_ways(us, wait)[1][np.searchsorted(us, u)])

    edges = [written(entries.groupBy(*at).cogroup(times.groupBy(*at)).applyInPandas(leads, types + "_block long, u long, to long").select(*key, "u", "to"))]
    longest = blocks.agg(F.max("_block")).first()[0] or 0
    for _ in range(int(longest).bit_length() - 1):
        a, b = edges[-1], edges[-1].select(*key, F.col("u").alias("to"), F.col("to").alias("further"))
        edges.append(written(a.join(b, [*key, "to"]).select(*key, "u", F.col("further").alias("to"))))
    marked = written(starts.select(*key, "u"))
    for e in reversed(edges):
        marked = written(marked.unionByName(marked.join(e, [*key, "u"]).select(*key, F.col("to").alias("u"))).distinct())
    on_track = entries.join(marked, [*key, "u"])

    def keep(entry: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if entry.empty:
            return pdf.iloc[:0][["_row"]]
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        us = pdf["_us"].to_numpy()
        after, kept = _ways(us, wait)[0], []
        i = int(np.searchsorted(us, entry["u"].iloc[0]))
        while i < len(us):
            kept.append(i)
            i = int(after[i])
        return pdf.loc[kept, ["_row"]]

    return on_track.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInPandas(keep, dealt.select("_row").schema).select("_row.*")

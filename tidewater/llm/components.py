"""Connected components by contraction, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every node of ``edges (u, v)``; nodes may be of any orderable type.

    In each round every node takes the first, in an order drawn anew, of all nodes at most two
    steps away; the graph is contracted to these and drops loops and repeats. A star, the usual
    shape of a group of copies, is one node after a round; the maps are composed backwards.
    Neighbours are reduced by a minimum (combined before the shuffle), and each round is cut by
    a reliable checkpoint.
    Defined results: loops and repeated edges are ignored, edges with a null end too; no edges
    give no rows.
    """
    rest = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    maps: list[DataFrame] = []
    while not rest.isEmpty():
        drawn = F.lit(len(maps))
        place = lambda c, drawn=drawn: F.struct(F.xxhash64(c, drawn).alias("p"), F.col(c).alias("v"))
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = cut(both.groupBy("u").agg(F.min(place("v")).alias("m")).select("u", F.least("m", place("u")).alias("m")))
        beyond = both.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("n"))
        to = cut(near.join(beyond, "u").select(F.col("u").alias("id"), F.least("m", "n")["v"].alias("root")))
        maps.append(to)
        a = rest.join(to.select(F.col("id").alias("u"), F.col("root").alias("x")), "u")
        b = a.join(to.select(F.col("id").alias("v"), F.col("root").alias("y")), "v")
        rest = cut(b.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct())
    if not maps:
        return rest.select(F.col("u").alias("id"), F.col("v").alias("root"))
    labels = maps[-1]
    for to in reversed(maps[:-1]):
        known = labels.select(F.col("id").alias("root"), F.col("root").alias("end"))
        labels = to.join(known, "root", "left").select("id", F.coalesce("end", "root").alias("root"))
    return labels

"""Connected components by local contraction: every node moves to the neighbour of smallest random priority, until few links
are left (Lacki, Mirrokni, Wlodarczyk, 2018); those one task joins."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import discard, stash

#: Links, 4 MB of them, that one task joins.
FEW = 1 << 18


def _ranked(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("p"), F.col(node).alias("v"))


def _union(batches):
    """All links of a bounded table: (node, component), the smallest node of each."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
    if not parts:
        return
    node, edge = np.unique(np.concatenate(parts, 1), return_inverse=True)
    a, b = edge.reshape(2, -1)
    up = np.arange(len(node))
    while True:  # each root takes the smallest root that a link shows it; then paths are halved until they end
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[up])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long) -> (node, component): the smallest node reachable, for each node that has a link.

    New priorities each round make the rounds grow with the logarithm of a component's size whatever its shape. Labels
    are narrow tables in the shared folder; a star's centre is pre-aggregated in each task, its joins are split by AQE.
    Null ends and links of a node to itself are left out; an empty table gives an empty table."""
    links = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for turn in count():  # each round moves one node of every component at least
        if links.count() <= FEW:
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(_ranked("b", turn)), _ranked("a", turn)).alias("t")).select("node", F.col("t.v").alias("to")))
        old, labels = labels, step.withColumnRenamed("to", "root") if labels is None else stash(
            labels.join(step.withColumnRenamed("node", "s"), F.col("root") == F.col("s"), "left").select("node", F.coalesce("to", "root").alias("root")))
        near, far = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = links.join(near, "a").join(far, "b").where("ta <> tb")
        before, links = links, stash(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        discard(before, *([old] if turn > 1 else []))  # the first labels are the first step
    rest = stash(links.repartition(1).mapInArrow(_union, "node long, component long"))
    if labels is None:
        return rest
    roots = labels.join(rest.withColumnRenamed("node", "s"), F.col("root") == F.col("s"), "left").select("node", F.coalesce("component", "root").alias("root"))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return stash(roots.join(least, "root").select("node", "component"))

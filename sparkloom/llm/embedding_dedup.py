"""Embedding near-dedup by NN-descent.

Neighbour lists start from rows that stand together in the order of random hyperplane codes, and are refined by
neighbours-of-neighbours joins: what meets in one vector's list, to or from it, is compared, and better neighbours move
in. A list keeps its best K, and K more by a hash; links found go into a forest of components at once, so that lists need
not hold all pairs of a dense cluster. Vectors
drawn by a hash until 256 of them have links, compared with all, audit recall; a table that has to be drawn whole for that
is answered by the comparison. While recall is not met, fresh tables of codes are added and lists and joins double; where a
join would then compare as many pairs as there are, all vectors are compared with all instead. Links inside a component are
then counted exactly, block by block, in double precision."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import discard, stash, table
from .components import components

THRESHOLD = 0.9
#: At first: length of a list, members of one join, tables of codes and their bits, rows of a code block and neighbours taken there.
K, JOIN, TABLES, BITS, BLOCK, TAKE = 8, 32, 8, 24, 64, 3
ROUNDS, RECALL = 2, 0.99
#: Vectors of one draw of the audit, and of those with links at which it ends.
AUDIT, LINKED = 256, 256
#: Members of one side of an exact comparison.
EXACT = 1024
#: Bytes of the vectors that are compared with all at once, and rows of one product with them.
ASK, ROWS = 1 << 23, 256
_SLACK = 1e-5  # joins run in single precision; what they find is judged again in double


def _matrix(col: pa.Array, kind=np.float32) -> np.ndarray:
    data = np.frombuffer(b"".join(col.to_pylist()), kind)
    return data.reshape(len(col), -1) if len(col) else np.zeros((0, 1), kind)


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct unit vectors: node, w copies, dim, vec in single and exact in double precision; members: vec_id, node).
    Equal vectors are one node under their smallest vec_id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    ok = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    v = v.withColumn("e", F.when(ok, F.transform("e", lambda x: x + F.lit(0.0))))
    good = v.where("e is not null and vec_id is not null")
    rows = good.groupBy("e").agg(F.min("vec_id").alias("node"), F.count("*").alias("w"))

    def unit(batches):
        for batch in batches:
            x = [np.array(r) for r in batch.column(0).to_pylist()]
            x = [r / np.abs(r).max() for r in x]
            x = [r / np.sqrt((r * r).sum()) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([len(r) for r in x], pa.int32()), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "w", "dim", "vec", "exact"])

    table_ = stash(rows.mapInArrow(unit, "node long, w long, dim int, vec binary, exact binary"))
    members = v.join(rows.select("e", "node"), "e", "left").select("vec_id", "node")
    return table_, members


def _pairs(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], ["a", "b", "s"])


def _start(v: DataFrame, level: int) -> DataFrame:
    """Pairs (a, b, s) from runs of rows in the order of each table of codes; a level has tables of its own."""

    def codes(batches):
        for batch in batches:
            x = batch.column(2).to_pylist()
            for dim in sorted(set(batch.column(1).to_pylist())):
                at = np.flatnonzero(batch.column(1).to_numpy() == dim)
                m = np.frombuffer(b"".join([x[i] for i in at]), np.float32).reshape(-1, dim)
                planes = np.random.default_rng([dim, level]).standard_normal((dim, TABLES * BITS)).astype(np.float32)
                bits = (m @ planes > 0).reshape(len(at), TABLES, BITS) @ (1 << np.arange(BITS))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), batch.column(1).take(pa.array(at)), pa.array(bits[:, t]), batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at))], ["t", "dim", "code", "node", "vec"])

    def meet(batches):
        for batch in batches:
            t, dim, node, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
            cuts = np.flatnonzero(np.append(True, (np.diff(t) != 0) | (np.diff(dim) != 0)))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(t)), strict=True):
                for i in range(lo, hi, BLOCK // 2):
                    j = min(hi, i + BLOCK)
                    if j - i < 2:
                        continue
                    m = _matrix(vec[i:j])
                    s = m @ m.T
                    np.fill_diagonal(s, -2)
                    k = min(TAKE, j - i - 1)
                    top = np.argpartition(-s, k - 1, 1)[:, :k]
                    row = np.repeat(np.arange(j - i), k)
                    yield _pairs(node[i:j][row], node[i:j][top.ravel()], s[row, top.ravel()])

    coded = v.select("node", "dim", "vec").mapInArrow(codes, "t int, dim int, code long, node long, vec binary")
    return coded.repartitionByRange("t", "dim", "code", "node").sortWithinPartitions("t", "dim", "code", "node").mapInArrow(meet, "a long, b long, s float")


def _lists(pairs: DataFrame, keep: int) -> DataFrame:
    """The best `keep` of each node; where they are all links, as many more by a hash: a saturated list grows, but a dense
    cluster does not list all its pairs, as its links are kept in the forest."""
    both = pairs.union(pairs.select("b", "a", "s")).groupBy("a", "b").agg(F.max("s").alias("s"))
    best, some = Window.partitionBy("a").orderBy(F.desc("s"), "b"), Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
    both = both.withColumn("n", F.row_number().over(best)).withColumn("m", F.row_number().over(some))
    return both.where((F.col("n") <= keep) | (F.col("m") <= keep)).drop("n", "m")


def _forest(pairs: DataFrame, v: DataFrame, forest: DataFrame | None, threshold: float) -> DataFrame:
    """(node, component) of all links so far: those of the pairs that single precision leaves no doubt about, and of the others
    between different components those that double precision finds."""
    sure = pairs.where(F.col("s") >= threshold + _SLACK).select("a", "b")
    comp = components(sure if forest is None else sure.union(forest.select("node", "component")))
    doubt = pairs.where(F.col("s").between(threshold - _SLACK, threshold + _SLACK)).select("a", "b").where("a <> b").distinct()
    ends = doubt.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    links = _links(ends.where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b"), v, threshold)
    return comp if links.isEmpty() else components(links.union(comp.select("node", "component")))


def _round(lists: DataFrame, v: DataFrame, turn: int, threshold: float, most: int) -> DataFrame:
    near = lists.select(F.col("a").alias("c"), F.col("b").alias("m")).union(lists.select("b", "a")).union(v.select("node", "node")).distinct()
    order = Window.partitionBy("c").orderBy(F.xxhash64(F.lit(turn), "c", "m"), "m")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    met = near.join(v.select("node", "dim", "vec"), F.col("m") == F.col("node")).select("c", "m", "dim", "vec")

    def work(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([*(rest.to_batches() if rest is not None else ()), batch]).combine_chunks()
            c = rows["c"].to_numpy()
            cut = int(np.searchsorted(c == c[-1], True))
            yield from join(rows.slice(0, cut))
            rest = rows.slice(cut)
        if rest is not None:
            yield from join(rest)

    def join(rows):
        if not len(rows):
            return
        c, m, dim, vec = rows["c"].to_numpy(), rows["m"].to_numpy(), rows["dim"].to_numpy(), rows["vec"].combine_chunks().to_pylist()
        cuts = np.flatnonzero(np.append(True, (np.diff(c) != 0) | (np.diff(dim) != 0)))
        out = []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(c)), strict=True):
            if hi - lo < 2:
                continue
            x = np.frombuffer(b"".join(vec[lo:hi]), np.float32).reshape(hi - lo, -1)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            best = s >= np.partition(s, -2, 1)[:, -2:-1]  # each member's two nearest, and all links
            i, j = np.nonzero(np.triu(best | best.T | (s >= threshold - _SLACK), 1))
            out.append((m[lo:hi][i], m[lo:hi][j], s[i, j]))
        if out:
            yield _pairs(*map(np.concatenate, zip(*out, strict=True)))

    return met.repartition("c").sortWithinPartitions("c", "dim").mapInArrow(work, "a long, b long, s float")


def _compare(x: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) in double precision of asked nodes to nodes of other components. A batch gives one link of a node to a
    component, as those inside one are counted later."""
    asked = asked.select("node", "dim", "exact", "component").toPandas()
    sets = {d: (g["node"].to_numpy(), g["component"].to_numpy(), _matrix(pa.array(g["exact"]), np.float64)) for d, g in asked.groupby("dim")}

    def work(batches):
        for batch in batches:
            node, dim, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for d, (q, comps, y) in sets.items():
                at, out = np.flatnonzero(dim == d), []
                for lo in range(0, len(at), ROWS):
                    some = at[lo : lo + ROWS]
                    i, j = np.nonzero((_matrix(batch.column(2).take(pa.array(some)), np.float64) @ y.T >= threshold) & (own[some][:, None] != comps))
                    one = np.unique(np.stack([j, own[some[i]]]), axis=1, return_index=True)[1]
                    out.append((q[j[one]], node[some[i[one]]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(np.concatenate, zip(*out, strict=True))], ["a", "b"])

    return stash(x.select("node", "dim", "exact", "component").mapInArrow(work, "a long, b long"))


def _truth(v: DataFrame, n: int, threshold: float) -> tuple[DataFrame, bool]:
    """All links (a, b) of the nodes drawn, and whether all nodes were: draws double until LINKED nodes have a link."""
    parts, width = max(1, -(-n // AUDIT)), v.agg(F.max("dim")).first()[0] or 1
    x = v.select("node", "dim", "exact", F.col("node").alias("component"), F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part"))
    truth, lo, step = None, 0, 1
    while lo < parts:
        links = _compare(x, x.where(F.col("part").between(lo, lo + step - 1)), threshold)
        truth = links if truth is None else truth.union(links)
        lo, step = lo + step, min(2 * step, max(1, ASK // (AUDIT * 8 * width)))
        if truth.select("a").distinct().count() >= LINKED:
            break
    return truth, lo >= parts


def _recall(truth: DataFrame, comp: DataFrame) -> tuple[float, DataFrame]:
    """Of the links of a node of the audit, the share with both ends in one component, where links are counted exactly: its
    mean over the nodes that have links; and the links without."""
    ends = truth.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    ends = ends.select("a", "b", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("hit"))
    share = ends.groupBy("a").agg(F.avg(F.col("hit").cast("double")).alias("share")).agg(F.avg("share")).first()[0]
    return (0.0 if share is None else share), ends.where("not hit").select("a", "b")


def _links(pairs: DataFrame, v: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those at or above the threshold in double precision."""
    x = v.select("node", "exact")
    pairs = pairs.join(x.select(F.col("node").alias("a"), F.col("exact").alias("xa")), "a").join(x.select(F.col("node").alias("b"), F.col("exact").alias("xb")), "b")

    def exact(batches):
        for batch in batches:
            xa, xb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            s = np.array([len(p) == len(q) and float(np.frombuffer(p) @ np.frombuffer(q)) >= threshold for p, q in zip(xa, xb, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(s))

    return stash(pairs.select("a", "b", "xa", "xb").mapInArrow(exact, "a long, b long"))


def _rest(v: DataFrame, comp: DataFrame, n: int, threshold: float) -> DataFrame:
    """All nodes compared with all: links (a, b) between different components."""
    parts = -(-n * 8 * v.agg(F.max("dim")).first()[0] // ASK)
    x = v.select("node", "dim", "exact").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    x = stash(x.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts))))
    found = [_compare(x.where(F.col("part") >= part), x.where(F.col("part") == part), threshold) for part in range(parts)]
    return reduce(DataFrame.union, found)


def _degrees(comp: DataFrame, v: DataFrame, threshold: float) -> DataFrame:
    """(node, others): copies of other nodes at or above the threshold in its component, by exact comparison of blocks of
    at most about 1,024 members with each other."""
    size = comp.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / EXACT)).cast("int").alias("k"))
    rows = comp.join(size, "component").join(v.select("node", "w", "dim", "exact"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("at", F.explode(F.expr("sequence(0, k - 1)")))
    # cell (i, j): rows of block i are asked, of block j are searched; a row goes to its line and to its column
    ask = rows.select("component", F.col("own").alias("i"), F.col("at").alias("j"), F.lit(True).alias("ask"), "node", "w", "dim", "exact")
    rows = ask.union(rows.select("component", F.col("at").alias("i"), F.col("own").alias("j"), F.lit(False), "node", "w", "dim", "exact"))

    def work(key, t):
        node, w, dim, asks = (t[k].to_numpy() for k in ("node", "w", "dim", "ask"))
        x, out = t["exact"].combine_chunks(), []
        for d in np.unique(dim):
            q, c = np.flatnonzero(asks & (dim == d)), np.flatnonzero(~asks & (dim == d))
            s = _matrix(x.take(pa.array(q)), np.float64) @ _matrix(x.take(pa.array(c)), np.float64).T >= threshold
            out.append((node[q], (s & (node[q][:, None] != node[c])) @ w[c]))
        a, b = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"node": a, "others": b})

    cells = rows.groupBy("component", "i", "j").applyInArrow(work, "node long, others long")
    return cells.groupBy("node").agg(F.sum("others").alias("others"))


def graph(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, members, (node, component) of linked nodes), once the audit's recall is met or all are compared with all."""
    v, members = nodes(vectors)
    n, keep, most, level, lists, comp = v.count(), K, JOIN, 0, None, None
    truth, whole = _truth(v, n, threshold)
    if whole:
        return v, members, components(truth)
    while True:
        for turn in range(level * ROUNDS, (level + 1) * ROUNDS + 1):
            first = turn == level * ROUNDS  # a level starts with codes, then come the joins
            pairs = stash(_start(v, level) if first else _round(lists, v, turn, threshold, most))
            comp = _forest(pairs, v, comp, threshold)
            old, lists = lists, stash(_lists(pairs if lists is None else pairs.union(lists), keep))
            discard(pairs, *[old] if old is not None else [])
        recall, missed = _recall(truth, comp)
        if recall >= RECALL:
            return v, members, comp if missed.isEmpty() else components(missed.union(comp.select("node", "component")))
        keep, most, level = 2 * keep, 2 * most, level + 1
        if most * most >= n:
            return v, members, components(_rest(v, comp, n, threshold).union(comp.select("node", "component")))


def dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """embeddings (vec_id, embedding) -> vec_id, n_links, component_id, kept.

    Vectors link at a cosine of threshold or more, in double precision, whatever their labels; those of different lengths
    do not. Null, zero, empty or not wholly finite vectors link with nothing and are kept; equal vectors link with each
    other. A null vec_id has no component. Repeated rows of one vec_id are copies like others."""
    v, members, comp = graph(vectors, threshold)
    others = _degrees(comp, v, threshold)
    per = v.select("node", "w").join(comp, "node", "left").join(others, "node", "left")
    out = members.join(per, "node", "left")
    return out.select("vec_id", F.coalesce(F.col("others") + F.col("w") - 1, F.col("w") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_dedup(spark, sf_dir) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as r from v),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.9::double * a.r * b.r),
c(a, b) as (select a, b from l union select c.a, l.b from c join l on c.b = l.a)
select e.vec_id, count(distinct l.b)::bigint as n_links, least(e.vec_id, coalesce(any_value(m.least), e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(any_value(m.least), e.vec_id)) as kept
from embeddings e left join l on l.a = e.vec_id left join (select a, min(b) as least from c group by a) m on m.a = e.vec_id
group by e.vec_id
"""

"""Exact top-k by inner product with two cover trees, one over queries and one over data.

Data go to the nearest of some pivots, one for about DATA rows, and within a pivot's region to blocks of bounded size, each
with a tree of its own. Queries are indexed too, and the two trees are traversed together: a pair of nodes is left out if no
inner product between them can reach the worst kth score of the queries below the query node: the product of the centres
and, for each, its radius times the other's reach bound it. A query is first asked in a block of its own region; its kth
score there then tells which other regions, by centre and radius, can hold anything better, and it goes to those alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import stash, table

#: Rows of a region and of a data block, both on average; queries of a batch; points of a leaf.
DATA, QUERIES, LEAF = 8192, 1024, 64
#: Products in double precision are exact below this sum.
EXACT = 2.0**52


class CoverTree:
    """Nodes over x: centres of one level are more than its scale apart and everything below one is within the scale, which
    halves from level to level; `order` puts the points below each node next to each other."""

    def __init__(self, x: np.ndarray):
        self.x, self.sq = x, np.einsum("ij,ij->i", x, x)
        self.center, self.radius, self.children, self.span = [], [], [], []
        order: list[np.ndarray] = []
        self._at = 0
        top = np.sqrt(max(0.0, float(self._dist(np.arange(len(x)), 0).max()))) if len(x) else 0.0
        self._build(np.arange(len(x)), 0, top, order)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)

    def _dist(self, rows, c):
        return np.maximum(self.sq[rows] + self.sq[c] - 2 * (self.x[rows] @ self.x[c]), 0)

    def _build(self, rows: np.ndarray, c: int, scale: float, order: list) -> int:
        me = len(self.center)
        d = np.sqrt(self._dist(rows, c))
        self.center.append(c), self.radius.append(float(d.max()) * (1 + 1e-9) + 1e-6), self.children.append([]), self.span.append(None)
        begin = self._at
        if len(rows) <= LEAF or d.max() < 1e-9:
            order.append(rows)
            self._at += len(rows)
        else:
            while scale / 2 >= d.max():
                scale /= 2
            scale /= 2
            for part, center in self._net(rows, c, scale):
                self.children[me].append(self._build(part, center, scale, order))
        self.span[me] = (begin, self._at)
        return me

    def _net(self, rows: np.ndarray, c: int, scale: float):
        """Points more than scale apart, the node's own centre first, and what each covers; small parts share a leaf."""
        centers, left = [c], rows
        owner = np.full(len(rows), -1)
        place = np.arange(len(rows))
        new = [c]
        while True:
            d = np.maximum(self.sq[left][:, None] + self.sq[new] - 2 * (self.x[left] @ self.x[new].T), 0)
            near = d.argmin(1)
            got = d[np.arange(len(left)), near] <= scale**2
            owner[place[got]] = len(centers) - len(new) + near[got]
            left, place = left[~got], place[~got]
            if not len(left):
                break
            cand, new = left[:128], []
            dd = np.maximum(self.sq[cand][:, None] + self.sq[cand] - 2 * (self.x[cand] @ self.x[cand].T), 0) > scale**2
            free = np.ones(len(cand), bool)
            for i in range(len(cand)):
                if free[i]:
                    new.append(cand[i])
                    free &= dd[i]
            new = np.array(new)
            centers += new.tolist()
        parts = [rows[owner == k] for k in range(len(centers))] if len(centers) <= LEAF else np.split(rows[np.argsort(owner, kind="stable")], np.flatnonzero(np.diff(np.sort(owner))) + 1)
        names = centers if len(centers) <= LEAF else [centers[k] for k in np.unique(owner)]
        bag: list[np.ndarray] = []
        for part, name in zip(parts, names, strict=True):
            if not len(part):
                continue
            if len(part) <= LEAF // 4 and len(names) > 4:  # too few for a node of their own
                bag.append(part)
                if sum(map(len, bag)) > LEAF // 2:
                    both = np.concatenate(bag)
                    yield both, int(both[0])
                    bag = []
            else:
                yield part, int(name)
        if bag:
            both = np.concatenate(bag)
            yield both, int(both[0])


def dual_search(data: np.ndarray, ids: np.ndarray, tree: CoverTree, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's best k, higher scores first, then smaller ids; -inf where there are fewer.

    Both trees are descended together, the wider node of a pair first, the more promising child of the data's first; a pair of
    leaves is one product."""
    q = CoverTree(queries)
    asked = queries[q.order]  # the queries below a node stand together
    best, who = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    reach_q, reach_d = np.sqrt(q.sq), np.sqrt(tree.sq)
    cq, cd = np.array(q.center), np.array(tree.center)
    rq, rd = np.array(q.radius), np.array(tree.radius)
    mq, md = queries[cq], data[cd]

    def bounds(a: int, b: np.ndarray) -> np.ndarray:
        return md[b] @ mq[a] + rq[a] * reach_d[cd[b]] + rd[b] * reach_q[cq[a]] + rq[a] * rd[b]

    def leaf(a: int, b: int) -> None:
        lo, hi = q.span[a]
        cols = tree.order[slice(*tree.span[b])]
        s = asked[lo:hi] @ data[cols].T
        hot = np.flatnonzero((s >= best[lo:hi, -1:]).any(1))
        if len(hot):
            both = np.concatenate([best[lo + hot], s[hot]], 1)
            names = np.concatenate([who[lo + hot], np.broadcast_to(ids[cols], (len(hot), len(cols)))], 1)
            order = np.lexsort((names, -both), axis=1)[:, :k]
            best[lo + hot], who[lo + hot] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    stack = [(0, 0, np.inf)]
    while stack:
        a, b, top = stack.pop()
        lo, hi = q.span[a]
        worst = best[lo:hi, -1].min()
        if top < worst - 1e-6 * abs(worst):
            continue
        if not q.children[a] and not tree.children[b]:
            leaf(a, b)
        elif tree.children[b] and (not q.children[a] or rd[b] >= rq[a]):
            below = np.array(tree.children[b])
            u = bounds(a, below)
            order = np.argsort(u)  # the best child comes off the stack first
            stack += [(a, int(c), float(x)) for c, x in zip(below[order], u[order], strict=True)]
        else:
            stack += [(c, b, float(bounds(c, np.array([b]))[0])) for c in q.children[a]]
    back = np.argsort(q.order)
    return best[back], who[back]


def whole(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component, a whole number whatever its size; vectors that are null or
    hold a null or a value that is not finite, before or after scaling, take no part, nor do rows without a vec_id."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    ok = F.coalesce(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf"))), F.lit(False))
    far = 2.0**53  # from here on every double is whole
    return x.where(ok).select("vec_id", F.transform("e", lambda c: F.when(F.abs(c * scale) < far, F.floor(c * scale).cast("double")).otherwise(c * scale)).alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), dim)


def ordered(score: int) -> str:
    """A string whose order is that of whole numbers."""
    t = str(abs(score))
    return f"p{len(t):04d}{t}" if score >= 0 else f"n{9999 - len(t):04d}" + "".join(str(9 - int(c)) for c in t)


def _regions(v: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """v (vec_id, v, dim, huge) -> with region (the nearest pivot's number, -1 for huge vectors), far (its distance) and norm; the
    pivots by dim: about one in DATA of the vectors, by a hash, with the origin where there is none."""
    picked = v.where(~F.col("huge") & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(DATA)) == 0)).select("dim", "v").distinct().toArrow()
    dims, rows = picked["dim"].to_pylist(), picked["v"].to_pylist()
    pivots = {d: np.array([r for r, x in zip(rows, dims, strict=True) if x == d]) for d in set(dims)}

    def work(batches):
        for batch in batches:
            dim, huge = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            region, far, norm = np.full(len(dim), -1, np.int64), np.zeros(len(dim)), np.zeros(len(dim))
            for d in np.unique(dim[~huge]):
                at = np.flatnonzero((dim == d) & ~huge)
                x, p = _matrix(batch.column(1).take(pa.array(at)), int(d)), pivots.get(int(d), np.zeros((1, int(d))))
                for lo in range(0, len(at), 512):
                    some = x[lo : lo + 512]
                    dd = np.maximum((some**2).sum(1)[:, None] + (p**2).sum(1) - 2 * some @ p.T, 0)
                    region[at[lo : lo + 512]] = near = dd.argmin(1)
                    far[at[lo : lo + 512]] = np.sqrt(((some - p[near]) ** 2).sum(1))
                    norm[at[lo : lo + 512]] = np.sqrt((some**2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(far), pa.array(norm)], ["vec_id", "v", "dim", "huge", "region", "far", "norm"])

    return v.select("vec_id", "v", "dim", "huge").mapInArrow(work, "vec_id long, v array<double>, dim int, huge boolean, region long, far double, norm double"), pivots


def _asked(rows: DataFrame, k: int, exact: bool) -> DataFrame:
    """rows (dim, region, block, kind: 0 data, 1 queries, vec_id, v) -> asked, vec_id, score, place: of each query of a block the
    k best of its data."""

    def work(batches):
        key, held, tree, asked = None, [], None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                now, kind, dim = tuple(keys[:3, lo].tolist()), int(keys[3, lo]), int(keys[0, lo])
                if now != key:
                    if asked:
                        yield from answer(tree, asked)
                    key, held, tree, asked = now, [], None, []
                part = batch.column(4)[lo:hi].to_numpy(), _matrix(batch.column(5)[lo:hi], dim)
                if kind == 0:
                    held.append(part)
                    continue
                if held:
                    ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    tree, held = (ids, x, CoverTree(x) if not exact and dim else None), []
                if tree is not None:
                    asked.append(part)
                    if sum(len(p[0]) for p in asked) >= QUERIES:
                        yield from answer(tree, asked)
                        asked = []
        if asked:
            yield from answer(tree, asked)

    def answer(tree, asked):
        data_ids, data, t = tree
        ids, x = (np.concatenate(c) for c in zip(*asked, strict=True))
        if t is not None:
            best, who = dual_search(data, data_ids, t, x, k)
            keep = np.isfinite(best)
            a, b, s = np.broadcast_to(ids[:, None], best.shape)[keep], who[keep], best[keep].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.nulls(len(a), pa.string())], names)
            return
        wide = [[int(c) for c in row] for row in data]
        for i, row in zip(ids.tolist(), x, strict=True):  # sums of any size
            own = [int(c) for c in row]
            s = [sum(map(int.__mul__, own, other)) for other in wide]
            top = sorted(range(len(s)), key=lambda j: (-s[j], data_ids[j]))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(top), pa.int64()), pa.array(data_ids[top]), pa.array([max(-(2**63), min(2**63 - 1, s[j])) for j in top], pa.int64()), pa.array([ordered(s[j]) for j in top], pa.string())], names)

    names = ["asked", "vec_id", "score", "place"]
    key = ["dim", "region", "block"]
    return rows.select(*key, "kind", "vec_id", "v").repartition(*key).sortWithinPartitions(*key, "kind", "vec_id").mapInArrow(work, "asked long, vec_id long, score long, place string")


def top_k(vectors: DataFrame, k: int, is_query) -> DataFrame:
    """vectors (vec_id, v array<double> of whole numbers) -> query_id, rank, vec_id, score: for each row that is_query selects,
    the k best of all other rows of the same length by inner product, ties to the smaller vec_id.

    Of equal vectors only the k + 1 of smallest vec_id can be in a list: a hot one costs no more than another. Scores are
    exact; one beyond 64 bits is ranked by its true value and shown as the nearest that a long holds. Where a sum could pass
    2**52, whole numbers of any length take the place of trees: vectors so large are asked of all, and compared with all. An
    empty table gives no rows; rows that repeat a vec_id and a vector are one; empty vectors have products of 0."""
    v = vectors.groupBy("vec_id", "v").agg(F.lit(1).alias("one")).select("vec_id", "v", F.size("v").alias("dim"))
    v = stash(v.withColumn("huge", F.exists("v", lambda c: c * c * F.col("dim") >= EXACT)))
    placed, pivots = _regions(v)
    placed = stash(placed)
    data = stash(placed.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n"))
    # a row for each region, that is for DATA vectors
    sizes = stash(data.groupBy("dim", "region").agg(F.max("far").alias("radius"), F.max("norm").alias("reach"), F.ceil(F.count("*") / DATA).cast("int").alias("blocks")))
    regions = sizes.toArrow().to_pylist()
    in_block = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("blocks")).cast("int")
    dealt = data.join(F.broadcast(sizes.select("dim", "region", "blocks")), ["dim", "region"]).select("dim", "region", in_block.alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = placed.where(is_query).groupBy("v", "dim", "region", "huge").agg(F.min("vec_id").alias("vec_id"))
    # first in one block of the own region
    at_home = asked.where(~F.col("huge")).join(F.broadcast(sizes.select("dim", "region", "blocks")), ["dim", "region"]).select("dim", "region", in_block.alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    first = stash(_asked(dealt.where("region >= 0").union(at_home), k + 1, False))
    worst = first.groupBy("asked").agg(F.min("score").alias("least"), F.count("*").alias("c")).select("asked", F.when(F.col("c") > k, F.col("least")).alias("least"))
    # then wherever the bound is not below the kth score there
    rest = asked.join(at_home.select(F.col("vec_id").alias("asked"), F.col("region").alias("own"), F.col("block").alias("home")), F.col("vec_id") == F.col("asked"), "left").drop("asked")
    rest = rest.join(worst, F.col("vec_id") == F.col("asked"), "left").select("vec_id", "v", "dim", "huge", "own", "home", "least")

    def route(batches):
        for batch in batches:
            dim, huge = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            own, home, least = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (4, 5, 6))
            at, regs, blocks = [], [], []
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                mine = [r for r in regions if r["dim"] == d]
                x = _matrix(batch.column(1).take(pa.array(rows)), int(d))
                p = pivots.get(int(d), np.zeros((1, int(d))))
                for r in mine:
                    go = huge[rows] | (r["region"] < 0) | np.isnan(least[rows])
                    if r["region"] >= 0:
                        c = p[r["region"]]
                        with np.errstate(over="ignore", invalid="ignore"):
                            bound = np.minimum(x @ c + np.sqrt((x**2).sum(1)) * (r["radius"] * (1 + 1e-9) + 1e-6), np.sqrt((x**2).sum(1)) * r["reach"] * (1 + 1e-9))
                        go |= ~(bound * (1 + 1e-9) + 1e-6 < least[rows])
                    for block in range(r["blocks"]):
                        hit = rows[go & ~((own[rows] == r["region"]) & (home[rows] == block) & (r["region"] >= 0))]
                        at.append(hit), regs.append(np.full(len(hit), r["region"])), blocks.append(np.full(len(hit), block))
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            regs, blocks = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (regs, blocks))
            i = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(i), pa.array(regs), pa.array(blocks.astype(np.int32)), pa.array(np.ones(len(at), np.int32)), batch.column(0).take(i), batch.column(1).take(i), batch.column(3).take(i)], ["dim", "region", "block", "kind", "vec_id", "v", "huge"])

    routed = stash(rest.mapInArrow(route, "dim int, region long, block int, kind int, vec_id long, v array<double>, huge boolean"))
    wide = (F.col("region") < 0) | F.col("huge")  # sums of any size
    key = ["dim", "region", "block", "kind", "vec_id", "v"]
    found = first.union(_asked(dealt.where("region >= 0").union(routed.where(~wide).select(*key)), k + 1, False))
    if any(r["region"] < 0 for r in regions):
        found = found.union(_asked(dealt.union(routed.where(wide).select(*key)), k + 1, True))
        # whole numbers below 2**52 in the same order of strings
        digits = F.abs("score").cast("string")
        small = F.when(F.col("score") >= 0, F.concat(F.lit("p"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(F.concat(F.lit("n"), (9999 - F.length(digits)).cast("string"), F.translate(digits, "0123456789", "9876543210")))
        order = [F.desc(F.coalesce("place", small)), F.col("vec_id")]
    else:
        order = [F.desc("score"), F.col("vec_id")]
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).where(F.col("n") <= k + 1)
    # back to every query of an equal vector, each without itself
    same = placed.where(is_query).select(F.col("vec_id").alias("query_id"), "v").join(asked.select("v", F.col("vec_id").alias("asked")), "v").select("query_id", "asked")
    out = same.join(found, "asked").where("query_id <> vec_id")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir) -> DataFrame:
    return top_k(whole(table(spark, sf_dir, "embeddings")), 20, F.col("vec_id") % 20 == 0)


OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings where embedding is not null),
s as (select q.vec_id as query_id, d.vec_id, list_dot_product(q.v, d.v)::bigint as score from v q join v d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

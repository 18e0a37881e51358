"""N-gram Jaccard join by signature trees: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A set's shingles stand in one order: rare ones by their hash, then the most frequent ones of the corpus, rarer first. Two
sets that similar share a shingle among the first fifth of each, so pairs meet in the group of such a shingle. The further
on a shingle stands, the smaller a partner must be that has it as the first one shared: a set stays in a group only if that
has one so small. The order alone depends on the count of frequent shingles, not what is found.

Within a group a signature tree is built over the members: each node holds the bitwise OR of the bitmaps below it and their
range of sizes, and a dual traversal of the tree with itself leaves out pairs of nodes whose largest possible overlap is
below what their sizes ask for. What is left is compared shingle by shingle. Equal sets are one node. Before that, in three
of its groups, a set is held against a few leaders only, so that copies hang together and the traversal can also leave out
nodes that lie in one component already: it answers for every pair of sets not yet connected.

A pair that shares several groups is left to the one of the smallest shingle among the first few of each. The exact
comparison goes by groups too: a set's shingles travel once to a group in which it has pairs, not once for each pair.

Groups above a size are dealt into cells of bounded size, every pair of their members in exactly one cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import discard, stash, table
from ._text import U, mix, run_hashes, slices, word_grams, word_hashes, words
from .components import components

WIDTH = 5
#: 100 * intersection >= 80 * union, as a share of both sizes: intersection >= 80 / 180 * (a + b).
PERCENT = 80
LEAF, FAN = 16, 8
#: Bytes of signatures that a line of a group's cells takes, and the least that a set counts for.
CELL, MARK = 4_000_000, 512
#: Groups in which a set meets leaders; smallest groups of a set that its rows name, to leave a pair to one group.
MEET, HEADS = 3, 4
#: Other members of such a group that a set is held against.
NEXT = 12
#: Bytes of shingles, and pairs, that one cell of the exact comparison takes; the least that a set counts for.
ROOM, PAIRS, LEAST = 8_000_000, 32_768, 4096
#: Bits of the widest signature, and bytes of signatures that a traversal holds against others at once.
WIDEST, STEP = 1 << 16, 8_000_000
#: Rows of two numbers, about 3 MB, up to which a table of ids is broadcast.
BROADCAST_ROWS = 100_000
#: Shingles that are ordered last, 1 MB at most: the most frequent of those that OFTEN of CHUNK consecutive shingles are.
FREQUENT, OFTEN, CHUNK = 1 << 17, 4, 1 << 21
#: Rows of a frequent shingle that go to one task.
SHARE = 100_000
#: Bits of a shingle's hash, and bytes of it; texts of a slice, so that both fit a word.
_BITS, _BYTES, _ROWS = 52, 7, 4096


def shingles(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 52 bits, offsets per text): each text's distinct shingles in order; a text of fewer words than a shingle
    has, its whole sequence as one."""
    starts, ends, per = words(raw, offs)
    h = word_hashes(raw, starts, ends, lower=True)
    count = np.diff(per)
    gram = word_grams(h, WIDTH)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(doc[: len(gram)] == doc[WIDTH - 1 :]) if len(gram) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    key = np.concatenate([gram[at], run_hashes(h, per[short], per[short + 1])]) >> U(64 - _BITS)
    key |= np.concatenate([doc[at], short]).astype(U) << U(_BITS)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key & U(2**_BITS - 1)).astype(np.int64), np.searchsorted(key >> U(_BITS), np.arange(len(count) + 1).astype(U))


def _node(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each set, 0 for the empty one."""
    c = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens.astype(U) + U(0x5EED)))])
    n = np.diff(offs)
    out = mix(c[offs[1:]] - c[offs[:-1]] + n.astype(U)).view(np.int64)
    return np.where(n > 0, out, 0)


def prefix(n: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles a partner must share one of: n - ceil(n * 80 %) + 1."""
    return np.where(n > 0, n - -(-n * PERCENT // 100) + 1, 0)


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap of 2 n to 4 n bits, a power of two, at least 128; of WIDEST bits for the largest sets, for which it prunes
    less."""
    size = min(WIDEST, max(128, 1 << int(2 * len(tokens) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(tokens * 0x9E3779B1 >> 13) & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, node, n, least (its smallest shingle), bits (its signature). And rows token, hits: shingles
    that a task has met often."""

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for i, raw, offs in slices(batch.column(1), rows=_ROWS):
                tokens, at = shingles(raw, offs)
                n = np.diff(at)
                least = np.append(tokens, 0)[at[:-1]]
                bits = [signature(tokens[a:b]) if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + len(n)], pa.array(_node(tokens, at)), pa.array(n), pa.array(least), pa.array(bits, pa.binary()), none, none], names)
                held.append(tokens)
                size += len(tokens)
                if size > CHUNK:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    def often(held):
        token, hits = np.unique(np.concatenate(held), return_counts=True)
        token, hits = token[hits >= OFTEN], hits[hits >= OFTEN]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(token), pa.binary()), pa.array(token), pa.array(hits)], names)

    names = ["doc_id", "node", "n", "least", "bits", "token", "hits"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, node long, n long, least long, bits binary, token long, hits long")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, their place in the order, tasks that their rows are dealt to): at most FREQUENT, sorted by shingle."""
    top = sets.where("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "token").limit(FREQUENT).toPandas()
    token, hits = top["token"].to_numpy(np.int64), top["hits"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], (len(token) - order).astype(np.int64), hits[order] // SHARE + 1


def _tokens(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """token, node, size, cell: the first shingles of each set; size holds, above 32 bits, how many it has, and below, up to
    which size a partner may have this as the first one shared: both have at least 80 / 180 of the sizes' sum from there on.
    cell: of a frequent shingle, a part of its rows, else -1. A task names equal sets once."""

    def work(batches):
        hot, place, cells = frequent
        seen: set[int] = set()
        for batch in batches:
            for _, raw, offs in slices(batch.column(0), rows=_ROWS):
                tokens, at = shingles(raw, offs)
                node, size = _node(tokens, at), np.diff(at)
                new = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        new[i] = True
                k = np.minimum(np.searchsorted(hot, tokens), max(0, len(hot) - 1))
                often = hot[k] == tokens if len(hot) else np.zeros(len(tokens), bool)
                if often.any():
                    order = np.argsort(np.repeat(np.arange(len(size)), size) << 20 | np.where(often, place[k], 0), kind="stable")
                    tokens, k, often = tokens[order], k[order], often[order]
                n = np.where(new, prefix(size), 0)
                ends = np.cumsum(n)
                rank = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
                whole = np.repeat(size, n)
                most = (100 + PERCENT) * (whole - rank) // PERCENT - whole
                i, own = np.repeat(at[:-1], n) + rank, np.repeat(node, n)
                cell = np.full(len(i), -1)
                some = np.flatnonzero(often[i])
                cell[some] = own[some] % cells[k[i[some]]]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[i]), pa.array(own), pa.array(whole << 32 | np.maximum(most, 0)), pa.array(cell.astype(np.int32))], ["token", "node", "size", "cell"])

    return docs.select("text").mapInArrow(work, "token long, node long, size long, cell int")


def _groups(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """token, node, n: the rows of shingles that another set has too, small enough for both. A task reads its rows in order
    and holds one of them; those of a frequent shingle, in several tasks, all pass."""

    def work(batches):
        held = np.zeros((4, 0), np.int64)  # the first row of the last shingle: token, node, size, cell
        said = False  # and whether it has been passed on
        for batch in batches:
            if not len(batch):
                continue
            t = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], 1)
            same = (t[:3, 1:] == t[:3, :-1]).all(0)  # an equal set, from another task
            t = t[:, np.append(True, ~same)]
            token, n, most = t[0], t[2] >> 32, t[2] & 0xFFFFFFFF
            new = np.append(True, token[1:] != token[:-1])
            first = np.flatnonzero(new)
            own = np.cumsum(new) - 1
            hot = t[3] >= 0
            keep = ~new & (hot | (most >= n[first][own]))
            with_more = np.zeros(len(first), bool)
            with_more[own[keep]] = True
            keep[first] = with_more | hot[first]
            last_said = bool(keep[first[-1]]) or (len(first) == 1 and held.shape[1] > 0 and said)
            if held.shape[1] and said:
                keep[0] = False
            held, said = t[:, first[-1] :][:, :1], last_said
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(t[1][keep]), pa.array(n[keep])], ["token", "node", "n"])

    dealt = _tokens(docs, frequent).repartition("token", "cell").sortWithinPartitions("token", "cell", "size", "node")
    return dealt.mapInArrow(work, "token long, node long, n long")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, tokens (7 bytes each) of the nodes wanted, each from one document (wanted: node, doc_id). The few ids that near
    copies make are broadcast if counting has shown that they take a few MB at most; else the texts are shuffled."""
    wanted = stash(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("node", "text")

    def work(batches):
        for batch in batches:
            want = batch.column(0).to_numpy()
            for i, raw, offs in slices(batch.column(1), rows=_ROWS):
                tokens, at = shingles(raw, offs)
                ok = _node(tokens, at) == want[i : i + len(offs) - 1]  # rows that share the doc_id may hold other texts
                data = tokens.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()
                rows = [data[_BYTES * a : _BYTES * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + len(rows)], pa.array(rows, pa.binary())], ["node", "tokens"]).filter(pa.array(ok))

    return picked.mapInArrow(work, "node long, tokens binary").dropDuplicates(["node"])


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return out.view("<i8").ravel()


def _fold(bits: np.ndarray) -> np.ndarray:
    """The bitmaps of half the width."""
    return bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]


def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class Tree:
    """Signatures, level by level: OR of bitmaps, sizes from and to, the most shingles that share a bit with others of their
    set, components from and to, first groups from and to. Level 0 are the sets themselves."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray, head: np.ndarray):
        extra = n - _pop(bits)
        self.levels = [(bits, n, n, extra, comp, comp, head, head)]
        fan = LEAF
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, x, *ranges = self.levels[-1]
            cut = np.arange(0, len(lo), fan)
            self.levels.append((np.bitwise_or.reduceat(b, cut, 0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(x, cut), *((np.maximum if k % 2 else np.minimum).reduceat(r, cut) for k, r in enumerate(ranges))))
            fan = FAN

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else FAN


def dual(a: Tree, b: Tree, same: bool):
    """Pairs (i, j) of sets that may be similar enough, i < j if the trees are the same; none of one component or of one first
    group, which is another than this."""
    height = max(len(a.levels), len(b.levels)) - 1
    most = max(256, STEP // (8 * a.levels[0][0].shape[1]))

    def near(level, i, j):
        la, lb = (t.levels[min(level, len(t.levels) - 1)] for t in (a, b))
        keep = (5 * la[2][i] >= 4 * lb[1][j]) & (5 * lb[2][j] >= 4 * la[1][i])
        if same and level == 0:
            keep &= i < j
        for lo, hi in ((4, 5), (6, 7)):
            keep &= ~((la[lo][i] == la[hi][i]) & (lb[lo][j] == lb[hi][j]) & (la[lo][i] == lb[lo][j]))
        i, j = i[keep], j[keep]
        shared = _pop(la[0][i] & lb[0][j])
        # shingles of a set whose bit the other side has: the shared bits, and what falls on a bit once more
        top = np.minimum(shared + np.minimum(la[3][i], lb[3][j]), np.minimum(la[2][i], lb[2][j]))
        if level == 0:  # one set on each side: all of a set's shingles on bits that the other has not are missing
            ones = [n - x for n, x in ((la[1][i], la[3][i]), (lb[1][j], lb[3][j]))]
            top = np.minimum(top, np.minimum(la[1][i] - (ones[0] - shared), lb[1][j] - (ones[1] - shared)))
        keep = 180 * top >= 80 * (la[1][i] + lb[1][j])
        return i[keep], j[keep]

    stack = [(height, *near(height, np.zeros(1, np.int64), np.zeros(1, np.int64)))]
    while stack:
        level, i, j = stack.pop()
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        fa, fb = (a.fan(level) if level < len(a.levels) else 1), (b.fan(level) if level < len(b.levels) else 1)
        na, nb = (len(t.levels[min(level - 1, len(t.levels) - 1)][1]) for t in (a, b))
        fit = max(1, most // (fa * fb))  # pairs whose children are held at once; the rest waits
        if len(i) > fit:
            stack.append((level, i[fit:], j[fit:]))
            i, j = i[:fit], j[:fit]
        ci = (i[:, None] * fa + np.repeat(np.arange(fa), fb)).ravel()
        cj = (j[:, None] * fb + np.tile(np.arange(fb), fa)).ravel()
        keep = (ci < na) & (cj < nb) & ((ci <= cj) | (not same))
        stack.append((level - 1, *near(level - 1, ci[keep], cj[keep])))


def leaders(bits: np.ndarray, n: np.ndarray, tries: int = 4):
    """Pairs (leader, member) that may be similar enough: a leader takes what is near it out of the group; ends after some
    leaders in a row that found nothing. Only a start: what it leaves is the traversal's."""
    left, failed = np.arange(len(n)), 0
    while len(left) > 1 and failed < tries:
        i, rest = left[0], left[1:]
        shared = _pop(bits[rest] & bits[i])
        top = np.minimum(n[i] - (_pop(bits[i]) - shared), n[rest] - (_pop(bits[rest]) - shared))
        near = 180 * top >= 80 * (n[i] + n[rest])
        failed = 0 if near.any() else failed + 1
        if near.any():
            yield np.full(near.sum(), i), rest[near]
        left = rest[~near]


def elsewhere(x: np.ndarray, y: np.ndarray, token: int) -> np.ndarray:
    """Whether rows of two tables of heads have a smaller group in common than this one."""
    x = np.where(x < token, x, -1)
    return ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any((1, 2))


def _widths(n, least, bits):
    """The members by width of signature, near ones beside each other: (members, their bitmaps), and the same of those twice as
    wide, folded."""
    width = np.array([len(b) for b in bits])
    order = np.lexsort((n, least))
    for w in np.unique(width):
        a, b = order[width[order] == w], order[width[order] == 2 * w]
        ma = np.frombuffer(b"".join([bits[k] for k in a]), np.uint64).reshape(len(a), -1)
        yield a, ma, b, _fold(np.frombuffer(b"".join([bits[k] for k in b]), np.uint64).reshape(len(b), -1)) if len(b) else None


def neighbours(bits: np.ndarray, n: np.ndarray, places: np.ndarray):
    """Pairs that may be similar enough of each member with the next NEXT in the order of places, a ring: where many are about
    as similar as asked, they connect what no leader does."""
    order = np.argsort(places)
    for step in range(1, min(NEXT, len(n) // 2) + 1):
        i, j = order, np.roll(order, -step)
        shared = _pop(bits[i] & bits[j])
        top = np.minimum(n[i] - (_pop(bits[i]) - shared), n[j] - (_pop(bits[j]) - shared))
        near = 180 * top >= 80 * (n[i] + n[j])
        yield i[near], j[near]


def _led(token, node, n, least, bits):
    """Pairs of a group's members with leaders and with some others."""
    out = [np.zeros((2, 0), np.int64)]
    for a, ma, b, mb in _widths(n, least, bits):
        rows, m = (np.concatenate([a, b]), np.concatenate([ma, mb])) if mb is not None else (a, ma)
        places = mix((node[rows] ^ token).view(U))
        out += [np.stack([rows[i], rows[j]]) for found in (leaders(m, n[rows]), neighbours(m, n[rows], places)) for i, j in found]
    return np.concatenate(out, 1)


def _traversed(token, n, least, bits, comp, heads, side, cross: bool):
    """Pairs of a group's or cell's members that the traversal leaves, but for those that a smaller group finds."""
    head = np.where((heads[:, 0] >= 0) & (heads[:, 0] < token), heads[:, 0], -1 - np.arange(len(n)))
    out = [np.zeros((2, 0), np.int64)]
    for a, ma, b, mb in _widths(n, least, bits):
        ta = Tree(ma, n[a], comp[a], head[a])
        found = [(a[i], a[j]) for i, j in dual(ta, ta, True)] if len(a) > 1 else []
        if mb is not None:
            found += [(a[i], b[j]) for i, j in dual(ta, Tree(mb, n[b], comp[b], head[b]), False)]
        for i, j in found:
            keep = ~elsewhere(heads[i], heads[j], token)
            if cross:
                keep &= side[i] != side[j]
            out.append(np.stack([i[keep], j[keep]]))
    return np.concatenate(out, 1)


def _by_cell(rows: DataFrame, key: list[str], judge) -> DataFrame:
    """Distinct pairs (a, b) with the smallest token that gives them: judge(cell) gives two rows of members' places for the
    rows of each cell, which has a bounded size; the columns of a cell are arrays by name, bits a list."""
    names = rows.columns

    def work(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([*(rest.to_batches() if rest is not None else ()), batch]).combine_chunks()
            last = np.logical_and.reduce([t[k].to_numpy() == t[k].to_numpy()[-1] for k in key])
            cut = int(np.searchsorted(last, True))
            yield from cells(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from cells(rest)

    def cells(t):
        if not len(t):
            return
        col = {k: t[k].to_numpy() for k in names if k not in ("bits", "heads")}
        bits, out = t["bits"].combine_chunks().to_pylist(), []
        if "heads" in names:
            lists = t["heads"].combine_chunks()
            count, col["heads"] = lists.value_lengths().to_numpy(), np.full((len(t), HEADS), -1)
            col["heads"][np.arange(HEADS) < count[:, None]] = lists.flatten().to_numpy()
        cuts = np.flatnonzero(np.append(True, np.logical_or.reduce([np.diff(col[k]) != 0 for k in key])))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(t)], strict=True):
            if hi - lo > 1:
                i, j = judge({k: x[lo:hi] for k, x in col.items()} | {"bits": bits[lo:hi]}) + lo
                a, b = col["node"][i], col["node"][j]
                out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.full(len(a), col["token"][lo])]))
        if out:
            a, b, token = np.concatenate(out, 1)
            order = np.lexsort((token, b, a))
            a, b, token = a[order], b[order], token[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (a, b, token)], ["a", "b", "token"])

    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(work, "a long, b long, token long").groupBy("a", "b").agg(F.min("token").alias("token"))


def _lines(groups: DataFrame) -> DataFrame:
    """token, k: into how many lines the members of a group are dealt, for groups of several."""
    room = F.greatest(F.least("n", F.lit(WIDEST // 8)), F.lit(MARK))  # a signature has n bytes at most
    return groups.groupBy("token").agg(F.ceil(F.sum(room) / CELL).cast("int").alias("k"), F.count("*").alias("members")).where("members > 1").drop("members")


def _near(groups: DataFrame, marks: DataFrame, docs: DataFrame, owner: DataFrame) -> DataFrame:
    """Links (a, b) of sets to leaders that they meet in MEET groups each. Members of a group above a cell's size meet those of
    their line; then one of each component, and so on until a cell holds the rest or no more hang together."""
    picks = groups.groupBy("node").agg(F.first("n").alias("n"), *(F.min_by("token", F.xxhash64("token", F.lit(k))).alias(f"t{k}") for k in range(MEET)))
    open_ = stash(picks.select("node", "n", F.explode(F.array_distinct(F.array(*(f"t{k}" for k in range(MEET))))).alias("token")))
    links, left = None, None
    while True:
        lines = stash(_lines(open_))
        rows = open_.join(lines, "token").withColumn("line", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        rows = rows.select("token", "line", "node").join(marks, "node").select("token", "line", "node", "n", "least", "bits")
        found = _verified(_by_cell(rows, ["token", "line"], lambda c: _led(c["token"][0], c["node"], c["n"], c["least"], c["bits"])), docs, owner, marks)
        links = found if links is None else links.union(found)
        wide = lines.where("k > 1")
        if wide.isEmpty():
            return links
        comp = components(links)
        rest = open_.join(wide.select("token"), "token", "left_semi").join(comp, "node", "left")
        old, open_ = open_, stash(rest.groupBy("token", F.coalesce("component", "node")).agg(F.min_by("n", "node").alias("n"), F.min("node").alias("node")).select("node", "n", "token"))
        discard(old, lines)
        before, left = left, open_.count()
        if left == before:
            return links


def _apart(groups: DataFrame, marks: DataFrame) -> DataFrame:
    """groups (token, node, n, comp), marks (node, n, least, bits) -> distinct pairs (a, b) that may be similar enough and are
    in different components, and the smallest group (token) that found them: a pair is left to a smaller group if one is
    known."""
    marks = marks.join(groups.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("token")), 1, HEADS).alias("heads")), "node")
    rows = groups.join(_lines(groups), "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    # with k lines a member goes to the k cells of its line: (own, x) from own on, (x, own) before it
    rows = rows.withColumn("x", F.explode(F.expr("sequence(0, k - 1)"))).select("token", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "node", "comp")
    rows = rows.join(marks, "node").select("token", "i", "j", "own", "node", "n", "least", "comp", "heads", "bits")
    return _by_cell(rows, ["token", "i", "j"], lambda c: _traversed(c["token"][0], c["n"], c["least"], c["bits"], c["comp"], c["heads"], c["own"], bool(c["i"][0] != c["j"][0])))


def _verified(pairs: DataFrame, docs: DataFrame, owner: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs that are similar enough, shingle by shingle. owner: node, doc_id of one document that has it.

    A group's pairs are dealt into cells, k lines by k, so that a cell's sets and pairs are bounded; a set's shingles go once
    to each cell that has pairs of it."""
    pairs = stash(pairs)
    whole = stash(_whole_sets(docs, _ends(pairs).distinct().join(owner, "node")))
    room = _ends(pairs, "token").distinct().join(marks.select("node", "n"), "node").groupBy("token").agg(F.ceil(F.sum(F.greatest(F.col("n") * _BYTES, F.lit(LEAST))) / ROOM).alias("k"))
    many = pairs.groupBy("token").agg(F.ceil(F.sqrt(F.count("*") / PAIRS)).alias("m"))
    # a table of its own: AQE splits the join of a hot token only if no aggregate stands between it and the exchanges
    lines = stash(room.join(many, "token").select("token", F.greatest("k", "m").cast("int").alias("k")))
    cells = stash(pairs.join(lines, "token").select("token", *(F.pmod(F.xxhash64(c), F.col("k")).cast("int").alias(f"l{c}") for c in "ab"), "a", "b"))
    key = ["token", "la", "lb"]
    sets = _ends(cells, *key).distinct().join(whole, "node").select(*key, F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    rows = sets.union(cells.select("*", F.lit(None).cast("binary"))).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("b"))

    def work(batches):
        at, held = None, {}
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (token, la, lb, a, b, tokens) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if (token, la, lb) != at:
                    at, held = (token, la, lb), {}
                if b is None:
                    held[a] = unpack(tokens)
                elif a in held and b in held:
                    x, y = held[a], held[b]
                    z = np.concatenate([x, y])
                    z.sort(kind="stable")
                    inter = int(np.count_nonzero(z[1:] == z[:-1]))
                    ok[i] = 100 * inter >= PERCENT * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4)], ["a", "b"]).filter(pa.array(ok))

    out = stash(rows.mapInArrow(work, "a long, b long"))
    discard(pairs, whole, cells, lines)
    return out


def _ends(pairs: DataFrame, *key: str) -> DataFrame:
    return pairs.select(*key, F.col("a").alias("node")).union(pairs.select(*key, "b"))


def join(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id reachable by links.

    A-Z count as a-z. Null, empty and wordless texts have no shingle and link with nothing. Rows that share a doc_id are one
    node. A null doc_id takes part in no link but with texts of the same shingles, and names no component: else its own is null."""
    seen = stash(_sets(docs))
    sets = seen.where("node is not null")
    groups = stash(_groups(docs, _frequent(seen)))
    owner = sets.where("node <> 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    marks = stash(sets.select("node", "n", "least", "bits").join(groups.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    links = _near(groups, marks, docs, owner)
    labelled = stash(groups.join(components(links), "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("comp")))
    discard(groups)
    # groups of one component are done; of those with the same members one stays
    apart = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")).where("lo <> hi")
    kept = apart.groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token")
    open_ = stash(labelled.join(kept, "token", "left_semi"))
    discard(labelled)
    more = _verified(_apart(open_, marks), docs, owner, marks)
    discard(open_, marks)
    # documents hang on their sets; rows of one doc_id hang together
    comp = components(links.union(more))
    rows = sets.join(comp, "node", "left").select("doc_id", "n", F.when(F.col("node") != 0, F.coalesce("component", "node")).alias("c"))
    least = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def op10_ngram_join(spark, sf_dir) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
h as (select *, count(*) over (partition by g) as c from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from h a join h b on a.g = b.g and a.doc_id < b.doc_id where a.c > 1 and b.c > 1 group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
c(a, b) as (select a, b from e union select c.a, e.b from c join e on c.b = e.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join (select a, min(b) as least from c group by a) m on m.a = w.doc_id
"""

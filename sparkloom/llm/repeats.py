"""Candidates for repeated windows, for substring dedup over bytes and over words.

Every window answers to one of its k-grams, the one of smallest hash; equal windows answer to equal k-grams at the same
place in them. So only documents' windows with a k-gram that another window also answers to (another run of windows, in
any document) can repeat, and all equal windows meet in the group of their k-gram. Runs of windows whose whole stretch of
text is equal, as in copies, collapse to one with a count before their text is fetched: a group holds different texts
only. Nothing is capped: a group with more than `most` different stretches is not gathered in one task, the hashes of its
windows are counted instead. Stretches and windows count as equal if 64-bit hashes of all their symbols agree, and with them
their k-grams and places.

Rows that share a doc_id are told apart by a hash of their text and count as one document in the order of documents; a
null doc_id comes last in that order. Null and empty texts have no windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import discard, stash
from ._text import U, anchor_runs, run_hashes, slices, stretch_hashes

#: pos = lo << 20 | starts << 10 | offset of the anchor from lo, in symbols of the document; windows are below 1,024.
RUNS = "anchor long, ctx long, d long, t long, pos long"


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols of `width` bytes: `grams` gives per slice (k-gram hashes, symbol offsets of documents, hash of a run i:j),
    `cut` the stretch of symbols lo:hi of one text as bytes, for the kernel."""

    window: int
    k: int
    width: int
    grams: Callable
    cut: Callable


def keyed(docs: DataFrame) -> DataFrame:
    """(d, t, doc_id, text): d orders documents, t tells texts of one doc_id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("t"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def runs(docs: DataFrame, s: Symbols, only_anchor: bool = False) -> DataFrame:
    def work(batches):
        for batch in batches:
            for i, raw, offs in slices(batch.column(2)):
                gram, sym_offs, run = s.grams(raw, offs)
                doc, at, lo, n = anchor_runs(gram, sym_offs, s.window, s.k)
                anchor = gram[at].view(np.int64)
                if only_anchor:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
                    continue
                ctx = run(lo, lo + n + s.window - 1) + (at - lo).astype(U)
                pos = (lo - sym_offs[doc]) << 20 | n << 10 | (at - lo)
                row = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ctx.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(pos)], ["anchor", "ctx", "d", "t", "pos"])

    return docs.select("d", "t", "text").mapInArrow(work, "anchor long" if only_anchor else RUNS)


def repeated(docs: DataFrame, s: Symbols, kernel: Callable, order_matters: bool, most: int = 4000, block: int = 250_000) -> DataFrame:
    """(d, t, spans array<long>): for each text with repeated windows, their first symbols, as lo << 20 | count.

    kernel(groups) works on whole groups of stretches: arrays `group` (a number, in order), `weight`, `d`, `pos`, `bytes`,
    and returns (row, start, count, kind): windows of each stretch that repeat, kind 0 in all runs with that stretch, 1 in
    all but the first. With order_matters the first window of equal ones stays."""
    spark = docs.sparkSession
    docs = keyed(docs)
    # tables of their own: AQE splits the join of a hot anchor only if no aggregate stands between it and the exchanges
    often = stash(runs(docs, s, only_anchor=True).groupBy("anchor").count().where("count > 1").select("anchor"))
    members = stash(runs(docs, s).join(often, "anchor", "left_semi"))
    each = stash(members.groupBy("anchor", "ctx").agg(F.count("*").alias("weight"), F.min(F.struct("d", "pos", "t")).alias("f")))
    size = stash(each.groupBy("anchor").agg(F.count("*").alias("stretches"), F.sum("weight").alias("runs")).where("runs > 1"))
    stretch = stash(each.join(size, "anchor").select("anchor", "ctx", "weight", "f.d", "f.t", "f.pos", "stretches"))
    discard(often, each, size)
    found = _judge(docs, stretch, s, kernel, order_matters, most, block)
    keys = ["anchor", "ctx"]
    found = found.withColumnRenamed("d", "fd").withColumnRenamed("pos", "fpos")
    hits = members.join(found, keys).where(~((F.col("kind") == 1) & (F.col("d") == F.col("fd")) & (F.col("pos") == F.col("fpos"))))
    spans = hits.select("d", "t", (((F.shiftright("pos", 20) + F.col("start")) * (1 << 20)) + F.col("count")).alias("span"))
    out = stash(spans.groupBy("d", "t").agg(F.array_sort(F.collect_set("span")).alias("spans")))
    return out


def _judge(docs: DataFrame, stretch: DataFrame, s: Symbols, kernel: Callable, order_matters: bool, most: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    need = stretch.groupBy("d", "t").agg(F.collect_list(F.struct("anchor", "ctx", "weight", "pos", (F.col("stretches") > most).alias("big"))).alias("rows"))

    def fetch(batches):
        for batch in batches:
            d, rows = batch.column(0), batch.column(2)
            for i, raw, offs in slices(batch.column(1)):
                part = rows[i : i + len(offs) - 1]
                flat, count = part.flatten(), np.diff(part.offsets.to_numpy().astype(np.int64))
                own = np.repeat(np.arange(len(count)), count)
                pos = flat.field("pos").to_numpy()
                lo, n = pos >> 20, pos >> 10 & 1023
                cut = s.cut(raw, offs, own, lo, lo + n + s.window - 1)
                for a in range(0, len(flat), 20_000):
                    yield pa.RecordBatch.from_arrays([*(flat.field(k)[a : a + 20_000] for k in ("anchor", "ctx", "weight")), d[i : i + len(count)].take(pa.array(own[a : a + 20_000])), flat.field("pos")[a : a + 20_000], flat.field("big")[a : a + 20_000], cut[a : a + 20_000]], ["anchor", "ctx", "weight", "d", "pos", "big", "bytes"])

    texts = docs.select("d", "t", "text").join(need.hint("shuffle_hash"), ["d", "t"]).select("d", "text", "rows")
    rows = stash(texts.mapInArrow(fetch, "anchor long, ctx long, weight long, d long, pos long, big boolean, bytes binary"))

    def judge(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > block:
                rows = pa.Table.from_batches(held).combine_chunks()
                a = rows["anchor"].to_numpy()
                cut = int(np.searchsorted(a == a[-1], True))  # groups stand together: all but the last are whole
                if cut:
                    yield from answer(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield from answer(pa.Table.from_batches(held).combine_chunks())

    def answer(rows: pa.Table):
        if not len(rows):
            return
        # rows that repeat a doc_id and a text have fetched the same stretch
        same = np.logical_and.reduce([np.diff(rows[k].to_numpy()) == 0 for k in ("anchor", "ctx")])
        rows = rows.filter(pa.array(np.append(True, ~same))).combine_chunks()
        a, col = rows["anchor"].to_numpy(), rows["bytes"].combine_chunks()
        cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
        size = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        # whole groups, as many as begin in one block of bytes
        cuts = cuts[np.append(True, np.diff((size[cuts] - size[0]) // block) > 0)]
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=True):
            if lo < hi:
                yield from part(rows.slice(lo, hi - lo))

    def part(rows: pa.Table):
        a = rows["anchor"].to_numpy()
        row, start, count, kind = kernel(np.cumsum(np.append(False, a[1:] != a[:-1])), rows["weight"].to_numpy(), rows["d"].to_numpy(), rows["pos"].to_numpy(), rows["bytes"].combine_chunks())
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([*(rows[k].combine_chunks().take(at) for k in ("anchor", "ctx", "d", "pos")), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(kind, pa.int32())], ["anchor", "ctx", "d", "pos", "start", "count", "kind"])

    schema = "anchor long, ctx long, d long, pos long, start long, count long, kind int"
    small = rows.where("not big").select("anchor", "ctx", "weight", "d", "pos", "bytes").repartition("anchor").sortWithinPartitions("anchor", "ctx").mapInArrow(judge, schema)

    # groups of more than `most` different stretches: one row per window of theirs, counted by a hash of all its symbols
    def explode(batches):
        for whole in batches:
            for k in range(0, len(whole), 100):  # stretches hold hundreds of windows
                batch = whole[k : k + 100]
                pos = batch.column(4).to_numpy()
                n = pos >> 10 & 1023
                row = pa.array(np.repeat(np.arange(len(n)), n))
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h = _window_hashes(batch.column(5), n, s)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in range(5)), pa.array(start), pa.array(h.view(np.int64))], ["anchor", "ctx", "weight", "d", "pos", "start", "h"])

    one = rows.where("big").dropDuplicates(["anchor", "ctx"]).select("anchor", "ctx", "weight", "d", "pos", "bytes").mapInArrow(explode, "anchor long, ctx long, weight long, d long, pos long, start long, h long")
    place = F.struct("d", (F.shiftright("pos", 20) + F.col("start")).alias("s"), "ctx")
    sums = one.groupBy("anchor", "h").agg(F.sum("weight").alias("w"), F.min(place).alias("first")).where("w > 1")
    big = one.join(sums, ["anchor", "h"]).select("anchor", "ctx", "d", "pos", "start", F.lit(1).cast("long").alias("count"), (F.when(place == F.col("first"), 1).otherwise(0) if order_matters else F.lit(0)).cast("int").alias("kind"))
    out = stash(small.unionByName(big))
    return out


def _window_hashes(col: pa.Array, n: np.ndarray, s: Symbols) -> np.ndarray:
    """Of every window of every stretch."""
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    i = np.repeat((offs[:-1] - offs[0]) // s.width - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return run_hashes(raw.view(U), i, i + s.window) if s.width == 8 else stretch_hashes(raw, i, i + s.window)

"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Candidate stretches (see repeats) are concatenated, block by block, and suffix-sorted to the minimum length. On the
Burrows-Wheeler transform, breadth-first backward extension then meets the boundaries between suffixes in the order of
their common prefix (after Beller, Gog, Ohlebusch, Schnattinger, 2013) and stops at the minimum length: suffixes between
which no boundary has been met by then begin with the same string."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from ._io import table
from ._text import byte_grams, slices, stretch_hashes

MIN_BYTES, GRAM = 400, 32
_END = 0xFF  # not in any UTF-8 text


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of text by their first `depth` bytes at least (by prefix doubling), and the common prefix, up to 8, of
    each with the one before."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key)
    diff = np.zeros(n, np.uint64)
    diff[1:] = key[order[1:]] ^ key[order[:-1]]
    lcp = np.full(n, 8, np.int32)
    for i in range(8):
        lcp[diff >> np.uint64(8 * i) > 0] = 7 - i
    # a suffix's rank is the place where those equal so far begin; those alone with their rank stand where they belong
    new = np.append(True, diff[1:] > 0)
    del padded, key, diff
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 8
    while h < depth and len(at):
        i = order[at]
        ahead = i + h
        pair = rank[i] << 32 | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        s = np.argsort(pair)
        order[at] = i = i[s]
        pair = pair[s]
        new = np.append(True, pair[1:] != pair[:-1])
        rank[i] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return order, lcp


def open_boundaries(text: np.ndarray, order: np.ndarray, short: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix, in order, shares `least` bytes or more with the one before. short: common prefixes up to 8.

    Level l holds the intervals of strings of l bytes whose right boundary was met at l - 1. Extending each to the left by
    every byte before it gives intervals of strings of l + 1 bytes; those whose right boundary is met now go on."""
    n = len(text)
    before = text[order - 1]  # the first suffix is preceded by the text's last byte, a separator
    to = np.zeros(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)  # LF mapping
    met = np.ones(n + 1, bool)
    met[:n] = short < 8
    met[0] = True
    # strings of 8 bytes: the intervals between boundaries below 8; those whose right boundary has 7 begin the search
    edge = np.flatnonzero(met)
    last = np.append(short, -1)
    lo, hi = edge[:-1], edge[1:]
    go = last[hi] == 7
    lo, hi = lo[go], hi[go]
    # equal bytes that stand together in the transform are one piece: a repetitive text has few
    begin = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
    piece = np.zeros(n, np.int64)
    piece[begin[1:]] = 1
    np.cumsum(piece, out=piece)
    symbol, first = before[begin], to[begin]
    begin = np.append(begin, n)
    for _ in range(8, least):
        if not len(lo):
            break
        a = piece[lo]
        count = piece[hi - 1] - a + 1
        if count.max() > 1:
            own = np.repeat(np.arange(len(lo)), count)
            r = a[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            lo, hi = np.maximum(lo[own], begin[r]), np.minimum(hi[own], begin[r + 1])
        else:
            own, r = None, a
        byte = symbol[r]
        keep = byte != _END  # strings do not run over the end of a stretch
        new = first[r] + lo - begin[r]
        lo, hi = new, new + hi - lo
        if own is not None:  # one string's pieces with the same byte meet in one interval
            many = np.flatnonzero(keep & (count[own] > 1))
            s = many[np.argsort(lo[many])]
            more = (lo[s[1:]] == hi[s[:-1]]) & (own[s[1:]] == own[s[:-1]]) & (byte[s[1:]] == byte[s[:-1]])
            if more.any():
                head = np.flatnonzero(np.append(True, ~more))
                hi[s[head]] = hi[s[np.append(head[1:], len(s)) - 1]]
                keep[s[1:][more]] = False
        lo, hi = lo[keep], hi[keep]
        go = ~met[hi]
        lo, hi = lo[go], hi[go]
        met[hi] = True
    return ~met[:n]


def kernel(group, weight, d, pos, col: pa.Array):
    """The windows that repeat in these stretches, as runs (row, start, count, 0). A stretch that stands for copies repeats
    by its weight."""
    n = pos >> 10 & 1023
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    row = np.repeat(np.arange(len(n)), np.diff(offs))
    text = np.full(len(raw) + len(n), _END, np.uint8)
    text[np.arange(len(raw)) + row] = raw
    order, short = suffix_order(text, MIN_BYTES)
    same = open_boundaries(text, order, short, MIN_BYTES)
    begin = offs[:-1] + np.arange(len(n))  # of each stretch in the text
    of = np.repeat(np.arange(len(n)), np.diff(offs) + 1)
    start = np.arange(len(text)) - begin[of]
    cls = np.zeros(len(text), np.int64)
    cls[order] = np.cumsum(~same)
    at = np.flatnonzero(start < n[of])
    total = np.bincount(cls[at], weight[of[at]])
    at = at[total[cls[at]] >= 2]
    return join_runs(of[at], start[at], np.zeros(len(at), np.int64))


def join_runs(row: np.ndarray, start: np.ndarray, kind: np.ndarray):
    """Consecutive starts of one row and kind as (row, start, count, kind)."""
    s = np.lexsort((start, kind, row))
    row, start, kind = row[s], start[s], kind[s]
    new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(start) != 1) | (np.diff(kind) != 0))) if len(row) else np.zeros(0, np.int64)
    return row[new], start[new], np.diff(np.append(new, len(row))), kind[new]


def _grams(raw, offs):
    return byte_grams(raw, GRAM), offs, lambda i, j: stretch_hashes(raw, i, j)


def _cut(raw, offs, own, lo, hi) -> pa.Array:
    size = hi - lo
    ends = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(offs[own] + lo - ends[:-1], size) + np.arange(ends[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


SYMBOLS = repeats.Symbols(MIN_BYTES, GRAM, 1, _grams, _cut)


def merged(spans: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Windows as lo << 20 | count to maximal covered stretches."""
    out: list[tuple[int, int]] = []
    for lo, end in sorted((x >> 20, (x >> 20) + (x & 0xFFFFF) - 1 + window) for x in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((lo, end))
    return out


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, and removed (array of begin, end in bytes) with kept
    (the remaining bytes), or with digest kept_sha256.

    Every byte in a string of 400 bytes that starts anywhere else, in the same document too, is removed, as judged on the
    input. Null and empty texts have no bytes; repeated rows are other documents, so long ones lose all."""
    spans = repeats.repeated(docs, SYMBOLS, kernel, order_matters=False)
    texts = repeats.keyed(docs).join(spans.hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "text", "spans")

    def work(batches):
        for batch in batches:
            lists = batch.column(2)
            for i, raw, offs in slices(batch.column(1)):
                rows, view, offs = [], memoryview(raw), offs.tolist()
                for k, s in enumerate(lists[i : i + len(offs) - 1].to_pylist()):
                    text, cut = view[offs[k] : offs[k + 1]], merged(s, MIN_BYTES)
                    edges = [0, *(x for c in cut for x in c), len(text)]
                    parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    if digest:
                        h = hashlib.sha256()
                        for p in parts:
                            h.update(p)
                        rows.append((len(text), sum(b - a for a, b in cut), len(cut), h.hexdigest()))
                    else:
                        rows.append((len(text), sum(b - a for a, b in cut), len(cut), [{"begin": a, "end": b} for a, b in cut], b"".join(parts)))
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + len(rows)], *cols], names)

    kinds = [pa.int64()] * 3 + ([pa.string()] if digest else [pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64()})), pa.binary()])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digest else ["removed", "kept"])]
    return texts.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "removed array<struct<begin:long,end:long>>, kept binary"))


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), digest=True)

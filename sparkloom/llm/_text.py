"""Numpy kernels over Arrow text columns: words, rolling hashes, sliding minima. Texts are seen as UTF-8 bytes; every
kernel works on slices of bounded size, a document is never cut."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One random 64-bit value for each byte.
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.bases, self.up, self.down = (base, pow(base, -1, 2**64)), np.ones(1, U), np.ones(1, U)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in zip(("up", "down"), self.bases, strict=True):
                a = np.full(max(n, 2 * len(self.up)), base, U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """c with value(i, j) = (c[j] - c[i]) * down[i], the same for equal runs of values wherever they stand."""
        self.need(len(values) + 1)
        c = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=c[1:])
        return c


#: Rolling, so some different strings agree by its structure: for finding candidates only.
BYTES = Powers(0x9E3779B97F4A7C15)
_STEP, _SEED = U(0xD1342543DE82EF95), U(0x2545F4914F6CDD1D)
#: The low r bytes of a lane.
_MASK = np.array([(1 << 8 * r) - 1 for r in range(9)], U)
#: Bytes above which a stretch is hashed by itself.
LONG = 4096


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each stretch, 8 at a step with all bits mixed after each: no structure of a text makes
    different stretches agree."""
    size = ends - starts
    steps = (size + 7) >> 3
    far = np.flatnonzero(size > LONG)
    steps[far] = 0
    order = np.argsort(-steps, kind="stable")
    s, n, steps = starts[order], size[order], steps[order]
    lanes = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(n.astype(U) + _SEED)
    # rows by falling length: those that a step concerns come first
    live = np.searchsorted(-steps, -np.arange(1, steps[0] + 1 if len(steps) else 1), "right")
    for k, m in enumerate(live.tolist()):
        h[:m] = mix(h[:m] * _STEP ^ (lanes[s[:m] + 8 * k] & _MASK[np.minimum(n[:m] - 8 * k, 8)]))
    out = np.empty_like(h)
    out[order] = h
    for k in far.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for runs of 64-bit values, such as hashes of words."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    s, n = starts[order], size[order]
    h = mix(n.astype(U) + _SEED)
    live = np.searchsorted(-n, -np.arange(1, n[0] + 1 if len(n) else 1), "right")
    for k, m in enumerate(live.tolist()):
        h[:m] = mix(h[:m] * _STEP ^ values[s[:m] + k])
    out = np.empty_like(h)
    out[order] = h
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two halves' hashes."""
    return mix(mix(a + _SEED) * _STEP ^ b)


def slices(col: pa.Array, limit: int = SLICE, rows: int = 32768):
    """(first row, bytes, offsets): runs of at most so many rows with at most limit bytes, or one row; a null is an empty
    text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n, kind = len(col), np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(raw: np.ndarray, offs: np.ndarray, ink: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each document) of the runs of bytes that ink has: those other than 0x20, 0x09-0x0D."""
    ink = ink[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True  # a document's first byte, and one past the last
    begin, end = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    end[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return stretch_hashes(_LOWER[raw] if lower else raw, starts, ends)


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all k-grams of bytes."""
    c = BYTES.prefix(_BYTE[raw])
    n = max(0, len(raw) - k + 1)
    return mix((c[k : k + n] - c[:n]) * BYTES.down[:n])


def word_grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of words: each step multiplies and folds, so that no sum of words' hashes can cancel."""
    n = max(0, len(h) - k + 1)
    x = h[:n].copy()
    for j in range(1, k):
        x ^= x >> U(29)
        x *= _STEP
        x += h[j : j + n]
    return mix(x)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n, size = len(a) - w + 1, 1
    while 2 * size <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:n], a[w - size : w - size + n]) if size < w else a[:n]


def anchor_runs(grams: np.ndarray, offs: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window of symbols inside a document is answered for by its k-gram of smallest hash (leftmost among equals).
    Returns (document, anchor position, first start, number of starts) for the runs of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(grams) < window - k + 1:
        return none, none, none, none
    sel = sliding_min((grams & ~U(0xFFFFFFFF)) | np.arange(len(grams), dtype=U), window - k + 1) & U(0xFFFFFFFF)
    lens = np.diff(offs)
    has = np.flatnonzero(lens >= window)
    count = lens[has] - window + 1
    if not len(has):
        return none, none, none, none
    doc = np.repeat(has, count)
    at = np.arange(len(doc)) + np.repeat(offs[has] - (np.cumsum(count) - count), count)
    own = sel[at].astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], own[first], at[first], np.diff(np.append(first, len(at)))

"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word enters as a vector of its own and the mean of vectors of its character trigrams. The network reads windows of 32
words that overlap by 16; a text's score is that of its worst window. Training, in numpy in one task, is from a bounded
sample of labelled texts: in every round each text gives the window that the network then finds worst."""

from __future__ import annotations

import copy
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import table
from ._text import slices, word_hashes, words
from .language import held

LENGTH, STRIDE = 32, 16
WORD_BUCKETS, CHAR_BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 16, 1 << 12, 12, 8, 8, 8
#: The bound of the training sample: labelled texts of each class, by a hash of doc_id, and the longest text among them.
SAMPLE, SAMPLE_CHARS = {1: 1000, 0: 2000}, 40_000
ROUNDS, BATCH, RATE = 6, 64, 0.005
#: A word has a vector of its own if so many texts of the sample hold it.
KNOWN = 8
_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOW = np.arange(256, dtype=np.int64)
_LOW[65:91] += 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """The distinct words of some texts: bucket and character trigrams of each, and the windows over them."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        starts, ends, per = words(raw, offs, _INK)
        h = word_hashes(raw, starts, ends, lower=True)
        uniq, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (uniq >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        s, self.size = starts[first], ends[first] - starts[first]
        self.begin = np.cumsum(self.size) - self.size
        at = np.repeat(s - self.begin, self.size) + np.arange(self.size.sum())
        c = _LOW[raw[at]] if len(at) else np.zeros(0, np.int64)
        before, after = np.roll(c, 1), np.roll(c, -1)
        if len(c):
            before[self.begin], after[self.begin + self.size - 1] = 0, 1
        self.gram = ((before * 65_599 + c) * 65_599 + after) * 2654435769 % (1 << 32) >> 20
        n = np.diff(per)
        count = np.where(n > LENGTH, -(-(n - LENGTH) // STRIDE) + 1, 1)
        self.doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        at = (per[:-1][self.doc] + k * STRIDE)[:, None] + np.arange(LENGTH)
        #: the word in each place of each window, -1 beyond the text
        self.windows = np.where(at < per[1:][self.doc][:, None], np.append(self.word, 0)[np.minimum(at, len(self.word))], -1)
        self.count = count

    def take(self, ids: np.ndarray) -> Words:
        """The same for some of the words, without windows."""
        w = object.__new__(Words)
        w.bucket, w.size = self.bucket[ids], self.size[ids]
        w.begin = np.cumsum(w.size) - w.size
        w.gram = self.gram[np.repeat(self.begin[ids] - w.begin, w.size) + np.arange(w.size.sum())]
        return w


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        g = lambda *shape, s=None: (rng.standard_normal(shape) * (s or shape[0] ** -0.5)).astype(np.float32)
        self.p = {"word": g(WORD_BUCKETS, WORD_DIM, s=0.05), "char": g(CHAR_BUCKETS, CHAR_DIM, s=0.1)}
        for way in "fb":
            self.p |= {f"x{way}": g(d, 3 * h), f"u{way}": g(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": g(2 * h, ATTEND), "v": g(ATTEND), "o": g(2 * h), "k": np.zeros(1, np.float32)}
        self.known = np.ones((WORD_BUCKETS, 1), np.float32)  # words that the sample holds often enough to have a vector
        self.moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        self.t = 0

    def vectors(self, w: Words) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][w.gram], w.begin, 0) / w.size[:, None] if len(w.size) else np.zeros((0, CHAR_DIM))
        return np.concatenate([self.p["word"][w.bucket] * self.known[w.bucket], chars], 1).astype(np.float32)

    def _gru(self, way: str, proj: np.ndarray, win: np.ndarray, keep: list | None) -> np.ndarray:
        h, n = HIDDEN, len(win)
        out = np.zeros((LENGTH, n, h), np.float32)
        s, u = np.zeros((n, h), np.float32), self.p[f"u{way}"]
        for t in range(LENGTH) if way == "f" else range(LENGTH - 1, -1, -1):
            x, on = proj[win[:, t]], (win[:, t] >= 0)[:, None]
            y = s @ u
            zr = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
            new = np.where(on, c + z * (s - c), s)
            if keep is not None:
                keep.append((t, s, z, r, c, y[:, 2 * h :], on))
            out[t] = s = new
        return out

    def forward(self, vec: np.ndarray, win: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        p, both = self.p, []
        for way in "fb":
            keep = None if kept is None else kept.setdefault(way, [])
            both.append(self._gru(way, np.concatenate([vec @ p[f"x{way}"] + p[f"c{way}"], np.zeros((1, 3 * HIDDEN), np.float32)]), win, keep))
        hid = np.concatenate(both, 2)
        act = np.tanh(hid @ p["a"])
        e = np.where((win >= 0).T, act @ p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        w *= (win >= 0).T
        pooled = (w[:, :, None] * hid).sum(0)
        if kept is not None:
            kept |= {"hid": hid, "act": act, "w": w, "pooled": pooled}
        return pooled @ p["o"] + p["k"][0]

    def backward(self, w: Words, vec: np.ndarray, win: np.ndarray, kept: dict, d: np.ndarray) -> dict:
        p, h, g = self.p, HIDDEN, {}
        g["k"], g["o"] = d.sum(keepdims=True), kept["pooled"].T @ d
        dp = d[:, None] * p["o"]
        hid, act, a = kept["hid"], kept["act"], kept["w"]
        dh = a[:, :, None] * dp
        da = (hid * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["v"] = np.tensordot(de, act, 2)
        dt = de[:, :, None] * p["v"] * (1 - act**2)
        g["a"] = np.tensordot(hid, dt, ((0, 1), (0, 1)))
        dh += dt @ p["a"].T
        dvec = np.zeros_like(vec)
        flat = []
        for way, part in (("f", dh[:, :, :h]), ("b", dh[:, :, h:])):
            gu, gx = np.zeros_like(p[f"u{way}"]), np.zeros((LENGTH, len(win), 3 * h), np.float32)
            back = np.zeros((len(win), h), np.float32)
            for t, s, z, r, c, y, on in reversed(kept[way]):
                ds = back + part[t]
                go = ds * on
                dc, dz = go * (1 - z) * (1 - c**2), go * (s - c) * z * (1 - z)
                dr = dc * y * r * (1 - r)
                dy = np.concatenate([dz, dr, dc * r], 1)
                gx[t] = np.concatenate([dz, dr, dc], 1)
                gu += s.T @ dy
                back = ds * ~on + go * z + dy @ p[f"u{way}"].T
            g[f"u{way}"], g[f"c{way}"] = gu, gx.sum((0, 1))
            flat.append(gx)
        at = win.T.ravel()
        used = np.flatnonzero(at >= 0)
        order = used[np.argsort(at[used], kind="stable")]
        ids, begin = np.unique(at[order], return_index=True)
        for way, gx in zip("fb", flat, strict=True):
            per = np.add.reduceat(gx.reshape(-1, 3 * h)[order], begin, 0) if len(order) else np.zeros((0, 3 * h), np.float32)
            g[f"x{way}"] = vec[ids].T @ per
            dvec[ids] += per @ p[f"x{way}"].T
        g["word"] = (w.bucket[ids], dvec[ids, :WORD_DIM] * self.known[w.bucket[ids]])
        sizes = w.size[ids]
        grams = w.gram[np.repeat(w.begin[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        g["char"] = (grams, np.repeat(dvec[ids, WORD_DIM:] / sizes[:, None], sizes, 0))
        return g

    def step(self, grads: dict) -> None:
        """Adam; for the two tables, only in the rows that were used."""
        self.t += 1
        for k, g in grads.items():
            m, v = self.moments[k]
            if isinstance(g, tuple):
                ids, place = np.unique(g[0], return_inverse=True)
                full = np.zeros((len(ids), g[1].shape[1]), np.float32)
                np.add.at(full, place, g[1])
                g, rows = full, ids
            else:
                rows = slice(None)
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.99 * v[rows] + 0.01 * g**2
            self.p[k][rows] -= RATE * (m[rows] / (1 - 0.9**self.t)) / (np.sqrt(v[rows] / (1 - 0.99**self.t)) + 1e-6)


def _counts(w: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word: the texts that hold it, and its log odds over them, drawn towards 0 for rare words."""
    key = np.where(w.windows >= 0, w.windows * len(y) + w.doc[:, None], -1).ravel()
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1]) & (key >= 0)]
    n, pos = np.bincount(key // len(y), minlength=len(w.bucket)), np.bincount(key // len(y), y[key % len(y)], len(w.bucket))
    share = y.mean()
    return n, np.clip(np.log((pos + 12 * share) / (n - pos + 12 * (1 - share)) * (1 - share) / share), -2, 3)


def train(texts: list[str], y: np.ndarray) -> Network | None:
    """A network from labelled texts (1 toxic); none without both classes. A fifth of the texts is kept from training: the
    round that does best on them is returned."""
    if not len(texts) or y.min() == y.max():
        return None
    net, rng = Network(), np.random.default_rng(3)
    raw = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(w.count)[:-1]])
    own = rng.permutation(len(y)) % 5 > 0
    if len(set(y[own])) < 2:
        own[:] = True
    n, odds = _counts(_only(w, own), y)
    net.known[:] = 0
    net.known[w.bucket[n >= KNOWN]] = 1
    net.p["word"][w.bucket, 0] = odds  # a start from the sample's word counts; training moves it
    value = np.where(w.windows >= 0, odds[w.windows], -9).max(1) if len(odds) else np.zeros(len(w.windows))
    best = (np.inf, net)
    rounds = max(ROUNDS, min(50, 16_000 // len(y)))  # a small sample gives few steps a round
    for turn in range(rounds + 1):
        if turn:
            vec = net.vectors(w)
            value = np.concatenate([net.forward(vec, w.windows[i : i + 4096]) for i in range(0, len(w.windows), 4096)])
            q, hold = _sigmoid(np.maximum.reduceat(value, first)), ~own if not own.all() else own
            loss = -np.mean(np.log(np.where(y[hold] == 1, q[hold], 1 - q[hold])))
            if loss < best[0]:
                best = loss, copy.deepcopy(net)
        top = np.repeat(np.maximum.reduceat(value, first), w.count)
        at = np.flatnonzero(value == top)
        worst = at[np.unique(w.doc[at], return_index=True)[1]]
        todo = rng.permutation(np.flatnonzero(own))
        for part in np.array_split(todo, max(1, len(todo) // BATCH)) if turn < rounds else ():
            ids, win = np.unique(w.windows[worst[part]], return_inverse=True)
            win = win.reshape(-1, LENGTH) - (ids[0] < 0)
            few = w.take(ids[ids >= 0])
            vec, kept = net.vectors(few), {}
            d = (_sigmoid(net.forward(vec, win, kept)) - y[part]) / len(part)
            net.step(net.backward(few, vec, win, kept, d.astype(np.float32)))
    best[1].moments = {}
    return best[1]


def _only(w: Words, own: np.ndarray) -> Words:
    """The windows of some texts."""
    out, keep = copy.copy(w), own[w.doc]
    out.windows, out.doc = w.windows[keep], w.doc[keep]
    return out


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text of a bounded sample of labelled texts: the labels of each class that come first by a hash of
    doc_id; the texts come by a broadcast of at most 3,000 ids. Null labels and texts are left out, repeated ones count once."""
    ids = None
    for kind, n in SAMPLE.items():
        part = labels.where(F.col("toxic") == kind).select("doc_id", "toxic").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = part if ids is None else ids.unionByName(part)
    return docs.select("doc_id", "text").where(f"length(text) between 1 and {SAMPLE_CHARS}").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Trains in one task, which reads the bounded sample and nothing else; the driver gets the network, about 4 MB."""

    def work(batches):
        texts, y = [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(y, float)))], pa.binary())], ["net"])

    got = sample(docs, labels).repartition(1).sortWithinPartitions("doc_id").select("toxic", "text").mapInArrow(work, "net binary").first()
    return pickle.loads(got.net) if got else None


def score(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents (doc_id, text) -> doc_id, the columns keep, score (0 to 1).

    All words of all texts are read, in overlapping windows. A null text or one without a letter or digit is not toxic
    (at most 0.25), without a network all score 0. Rows are scored one by one: repeated rows and null ids need no care."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    d = docs.select("doc_id", *keep, "text")
    cols = d.columns[:-1]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def work(batches):
        net = shared.value
        for batch in batches:
            for i, raw, offs in slices(batch.column(len(cols)), 1 << 20):
                out = np.zeros(len(offs) - 1)
                if net is not None:
                    w = Words(raw, offs)
                    vec = net.vectors(w)
                    value = np.concatenate([net.forward(vec, w.windows[k : k + 4096]) for k in range(0, len(w.windows), 4096)])
                    out = _sigmoid(np.maximum.reduceat(value, np.concatenate([[0], np.cumsum(w.count)[:-1]]))).astype(float)
                    none = w.windows[np.concatenate([[0], np.cumsum(w.count)[:-1]]), 0] < 0
                    out[none] = np.minimum(out[none], 0.25)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i : i + len(out)] for c in range(len(cols))), pa.array(out)], [*cols, "score"])

    return d.mapInArrow(work, f"{kind}, score double")


def op6_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit(docs, labels.where(held(F.col("doc_id"), 5) != 0))
    found = score(docs.select("doc_id", "text", (held(F.col("doc_id"), 5) == 0).alias("held_out")), net, ("held_out",))
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

"""BPE encoding and decoding by a dynamic programme over prefixes.

Every prefix of a piece has one encoding, so one last token. Scanning the symbols through an automaton of all tokens gives
the tokens that end at each prefix, longest first; the one that is compatible with the last token before it is the
prefix's own (pair compatibility: undo the merges on both sides of the seam, the younger first, and look for a merge across
it that would have come earlier). Back-pointers from the whole piece give the ids. All pieces of a batch advance together,
symbol by symbol, in numpy.

A tokenizer is read from its JSON file: NFC, white space, lower case; pieces by the file's pattern; byte symbols, the last
of a piece marked as its end. Added tokens in a text are found before anything else. Decoding joins token strings by a
space, as the library does for a file without a decoder."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ._io import small_batches, table

#: White space of the pattern's \s: what str.split() takes, but for the four information separators.
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Words that are letters with ASCII signs after them, if any; all bytes of such a word that _LETTER has are its letters.
_PLAIN = r"^\p{L}*[!-/:-@\[-`{-~]*$"
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_ODD = regex.compile(r"[\x1c-\x1f]")


def _unassigned() -> re.Pattern:
    known = [unicodedata.category(chr(c)) != "Cn" for c in range(0x10000)]
    edges = [c for c in range(0x10001) if (c < 0x10000 and not known[c]) != (c > 0 and not known[c - 1])]
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]")


#: One pattern for the first plane, which re looks up in a bitmap; what lies beyond is rare.
_NEW, _BEYOND = _unassigned(), re.compile("[\U00010000-\U0010ffff]")


def unknown(text: str) -> bool:
    """Whether a text has a character that Python's tables do not know, while the library's, of a later Unicode, may: it is left
    to those."""
    return bool(_NEW.search(text)) or any(unicodedata.category(c) == "Cn" for c in _BEYOND.findall(text))


#: Characters of text that are encoded together, or one text.
BATCH = 4_000_000
_HASH = np.uint32(2654435769)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary: itself where it is printable, else the next from
    U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Table:
    """An open hash table from 32-bit keys to 32-bit values, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.int64(2**bits - 1)
        self.keys, self.values = np.full(2**bits, 0xFFFFFFFF, np.uint32), np.full(2**bits, -1, np.int32)
        keys, left = keys.astype(np.uint32), np.arange(len(keys))
        at = ((keys * _HASH) >> self.shift).astype(np.int64)
        while len(left):
            free = left[self.keys[at[left]] == 0xFFFFFFFF]
            _, one = np.unique(at[free], return_index=True)
            self.keys[at[free[one]]], self.values[at[free[one]]] = keys[free[one]], values[free[one]]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint32)
        at = ((keys * _HASH) >> self.shift).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0xFFFFFFFF))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != 0xFFFFFFFF)]
        return out


class Model:
    """The tables of one tokenizer, bounded by the vocabulary; each worker builds them once from the file's bytes."""

    def __init__(self, data: bytes):
        self.file, spec = data, json.loads(data)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.names = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for name, i in [*vocab.items(), *self.added.items()]:
            self.names[i] = name
        byte = {c: b for b, c in enumerate(byte_letters())}
        n = len(self.names)
        self.left, self.right, self.rank = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        pairs = np.zeros((len(merges), 2), np.int64)
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            self.left[t], self.right[t], self.rank[t] = vocab[a], vocab[b], r
            pairs[r] = vocab[a], vocab[b]
        assert n <= 65536 and len(merges) == (self.rank >= 0).sum(), "a token must come from one merge"
        self.merged = Table(pairs[:, 0] << 16 | pairs[:, 1], np.arange(len(merges)))
        #: tokens as strings over 512 symbols: bytes, and bytes that end a piece
        spelt = {}
        for name, i in vocab.items():
            end = self.suffix and name.endswith(self.suffix)
            s = [byte[c] for c in (name[: -len(self.suffix)] if end else name)]
            if end:
                s[-1] += 256
            spelt[i] = s
        self.length = np.zeros(n, np.int32)
        self._automaton(spelt)
        self.alone = np.ones(n, bool)
        self._check(spelt)

    def _check(self, spelt: dict[int, list[int]]) -> None:
        """Every token must be the encoding of its own string: its two halves, encoded alone, then meet at a seam that no
        other merge crosses earlier."""
        t = np.flatnonzero(self.rank >= 0)
        for k in t[np.argsort(self.rank[t])]:
            self.alone[k] = self.alone[self.left[k]] and self.alone[self.right[k]]
        self.alone[t] &= self.compatible(self.left[t], self.right[t], self.rank[t])

    def _automaton(self, spelt: dict[int, list[int]]) -> None:
        """A trie of the tokens with links to each node's longest proper suffix in it, and to the longest token there."""
        edges, ends, depth, up = {}, [-1], [0], [(0, 0)]
        for i, s in spelt.items():
            node = 0
            for c in s:
                key = node << 9 | c
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1), depth.append(depth[node] + 1), up.append((node, c))
                node = edges[key]
            ends[node], self.length[i] = i, len(s)
        link, longest = [0] * len(ends), [-1] * len(ends)
        self.shorter = np.full(len(self.names), -1, np.int32)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            parent, c = up[node]
            if parent:
                f = link[parent]
                while f and f << 9 | c not in edges:
                    f = link[f]
                link[node] = edges.get(f << 9 | c, 0)
            longest[node] = ends[node] if ends[node] >= 0 else longest[link[node]]
            if ends[node] >= 0:
                self.shorter[ends[node]] = longest[link[node]]
        self.edges = Table(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self.link, self.longest = np.array(link, np.int32), np.array(longest, np.int32)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether encoding the two strings together leaves the seam between tokens a and b, up to the merge of rank until."""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 2**31 - 1, np.int64) if until is None else until.astype(np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            m = self.merged.get(a << 16 | b)
            bad = (m >= 0) & (m < limit)
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb  # of equal ones the right one came later
            # a merge across the seam of the same rank comes first only if it stands left of the one undone
            limit = np.where(first, ra, rb + 1).astype(np.int64)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces (strings without nulls), end to end, and the offsets of each piece's own. Pieces of similar
        length advance together."""
        raw, offs = _bytes(pieces)
        lens = np.diff(offs)
        order = np.argsort(lens, kind="stable")
        order = order[np.searchsorted(lens[order], 1) :]
        parts, count, i = [], np.zeros(len(pieces), np.int64), 0
        while i < len(order):
            most = max(16, 2 * int(lens[order[i]]))
            j = min(int(np.searchsorted(lens[order], most, "right")), i + max(1, 4_000_000 // most))
            parts.append((order[i:j], self._encode(raw, offs, order[i:j], count)))
            i = j
        out = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(count, out=out[1:])
        ids = np.zeros(out[-1], np.int64)
        for own, steps in parts:
            for k, (live, t) in enumerate(steps):
                ids[out[own[live] + 1] - 1 - k] = t
        return ids, out

    def _encode(self, raw: np.ndarray, offs: np.ndarray, own: np.ndarray, count: np.ndarray) -> list:
        """own: pieces by length. Returns the back-pointer walk, the last tokens first."""
        lens = offs[own + 1] - offs[own]
        row, col = np.repeat(np.arange(len(own)), lens), _ramp(lens)
        sym = np.zeros((int(lens[-1]), len(own)), np.int64)
        sym[col, row] = raw[offs[own][row] + col]
        if self.suffix:
            sym[lens - 1, np.arange(len(own))] += 256
        last = np.full((len(sym) + 1, len(own)), -1, np.int32)
        state = np.zeros(len(own), np.int64)
        for i in range(len(sym)):
            lo = int(np.searchsorted(lens, i, "right"))  # longer pieces stand last
            here, c = np.arange(lo, len(own)), sym[i, lo:]
            s, left = state[lo:], np.arange(len(own) - lo)
            while len(left):
                to = self.edges.get(s[left] << 9 | c[left])
                end = (to < 0) & (s[left] == 0)
                s[left[to >= 0]] = to[to >= 0]
                left = left[(to < 0) & ~end]
                s[left] = self.link[s[left]]
            t, left = self.longest[s], np.arange(len(here))
            while len(left):
                begin = i + 1 - self.length[t[left]]
                fits = (begin == 0) & self.alone[t[left]]
                seam = np.flatnonzero(begin)
                fits[seam] = self.compatible(last[begin[seam], here[left[seam]]], t[left[seam]])
                left = left[~fits]
                t[left] = self.shorter[t[left]]
            last[i + 1, lo:] = t
        steps, at, live = [], lens.copy(), np.arange(len(own))
        while len(live):
            t = last[at[live], live]
            steps.append((live, t))
            count[own[live]] += 1
            at[live] -= self.length[t]
            live = live[at[live] > 0]
        return steps


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def _ramp(lens: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, end to end."""
    return np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)


def _expand(values: np.ndarray, offs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that codes name, end to end, with their offsets."""
    lens = offs[codes + 1] - offs[codes]
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return values[np.repeat(offs[codes] - out[:-1], lens) + np.arange(out[-1])], out


class Coder:
    """Whole texts to ids. Each distinct word of a batch is split once, each distinct piece encoded once."""

    def __init__(self, model: Model):
        self.m, self.strange = model, False
        self.piece = regex.compile(model.pattern)
        self.added = regex.compile("|".join(map(regex.escape, sorted(model.added, key=len, reverse=True)))) if model.added else None
        self.id_names, self.names = pa.array([str(i) for i in range(len(model.names))]), pa.array(model.names)

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised; an added token is a word of its own, with a blank before it."""
        if self.added and any(a in text for a in self.m.added):
            out, i = [], 0
            for hit in self.added.finditer(text):
                out += [*self._words(text[i : hit.start()]), " " + hit[0]]
                i = hit.end()
            return out + self._words(text[i:])
        return self._words(text)

    @functools.cached_property
    def library(self):
        """The tokenizers library's own tables, for characters that Python's do not know."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.m.file.decode())

    def _split(self, word: str) -> list[str]:
        """The pieces of a word."""
        if not unknown(word):
            return self.piece.findall(word)
        byte = {c: b for b, c in enumerate(byte_letters())}
        return [bytes(byte[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if unknown(text):
                self.strange = True
                return [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # a capital sigma's small form is not that of word ends here
        text = text.lower()
        return [w for w in _SPACES.split(text) if w] if _ODD.search(text) else text.split()

    def pieces(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces, and for each word the codes of its own, end to end with offsets. Words of letters with other
        signs after them, if any, are split by one regular expression over the column; the rest one by one."""
        n, plain = len(words), pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        if self.strange:
            plain = plain & np.array([not unknown(w) for w in words.to_pylist()], bool)
        rest = np.flatnonzero(~plain)
        split = [[w] if w[0] == " " else self._split(w) for w in words.take(pa.array(rest)).to_pylist()]
        raw, at = _bytes(words)
        letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
        cut = at[:-1] + np.where(plain, letters[at[1:]] - letters[at[:-1]], 0)
        size = np.stack([cut > at[:-1], plain & (cut < at[1:])], 1).astype(np.int64)
        # both parts of every plain word, as one column over the same bytes
        bounds = np.append(np.stack([at[:-1], cut], 1).ravel(), at[-1]).astype(np.int32)
        parts = pa.StringArray.from_buffers(2 * n, pa.py_buffer(bounds), pa.py_buffer(raw))
        codes = pa.concat_arrays([parts.take(pa.array(np.flatnonzero(size.ravel()))), pa.array([p for ps in split for p in ps], pa.string())]).dictionary_encode()
        code, own = codes.indices.to_numpy().astype(np.int64), int(size.sum())
        count = size.sum(1)
        count[rest] = [len(ps) for ps in split]
        offs = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=offs[1:])
        out = np.zeros(offs[-1], np.int64)
        has = np.flatnonzero(size.ravel())
        out[offs[has // 2] + (has % 2) * size[has // 2, 0]] = code[:own]
        if len(rest):
            out[np.repeat(offs[rest], count[rest]) + _ramp(count[rest])] = code[own:]
        return codes.dictionary, out, offs

    def run(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and each text's offsets."""
        self.strange = False
        split = [self.words(t) if t else [] for t in texts]
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(ws) for ws in split], out=ends[1:])
        words = pa.array(itertools.chain.from_iterable(split), pa.string(), size=int(ends[-1])).dictionary_encode()
        distinct, piece_of, piece_offs = self.pieces(words.dictionary)
        ids, offs = self.m.encode(distinct)
        for name, i in self.m.added.items():
            k = pc.index(distinct, " " + name).as_py()
            if k >= 0:  # one id, whatever the model made of its string
                ids[offs[k] : offs[k + 1]] = -1
                ids[offs[k]] = i
        by_word, word_offs = _expand(ids, offs, piece_of)
        word_ids, own = by_word, word_offs[piece_offs]
        flat, flat_offs = _expand(word_ids, own, words.indices.to_numpy().astype(np.int64))
        out = flat_offs[ends]
        if (flat < 0).any():
            held = np.concatenate([[0], np.cumsum(flat >= 0)])
            flat, out = flat[flat >= 0], held[out]
        return flat, out

    def joined(self, ids: np.ndarray, offs: np.ndarray, names: pa.Array) -> pa.Array:
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offs), names.take(pa.array(ids))), " ")


_coder: dict[str, Coder] = {}


def _coded(shared, key: str) -> Coder:
    """One per worker and model."""
    if key not in _coder:
        _coder.clear()
        _coder[key] = Coder(Model(shared.value))
    return _coder[key]


def _groups(texts: list[str | None], limit: int):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= limit):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """documents -> doc_id, n_tokens, and ids array<int> with decoded string, or with digest their SHA-256 (of the decimal
    ids joined by a space, and of the decoded text in UTF-8).

    Null and empty texts have no ids and decode to an empty text. Rows are encoded one by one, so repeated rows, null
    doc_ids, further columns and very long texts need no care; memory follows the longest text and the kept words."""
    small_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes()), uuid.uuid4().hex
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]

    def sha(col: pa.Array) -> pa.Array:
        raw, offs = _bytes(col)
        raw, offs = memoryview(raw), offs.tolist()
        return pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in itertools.pairwise(offs)], pa.string())

    def work(batches):
        coder = _coded(shared, key)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _groups(texts, BATCH):
                ids, offs = coder.run(texts[i:j])
                decoded = coder.joined(ids, offs, coder.names)
                if digest:
                    a, b = sha(coder.joined(ids, offs, coder.id_names)), sha(decoded)
                else:
                    a, b = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())), decoded.cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(offs)), a, b], names)

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(work, schema)


def op3_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)

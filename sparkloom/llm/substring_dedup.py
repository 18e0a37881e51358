"""Substring dedup by level-wise doubling: word windows repeated at one length alone are extended to twice that length,
until the wanted length is reached or no candidate survives.

The first level, 5 words, is that of the k-grams that windows answer to (see repeats). At each further level a window is
held against the others of its group by a stretch of twice the length around its k-gram, whose place follows from the
place of the k-gram in the window alone, so equal windows are held by equal stretches."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from ._io import table
from ._text import U, joined, mix, run_hashes, slices, word_grams, word_hashes, words
from .suffix_dedup import join_runs, merged

WINDOW, GRAM = 20, 5


def kernel(group, weight, d, pos, col: pa.Array):
    lo, n, off = pos >> 20, pos >> 10 & 1023, pos & 1023
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    gram = word_grams(np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(U), GRAM)
    begin = (offs[:-1] - offs[0]) // 8
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = GRAM
    while size < WINDOW and len(row):
        size, before = min(2 * size, WINDOW), size
        gram = joined(gram[: len(gram) - size + before], gram[size - before :])  # a stretch is its two halves
        half, place = size // 2, off[row] - start
        shift = np.minimum(place // half * half, WINDOW - size)
        i = begin[row] + start + shift
        key = mix(gram[i] ^ mix((group[row] * 1024 + place - shift).astype(U)))
        # a stretch counts once for each document's run, however many of the run's windows hold it
        _, one, back = np.unique(mix(key ^ mix(row.astype(U))), return_index=True, return_inverse=True)
        _, cls = np.unique(key[one], return_inverse=True)
        total = np.bincount(cls, weight[row[one]])
        live = (total[cls] >= 2)[back]
        row, start, key = row[live], start[live], key[live]
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    order = np.lexsort((lo[row] + start, d[row], key))
    row, start, key = row[order], start[order], key[order]
    first = np.append(True, key[1:] != key[:-1])
    # the first of equal windows stays; others with its stretch in further places go
    keep = ~first | (weight[row] > 1)
    return join_runs(row[keep], start[keep], first[keep].astype(np.int64))


def _symbols(raw, offs):
    starts, ends, per = words(raw, offs)
    return word_hashes(raw, starts, ends), per


def _grams(raw, offs):
    h, per = _symbols(raw, offs)
    return word_grams(h, GRAM), per, lambda i, j: run_hashes(h, i, j)


def _cut(raw, offs, own, lo, hi) -> pa.Array:
    h, per = _symbols(raw, offs)
    size = hi - lo
    ends = np.concatenate([[0], np.cumsum(size)])
    data = h[np.repeat(per[own] + lo - ends[:-1], size) + np.arange(ends[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(8 * ends), pa.py_buffer(data)]).cast(pa.binary())


SYMBOLS = repeats.Symbols(WINDOW, GRAM, 8, _grams, _cut)


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_words, n_removed, and kept (the remaining words joined by a space), or with
    digest kept_sha256.

    A word goes if a window of 20 words that covers it also starts earlier: in a document of smaller doc_id, or before it
    in the same. Windows are judged on the input. Null and empty texts have no words; a null doc_id is after all others;
    rows with one doc_id are the same document to that order, so repeated rows lose nothing to each other."""
    spans = repeats.repeated(docs, SYMBOLS, kernel, order_matters=True)
    texts = repeats.keyed(docs).join(spans.hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "text", "spans")

    def work(batches):
        for batch in batches:
            lists = batch.column(2)
            for i, raw, offs in slices(batch.column(1)):
                rows, data, offs = [], raw.tobytes(), offs.tolist()
                for k, s in enumerate(lists[i : i + len(offs) - 1].to_pylist()):
                    ws = data[offs[k] : offs[k + 1]].split()
                    n = len(ws)
                    if s:
                        keep = np.ones(n, bool)
                        for a, b in merged(s, WINDOW):
                            keep[a:b] = False
                        ws = list(compress(ws, keep.tolist()))
                    kept = b" ".join(ws)
                    rows.append((n, n - len(ws), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + len(rows)], *cols], ["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "kept"
    return texts.mapInArrow(work, f"doc_id long, n_words long, n_removed long, {name} string")


def op5_substring_dedup(spark, sf_dir) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), digest=True)


OP5_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, unnest(range(1, len(ws) - 18)) as i, ws from w where len(ws) >= 20),
g as (select doc_id, i, array_to_string(ws[i : i + 19], ' ') as g from s),
r as (select doc_id, i, row_number() over (partition by g order by doc_id, i) > 1 as again from g),
c as (select distinct doc_id, i + k as i from r, range(0, 20) t(k) where again),
p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
k as (select p.doc_id, string_agg(word, ' ' order by p.i) as kept, count(*) as n from p anti join c on p.doc_id = c.doc_id and p.i = c.i group by p.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""

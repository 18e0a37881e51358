"""Language identification by multilingual mixture inference (after Lui, Lau, Baldwin, 2014).

A text is a mixture of languages, each a distribution over byte trigrams learnt from labelled texts. Expectation
maximisation estimates the proportions; nested language sets, by estimated proportion, are fitted again and the one of
highest penalised likelihood is kept. The prediction is the set's largest language, the score its proportion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import table
from ._text import slices

BUCKETS = 1 << 16
#: EM steps over all languages and for a set; the pseudo-counts a language shares over the buckets.
STEPS, SET_STEPS, PSEUDO = 8, 8, 2000.0
#: What one more language must gain in log likelihood, times ln(number of trigrams): neighbouring trigrams overlap in two
#: bytes, so each tells about a third of what an independent one would.
PENALTY = 1.5
_LETTER = regex.compile(r"\p{L}")
#: Lower case for A-Z; other ASCII signs than letters count as white space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _a in (65, 97):
    _FOLD[_a : _a + 26] = np.arange(97, 123)


def held(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; a null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def trigrams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all byte trigrams of texts that have a blank put before and after them."""
    lens = np.diff(offs)
    padded = np.full(len(raw) + 2 * len(lens), 32, np.uint32)
    padded[np.arange(len(raw)) + np.repeat(2 * np.arange(len(lens)) + 1, lens)] = _FOLD[raw]
    code = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    doc = np.repeat(np.arange(len(lens), dtype=np.uint32), lens + 2)
    keep = (doc[:-2] == doc[2:]) & (code != 0x202020)
    return doc[:-2][keep], ((code[keep] * np.uint32(2654435769)) >> np.uint32(16))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs (text, lang) -> the languages, by name, and the probability of each bucket in each.

    Counts are over all rows with a language, within each task first; what reaches the driver is a row for each bucket and
    language, at most 65,536 per language. No rows: no languages."""

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, raw, offs in slices(batch.column(0)):
                doc, bucket = trigrams(raw, offs)
                names = {x: k for k, x in enumerate(dict.fromkeys(langs[i : i + len(offs) - 1]))}
                own = np.array([names[x] for x in langs[i : i + len(offs) - 1]])[doc] if len(doc) else np.zeros(0, int)
                both = np.bincount(own * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, k in names.items():
                    found[name] = found.get(name, 0) + both[k]
        for name, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = docs.select("text", "lang").where("lang is not null and text is not null").mapInArrow(count, "lang string, bucket long, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].unique().to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        enc = got["lang"].combine_chunks().dictionary_encode()
        enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
        kind = np.array([place[x] for x in enc.dictionary.to_pylist()])[enc.indices.to_numpy()]
        counts[got["bucket"].to_numpy(), kind] = got["n"].to_numpy()
    return langs, ((counts + PSEUDO / BUCKETS) / (counts.sum(0) + PSEUDO)).astype(np.float32)


def _fit(p: np.ndarray, n: np.ndarray, first: np.ndarray, size: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts together: entries p, n of a text stand together, first is where each begins, size how many."""
    total, one = np.add.reduceat(n, first)[:, None], np.ones(p.shape[1], np.float32)
    for _ in range(steps):
        part = p * np.repeat(pi, size, 0)
        part *= (n / (part @ one))[:, None]
        pi = np.add.reduceat(part, first, 0) / total
    return pi, np.add.reduceat(n * np.log((p * np.repeat(pi, size, 0)) @ one), first)


def mixtures(prob: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Proportions of the languages in each text, 0 for those outside the chosen set; all 0 without trigrams."""
    out = np.zeros((len(offs) - 1, prob.shape[1]), np.float32)
    doc, bucket = trigrams(raw, offs)
    if not len(doc) or not prob.shape[1]:
        return out
    key = doc << np.uint32(16) | bucket
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(new, len(key))).astype(np.float32)
    key = key[new]
    doc, p = key >> np.uint32(16), prob[key & np.uint32(0xFFFF)]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size, own = np.diff(np.append(first, len(doc))), doc[first]
    few = np.full((len(first), prob.shape[1]), 1 / prob.shape[1], np.float32)
    pi, _ = _fit(p, n, first, size, few, STEPS)
    order = np.argsort(-pi, 1, kind="stable")
    tokens = np.log(np.add.reduceat(n, first))
    best = np.zeros_like(pi)
    score = np.full(len(first), -np.inf)
    live = np.arange(len(first))  # texts for which a set of this size is tried
    for k in range(1, prob.shape[1] + 1):
        if k > 1:  # the k-th language is worth a try if the mixture of all gives it a trigram
            live = live[pi[live, order[live, k - 1]] * np.exp(tokens[live]) >= 1]
        if not len(live):
            break
        rows = np.repeat(first[live] - (np.cumsum(size[live]) - size[live]), size[live]) + np.arange(size[live].sum())
        sub = np.zeros((len(live), prob.shape[1]), np.float32)
        np.put_along_axis(sub, order[live, :k], 1.0, 1)
        sub *= np.maximum(pi[live], 1e-6)
        sub /= sub.sum(1, keepdims=True)
        starts = np.cumsum(size[live]) - size[live]
        fit, ll = _fit(p[rows], n[rows], starts, size[live], sub, 0 if k == 1 else SET_STEPS)
        gain = ll - PENALTY * (k - 1) * tokens[live]
        better = gain > score[live]
        best[live[better]], score[live[better]] = fit[better], gain[better]
    out[own] = best
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """documents (doc_id, text) -> doc_id, the columns keep, lang_pred, score, languages (map of the set's proportions).

    A null text, one without a letter, or a model without languages gives `und`, 0 and no languages; equal proportions go
    to the language that comes first by name. Rows are judged one by one: repeated rows and null ids need no care."""
    langs, prob = model
    shared = docs.sparkSession.sparkContext.broadcast(prob)
    cols = ["doc_id", *keep]
    d = docs.select(*cols, "text")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def work(batches):
        prob = shared.value
        for batch in batches:
            texts = batch.column(len(cols))
            for i, raw, offs in slices(texts):
                pi = mixtures(prob, raw, offs)
                letters = np.concatenate([[0], np.cumsum(_FOLD[raw] > 96)])
                has = letters[offs[1:]] > letters[offs[:-1]]
                ascii_ = np.concatenate([[0], np.cumsum((_FOLD[raw] > 96) & (raw < 128))])
                for k in np.flatnonzero(has & (ascii_[offs[1:]] == ascii_[offs[:-1]])):
                    has[k] = bool(_LETTER.search(texts[i + int(k)].as_py() or ""))
                has &= pi.sum(1) > 0
                top = pi.argmax(1) if len(langs) else np.zeros(len(has), int)
                names = [langs[t] if h else "und" for t, h in zip(top.tolist(), has.tolist(), strict=True)]
                score = np.where(has, pi[np.arange(len(has)), top] if len(langs) else 0.0, 0.0).astype(float)
                sets = [[(langs[c], float(row[c])) for c in np.flatnonzero(row)] if h else [] for row, h in zip(pi, has.tolist(), strict=True)]
                j = i + len(has)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[i:j] for c in range(len(cols))), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(sets, pa.map_(pa.string(), pa.float64()))], [*cols, "lang_pred", "score", "languages"])

    return d.mapInArrow(work, f"{kind}, lang_pred string, score double, languages map<string,double>")


def op1_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(held(F.col("doc_id"), 3) != 1))
    found = identify(docs.withColumn("held_out", held(F.col("doc_id"), 3) == 1), model, ("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")

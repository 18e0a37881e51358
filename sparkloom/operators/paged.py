"""Attention over paged records: gather, decode, softmax-weighted sums with map-side partial results, the sink's gate.

A record is 448 FP8 bytes in seven groups of 64, then 64 BF16 values; its eight scale bytes, of which the last is not used,
stand after all records of its page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
WIDTH, RECORD, SCALES, GROUP = 512, 576, 8, 64
SCALE = 512.0**-0.55
#: Rows of one query row that go to one task, and rows that are decoded at once.
SHARE, ROWS = 65_536, 2048
#: Bytes of a batch that goes back to Spark.
PACK = 4 << 20


def _fp8() -> np.ndarray:
    """The value of each byte of 1 sign, 4 exponent and 3 mantissa bits."""
    b = np.arange(256)
    e, m = b >> 3 & 15, b & 7
    v = np.where(e == 0, m / 8 * 2.0**-6, (1 + m / 8) * 2.0 ** (e - 7)) * np.where(b >= 128, -1, 1)
    v[b & 127 == 127] = np.nan
    return v


FP8 = _fp8()


def decode(records: pa.Array, scales: pa.Array) -> np.ndarray:
    """The values, a row of 512 doubles for each record; scale byte 255 is NaN."""
    raw = np.frombuffer(b"".join(records.to_pylist()), np.uint8).reshape(-1, RECORD)
    e = np.frombuffer(b"".join(scales.to_pylist()), np.uint8).reshape(-1, SCALES)[:, :7]
    factor = np.where(e == 255, np.nan, 2.0 ** (e.astype(float) - 127))
    low = FP8[raw[:, :448]].reshape(-1, 7, GROUP) * factor[:, :, None]
    high = (np.ascontiguousarray(raw[:, 448:]).view("<u2").astype(np.uint32) << 16).view(np.float32)
    return np.concatenate([low.reshape(-1, 448), high.astype(float)], 1)


def pages(rows: DataFrame, per_page: int) -> DataFrame:
    """rows (page, slot, rec, scale) -> page, data: all its records, then all scale bytes; slots without a record are zeros."""
    zero = lambda n: F.to_binary(F.lit("00" * n), F.lit("hex"))
    slots = F.sequence(F.lit(0), F.lit(per_page - 1))
    g = rows.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), F.struct("rec", "scale")))).alias("m"))
    part = lambda field, n: F.unhex(F.array_join(F.transform(slots, lambda s: F.hex(F.coalesce(F.try_element_at("m", s)[field], zero(n)))), ""))
    return g.select("page", F.concat(part("rec", RECORD), part("scale", SCALES)).alias("data"))


def gather(index: DataFrame, pages: DataFrame, per_page: int) -> DataFrame:
    """index (..., idx) -> the same with page, slot, rec and scale of the record; negative indices are left out."""
    at = index.where("idx >= 0").withColumn("page", F.expr(f"idx div {per_page}")).withColumn("slot", (F.col("idx") % per_page).cast("int"))
    got = at.join(pages, "page")
    return got.withColumn("rec", F.expr(f"substring(data, slot * {RECORD} + 1, {RECORD})")).withColumn("scale", F.expr(f"substring(data, {per_page * RECORD} + slot * {SCALES} + 1, {SCALES})")).drop("data")


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))


def _decoded(records: DataFrame, keep: list[str], out: dict[str, str], columns) -> DataFrame:
    """records (keep, rec, scale) -> keep and the columns that are made from the values of a block of rows."""

    def work(batches):
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                b = batch[i : i + ROWS]
                v = decode(b.column(len(keep)), b.column(len(keep) + 1))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns(v)], [*keep, *out])

    kinds = dict(records.dtypes)
    return records.select(*keep, "rec", "scale").mapInArrow(work, ", ".join(f"{k} {t}" for k, t in ({k: kinds[k] for k in keep} | out).items()))


def decoded(records: DataFrame, keep: list[str]) -> DataFrame:
    """records (keep, rec, scale) -> keep, values."""
    return _decoded(records, keep, {"values": "array<double>"}, lambda v: [_vectors(v)])


def sums(records: DataFrame, keep: list[str], spans: dict[str, tuple[int, int]]) -> DataFrame:
    """records (keep, rec, scale) -> keep and, by name, the sum of the values of each span (begin, end)."""
    return _decoded(records, keep, dict.fromkeys(spans, "double"), lambda v: [pa.array(v[:, lo:hi].sum(1)) for lo, hi in spans.values()])


def _packed(batches):
    """The same rows in batches of a few MB."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _by_query(records: DataFrame, queries: DataFrame, work, schema: str) -> DataFrame:
    """work(row_id, salt, heads, ids, logits, values) over the records of a row, block by block, with all queries of it; ids is
    None when a row ends, also one without records. A row of many records is dealt to several tasks, its queries to each."""
    parts = records.groupBy("row_id").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
    none = F.lit(None).cast("binary")
    many = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    q = queries.join(parts, "row_id", "left").withColumn("salt", F.explode(many)).select("row_id", "salt", F.lit(0).alias("kind"), F.col("head").cast("long").alias("id"), none.alias("rec"), none.alias("scale"), F.col("q").cast("array<double>").alias("q"))
    r = records.join(parts, "row_id").select("row_id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), "rec", "scale", F.lit(None).cast("array<double>").alias("q"))

    def groups(batches):
        now, heads, qs = None, [], None
        for whole in batches:
            for i in range(0, len(whole), ROWS):
                batch = whole[i : i + ROWS]
                rows = batch.column(0)  # a null has no records, only queries
                key = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (rows.fill_null(0), batch.column(1), batch.column(2), rows.is_valid())])
                isrec = np.flatnonzero(key[2])
                v = decode(*(batch.column(k).take(pa.array(isrec)) for k in (4, 5)))
                if not np.isfinite(v).all():
                    raise ValueError("a selected record holds a value that is not finite")
                place = np.cumsum(key[2]) - key[2]  # of a record among those of the batch
                ids = batch.column(3).to_numpy()
                at = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))).tolist()
                for lo, hi in zip(at, [*at[1:], len(batch)], strict=True):
                    if now != (row := (int(key[0, lo]) if key[3, lo] else None, int(key[1, lo]))):
                        if now is not None and heads:
                            yield from work(*now, np.array(heads), None, None, None)
                        now, heads, qs = row, [], None
                    if key[2, lo] == 0:
                        heads += ids[lo:hi].tolist()
                        new = np.array(batch.column(6)[lo:hi].to_pylist())
                        qs = new if qs is None else np.concatenate([qs, new])
                    elif heads:
                        x = v[place[lo] : place[lo] + hi - lo]
                        yield from work(*now, np.array(heads), ids[lo:hi], qs @ x.T * SCALE, x)
        if now is not None and heads:
            yield from work(*now, np.array(heads), None, None, None)

    return q.union(r).repartition("row_id", "salt").sortWithinPartitions("row_id", "salt", "kind", "id").mapInArrow(lambda batches: _packed(groups(batches)), schema)


def scores(records: DataFrame, queries: DataFrame) -> DataFrame:
    """records (row_id, id, rec, scale), queries (row_id, head, q) -> row_id, head, id, score: every query of a row against every
    record of it."""

    def work(row, _salt, heads, ids, logits, _):
        if ids is not None:
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads) * n, row)), pa.array(np.repeat(heads, n)), pa.array(np.tile(ids, len(heads))), pa.array(logits.ravel())], ["row_id", "head", "id", "score"])

    return _by_query(records, queries, work, "row_id long, head long, id long, score double")


def attend(records: DataFrame, queries: DataFrame, sinks: DataFrame | None = None) -> DataFrame:
    """The same -> row_id, head, lse, output (512 doubles), for every query: the log of the sum of exponents, and the records
    weighted by the softmax. A query without a record has an output of zeros and an lse of infinity.

    A task keeps a maximum, a sum and a vector of each query; those are merged, in the order of the tasks' salts. With sinks
    (row_id, head, sink) the output is multiplied by the sigmoid of lse less sink, lse stays; a null sink gates nothing."""
    names = ["row_id", "head", "salt", "m", "s", "x"]
    held: dict[tuple, tuple] = {}

    def work(row, salt, heads, ids, logits, v):
        m, s, x = held.pop((row, salt), None) or (np.full(len(heads), -np.inf), np.zeros(len(heads)), np.zeros((len(heads), WIDTH)))
        if ids is None:  # the row ends here
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(heads), pa.int64()), pa.array(heads), pa.array(np.full(len(heads), salt)), pa.array(m), pa.array(s), _vectors(x)], names)
            return
        top = np.maximum(m, logits.max(1))
        old, w = np.exp(m - top), np.exp(logits - top[:, None])
        held[row, salt] = top, s * old + w.sum(1), x * old[:, None] + w @ v

    def merge(batches):
        now = m = s = x = None

        def ended():
            return pa.RecordBatch.from_arrays([pa.array(now[:1], pa.int64()), pa.array(now[1:]), pa.array([m + np.log(s) if s else np.inf]), _vectors((x / s if s else x)[None])], ["row_id", "head", "lse", "output"])

        for batch in batches:
            rows, heads, _, ms, ss = (c.to_pylist() for c in batch.columns[:5])
            for row, head, m2, s2, x2 in zip(rows, heads, ms, ss, batch.column(5).flatten().to_numpy().reshape(-1, WIDTH), strict=True):
                if now != (row, head):
                    if now is not None:
                        yield ended()
                    now, m, s, x = (row, head), m2, s2, x2
                elif s2:
                    top = max(m, m2)
                    a, b = np.exp(m - top), np.exp(m2 - top)
                    m, s, x = top, s * a + s2 * b, x * a + x2 * b
        if now is not None:
            yield ended()

    parts = _by_query(records, queries, work, "row_id long, head long, salt long, m double, s double, x array<double>")
    parts = parts.repartition("row_id", "head").sortWithinPartitions("row_id", "head", "salt")
    out = parts.mapInArrow(lambda batches: _packed(merge(batches)), "row_id long, head long, lse double, output array<double>")
    out = out.select(*(F.col(k).cast(dict(queries.dtypes)[k]).alias(k) for k in ("row_id", "head")), "lse", "output")
    if sinks is None:
        return out
    return out.join(sinks, ["row_id", "head"], "left").select("row_id", "head", "lse", F.transform("output", lambda x: x * gate(F.col("lse"), F.col("sink"))).alias("output"))


def gate(lse: Column, sink: Column) -> Column:
    """The sigmoid of lse less sink; 1 without a sink, or where there is nothing to gate."""
    return F.when(sink.isNull() | (lse == float("inf")), 1.0).otherwise(1 / (1 + F.exp(sink - lse)))

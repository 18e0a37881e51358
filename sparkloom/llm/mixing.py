"""Mixing sources to target weights by weighted fair queueing.

Each document enters its source's queue up to twice, in an order shuffled by a keyed hash. A copy's virtual finish time
is the cumulative size of its source's queue up to and including it, divided by the source's target; all queues reach
1 together, whatever their sizes. The copies are range-sorted by finish time over all sources and cut where the
cumulative size passes the total budget. Each step that later ones read more than once is written as a table, so that no
plan holds another's work again: one plan of all steps takes the driver more memory than the steps themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import discard, stash, table

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one bucket of a queue, or of the range-sorted mix, holds on average: what one window sums in order.
BUCKET = 2000
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, ...) -> the same with `target`, `budget`.

    The sources, by code point with null last, take the weights in turn and share `share` of all sizes; no target is above
    `most` times its source's size, the excess goes to the others by weight. In closed form: in the order of cap over
    weight, a source is capped if its cap is at most its share of what the capped ones before it leave; the first that is
    not fixes the level of the rest. The windows without a partition run over one row per source alone."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = (s.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
         .withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("wrest", F.sum("w").over(after))
         .withColumn("nth", F.row_number().over(order))
         .withColumn("free", F.col("cap") * F.col("wrest") > F.col("rest") * F.col("w")))
    level = F.min(F.when(F.col("free"), F.struct("nth", (F.col("rest") / F.col("wrest")).alias("level")))).over(everything)
    s = s.withColumn("level", level["level"])
    return s.select(*sources.columns, F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"), "budget")


def _ahead(sums: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """sums with, as name, the sum of value over the rows of the keys that come before in the order of the whole number at: within
    runs of BUCKET numbers, and between those over a row for each."""
    run = F.floor(F.col(at) / BUCKET)
    inside = Window.partitionBy(*keys, "__run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    s = sums.withColumn("__run", run)
    runs = s.groupBy(*keys, "__run").agg(F.sum(value).alias("__z"))
    between = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__z").over(between), F.lit(0).cast("long"))).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__run").alias("__r"), "__before")
    on = F.col("__run") == F.col("__r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    s = s.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long"))).join(runs, on)
    return s.withColumn(name, F.col("__before") + F.col("__in")).select(*sums.columns, name)


def queues(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """As _queues, without the tables that the result reads."""
    return _queues(docs, weights, share, most, seed)[0]


def _queues(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: str) -> tuple[DataFrame, list[DataFrame]]:
    """docs (doc_id, source, size, and tie, a hash of the text) -> a row for each document and copy: besides those columns `dup`,
    `copy`, `source_size`, `target`, `finish`, `position` (sizes in the mix up to and including it), `taken` (whether the
    budget holds it); and the stashed tables that those rows are read from.

    Rows that repeat a document are documents of their own, told apart by `dup`, in the order of tie. Null sources form one source; null sizes
    count 0; copies without size have no finish time and are not taken. No task sees a whole source: sums run within
    buckets of the shuffled order, and between buckets over one row for each."""
    docs = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "tie")
    rows = stash(docs.withColumn("dup", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("tie"))))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs")), weights, share, most)
    goal = goal.withColumn("n_buckets", F.greatest(F.lit(1), F.ceil(F.col("source_docs") / BUCKET))).withColumn("n_ranges", F.greatest(F.lit(1), F.ceil(F.sum("source_docs").over(Window.partitionBy()) / BUCKET))).withColumnRenamed("source", "s")
    goal = stash(goal)
    d = rows.join(goal, rows["source"].eqNullSafe(goal["s"])).drop("s").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(most))))
    d = d.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "copy", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "dup")))
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("n_buckets")))
    inside = Window.partitionBy("source", "copy", "bucket").orderBy("h", "doc_id", "dup").rowsBetween(Window.unboundedPreceding, 0)
    d = queued = stash(d.withColumn("cum", F.sum("size").over(inside)))
    discard(rows, goal)
    sums = d.groupBy("source", "copy", "bucket").agg(F.sum("size").alias("z"), F.first("n_buckets").alias("n"))
    buckets = stash(sums.withColumn("at", (F.col("copy") - 1) * F.col("n") + F.col("bucket")))
    sums = _ahead(buckets, ["source"], "at", "z", "base").select(F.col("source").alias("s"), F.col("copy").alias("c"), F.col("bucket").alias("b"), "base")
    d = d.join(sums, d["source"].eqNullSafe(F.col("s")) & (F.col("copy") == F.col("c")) & (F.col("bucket") == F.col("b"))).drop("s", "c", "b")
    d = d.withColumn("finish", F.when(F.col("size") > 0, (F.col("base") + F.col("cum")) / F.col("target")))
    # the global order, range by range of finish time: a range holds about budget / n_ranges words, whatever the sources
    d = stash(d.withColumn("range", F.floor(F.col("finish") * F.col("n_ranges"))))
    discard(queued, buckets)
    ranked = Window.partitionBy("range").orderBy("finish", F.col("source").isNull(), "source", "h", "doc_id", "dup").rowsBetween(Window.unboundedPreceding, 0)
    sizes = stash(d.where("finish is not null").groupBy("range").agg(F.sum("size").alias("z")))
    ranges = stash(_ahead(sizes, [], "range", "z", "ahead").select(F.col("range").alias("r"), "ahead"))
    discard(sizes)
    some = d.where("finish is not null").withColumn("here", F.sum("size").over(ranked)).join(ranges, F.col("range") == F.col("r"))
    some = some.withColumn("position", F.col("ahead") + F.col("here")).withColumn("taken", F.col("position") <= F.col("budget"))
    keep = ["doc_id", "source", "size", "tie", "dup", "copy", "source_size", "target", "finish", "position", "taken"]
    none = d.where("finish is null").withColumn("position", F.lit(None).cast("long")).withColumn("taken", F.lit(False))
    return some.select(*keep).unionByName(none.select(*keep)), [d, ranges]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """documents -> the mix: a row of docs for each copy taken (a document up to `most` times), its columns unchanged.
    Columns beyond doc_id, source and text pass through, whatever their names."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    q, read = _queues(sized, weights, share, most, seed)
    got = stash(q.where("taken").groupBy("doc_id", "source", "size", "dup").agg(F.count("*").alias("copies")))
    discard(*read)
    key = lambda size, of="": F.struct(F.col(f"{of}doc_id").alias("doc_id"), F.col(f"{of}source").alias("source"), size.alias("size")).alias("__key")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    d = d.select("__row", key(n_words(F.col("__row.text")), "__row."), F.lit(None).cast("int").alias("__dup"), F.lit(None).cast("long").alias("__copies"))
    got = got.select(F.lit(None).cast(d.schema["__row"].dataType).alias("__row"), key(F.col("size")), F.col("dup").alias("__dup"), F.col("copies").alias("__copies"))
    # dealt out once, texts with their numbers of copies; a join would deal the numbered texts out again
    both = d.unionByName(got).repartition("__key")
    number = F.row_number().over(Window.partitionBy("__key", F.col("__row").isNull()).orderBy(F.xxhash64("__row.text")))
    both = both.withColumn("__dup", F.coalesce("__dup", number))
    both = both.withColumn("__copies", F.max("__copies").over(Window.partitionBy("__key", "__dup"))).where("__row is not null and __copies is not null")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")


def op9_mix(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    q = queues(docs)
    return q.groupBy("doc_id", "source", "size", "dup").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))), F.lit(0).cast("long")).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
u as (select *, row_number() over (partition by doc_id, source, size) as dup from d),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, list_extract([5.0, 2.0, 1.0]::double[], ((row_number() over (order by source is null, source) - 1) % 3 + 1)::int) as w, 2.0::double * source_size as cap from s),
x as (
  select *, 1.5::double * sum(source_size) over () as budget, row_number() over (order by cap / w, source is null, source) as nth,
    sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as wrest,
    1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as rest
  from w),
l as (select arg_min(rest / wrest, nth) filter (where cap * wrest > rest * w) as level from x),
t as (select source, source_size, budget, case when level is null then cap else least(cap, level * w) end as target from x, l),
c as (select u.*, source_size, target, budget, copy, md5(concat_ws(':', 'mix', copy, coalesce(doc_id::varchar, 'null'), dup)) as h
  from u join t on u.source is not distinct from t.source, (values (1), (2)) k(copy)),
f as (select *, sum(size) over (partition by source order by copy, h, doc_id, dup)::bigint / target as finish from c where size > 0),
p as (select *, sum(size) over (order by finish, source is null, source, h, doc_id, dup rows unbounded preceding) <= budget as taken from f)
select c.doc_id, c.size, any_value(c.source_size) as source_size, any_value(c.target) as target, coalesce(sum(p.size) filter (where p.taken), 0)::bigint as taken
from c left join p on c.doc_id is not distinct from p.doc_id and c.source is not distinct from p.source and c.size = p.size and c.dup = p.dup and c.copy = p.copy
group by c.doc_id, c.source, c.size, c.dup
"""

"""The work profiles that attention is judged on: a grid of cases with their scopes, lengths, selections and valid counts, and
the roofline estimate of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
DIMENSION, RECORD, SCORED, FIXTURES = 512, 584, "roofline-b128-q3-h128-k1152-c32768", "fixture"
FLOPS, BANDWIDTH, TIMED = 2.25e15, 8e12, 128
FIXTURE_LENGTHS, PADDED = {0: (0, 7, 650, 317), 1: (0, 5, 512, 129)}, (2, 1)
_SCOPE = "array<struct<nominal:int,topk:int,page:int,masked:boolean>>"


def cases(spark: SparkSession) -> DataFrame:
    """case_id, name, batch, queries, heads, scored, sliding, sinks, throughput_weight, scopes: grids of configurations one
    after the other, and at the end the one case that is scored."""
    table = lambda columns, values: spark.sql(f"select * from values {values} t({columns})")
    shapes = table("o2, batch, queries", "(0, 2, 1), (1, 74, 2), (2, 128, 3)")
    kinds = table("config, heads, topk, page, masked", "(1, 64, 512, 64, false), (2, 128, 1024, 64, false), (3, 64, 1024, 2, true), (4, 128, 1024, 2, true)")
    heads, flag = table("heads", "(64), (128)"), table("f", "(false), (true)")
    scope = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, ("nominal", "topk", "page", "masked"), strict=True)))
    lit = lambda *x: scope(*map(F.lit, x))

    def made(df: DataFrame, group: int, order: list, name: Column, batch, queries, scored: bool, sliding: bool, sinks, weight: int, scopes: Column) -> DataFrame:
        of = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select(F.struct(F.lit(group).alias("g"), *(F.col(o).cast("int").alias(f"o{i}") for i, o in enumerate(order))).alias("place"), name.alias("name"), of(batch).cast("int").alias("batch"), of(queries).cast("int").alias("queries"), "heads",
                         F.lit(scored).alias("scored"), F.lit(sliding).alias("sliding"), of(sinks).alias("sinks"), F.lit(weight).alias("throughput_weight"), scopes.cast(_SCOPE).alias("scopes"))

    none = F.lit(0)
    production = made(kinds.crossJoin(shapes).withColumn("z", none), 0, ["config", "o2", "z"], F.format_string("production-%d-b%d-q%d", "config", "batch", "queries"), F.col("batch"), F.col("queries"), True, True, True, 0,
                      F.array(lit(16384, 128, 256, False), scope(F.lit(16384), F.col("topk"), F.col("page"), F.col("masked"))))
    long = made(heads.withColumn("z", none), 1, ["heads", "z", "z"], F.format_string("long-h%d", "heads"), 148, 2, True, False, True, 0, F.array(lit(32768, 16384, 64, False)))
    fixed = heads.crossJoin(flag.withColumnRenamed("f", "extra")).crossJoin(flag.withColumnRenamed("f", "sinks"))
    first, second = lit(650, 576, 53, True), lit(512, 64, 61, True)
    fixture = made(fixed, 2, ["heads", "extra", "sinks"], F.format_string("fixture-h%d-extra%d-sink%d", "heads", F.col("extra").cast("int"), F.col("sinks").cast("int")), 4, 3, False, False, F.col("sinks"), 0,
                   F.when(F.col("extra"), F.array(first, second)).otherwise(F.array(first)))
    one = made(table("heads, z", "(128, 0)"), 3, ["z", "z", "z"], F.lit(SCORED), 128, 3, True, True, True, 1, F.array(lit(32768, 128, 256, False), lit(32768, 1024, 64, False)))
    every = production.unionByName(long).unionByName(fixture).unionByName(one)
    # a manifest's ordinal: its place in the array of all, which is small
    listed = every.groupBy().agg(F.array_sort(F.collect_list(F.struct(*every.columns))).alias("c")).select(F.posexplode("c").alias("case_id", "c"))
    return listed.select("case_id", *(f"c.{x}" for x in every.columns if x != "place"))


def profiles(cases: DataFrame) -> DataFrame:
    """A row for each case, scope and batch entry: length, selected (null without a mask), and the counts of valid entries of
    each query row. Lengths and selections come from a formula over case, scope and entry; the fixtures' are fixed, and one
    of their rows is padding."""
    s = cases.select("*", F.posexplode("scopes").alias("scope_id", "s")).select("case_id", "name", "batch", "queries", "scored", "sliding", "scope_id", "s.*")
    s = s.withColumn("batch_id", F.explode(F.sequence(F.lit(0), F.col("batch") - 1))).where("batch_id < batch")
    own = F.when(F.col("scope_id") == 0, F.array(*map(F.lit, FIXTURE_LENGTHS[0]))).otherwise(F.array(*map(F.lit, FIXTURE_LENGTHS[1])))
    drawn = F.greatest(F.expr("nominal div 2 + pmod(batch_id * 7919 + case_id * 104729 + scope_id * 31, nominal)"), F.col("queries")).cast("int")
    picked = F.expr("cast(pmod(batch_id * 6007 + case_id * 13, topk + 1) as int)")
    fixed = F.element_at(F.array(F.lit(0), F.col("topk"), F.expr("cast(topk div 2 as int)") + 1, F.lit(0)), F.col("batch_id") + 1)
    even = F.col("throughput_weight") > 0 if "throughput_weight" in s.columns else F.col("name") == SCORED
    s = s.withColumn("length", F.when(even, F.col("nominal")).when(~F.col("scored"), F.element_at(own, F.col("batch_id") + 1)).otherwise(drawn))
    s = s.withColumn("selected", F.when(~F.col("scored"), fixed).when(F.col("masked"), picked))

    def valid(row: Column) -> Column:
        seen = F.when(F.col("sliding") & (F.col("scope_id") == 0), F.col("length") - F.col("queries") + row + 1).otherwise(F.col("length"))
        count = F.least(F.greatest(seen, F.lit(0)), F.col("topk"), F.coalesce("selected", "topk"))
        return F.when(~F.col("scored") & (F.col("batch_id") == PADDED[0]) & (row == PADDED[1]), 0).otherwise(count)

    return s.withColumn("valid", F.transform(F.sequence(F.lit(0), F.col("queries") - 1), valid))


def capacities(profiles: DataFrame) -> DataFrame:
    """Of each case and scope: capacity (a multiple of four pages), pages and the stride of a page in whole records."""
    c = profiles.groupBy("case_id", "name", "scope_id", "page", "batch").agg(F.max("length").alias("longest"))
    c = c.withColumn("capacity", F.greatest(F.lit(1), F.ceil(F.col("longest") / (4 * F.col("page")))) * 4 * F.col("page"))
    return c.select("case_id", "name", "scope_id", "capacity", F.expr("batch * capacity div page").alias("pages"), (F.ceil(F.col("page") * RECORD / F.lit(576)) * 576).alias("stride"))


def roofline(cases: DataFrame) -> DataFrame:
    """The estimate of each case, as if all selections were full: operations, bytes, seconds for either, the larger of them, the
    rate it allows and what limits it. A sliding window's first scope adds a position for each further query row."""
    c = cases.withColumn("tokens", F.col("batch").cast("long") * F.col("queries"))
    c = c.withColumn("selected", F.aggregate("scopes", F.lit(0).cast("long"), lambda n, s: n + s.topk))
    c = c.withColumn("union", F.col("selected") + F.when(F.col("sliding"), F.col("queries") - 1).otherwise(0))
    c = c.where("least(batch, queries, heads, selected) > 0")
    c = c.withColumn("flops", 4 * F.col("tokens") * F.col("heads") * F.col("selected") * DIMENSION).withColumn("kv_bytes", F.col("batch") * F.col("union") * RECORD)
    c = c.withColumn("bytes", F.col("tokens") * F.col("heads") * (DIMENSION * 4 + 4) + F.col("tokens") * F.col("selected") * 4 + F.when(F.col("sinks"), F.col("heads") * 4).otherwise(0) + F.col("kv_bytes") / F.lit(float(TIMED)))
    c = c.withColumn("compute_seconds", F.col("flops") / F.lit(FLOPS)).withColumn("memory_seconds", F.col("bytes") / F.lit(BANDWIDTH)).withColumn("ideal_seconds", F.greatest("compute_seconds", "memory_seconds"))
    return c.select("name", "flops", "kv_bytes", "bytes", "compute_seconds", "memory_seconds", "ideal_seconds", (F.col("tokens") / F.col("ideal_seconds")).alias("rate"), F.when(F.col("compute_seconds") >= F.col("memory_seconds"), "compute").otherwise("memory").alias("limited_by"))

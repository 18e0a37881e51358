"""Comparison within tolerances, case grids, report gates and rewards.

Reports are JSON documents made from all of `events`: the type is the suite, event_id % 2 the role, user_id % 9 the run; each
holds all 23 cases, and here and there something that a gate must find. The oracles work on the numbers that the documents
are made from, without documents. Answers come from `lineitem`, perturbed by l_orderkey % 14."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, gates, profiles
from ..operators.ranking import reward
from ..sources.tables import table
from .sqlplans import query

#: (suite, role, run) of the reports with a count and a sum that decide what they hold.
_G = "g as (select event_type as suite, event_id % 2 as role, user_id % 9 as run, count(*) as c, cast(sum(event_id) as bigint) as s from events group by event_type, event_id % 2, user_id % 9)"


def reports(spark, d) -> DataFrame:
    """suite, role, run, json: the documents, as text."""
    g = spark.sql("select event_type as suite, if(event_id % 2 = 0, 'baseline', 'candidate') as role, user_id % 9 as run, count(*) as c, sum(event_id) as s from {events} group by all", events=table(spark, d, "events"))
    rows = g.crossJoin(F.broadcast(profiles.cases(spark).select("case_id", "name", "throughput_weight"))).where("(s * 7 + case_id * 13 + run) % 1500 <> 0")
    good = lambda ok: F.create_map(F.lit("output"), _check(F.lit(True)), F.lit("lse"), _check(ok))
    _check = lambda ok: F.struct((F.col("s") % 7 / 1e7).alias("max_absolute"), F.lit(0.0).alias("distance"), ok.alias("passed"))
    ok = F.expr("(s * 7 + case_id * 13 + run) % 1500 <> 1")
    seconds = F.expr("(1000 + s % 1000) / 1e6 * if(role = 'candidate', 8e-1, 1e0)")
    timed = F.col("throughput_weight") > 0
    only = lambda c: F.when(timed, c)
    item = F.struct(good(ok).alias("numerical"), good(F.lit(True)).alias("same_storage"), only(seconds).alias("seconds"), only(seconds * F.expr("if(s % 90 = 2, 127, 128)")).alias("block_seconds"),
                    only(F.expr("if(s % 90 = 0, 1, 128)")).alias("timed_calls"), only(F.lit(32)).alias("warmup_calls"), only(F.lit(128)).alias("distinct_queries"), only(F.lit(3)).alias("snapshot_copies"),
                    only(F.map_from_arrays(F.expr("array('0', '64', if(s % 90 = 1, '126', '127'))"), F.array(*[good(F.lit(True))] * 3))).alias("timed_output_checks"))
    r = rows.groupBy("suite", "role", "run", "c", "s").agg(F.map_from_entries(F.collect_list(F.struct("name", item.alias("item")))).alias("cases"))
    return r.select("suite", "role", "run", F.to_json(F.struct(F.lit("torch").alias("torch"), F.lit("gpu").alias("gpu"), (F.col("run") * 100003 + 17).alias("seed"), (F.col("c") * 1024).alias("peak_gpu_bytes"), (F.col("c") / 8).alias("workload_seconds"), "cases")).alias("json"))


def _parsed(spark, d) -> DataFrame:
    return gates.parsed(reports(spark, d))


def _measured(spark, d) -> DataFrame:
    return gates.measured(_parsed(spark, d), profiles.cases(spark), ["suite", "role"])


def report_flatten(spark, d) -> DataFrame:
    f = gates.flat(_parsed(spark, d).withColumn("peak", F.col("report.peak_gpu_bytes")))
    return f.select("suite", "role", "run", "name", "peak", F.round("item.seconds", 9).alias("seconds"), F.size(F.coalesce(F.map_keys("item.timed_output_checks"), F.array())).alias("checks"))


def coverage_check(spark, d) -> DataFrame:
    """Of each set: its runs, whether they are nine, and the names that its reports lack or have too much."""
    r = _parsed(spark, d).crossJoin(F.broadcast(gates.manifest(profiles.cases(spark)).select("names")))
    got = F.map_keys("report.cases")
    r = r.select("suite", "role", F.size(F.array_except("names", got)).alias("m"), F.size(F.array_except(got, "names")).alias("x"))
    return r.groupBy("suite", "role").agg(F.count("*").alias("runs"), (F.count("*") == gates.RUNS).cast("int").alias("nine"), F.sum("m").alias("missing"), F.sum("x").alias("extra"))


def evidence_gate(spark, d) -> DataFrame:
    f = gates.flat(_parsed(spark, d))
    passed = gates.evidence(F.col("item.numerical")) & gates.evidence(F.col("item.same_storage"))
    return f.groupBy("suite", "role").agg(F.count("*").alias("items"), F.count_if(~passed).alias("failed"))


def protocol_gate(spark, d) -> DataFrame:
    f = gates.flat(_parsed(spark, d)).where(F.col("name") == profiles.SCORED)
    return f.select("suite", "role", "run", F.coalesce(gates.protocol(F.col("item")), F.lit("valid")).alias("verdict"))


def median_rate(spark, d) -> DataFrame:
    return _measured(spark, d).select("suite", "role", "runs", F.coalesce("error", F.lit("none")).alias("error"), F.round("median_seconds", 9).alias("median_seconds"), F.round("rate", 4).alias("rate"), F.round("efficiency", 9).alias("efficiency"))


def paired_ratio(spark, d) -> DataFrame:
    """Run by run: the candidate's time over the baseline's, where both have one; and which of them went first."""
    f = gates.flat(_parsed(spark, d)).where(F.col("name") == profiles.SCORED)
    a, b = (f.where(F.col("role") == r).select("suite", "run", F.col("item.seconds").alias(r)) for r in ("baseline", "candidate"))
    return a.join(b, ["suite", "run"]).select("suite", "run", F.round(F.col("baseline") / F.col("candidate"), 9).alias("ratio"), F.when(F.col("run") % 2 == 0, "baseline").otherwise("candidate").alias("first"))


def block_timing(spark, d) -> DataFrame:
    """Seconds a call by block, peak of memory over the runs, and the share of the wall that the block takes."""
    f = gates.flat(_parsed(spark, d).withColumn("peak", F.col("report.peak_gpu_bytes")).withColumn("wall", F.col("report.workload_seconds"))).where(F.col("name") == profiles.SCORED)
    return f.groupBy("suite", "role").agg(F.round(F.avg(F.col("item.block_seconds") / F.col("item.timed_calls")), 9).alias("per_call"), F.max("peak").alias("peak"), F.round(F.max(F.col("item.block_seconds") / F.col("wall")), 9).alias("share"))


def reward_throughput(spark, d) -> DataFrame:
    p = gates.paired(_measured(spark, d), ["suite"])
    return p.select("suite", "outcome", "valid", F.round("reward", 6).alias("reward"), F.round("ratio", 6).alias("ratio"))


def reward_subset(spark, d) -> DataFrame:
    """The same for the scored case alone: a subset of the cases has no reward, whatever its ratio."""
    cases = profiles.cases(spark).where(F.col("name") == profiles.SCORED)
    r = _parsed(spark, d).withColumn("report", F.col("report").withField("cases", F.map_filter("report.cases", lambda k, v: k == profiles.SCORED)))
    p = gates.paired(gates.measured(r, cases, ["suite", "role"], diagnostic_only=True), ["suite"], subset=True)
    return p.select("suite", "outcome", "valid", F.round("reward", 6).alias("reward"))


def failure_class(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("setup", "build", "baseline", "candidate", "complete"))), (F.col("event_id") % 5 + 1).cast("int")).alias("phase"), (F.col("user_id") % 4 == 0).alias("os"))
    return e.select("event_id", gates.failure(F.col("phase"), F.col("os")).alias("outcome"))


def scored_gate(spark, d) -> DataFrame:
    c = gates.manifest(profiles.cases(spark))
    return c.select(F.size("scored_names").alias("scored"), F.get("scored_names", 0).alias("name"), (F.size("scored_names") == 1).cast("int").alias("valid"))


def distinct_gate(spark, d) -> DataFrame:
    """Of each set the distinct seeds of its reports: nine, or it may not run."""
    return _parsed(spark, d).groupBy("suite", "role").agg(F.count_distinct("report.seed").alias("seeds"), ((F.count_distinct("report.seed") == gates.RUNS) & (F.count("*") == gates.RUNS)).cast("int").alias("valid"))


def case_grid(spark, d) -> DataFrame:
    return profiles.cases(spark).select("case_id", "name", "batch", "queries", "heads", F.col("scored").cast("int").alias("scored"), F.col("sliding").cast("int").alias("sliding"), F.col("sinks").cast("int").alias("sinks"), "throughput_weight", F.array_join(F.transform("scopes", lambda s: F.concat_ws("/", s.nominal, s.topk, s.page, s.masked.cast("int"))), "+").alias("scopes"))


def filter_case(spark, d) -> DataFrame:
    """The manifest as a document, read again, and the cases of one name; none is an error."""
    c = profiles.cases(spark)
    text = c.groupBy().agg(F.to_json(F.struct(F.lit(5).alias("version"), F.collect_list(F.struct("name", "batch", "heads")).alias("cases"))).alias("json"))
    doc = text.select(F.from_json("json", "version int, cases array<struct<name:string,batch:int,heads:int>>", {"mode": "FAILFAST"}).alias("m"))
    found = doc.select(F.filter("m.cases", lambda x: x["name"] == profiles.SCORED).alias("f"))
    return found.select(F.explode(F.when(F.size("f") > 0, F.col("f")).otherwise(F.raise_error(F.lit("unknown case name")).cast("array<struct<name:string,batch:int,heads:int>>"))).alias("x")).select("x.*")


def seed_derive(spark, d) -> DataFrame:
    """The ordinal is the manifest's, before any filter."""
    return profiles.cases(spark).where("throughput_weight = 0 and scored").select("name", "case_id", (F.lit(771731) + F.col("case_id") * 100003).cast("long").alias("seed"))


def valid_counts(spark, d) -> DataFrame:
    p = profiles.profiles(profiles.cases(spark))
    return p.select("name", "scope_id", "batch_id", "length", "selected", F.array_join("valid", ",").alias("valid"))


def capacity_round(spark, d) -> DataFrame:
    return profiles.capacities(profiles.profiles(profiles.cases(spark))).drop("case_id")


def roofline(spark, d) -> DataFrame:
    r = profiles.roofline(profiles.cases(spark))
    return r.select("name", "flops", "kv_bytes", F.round("bytes", 3).alias("bytes"), *(F.round(F.col(c) * 1e6, 6).alias(c) for c in ("compute_seconds", "memory_seconds", "ideal_seconds")), F.round("rate", 3).alias("rate"), "limited_by")


#: Order and line alone repeat in the test tables.
_KEY = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _answers(spark, d) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "lineitem").select(*_KEY, F.col("l_extendedprice").alias("v"))
    k, inf = F.col("l_orderkey") % 14, float("inf")
    odd = lambda at: F.when(k == at, F.lit(float("nan"))).when(k == at + 1, inf).when(k == at + 2, -inf)
    want = x.withColumn("v", F.when(k.between(1, 3), odd(1)).otherwise(F.col("v")))
    got = x.withColumn("v", F.when(k.between(1, 3), odd(1)).when((k == 8) & (F.col("l_returnflag") == "R"), float("nan")).when(k == 0, F.col("v") * (1 + 1e-4)).when((k == 9) & (F.col("l_returnflag") == "A"), F.col("v") * 1.2).otherwise(F.col("v")))
    return got, want




def allclose_compare(spark, d) -> DataFrame:
    c = compare.allclose(*_answers(spark, d), _KEY, "v", ["l_returnflag"], (1e-3, 2.01 / 128, 5e-6))
    return c.select("l_returnflag", "elements", "nan_mismatch", "inf_mismatch", "neg_inf_mismatch", "unpaired", "outside", F.round("max_absolute", 4).alias("max_absolute"), F.round("distance", 9).alias("distance"), F.col("passed").cast("int").alias("passed"))


def cos_diff(spark, d) -> DataFrame:
    got, want = _answers(spark, d)
    return compare.allclose(got, want, _KEY, "v", ["l_returnflag"], (1e-3, 2.01 / 128, 5e-6)).select("l_returnflag", F.round("distance", 9).alias("distance"))


def argmax_error(spark, d) -> DataFrame:
    """Where the error is largest, as a place in a tensor of lines of 64 orders: the last dimension runs fastest."""
    got, want = _answers(spark, d)
    return compare.worst(got, want, _KEY, "v", ["l_returnflag"]).select("l_returnflag", "l_orderkey", "l_linenumber", F.expr("l_orderkey div 64").alias("line"), (F.col("l_orderkey") % 64).alias("place"))


def bitwise_equal(spark, d) -> DataFrame:
    return compare.unequal(*_answers(spark, d), _KEY, "v", ["l_returnflag"])


_CASES = """c as (select * from (values
  (0, 'production-1-b2-q1', 2, 1, 64, 1, 1, 1, 0, 512, 64, 0), (1, 'production-1-b74-q2', 74, 2, 64, 1, 1, 1, 0, 512, 64, 0), (2, 'production-1-b128-q3', 128, 3, 64, 1, 1, 1, 0, 512, 64, 0),
  (3, 'production-2-b2-q1', 2, 1, 128, 1, 1, 1, 0, 1024, 64, 0), (4, 'production-2-b74-q2', 74, 2, 128, 1, 1, 1, 0, 1024, 64, 0), (5, 'production-2-b128-q3', 128, 3, 128, 1, 1, 1, 0, 1024, 64, 0),
  (6, 'production-3-b2-q1', 2, 1, 64, 1, 1, 1, 0, 1024, 2, 1), (7, 'production-3-b74-q2', 74, 2, 64, 1, 1, 1, 0, 1024, 2, 1), (8, 'production-3-b128-q3', 128, 3, 64, 1, 1, 1, 0, 1024, 2, 1),
  (9, 'production-4-b2-q1', 2, 1, 128, 1, 1, 1, 0, 1024, 2, 1), (10, 'production-4-b74-q2', 74, 2, 128, 1, 1, 1, 0, 1024, 2, 1), (11, 'production-4-b128-q3', 128, 3, 128, 1, 1, 1, 0, 1024, 2, 1),
  (12, 'long-h64', 148, 2, 64, 1, 0, 1, 0, null, null, null), (13, 'long-h128', 148, 2, 128, 1, 0, 1, 0, null, null, null),
  (14, 'fixture-h64-extra0-sink0', 4, 3, 64, 0, 0, 0, 0, null, null, null), (15, 'fixture-h64-extra0-sink1', 4, 3, 64, 0, 0, 1, 0, null, null, null),
  (16, 'fixture-h64-extra1-sink0', 4, 3, 64, 0, 0, 0, 0, 64, 61, 1), (17, 'fixture-h64-extra1-sink1', 4, 3, 64, 0, 0, 1, 0, 64, 61, 1),
  (18, 'fixture-h128-extra0-sink0', 4, 3, 128, 0, 0, 0, 0, null, null, null), (19, 'fixture-h128-extra0-sink1', 4, 3, 128, 0, 0, 1, 0, null, null, null),
  (20, 'fixture-h128-extra1-sink0', 4, 3, 128, 0, 0, 0, 0, 64, 61, 1), (21, 'fixture-h128-extra1-sink1', 4, 3, 128, 0, 0, 1, 0, 64, 61, 1),
  (22, 'roofline-b128-q3-h128-k1152-c32768', 128, 3, 128, 1, 1, 1, 1, 1024, 64, 0))
  t(case_id, name, batch, queries, heads, scored, sliding, sinks, throughput_weight, k2, p2, m2)),
o as (select case_id, 0 as scope_id, case when name like 'long%' or case_id = 22 then 32768 when name like 'fix%' then 650 else 16384 end as nominal, case when name like 'long%' then 16384 when name like 'fix%' then 576 else 128 end as topk,
    case when name like 'long%' then 64 when name like 'fix%' then 53 else 256 end as page, case when name like 'fix%' then 1 else 0 end as masked from c
  union all select case_id, 1, case when name like 'fix%' then 512 when case_id = 22 then 32768 else 16384 end, k2, p2, m2 from c where k2 is not null)"""
_PROFILE = _CASES + """, b as (select c.*, scope_id, nominal, topk, page, masked, unnest(range(0, batch)) as batch_id from c join o using (case_id)),
l as (select *, case when throughput_weight = 1 then nominal when scored = 0 then case when scope_id = 0 then [0, 7, 650, 317] else [0, 5, 512, 129] end[batch_id + 1]
    else greatest(queries, nominal // 2 + (batch_id * 7919 + case_id * 104729 + scope_id * 31) % nominal) end as length,
  case when scored = 0 then [0, topk, topk // 2 + 1, 0][batch_id + 1] when masked = 1 then (batch_id * 6007 + case_id * 13) % (topk + 1) end as selected from b)"""
_SIDE = "case when role = 0 then 'baseline' else 'candidate' end"
_CELLS = f"""with {_G}, {_CASES}, e as (select suite, {_SIDE} as role, run, g.c as n, s, case_id, name, throughput_weight as w, (s * 7 + case_id * 13 + run) % 1500 <> 1 as ok from g, c where (s * 7 + case_id * 13 + run) % 1500 <> 0),
t as (select *, (1000 + s % 1000) / 1e6 * case when role = 'candidate' then 0.8::double else 1 end as seconds, case when s % 90 = 2 then 127 else 128 end as calls,
  case when s % 90 = 0 then 'protocol' when s % 90 = 1 then 'samples' when s % 90 = 2 then 'block' end as what from e where w = 1)"""
_SETS = f"""{_CELLS}, h as (select suite, {_SIDE} as role, run from g), per as (select h.suite, h.role, h.run, (select count(*) from e where (e.suite, e.role, e.run) = (h.suite, h.role, h.run)) as names,
  (select count(*) from e where (e.suite, e.role, e.run) = (h.suite, h.role, h.run) and not ok) as bad, t.seconds, t.what, t.name is null as untimed from h left join t on (t.suite, t.role, t.run) = (h.suite, h.role, h.run)),
wrong as (select suite, role, run, 0 as phase, case when names <> 23 then 'coverage' else 'evidence' end as what from per where names <> 23 or bad > 0 union all select suite, role, run, 1, case when untimed then 'protocol' else what end from per where names = 23 and bad = 0 and (what is not null or untimed)),
m as (select per.suite, per.role, count(*) as runs, median(seconds) as med from per group by per.suite, per.role),
r as (select m.*, case when runs <> 9 then 'runs' else (select arg_min(what, phase * 100 + run) from wrong w where w.suite = m.suite and w.role = m.role) end as error from m)"""
_IDEAL = "4::double * 384 * 128 * 1152 * 512 / 2.25e15"
_CLIP = "least(1, greatest(0, ((b.med / c.med - 1) / (1.3515515495176977::double - 1) - 0.01::double) / 0.98::double))"
_PAIRS = "p as (select s.suite, b.med as bm, b.error as be, b.suite is null as nb, c.med as cm, c.error as ce, c.suite is null as nc, b.med / c.med as ratio from (select distinct suite from r) s left join r b on b.suite = s.suite and b.role = 'baseline' left join r c on c.suite = s.suite and c.role = 'candidate')"
_ANSWERS = """a as (select l_returnflag, l_orderkey, l_linenumber, case l_orderkey % 14 when 1 then 'nan'::double when 2 then 'inf'::double when 3 then '-inf'::double else l_extendedprice end as want,
  case when l_orderkey % 14 = 1 then 'nan'::double when l_orderkey % 14 = 2 then 'inf'::double when l_orderkey % 14 = 3 then '-inf'::double when l_orderkey % 14 = 8 and l_returnflag = 'R' then 'nan'::double when l_orderkey % 14 = 0 then l_extendedprice * (1 + 1e-4)
  when l_orderkey % 14 = 9 and l_returnflag = 'A' then l_extendedprice * 1.2::double else l_extendedprice end as got from lineitem),
z as (select *, case when isfinite(got) then got else 0 end as x, case when isfinite(want) then want else 0 end as y from a)"""
_DISTANCE = "case when sum(y * y) < 1e-12 then 0 else 1 - 2 * sum(x * y) / sum(x * x + y * y) end"

TEXTS = {
    "trial_grid": "select task, agent, cast(attempt as bigint) as attempt from (values ('retrieval'), ('attention')) t(task) cross join (values ('a'), ('b'), ('c')) a(agent) cross join (values (1), (2), (3)) n(attempt)",
    "ab_order": "select run, case when run % 2 = 0 then 'baseline' else 'candidate' end as first from (select distinct user_id % 9 as run from events) t",
}


def reward_clip(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(reward(F.col("value") / 100), 6).alias("reward"))


QUERIES = {k: query(k, v) for k, v in TEXTS.items()} | {f.__name__: f for f in (
    report_flatten, coverage_check, evidence_gate, protocol_gate, median_rate, paired_ratio, block_timing, reward_throughput, reward_subset, reward_clip, failure_class, scored_gate, distinct_gate,
    case_grid, filter_case, seed_derive, valid_counts, capacity_round, roofline, allclose_compare, cos_diff, argmax_error, bitwise_equal)}
ORACLES = TEXTS | {
    "report_flatten": f"{_CELLS} select e.suite, e.role, e.run, e.name, e.n * 1024 as peak, round(t.seconds, 9) as seconds, case when t.name is null then 0 else 3 end as checks from e left join t on (t.suite, t.role, t.run, t.name) = (e.suite, e.role, e.run, e.name)",
    "coverage_check": f"{_SETS} select suite, role, count(*) as runs, (count(*) = 9)::int as nine, sum(23 - names)::bigint as missing, 0::bigint as extra from per group by suite, role",
    "evidence_gate": f"{_CELLS} select suite, role, count(*) as items, count(*) filter (where not ok) as failed from e group by suite, role",
    "protocol_gate": f"{_CELLS} select suite, role, run, coalesce(what, 'valid') as verdict from t",
    "median_rate": f"{_SETS} select suite, role, runs, coalesce(error, 'none') as error, case when error is null then round(med, 9) end as median_seconds, case when error is null then round(384 / med, 4) end as rate, case when error is null then round({_IDEAL} / med, 9) end as efficiency from r",
    "paired_ratio": f"{_CELLS} select a.suite, a.run, round(a.seconds / b.seconds, 9) as ratio, case when a.run % 2 = 0 then 'baseline' else 'candidate' end as first from t a join t b on a.suite = b.suite and a.run = b.run and a.role = 'baseline' and b.role = 'candidate'",
    "block_timing": f"{_CELLS} select suite, role, round(avg(seconds * calls / case when what = 'protocol' then 1 else 128 end), 9) as per_call, max(n) * 1024 as peak, round(max(seconds * calls / (n / 8)), 9) as share from t group by suite, role",
    "reward_throughput": f"{_SETS}, {_PAIRS} select suite, case when nb or be is not null then 'evaluator' when nc or ce is not null then 'candidate' else 'complete' end as outcome, case when nb or be is not null then null when nc or ce is not null then 0 else 1 end as valid, case when nb or be is not null then null when nc or ce is not null then 0 else round({_CLIP.replace('b.med / c.med', 'ratio')}, 6) end as reward, case when not nb and not nc and be is null and ce is null then round(ratio, 6) end as ratio from p",
    "reward_subset": f"""{_CELLS}, v as (select g.suite, {_SIDE.replace('role =', 'g.role =')} as role, count(*) as runs, count(*) filter (where t.name is null or not t.ok or t.what is not null) as bad from g left join t on t.suite = g.suite and t.run = g.run and t.role = {_SIDE.replace('role =', 'g.role =')} group by 1, 2)
select s.suite, case when b.suite is null or b.runs <> 9 or b.bad > 0 then 'evaluator' when c.suite is null or c.runs <> 9 or c.bad > 0 then 'candidate' else 'complete' end as outcome, case when b.suite is null or b.runs <> 9 or b.bad > 0 then null else 0 end as valid, case when b.suite is null or b.runs <> 9 or b.bad > 0 then null else 0.0::double end as reward
from (select distinct suite from g) s left join v b on b.suite = s.suite and b.role = 'baseline' left join v c on c.suite = s.suite and c.role = 'candidate'""",
    "reward_clip": "select event_id, round(least(1, greatest(0, (value / 100 - 0.01::double) / 0.98::double)), 6) as reward from events",
    "failure_class": "select event_id, case event_id % 5 when 4 then 'complete' when 1 then case when user_id % 4 = 0 then 'evaluator' else 'candidate' end when 3 then case when user_id % 4 = 0 then 'evaluator' else 'candidate' end else 'evaluator' end as outcome from events",
    "scored_gate": f"with {_CASES} select count(*) as scored, min(name) as name, (count(*) = 1)::int as valid from c where throughput_weight > 0",
    "distinct_gate": f"with {_G} select suite, {_SIDE} as role, count(distinct run) as seeds, (count(distinct run) = 9)::int as valid from g group by all",
    "case_grid": f"with {_CASES} select c.*  exclude (k2, p2, m2), (select string_agg(concat_ws('/', nominal, topk, page, masked), '+' order by scope_id) from o where o.case_id = c.case_id) as scopes from c",
    "filter_case": "select 'roofline-b128-q3-h128-k1152-c32768' as name, 128 as batch, 128 as heads",
    "seed_derive": f"with {_CASES} select name, case_id, 771731 + case_id * 100003 as seed from c where case_id < 14",
    "valid_counts": f"""with {_PROFILE} select name, scope_id, batch_id, length, selected, array_to_string(list_transform(range(0, queries), lambda q: case when scored = 0 and batch_id = 2 and q = 1 then 0
  else least(greatest(case when sliding = 1 and scope_id = 0 then length - queries + q + 1 else length end, 0), topk, coalesce(selected, topk)) end), ',') as valid from l""",
    "capacity_round": f"with {_PROFILE} select name, scope_id, greatest(1, ceil(max(length) / (4 * page)))::bigint * 4 * page as capacity, batch * (greatest(1, ceil(max(length) / (4 * page)))::bigint * 4 * page) // page as pages, ceil(page * 584 / 576)::bigint * 576 as stride from l group by name, scope_id, page, batch",
    "roofline": f"""with {_CASES}, x as (select name, batch::bigint * queries as tokens, batch, queries, heads, sinks, sum(topk) as sel, sum(topk) + case when sliding = 1 then queries - 1 else 0 end as u from c join o using (case_id) group by name, batch, queries, heads, sinks, sliding),
y as (select name, 4 * tokens * heads * sel * 512 as flops, batch * u * 584 as kv_bytes, tokens * heads * 2052 + tokens * sel * 4 + sinks * heads * 4 + batch * u * 584 / 128 as bytes, tokens from x),
z as (select *, flops / 2.25e15 as cs, bytes / 8e12 as ms from y)
select name, flops::bigint as flops, kv_bytes::bigint as kv_bytes, round(bytes, 3) as bytes, round(cs * 1e6, 6) as compute_seconds, round(ms * 1e6, 6) as memory_seconds, round(greatest(cs, ms) * 1e6, 6) as ideal_seconds, round(tokens / greatest(cs, ms), 3) as rate, case when cs >= ms then 'compute' else 'memory' end as limited_by from z""",
    "allclose_compare": f"""with {_ANSWERS}, f as (select l_returnflag, count(*) as elements, count(*) filter (where isnan(got) <> isnan(want)) as nan_mismatch, count(*) filter (where (got = 'inf'::double) <> (want = 'inf'::double)) as inf_mismatch, count(*) filter (where (got = '-inf'::double) <> (want = '-inf'::double)) as neg_inf_mismatch, 0::bigint as unpaired,
  count(*) filter (where not (abs(x - y) < 1e-3 or abs(x - y) / (abs(y) + 1e-6) < 2.01::double / 128)) as outside, coalesce(max(abs(got - want)) filter (where isfinite(got) and isfinite(want)), 0) as max_absolute, {_DISTANCE} as distance from z group by l_returnflag)
select l_returnflag, elements, nan_mismatch, inf_mismatch, neg_inf_mismatch, unpaired, outside, round(max_absolute, 4) as max_absolute, round(distance, 9) as distance, (nan_mismatch + inf_mismatch + neg_inf_mismatch + outside = 0 and abs(distance) <= 5e-6)::int as passed from f""",
    "cos_diff": f"with {_ANSWERS} select l_returnflag, round({_DISTANCE}, 9) as distance from z group by l_returnflag",
    "argmax_error": f"with {_ANSWERS}, w as (select *, row_number() over (partition by l_returnflag order by abs(x - y) desc, l_orderkey, l_linenumber) as n from z) select l_returnflag, l_orderkey, l_linenumber, l_orderkey // 64 as line, l_orderkey % 64 as place from w where n = 1",
    "bitwise_equal": f"with {_ANSWERS} select l_returnflag, count(*) filter (where isnan(got) or isnan(want) or got <> want) as mismatches from z group by l_returnflag",
}

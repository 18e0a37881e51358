"""Gates for the reports of benchmark runs, and what they are worth: each report is judged in its row, a set of nine then
gives a median, a rate and a reward or the first thing wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import roofline
from .ranking import BEST_RATIO, reward

# Fixed values.
RUNS, TIMED, WARMUP, SNAPSHOTS = 9, 128, 32, 3
_N = "map<string,struct<max_absolute:double,distance:double,passed:boolean>>"
_ITEM = f"struct<numerical:{_N},same_storage:{_N},seconds:double,block_seconds:double,timed_calls:int,warmup_calls:int,distinct_queries:int,snapshot_copies:int,timed_output_checks:map<string,{_N}>>"
REPORT = f"torch string, gpu string, seed bigint, peak_gpu_bytes bigint, workload_seconds double, cases map<string,{_ITEM}>"


def parsed(reports: DataFrame, text: str = "json") -> DataFrame:
    """The JSON text as a struct `report`; a malformed one is an error."""
    return reports.withColumn("report", F.from_json(text, REPORT, {"mode": "FAILFAST"})).drop(text)


def flat(reports: DataFrame) -> DataFrame:
    """A row for each report and case, the other columns of the report with it."""
    return reports.select("*", F.explode("report.cases").alias("name", "item")).drop("report")


def evidence(n: Column) -> Column:
    """Whether output and lse, and nothing else, are there and have passed."""
    keys = F.array_sort(F.map_keys(n)) == F.array(F.lit("lse"), F.lit("output"))
    return F.coalesce(keys & F.forall(F.map_values(n), lambda x: x.passed.eqNullSafe(True)), F.lit(False))


def protocol(item: Column) -> Column:
    """What is wrong with a timed item, first things first; null if nothing."""
    same = item.timed_calls.eqNullSafe(TIMED) & item.warmup_calls.eqNullSafe(WARMUP) & item.distinct_queries.eqNullSafe(TIMED) & item.snapshot_copies.eqNullSafe(SNAPSHOTS)
    checks = F.coalesce(item.timed_output_checks, F.create_map().cast(f"map<string,{_N}>"))
    keys = F.map_keys(checks)
    sampled = (F.size(keys) == SNAPSHOTS) & F.array_contains(keys, str(TIMED - 1))
    in_range = F.forall(keys, lambda k: k.rlike("^[0-9]+$") & F.coalesce(F.try_to_number(k, F.lit("9" * 30)) < TIMED, F.lit(False)))
    s, b = item.seconds, F.coalesce(item.block_seconds, F.lit(0.0))
    timed = F.coalesce(~F.isnan(s) & (F.abs(s) < float("inf")) & (s > 0), F.lit(False))
    close = F.abs(b - s * TIMED) <= 1e-9 * F.greatest(F.abs(b), F.abs(s * TIMED))
    gates = {"protocol": same, "samples": sampled, "index": in_range, "sample evidence": F.forall(F.map_values(checks), evidence), "seconds": timed, "block": close}
    return F.coalesce(*(F.when(~ok, F.lit(name)) for name, ok in gates.items()))


def manifest(cases: DataFrame) -> DataFrame:
    """One row of a list of cases: names, whether they are unique, scored (names of weight above 0), and of the scored case
    the tokens of a call."""
    scored = F.col("throughput_weight") > 0
    return cases.groupBy().agg(F.collect_set("name").alias("names"), (F.count("*") == F.count_distinct("name")).alias("distinct_names"), F.collect_list(F.when(scored, F.col("name"))).alias("scored_names"), F.max(F.when(scored, F.col("batch") * F.col("queries"))).alias("tokens"))


def measured(reports: DataFrame, cases: DataFrame, by: list[str], diagnostic_only: bool = False) -> DataFrame:
    """reports (by, run, report) -> by, runs, error (null if all is well), median_seconds, rate, efficiency.

    Errors in order: the cases, the number of runs, the scored case; then run by run coverage and evidence; then run by run
    the timed item. Without a scored case, which only a diagnostic may lack, there is no rate. A set of which no report
    exists has no row."""
    r = reports.crossJoin(F.broadcast(manifest(cases)))
    got = F.map_keys("report.cases")
    covered = (F.size(F.array_except("names", got)) == 0) & (F.size(F.array_except(got, "names")) == 0)
    sound = F.forall(F.map_values("report.cases"), lambda i: evidence(i.numerical) & evidence(i.same_storage))
    item = F.try_element_at("report.cases", F.get("scored_names", 0))
    first = F.when(~F.coalesce(covered, F.lit(False)), "coverage").when(~F.coalesce(sound, F.lit(False)), "evidence")
    late = F.when(F.size("scored_names") > 0, protocol(item))
    wrong = F.when(first.isNotNull(), F.struct(F.lit(0).alias("phase"), F.col("run"), first.alias("what"))).when(late.isNotNull(), F.struct(F.lit(1).alias("phase"), F.col("run"), late.alias("what")))
    r = r.select(*by, "run", "names", "distinct_names", "scored_names", "tokens", wrong.alias("wrong"), item.seconds.alias("seconds"))
    g = r.groupBy(*by).agg(F.count("*").alias("runs"), F.min("wrong").alias("wrong"), F.median("seconds").alias("median_seconds"), *(F.first(c).alias(c) for c in ("names", "distinct_names", "scored_names", "tokens")))
    n = F.size("scored_names")
    error = F.when((F.size("names") == 0) | ~F.col("distinct_names"), "cases").when(F.col("runs") != RUNS, "runs").when(~((n == 1) | (F.lit(diagnostic_only) & (n == 0))), "scored").otherwise(F.col("wrong.what"))
    ideal = roofline(cases.where("throughput_weight > 0")).groupBy().agg(F.max("ideal_seconds").alias("ideal"))
    g = g.withColumn("error", error).crossJoin(F.broadcast(ideal))
    good = F.col("error").isNull()
    return g.select(*by, "runs", "error", F.when(good, F.col("median_seconds")).alias("median_seconds"), F.when(good, F.col("tokens") / F.col("median_seconds")).alias("rate"), F.when(good, F.col("ideal") / F.col("median_seconds")).alias("efficiency"))


def paired(measures: DataFrame, by: list[str], subset: bool = False) -> DataFrame:
    """measures with a column role (baseline, candidate) -> by, outcome, valid, reward, ratio, baseline_rate, candidate_rate.

    Three outcomes: scored; invalid (the candidate's fault: valid 0, reward 0); failure (the evaluator's: no reward at all). A
    subset of the cases never scores."""
    side = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    g = measures.groupBy(*by).agg(*(side(role, c).alias(f"{role}_{c}") for role in ("baseline", "candidate") for c in ("rate", "error")), *(F.count_if(F.col("role") == role).alias(f"{role}_sets") for role in ("baseline", "candidate")))
    phase = F.when((F.col("baseline_sets") == 0) | F.col("baseline_error").isNotNull(), "baseline").when((F.col("candidate_sets") == 0) | F.col("candidate_error").isNotNull(), "candidate").otherwise("complete")
    g = g.withColumn("phase", phase).withColumn("ratio", F.when(F.col("phase") == "complete", F.col("candidate_rate") / F.col("baseline_rate")))
    scored = (F.col("phase") == "complete") & ~F.lit(subset)
    value = F.when(scored, reward((F.col("ratio") - 1) / (BEST_RATIO - 1))).when(F.col("phase") != "baseline", F.lit(0.0))
    return g.select(*by, failure(F.col("phase"), F.lit(False)).alias("outcome"), F.when(F.col("phase") != "baseline", scored.cast("int")).alias("valid"), value.alias("reward"), "ratio", "baseline_rate", "candidate_rate")


def failure(phase: Column, os_error: Column) -> Column:
    """Whose failure an end in this phase is: the candidate's in its own phases, unless the system failed; else the evaluator's."""
    return F.when(phase == "complete", "complete").when(phase.isin("build", "candidate") & ~os_error, "candidate").otherwise("evaluator")

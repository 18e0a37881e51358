"""Every query with SQL gives what its SQL gives, at the smallest scale; and properties that SQL does not show."""

import hashlib
import json
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions.vectors import e8m0, fp8_e4m3
from sparkloom.operators import compare, gates, paged, profiles, ranking
from sparkloom.plans import attention
from sparkloom.plans.sqlplans import TABLES
from sparkloom.sources import files, tables

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    def cell(x):
        if pd.isna(x):
            return "null"
        return repr(round(float(x), 6) + 0.0) if isinstance(x, (int, float)) or hasattr(x, "dtype") or type(x).__name__ == "Decimal" else str(x)
    return sorted(tuple(map(cell, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_top_k_ties_go_to_the_smaller_id(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<float>")
    p = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 1, 5)], "vec_id long, v array<float>")
    assert [(r.vec_id, r["rank"]) for r in ranking.top_k(q, p, 2).orderBy("rank").collect()] == [(3, 1), (5, 2)]


def test_top_k_asks_more_queries_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST", 3)
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "query_id long, q array<float>")
    p = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "vec_id long, v array<float>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in ranking.top_k(q, p, 2).collect()}
    assert got == {(i, n + 1, v) for i in range(1, 10) for n, v in enumerate([v for v in range(9, -1, -1) if v != i][:2])} | {(0, 1, 1), (0, 2, 2)}


def test_unranked_support_gains_nothing(spark):
    ranked = spark.createDataFrame([(1, 10, 1)], "query_id long, vec_id long, rank int")
    sup = spark.createDataFrame([(1, 0, 10), (1, 0, 11)], "query_id long, kind int, vec_id long")
    got = ranking.ndcg(ranked, sup).first()
    assert got.ndcg == pytest.approx(1 / ranking.IDEAL) and got.both_at_2 == 0


def test_fp8_and_scale(spark):
    b = spark.range(256).select("id", fp8_e4m3(F.col("id").cast("int")).alias("v"), e8m0(F.col("id").cast("int")).alias("s")).orderBy("id").collect()
    assert b[0x7E].v == 448 and b[0x7F].v != b[0x7F].v and b[0x38].v == 1 and b[1].v == 2.0**-9 and b[0x80].v == 0
    assert b[127].s == 1 and b[255].s != b[255].s


def test_reward_ends(spark):
    x = spark.createDataFrame([(-1.0,), (0.01,), (0.5,), (2.0,)], "p double").select(ranking.reward(F.col("p")).alias("r")).collect()
    assert [round(r.r, 6) for r in x] == [0.0, 0.0, 0.5, 1.0]


def test_json_sink_refuses_non_finite_numbers(spark, tmp_path):
    with pytest.raises(Exception, match="non-finite"):
        tables.write_json(spark.createDataFrame([(float("inf"),)], "x double"), str(tmp_path / "a"))
    tables.write_json(spark.createDataFrame([(1.5,)], "x double"), str(tmp_path / "b"))
    assert tables.json_lines(spark, str(tmp_path / "b"), "x double").first().x == 1.5


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"x": 1}\n{"x": \n')
    with pytest.raises(Exception):
        tables.json_lines(spark, str(tmp_path / "x.json"), "x int").collect()


def test_archive_keeps_runs_apart(spark, tmp_path):
    """What is kept is frozen with its hashes; the status ends as finished or as error, and errors are not swallowed."""
    src, root, latest = tmp_path / "src", tmp_path / "runs", tmp_path / "latest"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("x")
    (src / "sub" / "b.txt").write_text("y")
    (src / "c.pyc").write_text("z")
    with files.RunArchive(spark, str(root), str(latest)) as run:
        kept = run.keep(str(src), "source")
        (src / "a.txt").write_text("changed")
    about = json.loads((latest / "checkpoint.json").read_text())
    assert about["status"] == "finished" and (kept / "a.txt").read_text() == "x"
    assert about["artifacts"]["source"]["sha256"] == {"a.txt": hashlib.sha256(b"x").hexdigest(), "sub/b.txt": hashlib.sha256(b"y").hexdigest()}
    with pytest.raises(KeyError), files.RunArchive(spark, str(root), str(latest)):
        raise KeyError("x")
    assert json.loads((latest / "checkpoint.json").read_text())["status"] == "error" and len(list(root.iterdir())) == 2
    with pytest.raises(ValueError):
        files.RunArchive(spark, str(root), str(root / "x"))


def test_files(spark, tmp_path):
    f = tmp_path / "w"
    f.write_bytes(b"12345")
    assert files.regular(str(f), 5) == str(f)
    (tmp_path / "link").symlink_to(f)
    for path, most in ((str(f), 4), (str(tmp_path / "link"), 9), (str(tmp_path), 9)):
        with pytest.raises(ValueError):
            files.regular(path, most)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x-1.whl").write_text("a")
    assert files.only(spark, str(tmp_path / "d"), "x-*.whl").endswith("x-1.whl")
    (tmp_path / "d" / "x-2.whl").write_text("a")
    with pytest.raises(ValueError):
        files.only(spark, str(tmp_path / "d"), "x-*.whl")
    t = spark.createDataFrame([("a", "x")], "name string, content string")
    good = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest())], "name string, sha256 string")
    assert files.pinned(t, good).count() == 1
    for lock in (good.where("false"), good.withColumn("sha256", F.lit("0"))):
        with pytest.raises(Exception, match="corrupt"):
            files.pinned(t, lock).collect()
    lines = spark.createDataFrame([("a: 1",), ("a: 2",), ("b: 3",)], "line string")
    assert files.after_prefix(lines, "b: ").first().value == "3"
    for prefix in ("a: ", "c: "):
        with pytest.raises(Exception, match="expected one line"):
            files.after_prefix(lines, prefix).collect()
    texts = ["", "abc", "aéb", "é" * 5, "x日本語", "🙂🙂"]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *(files.tail(F.col("t"), n).alias(f"t{n}") for n in (1, 2, 3, 5))).collect()
    for r in got:
        for n in (1, 2, 3, 5):
            assert r[f"t{n}"].replace("\ufffd", "") == r.t.encode()[-n:].decode(errors="ignore")
    assert spark.createDataFrame([("a=1\nb=x=y\nc\nd=",)], "t string").select(files.key_values(F.col("t")).alias("m")).first().m == {"a": "1", "b": "x=y", "d": ""}
    p = spark.createDataFrame([(x,) for x in ("a/b.pyc", "a/__pycache__/x", "a/b.py", "pyc")], "p string")
    assert [r.p for r in p.where(~files.excluded(F.col("p"), ("*.pyc", "__pycache__"))).collect()] == ["a/b.py", "pyc"]
    files.reward_document(str(tmp_path / "r"), {"valid": 1})
    with pytest.raises(ValueError):
        files.reward_document(str(tmp_path / "r"), {"reward": float("nan")})
    assert not (tmp_path / "r").exists()
    files.log_line(spark, str(tmp_path / "log"), spark.createDataFrame([("TERM", 7, ["a", "b"])], "signal string, pid int, args array<string>"))
    files.log_line(spark, str(tmp_path / "log"), spark.createDataFrame([("KILL", 8, ["c"])], "signal string, pid int, args array<string>"))
    assert sorted(r.value[20:] for r in spark.read.text(str(tmp_path / "log")).collect()) == [" SIGKILL 8 c", " SIGTERM 7 a b"]
    (tmp_path / "job.yaml").write_text("n_attempts: 3\ntasks:\n  - path: a\n  - path: b\nagents:\n  - name: x\n")
    assert files.trials(spark, files.descriptor(str(tmp_path / "job.yaml"))).count() == 6


def test_process_table(spark, tmp_path):
    for pid, stat, cmd, threads in ((1, "1 (init) S 0", b"init\0", 1), (5, "5 (sh) S 1", b"sh\0-c\0sleep infinity\0", 1), (6, "6 (sleep) S 5", b"sleep\0infinity\0", 1), (7, "7 (a) b) S 1", b"a\0x y\0", 1), (8, "8 (z) Z 1", b"", 1), (9, "9 (z) Z 1", b"", 2), (10, "10 (me) S 7", b"me\0", 1)):
        d = tmp_path / str(pid)
        (d / "task").mkdir(parents=True)
        for t in range(threads):
            (d / "task" / str(t)).mkdir()
        (d / "stat").write_text(stat + " 0 0")
        (d / "cmdline").write_bytes(cmd)
    p = files.processes(spark, str(tmp_path))
    assert p.where("pid = 7").first().args == ["a", "x y"]
    assert sorted(r.pid for r in files.targets(p, spark.createDataFrame([(10,)], "pid int")).collect()) == [7, 9]


def test_tensor_containers(spark):
    def file(tensors: dict) -> bytes:
        head, data = {}, b""
        for name, (kind, shape, raw) in tensors.items():
            head[name] = {"dtype": kind, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
            data += raw
        text = json.dumps(head).encode()
        return len(text).to_bytes(8, "little") + text + data

    good = file({"a": ("F32", [2, 1], np.array([1, np.inf], "<f4").tobytes()), "b": ("F16", [3], np.zeros(3, "<f2").tobytes()), "c": ("BF16", [1], b"\xc0\x7f")})
    t = files.tensors(spark.createDataFrame([("p", good)], "path string, content binary"))
    assert {(r["name"], tuple(r["shape"]), r["nonfinite"]) for r in t.collect()} == {("a", (2, 1), 1), ("b", (3,), 0), ("c", (1,), 1)}
    want = spark.createDataFrame([("a", [2, 1]), ("b", [4]), ("d", [1])], "name string, shape array<bigint>")
    assert dict(files.weights_faults(t, want).collect()) == {"a": "not finite", "b": "shape", "c": "extra", "d": "missing"}
    for bad in (good[:-1], file({"a": ("I8", [1], b"x")}), file({"a": ("F32", [2], b"1234")})):
        with pytest.raises(Exception):
            files.tensors(spark.createDataFrame([("p", bad)], "path string, content binary")).collect()


def _attention(q, v, sink):
    """By the definition, one query: logits over the records, their softmax, the sink."""
    if not len(v):
        return np.inf, np.zeros(512)
    x = v @ q * 512.0**-0.55
    lse = x.max() + np.log(np.exp(x - x.max()).sum())
    with np.errstate(over="ignore"):
        return lse, np.exp(x - lse) @ v * (1 if sink is None else 1 / (1 + np.exp(sink - lse)))


@pytest.mark.parametrize("share", [65_536, 2])
def test_attention_by_its_definition(spark, monkeypatch, share):
    """Rows of many and of no records, all kinds of sinks; a row dealt to several tasks."""
    monkeypatch.setattr(paged, "SHARE", share)
    rng = np.random.default_rng(3)
    sinks = {1: None, 2: float("inf"), 3: float("-inf"), 4: 0.5}
    recs, qs = {}, {(r, h): rng.uniform(-1, 1, 512) for r in sinks for h in (0, 1)}
    for i in range(20):
        low, high = rng.integers(0, 120, 448).astype(np.uint8), (rng.integers(0x3F00, 0x3F80, 64)).astype("<u2")
        recs[i] = (1 + i % 3, low.tobytes() + high.tobytes(), bytes([118, 119, 120, 121, 122, 123, 124, 255]))
    records = spark.createDataFrame([(r, i, bytearray(a), bytearray(b)) for i, (r, a, b) in recs.items()], "row_id long, id long, rec binary, scale binary")
    queries = spark.createDataFrame([(r, h, q.tolist()) for (r, h), q in qs.items()], "row_id long, head int, q array<double>")
    gates_ = spark.createDataFrame([(r, h, s) for r, s in sinks.items() for h in (0, 1)], "row_id long, head int, sink double")
    got = {(r.row_id, r["head"]): (r.lse, np.array(r.output)) for r in paged.attend(records, queries, gates_).collect()}
    for (r, h), q in qs.items():
        v = paged.decode(pa.array([x[1] for x in recs.values() if x[0] == r], pa.binary()), pa.array([x[2] for x in recs.values() if x[0] == r], pa.binary())) if r < 4 else np.zeros((0, 512))
        lse, out = _attention(q, v, sinks[r])
        assert got[r, h][0] == pytest.approx(lse) and np.allclose(got[r, h][1], out)
    assert paged.scores(records, queries).count() == 40
    bad = records.withColumn("scale", F.unhex(F.lit("ff" * 8)))
    with pytest.raises(Exception, match="not finite"):
        paged.attend(bad, queries).collect()


def test_pages_hold_records_then_scales(spark):
    rows = [(0, 1, b"a" * 576, b"s" * 8), (1, 0, b"b" * 576, b"t" * 8)]
    p = paged.pages(spark.createDataFrame([(a, b, bytearray(c), bytearray(d)) for a, b, c, d in rows], "page long, slot long, rec binary, scale binary"), 2)
    assert {r.page: len(r.data) for r in p.collect()} == {0: 1168, 1: 1168}
    index = spark.createDataFrame([(0, 1), (1, 2), (2, -1), (3, 1)], "pos int, idx long")
    assert {(r.pos, bytes(r.rec[:1]), bytes(r.scale[:1])) for r in paged.gather(index, p, 2).collect()} == {(0, b"a", b"s"), (1, b"b", b"t"), (3, b"a", b"s")}


def test_decoding():
    v = paged.decode(pa.array([bytes(range(256)) + bytes(192) + b"\x80\x3f" + bytes(126)], pa.binary()), pa.array([bytes([127] * 3 + [255] + [128] * 4)], pa.binary()))[0]
    assert v[0x38] == 1 and v[0x7E] == 448 and np.isnan(v[0x7F]) and v[0x80] == 0 and v[0xB8] == -1 and np.isnan(v[200]) and v[448] == 1 and v[449] == 0


def _n(ok=True):
    return {"output": {"passed": ok, "max_absolute": 0, "distance": 0}, "lse": {"passed": True, "max_absolute": 0, "distance": 0}}


def _runs(names, scored, seconds=0.001):
    out = []
    for run in range(9):
        cases = {}
        for name in names:
            cases[name] = {"numerical": _n(), "same_storage": _n()}
            if name == scored:
                cases[name] |= {"seconds": seconds, "block_seconds": seconds * 128, "timed_calls": 128, "warmup_calls": 32, "distinct_queries": 128, "snapshot_copies": 3, "timed_output_checks": {k: _n() for k in ("0", "64", "127")}}
        out.append({"torch": "t", "gpu": "g", "seed": run, "peak_gpu_bytes": 1, "workload_seconds": 1.0, "cases": cases})
    return out


def _set(where, change):
    def do(runs):
        at = runs
        for k in where[:-1]:
            at = at[k]
        if change is None:
            del at[where[-1]]
        else:
            at[where[-1]] = change
    return do


_S = profiles.SCORED
_BROKEN = {
    "seconds": [_set((0, "cases", _S, "seconds"), x) for x in (0, -1, float("nan"), float("inf"))],
    "protocol": [_set((3, "cases", _S, k), v) for k, v in (("timed_calls", 1), ("warmup_calls", 0), ("distinct_queries", 1), ("snapshot_copies", 0), ("timed_calls", None))],
    "samples": [_set((0, "cases", _S, "timed_output_checks"), x) for x in ({}, {"0": _n(), "1": _n(), "2": _n()})],
    "index": [_set((0, "cases", _S, "timed_output_checks"), x) for x in ({"0": _n(), "x": _n(), "127": _n()}, {"0": _n(), "128": _n(), "127": _n()}, {"-1": _n(), "1": _n(), "127": _n()})],
    "sample evidence": [_set((0, "cases", _S, "timed_output_checks", "127", "lse", "passed"), False)],
    "block": [_set((0, "cases", _S, "block_seconds"), x) for x in (1, None)],
    "coverage": [_set((0, "cases", "production-1-b2-q1"), None), _set((8, "cases", "long-h64"), None), _set((0, "cases", _S), None), _set((0, "cases", "other"), {"numerical": _n(), "same_storage": _n()})],
    "evidence": [_set((2, "cases", "production-1-b2-q1", k), x) for k in ("numerical", "same_storage") for x in (_n(False), {"output": _n()["output"]}, _n() | {"x": _n()["lse"]})] + [_set((2, "cases", _S, "numerical", "lse", "passed"), None)],
    "runs": [lambda r: r.pop(), lambda r: r.append(r[0])],
}


def test_gates_reject_what_is_wrong(spark):
    """A good set of reports, and each of its mutations by the first gate that must find it."""
    cases = profiles.cases(spark)
    names = [r["name"] for r in cases.select("name").collect()]
    rows, want = [], {}
    for what, changes in [("none", [lambda r: None]), *_BROKEN.items()]:
        for i, change in enumerate(changes):
            runs = _runs(names, _S)
            change(runs)
            want[f"{what}-{i}"] = what
            rows += [(f"{what}-{i}", run, json.dumps(doc)) for run, doc in enumerate(runs)]
    reports = gates.parsed(spark.createDataFrame(rows, "suite string, run int, json string"))
    got = {r.suite: r for r in gates.measured(reports, cases, ["suite"]).collect()}
    assert {k: r.error or "none" for k, r in got.items()} == want
    assert got["none-0"].rate == pytest.approx(384_000) and got["block-0"].rate is None
    ideal = {r["name"]: r for r in profiles.roofline(cases).collect()}[_S]
    assert (ideal.flops, ideal.kv_bytes, ideal.bytes, ideal.limited_by) == (4 * 384 * 128 * 1152 * 512, 128 * 1154 * 584, 103_303_824, "compute")
    assert got["none-0"].efficiency == pytest.approx(ideal.ideal_seconds / 0.001)
    for some, error in ((cases.where("false"), "cases"), (cases.union(cases), "cases"), (cases.where("throughput_weight = 0"), "scored")):
        assert gates.measured(reports.where("suite = 'none-0'"), some, ["suite"]).first().error == error
    slow = _runs(names, _S)
    slow[0]["cases"][_S] |= {"seconds": 999.0, "block_seconds": 999.0 * 128}
    r = gates.parsed(spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(slow)], "suite string, run int, json string"))
    assert gates.measured(r, cases, ["suite"]).first().median_seconds == 0.001
    with pytest.raises(Exception):
        gates.parsed(spark.createDataFrame([("s", 0, '{"cases": ')], "suite string, run int, json string")).collect()


def test_rewards_have_three_outcomes(spark):
    rows = [("scored", "baseline", 100.0, None), ("scored", "candidate", 120.0, None), ("bad", "baseline", 100.0, None), ("bad", "candidate", None, "block"), ("ours", "baseline", None, "runs"), ("ours", "candidate", 100.0, None), ("gone", "candidate", 1.0, None)]
    m = spark.createDataFrame(rows, "suite string, role string, rate double, error string")
    got = {r.suite: (r.outcome, r.valid, r.reward) for r in gates.paired(m, ["suite"]).collect()}
    p = (0.2 / 0.3515515495176977 - 0.01) / 0.98
    assert got == {"scored": ("complete", 1, pytest.approx(p)), "bad": ("candidate", 0, 0.0), "ours": ("evaluator", None, None), "gone": ("evaluator", None, None)}
    assert {r.suite: (r.valid, r.reward) for r in gates.paired(m, ["suite"], subset=True).collect()}["scored"] == (0, 0.0)


def test_allclose_masks_and_distance(spark):
    nan, inf = float("nan"), float("inf")
    sets = {"same": ([1.0, nan, inf, -inf], [1.0, nan, inf, -inf], True), "near": ([1.0, 100.01], [1.0, 100.0], True), "far": ([1.0, 2.0], [1.0, 3.0], False), "nan": ([nan, 1.0], [1.0, 1.0], False), "sign": ([inf], [-inf], False),
            "turned": ([1.004] * 500, [1.0] * 500, False), "short": ([1.0], [1.0, 2.0], False), "empty": ([0.0], [0.0], True)}
    frame = lambda k: spark.createDataFrame([(n, i, x) for n, s in sets.items() for i, x in enumerate(s[k])], "n string, i int, v double")
    got = {r.n: r.passed for r in compare.allclose(frame(0), frame(1), ["n", "i"], "v", ["n"], (1e-3, 0.01, 5e-6)).collect()}
    assert got == {n: s[2] for n, s in sets.items()}
    assert {r.n: r.mismatches for r in compare.unequal(frame(0), frame(1), ["n", "i"], "v", ["n"]).collect()}["same"] == 1


def test_new_values_give_new_answers(spark):
    """The same places with other values: nothing of the first answer is left."""
    q = spark.createDataFrame([(1, 0, [1.0] * 512)], "row_id long, head int, q array<double>")
    at = lambda b: spark.createDataFrame([(1, 1, bytearray([b] * 448 + [0] * 128), bytearray([127] * 8))], "row_id long, id long, rec binary, scale binary")
    a, b = (paged.attend(at(x), q).first().output[0] for x in (0x38, 0x40))
    assert (a, b) == (1.0, 2.0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_records_of_one_file_are_made_in_many_tasks(spark, tmp_path):
    """A file of one row group is one task; the digests are not made there. They are as the SQL says, for a null id too."""
    pd.DataFrame({"event_id": pd.array([*range(40), None], "Int64")}).to_parquet(tmp_path / "events.parquet")
    got = attention.records(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 4 and len({r.p for r in got.select(F.spark_partition_id().alias("p")).collect()}) > 1
    for r in got.collect():
        h = "".join(hashlib.md5(f"{'' if r.event_id is None else r.event_id}:{k}".encode()).hexdigest() for k in range(37))
        high = "".join(h[896 + 4 * j : 898 + 4 * j] + ("3f" if h[898 + 4 * j] < "8" else "bf") for j in range(64))
        assert bytes(r.rec).hex() == h[:896].replace("f", "e") + high
        assert bytes(r.scale).hex() == "".join(f"7{int(x, 16) % 8}" for x in h[1152:1160])


def test_sums_of_spans(spark):
    one = spark.createDataFrame([(1, bytearray(b"\x38" * 448 + b"\x80\x3f" * 64), bytearray([127, 128, 127, 127, 127, 127, 127, 0]))], "k int, rec binary, scale binary")
    assert tuple(paged.sums(one, ["k"], {"a": (0, 448), "b": (448, 512), "c": (64, 65)}).first()) == (1, 512.0, 64.0, 2.0)


def test_attention_merges_whole_vectors(spark):
    """Vectors are merged as such, not exploded to a row a dimension; queries without records, also of a null row, stay."""
    records = spark.createDataFrame([(1, i, bytearray([0x38] * 448 + [0] * 128), bytearray([127] * 8)) for i in range(3)], "row_id long, id long, rec binary, scale binary")
    q = spark.createDataFrame([(r, h, [1.0] * 512) for r in (1, 2, None) for h in (0, 1)], "row_id long, head int, q array<double>")
    out = paged.attend(records, q)
    assert dict(out.dtypes) == {"row_id": "bigint", "head": "int", "lse": "double", "output": "array<double>"}
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.row_id, r["head"], round(r.output[0], 9), r.output[511], np.isinf(r.lse)) for r in out.collect()} == {(r, h, float(r == 1), 0.0, r != 1) for r in (1, 2, None) for h in (0, 1)}


def test_bucket3_of_odd_values(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    values = [None, nan, inf, -inf, 0.0, -0.0, 25.0, np.nextafter(25, 0), 75.0, np.nextafter(75, 99), 1e308, 5e-324]
    pa.parquet.write_table(pa.table({"event_id": pa.array([None, *range(1, len(values))], pa.int64()), "value": pa.array(values, pa.float64())}), tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert rows(catalog.QUERIES["bucket3"](spark, str(tmp_path)).toPandas()) == rows(c.execute(catalog.ORACLES["bucket3"]).df())


def test_records_are_not_broadcast(spark):
    for made in (attention._tokens, attention.paged_gather):
        plan = made(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in next(x for x in plan.splitlines() if "Join" in x)

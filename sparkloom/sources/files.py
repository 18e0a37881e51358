"""Files: a tensor container, checked and pinned files, tails, lines of metadata, process tables, run archives, logs."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import shutil
import tomllib
import uuid
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
LARGEST, TAIL, MARKERS = 32_000_000, 12_000, ("error", "failed:", "killed", "undefined reference")
_WIDTH = {"F32": 4, "F16": 2, "BF16": 2}


def tensors(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, name, shape, dtype, nonfinite: the tensors of containers that begin with the length of a
    JSON header, eight bytes, and the header; its offsets count from its end. A container that does not hold what its header
    says is an error."""

    def values(kind: str, raw: bytes) -> np.ndarray:
        if kind == "BF16":
            return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        return np.frombuffer(raw, {"F32": "<f4", "F16": "<f2"}[kind])

    def work(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = int.from_bytes(content[:8], "little")
                header = json.loads(content[8 : 8 + n])
                for name, t in sorted(header.items()):
                    if name == "__metadata__":
                        continue
                    lo, hi = t["data_offsets"]
                    raw = content[8 + n + lo : 8 + n + hi]
                    if t["dtype"] not in _WIDTH or len(raw) != hi - lo or len(raw) != _WIDTH[t["dtype"]] * int(np.prod(t["shape"], dtype=np.int64)):
                        raise ValueError(f"{path}: {name} is not what the header says")
                    rows.append((path, name, t["shape"], t["dtype"], int(np.count_nonzero(~np.isfinite(values(t["dtype"], raw))))))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.int64()), strict=True)], ["path", "name", "shape", "dtype", "nonfinite"])

    return files.select("path", "content").mapInArrow(work, "path string, name string, shape array<bigint>, dtype string, nonfinite bigint")


def weights_faults(tensors: DataFrame, wanted: DataFrame) -> DataFrame:
    """tensors and wanted (name, shape) -> name, fault: names that one side lacks, shapes that differ, types beyond the three
    float ones, values that are not finite. No row: the weights are valid."""
    t = tensors.select("name", "shape", "dtype", "nonfinite", F.lit(True).alias("here"))
    j = t.join(wanted.select("name", F.col("shape").alias("want"), F.lit(True).alias("there")), "name", "full")
    fault = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "extra").when(F.col("shape") != F.col("want"), "shape").when(~F.col("dtype").isin(*_WIDTH), "dtype").when(F.col("nonfinite") > 0, "not finite")
    return j.select("name", fault.alias("fault")).where("fault is not null")


def regular(path: str, largest: int = LARGEST) -> str:
    """The path of a local file, if it is a regular one, no link, and not above the size."""
    s = os.lstat(path)
    if not (os.path.isfile(path) and not os.path.islink(path) and s.st_size <= largest):
        raise ValueError(f"{path}: not a regular file of at most {largest} bytes")
    return path


def pinned(files: DataFrame, lock: DataFrame) -> DataFrame:
    """files (name, content), lock (name, sha256) -> the files, whose hashes must be the lock's: a file that differs, or that no
    lock names, is an error."""
    j = files.join(lock.select("name", F.col("sha256").alias("__want")), "name", "left")
    ok = F.coalesce(F.sha2("content", 256) == F.col("__want"), F.lit(False))
    return j.withColumn("content", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("corrupt pinned file: "), "name")).cast(dict(files.dtypes)["content"]))).drop("__want")


def only(spark: SparkSession, folder: str, glob: str) -> str:
    """The one file below folder that the pattern takes; none, or several, is an error."""
    found = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path").limit(2).collect())
    if len(found) != 1:
        raise ValueError(f"expected one {glob}, got {found}")
    return found[0]


def after_prefix(lines: DataFrame, prefix: str, column: str = "line") -> DataFrame:
    """One row: what follows the prefix in the one line that begins with it; none, or several, is an error."""
    hit = lines.where(F.col(column).startswith(prefix)).groupBy().agg(F.count("*").alias("n"), F.max(F.substr(column, F.lit(len(prefix) + 1))).alias("value"))
    return hit.select(F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.format_string("expected one line, got %d", "n")).cast("string")).alias("value"))


def key_values(text: Column) -> Column:
    """The lines name=value of a text as a map; a value may hold further signs of equality."""
    pairs = F.transform(F.filter(F.split(text, "\n"), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.instr(x, "=") + 1).alias("v")))
    return F.map_from_entries(pairs)


def tail(text: Column, n: int = TAIL) -> Column:
    """The last n bytes of a text; bytes of a cut character become replacement signs."""
    raw = F.encode(text, "UTF-8")
    cut = F.substr(raw, F.greatest(F.length(raw) - n + 1, F.lit(1)), F.lit(n))
    # it may begin within a character
    lead = lambda i: F.conv(F.hex(F.substr(cut, F.lit(i), F.lit(1))), 16, 10).cast("int").between(128, 191)
    inside = F.when(F.length(raw) <= n, 0).when(lead(1) & lead(2) & lead(3), 3).when(lead(1) & lead(2), 2).when(lead(1), 1).otherwise(0)
    return F.concat(F.repeat(F.lit("�"), inside), F.decode(F.substr(cut, inside + 1, F.length(cut)), "UTF-8"))


def marked(log: Column, markers: tuple[str, ...] = MARKERS, most: int = 8000, last: int = 4000) -> Column:
    """The lines that hold a marker, whatever their case, cut to `most` characters, and the log's last ones."""
    lines = F.filter(F.split(log, "\n"), lambda x: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(x), m)))
    return F.concat(F.left(F.array_join(lines, "\n"), F.lit(most)), F.lit("\n"), F.right(log, F.lit(last)))


def processes(spark: SparkSession, root: str = "/proc") -> DataFrame:
    """pid, parent, state, args, n_threads of the processes below root, read on the driver; one that ends meanwhile is left
    out. The state stands after the last bracket of a name that may hold brackets itself."""
    rows = []
    for p in Path(root).glob("[0-9]*"):
        try:
            stat = (p / "stat").read_text(errors="replace").rpartition(") ")[2].split()
            raw = (p / "cmdline").read_bytes()
            args = raw.removesuffix(b"\0").decode(errors="replace").split("\0") if raw else []
            rows.append((int(p.name), int(stat[1]), stat[0], args, len(list((p / "task").iterdir())) if (p / "task").is_dir() else 1))
        except OSError:
            continue
    return spark.createDataFrame(rows, "pid int, parent int, state string, args array<string>, n_threads int")


def targets(table: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Of a process table, what may be stopped: not process 1, not the ancestors (pid), not the keepalive below process 1 or
    its sleeping child, no dead process of one thread."""
    keep = F.array(F.lit("sh"), F.lit("-c"), F.lit("sleep infinity"))
    top = table.where((F.col("args") == keep) & ((F.col("parent") == 1) | (F.col("pid") == 1))).select(F.col("pid").alias("top"))
    asleep = table.where(F.col("args") == F.array(F.lit("sleep"), F.lit("infinity"))).join(top, F.col("parent") == F.col("top"), "left_semi")
    spared = ancestors.select("pid").union(top.select("top")).union(asleep.select("pid"))
    return table.where("pid <> 1 and (state <> 'Z' or n_threads > 1)").join(spared, "pid", "left_anti")


def excluded(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a pattern takes the whole path or a name in it; exclusion wins over all else."""
    out = F.lit(False)
    for g in globs:
        pattern = fnmatch.translate(g).replace("(?s:", "").removesuffix(")\\z").removesuffix(")\\Z")
        out = out | path.rlike(f"(?s)(^|/)(?:{pattern})(/|$)")
    return out


def descriptor(path: str) -> dict:
    """A TOML document, or the plain two-level subset of YAML that job descriptors use."""
    text = Path(path).read_text()
    if path.endswith(".toml"):
        return tomllib.loads(text)
    out: dict = {}
    at: list | None = None
    for line in text.splitlines():
        if m := re.match(r"(\w+):\s*(.*)$", line):
            name, value = m.groups()
            out[name] = int(value) if value.isdigit() else value or []
            at = out[name] if not value else None
        elif (m := re.match(r"\s+- (?:\w+: )?(.+)$", line)) and at is not None:
            at.append(m[1])
    return out


def trials(spark: SparkSession, job: dict) -> DataFrame:
    """task, agent, attempt: every task with every agent, n_attempts times."""
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    return one("task", job["tasks"]).crossJoin(one("agent", job["agents"])).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(int(job["n_attempts"])))))


def reward_document(path: str, outcome: dict | None) -> None:
    """Delete the document at path; write the new one unless there is none, as after the evaluator's own failure. A number that
    is not finite is an error, and no document."""
    Path(path).unlink(missing_ok=True)
    if outcome is not None:
        Path(path).write_text(json.dumps(outcome, allow_nan=False))


def log_line(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append (signal, pid, args) as lines: time in UTC, signal, process, arguments."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows.select(F.concat_ws(" ", now, F.concat(F.lit("SIG"), "signal"), F.col("pid").cast("string"), F.array_join("args", " ")).alias("value")).write.mode("append").text(path)


class RunArchive:
    """A run's folder of its own below root, never written by another run: what is kept, its hashes, and a status that ends as
    finished or error; a copy of the status stands at `latest`."""

    def __init__(self, spark: SparkSession, root: str, latest: str):
        if Path(latest).resolve() == Path(root).resolve() or Path(root).resolve() in Path(latest).resolve().parents or Path(latest).resolve() in Path(root).resolve().parents:
            raise ValueError("the latest view must be outside the archive")
        self.spark, self.latest = spark, Path(latest)
        self.id = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
        self.path = Path(root) / self.id
        self.path.mkdir(parents=True)
        self.about = {"schema_version": 1, "run_id": self.id, "status": "running", "archive": str(self.path), "artifacts": {}}
        self._write()

    def _write(self) -> None:
        self.latest.mkdir(parents=True, exist_ok=True)
        for folder in (self.path, self.latest):
            (folder / "checkpoint.json").write_text(json.dumps(self.about, allow_nan=False))

    def keep(self, source: str, name: str, exclude: tuple[str, ...] = ("__pycache__", "*.pyc")) -> Path:
        """Copy a file or folder; the hashes, by path relative to the copy, go into the status."""
        target = self.path / name
        if Path(source).is_dir():
            shutil.copytree(source, target, ignore=shutil.ignore_patterns(*exclude))
        else:
            shutil.copyfile(source, target)
        self.about["artifacts"][name] = {"path": str(target), "sha256": hash_map(self.spark, str(target))}
        self._write()
        return target

    def __enter__(self) -> RunArchive:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.about["status"] = "error" if kind else "finished"
        if kind:
            self.about["error"] = f"{kind.__name__}: {error}"
        self._write()
        return False


def hash_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Relative path to SHA-256 of the files at path, a few artifacts, sorted."""
    root = Path(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root)).select("path", F.sha2("content", 256).alias("h"))
    rel = F.regexp_replace("path", "^file:/+", "/")
    base = str(root.resolve()) + "/" if root.is_dir() else str(root.resolve().parent) + "/"
    m = files.select(F.substr(rel, F.lit(len(base) + 1)).alias("p"), "h").groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "h")))).alias("m")).first()["m"]
    return dict(sorted((m or {}).items()))

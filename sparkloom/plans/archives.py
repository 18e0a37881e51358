"""Records, logs, hashes and process trees: JSON fields, key=value lines, markers, tails, manifests, globs, ancestors, tensor
containers."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files, tables
from ..sources.tables import table
from .sqlplans import query

#: The users as a tree: the parent of each is half of it.
_TREE = "p as (select distinct user_id as pid, cast(floor(user_id / 2e0) as bigint) as parent from events)"
TEXTS = {
    "hash_manifest": "select source, count(*) as files, min(sha2(text, 256)) as first_hash from documents group by source",
    "hash_verify": "select a.doc_id, case when a.h = b.h then 1 else 0 end as valid from (select doc_id, sha2(text, 256) as h from documents) a join (select doc_id, sha2(case when doc_id % 50 = 0 then concat(text, '!') else text end, 256) as h from documents) b on a.doc_id = b.doc_id",
    "keyset_equal": "select coalesce(a.k, b.k) as k, case when a.k is null then 'extra' else 'missing' end as side from (select c_custkey as k from customer) a full outer join (select distinct o_custkey as k from orders) b on a.k = b.k where a.k is null or b.k is null",
    "tree_ancestors": f"with recursive {_TREE}, a(pid, parent, depth) as (select max(pid), cast(floor(max(pid) / 2e0) as bigint), 0 from p union all select p.pid, p.parent, depth + 1 from a join p on p.pid = a.parent where a.parent > 0) select pid, parent, depth from a",
}


def scan_jsonl_props(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"].alias("k"))


def props_merge(spark, d) -> DataFrame:
    """One map over another: keys of the second win."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("a"), F.create_map(F.lit("seen"), F.lit(1).cast("long"), F.when(F.col("event_id") % 3 == 0, "k").otherwise("other"), F.lit(-1).cast("long")).alias("b"))
    m = F.map_zip_with("a", "b", lambda k, x, y: F.coalesce(y, x))
    return e.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat(x.key, F.lit("="), x.value))), ",").alias("merged"))


def run_stamp(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


def kv_parse(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("id="), "event_id", F.lit("\nkind=a="), "event_type", F.lit("\nempty=")).alias("text"))
    return e.select("event_id", F.explode(files.key_values(F.col("text"))).alias("name", "value"))


def prefix_extract_one(spark, d) -> DataFrame:
    first = F.col("event_id") == F.lit(7)
    lines = table(spark, d, "events").select(F.concat(F.when(first, "saved: ").otherwise("other: "), "event_id").alias("line"))
    return files.after_prefix(lines, "saved: ")


def tail_text(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.right("text", F.lit(14_000)).alias("chars"), files.tail(F.col("text")).alias("bytes"))


def pinned_scan(spark, d) -> DataFrame:
    """All texts by their pinned hashes: a text that its hash does not fit would end the query."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    return files.pinned(t, t.select("name", F.sha2("content", 256).alias("sha256")).distinct()).select("name", F.length("content").alias("size"))


def glob_exclude(spark, d) -> DataFrame:
    return table(spark, d, "pages").where(~files.excluded(F.col("url"), ("1*", "*.pyc"))).select("page_id", "url")


def assert_schema_constants(spark, d) -> DataFrame:
    """A document of five numbers, which must be these, or the query ends."""
    doc = table(spark, d, "nation").groupBy().agg(F.to_json(F.struct(F.count("*").alias("n"), F.min("n_nationkey").alias("lo"), F.max("n_nationkey").alias("hi"), F.count_distinct("n_regionkey").alias("regions"), F.max("n_regionkey").alias("last"))).alias("json"))
    c = doc.select(F.from_json("json", "n int, lo int, hi int, regions int, last int", {"mode": "FAILFAST"}).alias("c")).select("c.*")
    ok = F.struct("n", "lo", "hi", "regions", "last") == F.struct(*(F.lit(x).alias(n) for x, n in zip((25, 0, 24, 5, 4), ("n", "lo", "hi", "regions", "last"), strict=True)))
    return c.select(*(F.when(ok, F.col(n)).otherwise(F.raise_error(F.lit("unexpected configuration")).cast("int")).alias(n) for n in c.columns))


def token_truncate(spark, d) -> DataFrame:
    cut = lambda c, n: F.array_join(F.slice(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""), 1, n), " ")
    a = table(spark, d, "documents").select(F.lit("query").alias("kind"), F.col("doc_id").alias("id"), cut("text", 64).alias("tokens"))
    return a.unionByName(table(spark, d, "pages").select(F.lit("document").alias("kind"), F.col("page_id").alias("id"), cut("html", 256).alias("tokens")))


def log_markers(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", files.marked(F.col("text"), (*files.MARKERS, "the")).alias("excerpt"))


def _tree(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("pid")).distinct()
    args = F.when(F.col("pid") == 3, F.array(F.lit("sh"), F.lit("-c"), F.lit("sleep infinity"))).when(F.col("pid") % 3 == 0, F.array(F.lit("sleep"), F.lit("infinity"))).otherwise(F.array(F.lit("python"), F.col("pid").cast("string")))
    return e.select("pid", F.when(F.col("pid") == 3, 1).otherwise(F.expr("pid div 2")).alias("parent"), F.when(F.col("pid") % 11 == 0, "Z").otherwise("S").alias("state"), args.alias("args"), (F.col("pid") % 2 + 1).alias("n_threads"))


def tree_targets(spark, d) -> DataFrame:
    return files.targets(_tree(spark, d), QUERIES["tree_ancestors"](spark, d)).select("pid", "parent", "state")


def finite_guard(spark, d) -> DataFrame:
    e = tables.finite_guard(table(spark, d, "embeddings"))
    return e.select("vec_id", F.size("embedding").alias("width"))


def _containers(spark, d) -> DataFrame:
    """A container for each vector, of one tensor; every seventh in half precision, one in five with a value that is not
    finite."""

    def work(batches):
        for batch in batches:
            path, content = [], []
            for i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.array(v, "<f2" if i % 7 == 0 else "<f4")
                if i % 5 == 0:
                    x[0] = np.nan
                head = json.dumps({"__metadata__": {"format": "np"}, f"v{i}": {"dtype": "F16" if i % 7 == 0 else "F32", "shape": [1, len(x)], "data_offsets": [0, x.nbytes]}}).encode()
                path.append(f"{i}.tensors")
                content.append(len(head).to_bytes(8, "little") + head + x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(content, pa.binary())], ["path", "content"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(work, "path string, content binary")


def tensor_scan(spark, d) -> DataFrame:
    return files.tensors(_containers(spark, d)).select("path", "name", F.array_join("shape", ",").alias("shape"), "dtype", "nonfinite")


def weights_gate(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    want = e.where("vec_id % 13 <> 0").select(F.concat(F.lit("v"), "vec_id").alias("name"), F.when(F.col("label") == 3, F.array(F.lit(64), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(64))).cast("array<bigint>").alias("shape"))
    want = want.unionByName(e.where("vec_id % 50 = 0").select(F.concat(F.lit("w"), "vec_id").alias("name"), F.array(F.lit(1)).cast("array<bigint>").alias("shape")))
    return files.weights_faults(files.tensors(_containers(spark, d)), want)


QUERIES = {k: query(k, v) for k, v in TEXTS.items()} | {f.__name__: f for f in (scan_jsonl_props, props_merge, run_stamp, kv_parse, prefix_extract_one, tail_text, pinned_scan, glob_exclude, assert_schema_constants, token_truncate, log_markers, tree_targets, finite_guard, tensor_scan, weights_gate)}
_WORDS = "array_to_string(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda y: y <> '')[1:{}], ' ')"
ORACLES = TEXTS | {
    "scan_jsonl_props": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "props_merge": "select event_id, case when event_id % 3 = 0 then 'k=-1,seen=1' else concat('k=', json_extract_string(props, '$.k'), ',other=-1,seen=1') end as merged from events",
    "run_stamp": "select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp from events",
    "kv_parse": "select event_id, 'id' as name, event_id::varchar as value from events union all select event_id, 'kind', 'a=' || event_type from events union all select event_id, 'empty', '' from events",
    "prefix_extract_one": "select event_id::varchar as value from events where event_id = 7",
    "tail_text": """with c as (select doc_id, text, unnest(range(1, length(text) + 1)) as i from documents where strlen(text) > 12000), b as (select doc_id, i, text, sum(strlen(text[i])) over (partition by doc_id order by i desc) as s from c),
k as (select doc_id, max(s) as s, count(*) as n from b where s <= 12000 group by doc_id)
select d.doc_id, right(text, 14000) as chars, case when k.n is null then text else repeat('�', (12000 - k.s)::bigint) || right(text, k.n) end as bytes from documents d left join k on k.doc_id = d.doc_id""",
    "pinned_scan": "select doc_id::varchar as name, length(text)::int as size from documents",
    "glob_exclude": "select page_id, url from pages where not (url like '%/1%' or url like '1%' or url like '%.pyc' or url like '%.pyc/%')",
    "hash_manifest": TEXTS["hash_manifest"].replace("sha2(text, 256)", "sha256(text)"),
    "hash_verify": "select a.doc_id, case when a.doc_id % 50 = 0 then 0 else 1 end as valid from documents a",
    "assert_schema_constants": "select 25 as n, 0 as lo, 24 as hi, 5 as regions, 4 as last",
    "finite_guard": "select vec_id, len(embedding)::int as width from embeddings",
    "token_truncate": f"select 'query' as kind, doc_id as id, {_WORDS.format('text', 64)} as tokens from documents union all select 'document', page_id, {_WORDS.format('html', 256)} from pages",
    "log_markers": "select doc_id, left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the') or contains(lower(x), 'error') or contains(lower(x), 'failed:') or contains(lower(x), 'killed') or contains(lower(x), 'undefined reference')), chr(10)), 8000) || chr(10) || right(text, 4000) as excerpt from documents",
    "tree_targets": """with recursive u as (select distinct user_id as pid from events), p as (select pid, case when pid = 3 then 1 else pid // 2 end as parent, case when pid % 11 = 0 then 'Z' else 'S' end as state from u),
a(pid, parent) as (select max(pid), max(pid) // 2 from u union all select u.pid, u.pid // 2 from a join u on u.pid = a.parent where a.parent > 0)
select pid, parent, state from p where pid <> 1 and pid <> 3 and not (state = 'Z' and pid % 2 = 0) and pid not in (select pid from a) and not (pid % 3 = 0 and parent = 3 and exists (select 1 from u where pid = 3))""",
    "tensor_scan": "select vec_id || '.tensors' as path, 'v' || vec_id as name, '1,64' as shape, case when vec_id % 7 = 0 then 'F16' else 'F32' end as dtype, case when vec_id % 5 = 0 then 1 else 0 end::bigint as nonfinite from embeddings",
    "weights_gate": "select 'v' || vec_id as name, case when vec_id % 13 = 0 then 'extra' when label = 3 then 'shape' else 'not finite' end as fault from embeddings where vec_id % 13 = 0 or label = 3 or vec_id % 5 = 0 union all select 'w' || vec_id, 'missing' from embeddings where vec_id % 50 = 0",
}

"""The operators for training data against brute force on small fixtures with nulls, empty and long texts, repeated rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import _io, bpe, components, embedding_dedup, exact_topk, language, mixing, ngram_join, pii, repeats, substring_dedup, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, extra int, `__row` string"


def corpus() -> list:
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, out = text(120), []
    for i in range(40):
        out.append(text(rng.choice([0, 1, 3, 30, 150, 400])))
        if i % 4 == 0:
            out[-1] = f"{out[-1]}\n{shared} {text(5)}"
    base = text(200)
    for i in range(12):
        words = base.split()
        for _ in range(i):
            words[rng.randrange(200)] = "changed"
        out.append(" ".join(words).upper() if i == 3 else " ".join(words))
    out += [base, base, None, "", " \n\t ", "word", "a a a a " * 60, text(4000), " x  one two three", "Word"]
    return [(i, t, ["a", "b", None][i % 3] if i % 2 else "hot", "en", 1, "x") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def brute_bytes(rows):
    texts, seen, out = [(r[0], (r[1] or "").encode()) for r in rows], Counter(), {}
    for _, t in texts:
        seen.update(t[k : k + 400] for k in range(len(t) - 399))
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        out[i] = (len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])), sha(bytes(b for b, g in zip(t, gone) if not g)))
    return out


def brute_words(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        ws = WORD.findall(t or "")
        gone = [False] * len(ws)
        for k in range(len(ws) - 19):
            w = tuple(ws[k : k + 20])
            if w in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(w)
        out[i] = (len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g).encode()))
    return out


def test_suffix_dedup(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, digest=True).collect()}
    assert got == brute_bytes(rows)


def test_substring_dedup(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs, digest=True).collect()}
    assert got == brute_words(rows)


@pytest.mark.parametrize(("s", "kernel", "order", "module"), [(suffix_dedup.SYMBOLS, suffix_dedup.kernel, False, suffix_dedup), (substring_dedup.SYMBOLS, substring_dedup.kernel, True, substring_dedup)])
def test_groups_above_the_bound_give_the_same(docs, s, kernel, order, module):
    """The way for hot groups, taken for all of more than one stretch, against the kernel's."""
    size = F.expr("aggregate(spans, 0L, (n, x) -> n + (x & 1048575))")
    few, many = (repeats.repeated(docs, s, kernel, order, most=m).select("d", "t", size.alias("n")).orderBy("d", "t").collect() for m in (0, 4000))
    assert few == many and few


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_strings_that_rolling_hashes_confuse(spark):
    """Thue-Morse strings and their complements agree under polynomials modulo 2**64: as words, as runs of words, as bytes."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    runs = [" ".join(x[:512]) for x in (a, b)]
    texts = [f"{a} {rest}", f"{b} {rest}", *runs, a + a, b + b, f"x{a[:800]}", f"y{b[:800]}", f"z{a[:800]}"]
    rows = [(i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(d).collect()} == brute_join(rows)[0]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(d, digest=True).collect()} == brute_words(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(d, digest=True).collect()} == brute_bytes(rows)


def test_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, with other texts: each is judged by its own text."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    x, y, z = text(120), text(120), text(120)
    rows = [(None, x), (None, y), (None, f"{z} {x}"), (7, y), (7, z), (7, z), (None, None), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(d, digest=True).collect())
    want = brute_bytes([(k, t) for k, (_, t) in enumerate(rows)])
    assert got == sorted((a, b, h) for a, b, _, h in want.values())
    words = {}
    for r in substring_dedup.dedup(d, digest=True).collect():
        words.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    # of rows without an id, one document at the end of the order, x starts earlier alone than after z
    assert sorted(words[None]) == [(0, 0), (120, 0), (120, 120), (240, 240)]
    assert sorted(words[7]) == [(120, 0), (120, 0), (120, 0)]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(d).collect()} >= {(7, 116, 7), (8, 0, 8), (None, 0, None), (None, 116, 7)}


def brute_join(rows) -> tuple[dict, int]:
    sets = {}
    for i, t, *_ in rows:
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} if ws else set()
    up = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    return {i: (len(s), up[i]) for i, s in sets.items()}, len(links)


def test_ngram_join(docs, rows):
    want, links = brute_join(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert got == want and links > 10


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_near_the_threshold(spark, monkeypatch, small):
    """Families whose members are about 0.8 like each other, some above and some below; with small bounds, in many cells."""
    rng = random.Random(9)
    families = [[f"f{f}w{k}" for k in range(rng.choice([12, 60, 130, 300]))] for f in range(6)]
    rows = []
    for base in families:
        for _ in range(35):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words[rng.randrange(3) :])))
    if small:
        for name, value in (("CELL", 4000), ("ROOM", 20_000), ("PAIRS", 5), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(ngram_join, name, value)
    want, links = brute_join(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and links > 500 and len({c for _, c in want.values()}) > 12


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components(spark, monkeypatch, few):
    """A chain, a pair, a loop and a null end; by contraction alone, and in one task."""
    monkeypatch.setattr(components, "FEW", few)
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = dict(components.components(e).collect())
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert components.components(e.where("false")).count() == 0


def test_bpe_equals_library_on_characters_new_to_python():
    """Every character of the first three planes that Python's tables do not know, and as many others."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        coder, library = bpe.Coder(bpe.Model(f.read())), Tokenizer.from_file(path)
    new = [c for c in range(0x30000) if bpe.unknown(chr(c)) and library.normalizer.normalize_str(chr(c)) != chr(c) or c in (0x558, 0x1C89, 0xA7CB)]
    some = new + random.Random(1).sample([c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000], 5000)
    texts = [f"ab{chr(c)}cd {chr(c)} x{chr(c)}{chr(c)}, Z{chr(c)}1" for c in some]
    ids, offs = coder.run(texts)
    assert len(new) > 20
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, hex(some[k])


def test_bpe_equals_library(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    more = [(1000, "Hi<|endoftext|>there <|startoftext|> I'LL don't ''s 's's x'S"), (1001, "ΑΣ Σ İ ñ ñ ẛ̣ 12³ ½ 漢字 🎉!?\x1c\x85."), (None, "a" * 3000)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {r[0]: r[1] for r in [*rows, *more]}
    for r in bpe.encode(d, path).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), t.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("bucket", [2000, 3])
def test_mix(spark, docs, monkeypatch, bucket):
    """Targets and totals, positions as one running sum over all, the same from other partitions; repeats and nulls."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    d = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    d = d.union(spark.createDataFrame([(500, "z", 10, 1), (500, "z", 10, 2), (None, "z", None, 3)], "doc_id long, source string, size long, tie long"))
    q = mixing.queues(d).toPandas()
    again = mixing.queues(d.repartition(7)).toPandas()
    key = ["source", "doc_id", "size", "tie", "copy"]
    assert q.sort_values(key, na_position="last").reset_index(drop=True).equals(again.sort_values(key, na_position="last").reset_index(drop=True)[q.columns])
    ranked = q[q.finish.notna()].sort_values("position")
    assert (ranked.position.to_numpy() == ranked["size"].cumsum().to_numpy()).all() and ranked.finish.is_monotonic_increasing
    assert (ranked.taken == (ranked.position <= 1.5 * d.toPandas()["size"].fillna(0).sum())).all()
    per = q[q.taken].groupby("source", dropna=False).agg(taken=("size", "sum"), target=("target", "first"), source_size=("source_size", "first"))
    assert (per.taken <= per.target + q["size"].max()).all() and (per.taken >= per.target - q["size"].max()).all()
    assert (per.target <= 2 * per.source_size + 1e-6).all() and per.target.sum() == pytest.approx(1.5 * per.source_size.sum())
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs.where("false")).count() == 0


def test_mix_in_small_plans(spark, docs, monkeypatch):
    """No plan holds all steps, whose text, renewed after each stage, filled the driver; of the tables between only one stays."""
    before, plans, stash = set(_io._stashed), [], mixing.stash
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    monkeypatch.setattr(mixing, "stash", lambda df: plans.append(exchanges(df)) or stash(df))
    plans.append(exchanges(mixing.mix(docs)))
    assert plans[-1] == 1  # texts are dealt out once
    assert max(plans) <= 8 and len(set(_io._stashed) - before) == 1


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x = np.concatenate([x, x[:40] + 0.1 * rng.standard_normal((40, 16)), np.repeat(x[:1], 70, 0) + 0.05 * rng.standard_normal((70, 16)), x[5:8], x[5:6]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [])]
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * s.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 905))
    assert got[len(x) - 1].component_id == got[5].component_id


def test_embedding_cluster_chain_and_pairs(spark, monkeypatch):
    """A dense cluster, a chain whose ends are far apart and pairs, by descent: all links counted, lists bounded."""
    monkeypatch.setattr(embedding_dedup, "LINKED", 60)
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    cluster = unit(unit(rng.standard_normal(32)) + 0.03 * rng.standard_normal((500, 32)))
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    t = np.arange(40)[:, None] * 0.35
    chain = np.cos(t) * a + np.sin(t) * b
    base = unit(rng.standard_normal((300, 32)))
    pairs = unit(base[:120] + 0.06 * rng.standard_normal((120, 32)))
    x = np.concatenate([cluster, chain, base, pairs])
    held = []
    lists = embedding_dedup._lists
    monkeypatch.setattr(embedding_dedup, "_lists", lambda p, keep: held.append((r := lists(p, keep)).count() / keep) or r)
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    s = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(s, False)
    recall = sum(got[i].n_links for i in range(len(x))) / s.sum()
    print("recall of links", recall)
    assert recall >= 0.99 and max(held) <= 2 * len(x)


def test_embedding_links_that_lists_miss_are_found(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((60, 32)), 2, 0)
    x[1::2] += 0.2 * rng.standard_normal((60, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(embedding_dedup, "_start", lambda v, *_: v.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).cast("float").alias("s")).limit(0))
    monkeypatch.setattr(embedding_dedup, "_round", lambda lists, *_: lists)
    monkeypatch.setattr(embedding_dedup, "AUDIT", 16)
    monkeypatch.setattr(embedding_dedup, "LINKED", 8)
    got = embedding_dedup.dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    s = x @ x.T >= 0.9
    assert s.sum() > 160 and {r.vec_id: r.n_links for r in got} == dict(enumerate(s.sum(1) - 1))


def test_embedding_audit_without_links_is_not_passed(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 32))
    x[[3, 400]] = x[[700, 850]] + 0.1 * rng.standard_normal((2, 32))
    monkeypatch.setattr(embedding_dedup, "_start", lambda v, *_: v.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).cast("float").alias("s")).limit(0))
    monkeypatch.setattr(embedding_dedup, "_round", lambda lists, *_: lists)
    got = embedding_dedup.dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got if r.n_links} == {3, 400, 700, 850}


def test_embedding_lists_meet_a_small_audit(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((300, 32)), 4, 0) + 0.15 * rng.standard_normal((1200, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(embedding_dedup, "AUDIT", 32)
    monkeypatch.setattr(embedding_dedup, "LINKED", 32)
    monkeypatch.setattr(embedding_dedup, "_rest", None)
    got = embedding_dedup.dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.99 * ((x @ x.T >= 0.9).sum() - 1200)


@pytest.mark.parametrize("data", [8192, 40])
def test_exact_topk(spark, monkeypatch, data):
    """Against all products in whole numbers: ties, repeated vectors and rows, huge, empty and short ones, none with a value that
    is not finite; in one block, and in many regions, of which a query visits few."""
    monkeypatch.setattr(exact_topk, "DATA", data)
    rng = np.random.default_rng(4)
    near = rng.standard_normal((6, 8)) * 40
    x = np.concatenate([rng.standard_normal((300, 8)), np.repeat(rng.standard_normal((1, 8)), 60, 0), near[rng.integers(0, 6, 300)] + rng.standard_normal((300, 8))]).astype(np.float32)
    vecs = [r.tolist() for r in x] + [[1e8, 0.0] + [0.0] * 6, [5e7, 1.0] + [0.0] * 6, [-1e30] * 8, [3e38] * 8, [2.0**40] * 8, [], [], [1.5, 2.5], [0.5, -1.0], [0.0] * 8]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(1000, None), (1020, [float("inf")] * 8), (1040, [None] * 8), (None, [1.0] * 8), (3, vecs[3])]
    got = exact_topk.top_k(exact_topk.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x"))), 7, F.col("vec_id") % 5 == 0).collect()
    ints = [[int(np.floor(np.float64(np.float32(c)) * 64)) for c in v] for v in vecs]
    want = set()
    for q in range(0, len(vecs), 5):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[j])), j) for j in range(len(vecs)) if j != q and len(vecs[j]) == len(vecs[q]))[:7]
        want |= {(q, k + 1, j, max(-(2**63), min(2**63 - 1, -s))) for k, (s, j) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_both_trees_are_pruned(monkeypatch):
    """Clusters far apart: most pairs of leaves are never multiplied."""
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((20, 16)) * 100
    x, q = (centers[rng.integers(0, 20, n)] + rng.standard_normal((n, 16)) for n in (4000, 1000))
    tree, products = exact_topk.CoverTree(x), []
    lexsort = np.lexsort
    monkeypatch.setattr(exact_topk.np, "lexsort", lambda *a, **k: products.append(1) or lexsort(*a, **k))
    best, who = exact_topk.dual_search(x, np.arange(len(x)), tree, q, 5)
    leaves = [sum(not c for c in t.children) for t in (tree, exact_topk.CoverTree(q))]
    assert len(products) < leaves[0] * leaves[1] / 5
    s = q @ x.T
    assert np.allclose(np.sort(best, 1), np.sort(s, 1)[:, -5:])


def test_pii(spark):
    rows = [(1, "ana.b12@mail7.example.com +1 (017) 555-7713 97.51.17.173 Frau Maria Meier 4111 1111 1111 1111 DE89370400440532013000"), (2, "again ana.b12@mail7.example.com, not clean: 123-45-6789"), (3, "clean text 12"), (4, None), (5, ""), (None, "Herr Meier 1.2.3.4 and 1.2.3.5"), (3, "clean text 12")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__m", F.lit(1))
    got = pii.replace(d, "k", count="n")
    out = sorted((r.doc_id or 0, r.text, r.n) for r in got.collect() if r.text)
    assert got.columns == ["doc_id", "text", "__m", "n"] and got.count() == len(rows)
    text = {i: t for i, t, _ in out}
    assert text[3] == "clean text 12" and "mail7" not in text[1] and "97.51" not in text[1] and "Meier" not in text[1] + text[0]
    mail = text[1].split()[0]
    assert re.fullmatch(r"[a-z]{3}\.[a-z]\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mail) and mail in text[2]
    digits = re.search(r"4\d{3}( \d{4}){3}", text[1])[0].replace(" ", "")
    assert sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
    iban = re.search(r"DE\d{20}", text[1])[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    many = spark.createDataFrame([(i, f"{i % 256}.{i // 256}.1.1") for i in range(3000)], "doc_id long, text string")
    made = pii.replace(many, "k").select("text").distinct()
    assert made.count() == 3000 and made.join(many, "text").count() == 0


def test_names_keep_one_surrogate_a_word(spark):
    """Over 1,000 surnames and 40 given names: a word's surrogate is one, others have others, gender and script stay, keys differ."""
    rng = random.Random(2)
    letters = "bcdfghjklmnprstvw"
    surnames = sorted({"".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(4)).capitalize() for _ in range(1000)})
    people = [("Frau", rng.choice(pii.GIVEN["f"]), x) if i % 2 else ("Herr", rng.choice(pii.GIVEN["m"]), x) for i, x in enumerate(surnames)]
    rows = [(i, f"{t} {g} {x} und {t} {x}, {'Mrs' if t == 'Herr' else 'Mr'}. {x}; {g} {x}.") for i, (t, g, x) in enumerate(people)]
    rows += [(9000, "господин Иванов"), (9001, "MR JOHN SMITH met John Smith"), (9002, "Dr. Anna Kowalska, Prof. Dr. Kowalska"), (9003, "Ms Smith-Jones")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace(d, "k1").collect()}
    word: dict = {}
    for i, (t, g, x) in enumerate(people):
        m = re.fullmatch(rf"{t} (\w+) (\w+) und {t} (\w+), (?:Mr|Mrs)\. (\w+); (\w+) (\w+)\.", got[i])
        assert m and m[2] == m[3] == m[4] == m[6] and m[1] == m[5], got[i]
        assert m[1].endswith("a") == (g in pii.GIVEN["f"])
        for a, b in ((g, m[1]), (x, m[2])):
            assert word.setdefault(a, b) == b
    assert len(set(word.values())) == len(word) and not set(word.values()) & set(word)
    assert re.fullmatch(r"господин [А-Я][а-я]+", got[9000]) and "Иванов" not in got[9000]
    m = re.fullmatch(r"MR ([A-Z]+) ([A-Z]+) met (\w+) (\w+)", got[9001])
    assert m[1] == m[3].upper() and m[2] == m[4].upper() and "SMITH" not in got[9001] and got[9003].startswith(f"Ms {m[4]}-")
    m = re.fullmatch(r"Dr\. (\w+a) (\w+), Prof\. Dr\. (\w+)", got[9002])
    assert m[2] == m[3] and "Kowalska" not in got[9002]
    other = {r.doc_id: r.text for r in pii.replace(d, "k2").collect()}
    assert all(other[i] != got[i] for i in got)
    assert {r.doc_id: r.text for r in pii.replace(d.repartition(5), "k1").collect()} == got


def test_surrogates_when_formats_are_full(spark):
    """All entities of a small format: still one to one; and phones with blanks."""
    e = spark.createDataFrame([("ip", f"{i}.{j}.1.1") for i in range(10) for j in range(10)] + [("email", f"{c}@x.com") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, entity string")
    got = pii.one_to_one(e, "k").collect()
    assert len({r.entity for r in got}) == len({r.surrogate for r in got}) == 126
    text = pii.replace(spark.createDataFrame([(1, "call 555 123 4567 or 555-123-4567")], "doc_id long, text string"), "k").first().text
    assert re.fullmatch(r"call \d{3} \d{3} \d{4} or \d{3}-\d{3}-\d{4}", text) and "123" not in text.split(" or ")[0][5:]


def test_empty_tables(spark):
    """No rows in, none out, in every operator."""
    none = spark.createDataFrame([], SCHEMA + ", lang2 string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    import public_tokenizers

    made = [suffix_dedup.dedup(none), substring_dedup.dedup(none, digest=True), ngram_join.join(none), pii.replace(none, "k"), mixing.mix(none), bpe.encode(none, public_tokenizers.path("word_bpe_49k.json")),
            toxicity.score(none, toxicity.fit(none, labels)), language.identify(none, language.learn(none)), embedding_dedup.dedup(vectors), exact_topk.top_k(exact_topk.whole(vectors), 3, F.lit(True))]
    assert [m.count() for m in made] == [0] * len(made)


def test_pipeline_stages(spark, docs, rows, tmp_path):
    """Each stage on its own input, with nulls, empty and long texts, repeats and clashing names; then the chain."""
    import corpus_pipeline as c

    labels = [(r[0], int(bool(r[1]) and "badword" in r[1])) for r in rows]
    extra = [(5000 + i, f"some badword here {i} badword", "a", "en", 1, "x") for i in range(40)] + [(None, "no id at all", "a", "en", 1, "x"), (3, rows[3][1], "b", "en", 2, "y")]
    labels += [(r[0], 1) for r in extra[:40]]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.createDataFrame(rows + extra, SCHEMA).withColumn("__gone", F.lit(7)).withColumn("n_chars", F.length("text").cast("long"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = c.not_toxic(spark, d, str(tmp_path))
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == d.columns and not left & set(range(5000, 5040)) and len(left & {r[0] for r in rows}) >= 0.95 * len(rows)
    one = c.one_of_each_group(spark, d, str(tmp_path))
    want, _ = brute_join([r for r in rows + extra[:40]])
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect())
    assert one.columns == d.columns and kept == sorted([(False, i) for i, (_, comp) in want.items() if i == comp] + [(False, 3)] * (want[3][1] == 3) + [(True, 0)])
    safe = c.without_pii(spark, d, str(tmp_path))
    assert safe.columns == d.columns and sorted((r.doc_id or -1, r.text or "") for r in safe.collect()) == sorted((r.doc_id or -1, r.text or "") for r in d.collect())
    taken = c.mixed(spark, d, str(tmp_path))
    total = sum(len(WORD.findall(r.text or "")) for r in d.collect())
    assert taken.columns == d.columns and abs(sum(len(WORD.findall(r.text or "")) for r in taken.collect()) - 1.5 * total) < 5000
    assert sorted(map(str, c.mixed(spark, d.repartition(3), "").collect())) == sorted(map(str, taken.collect()))
    assert {r.doc_id for r in c.tokens(spark, d, "").collect()} == {r.doc_id for r in d.collect()}
    out = d
    for _, stage in c.STAGES:
        out = stage(spark, out, str(tmp_path))
    assert sorted(map(str, c.run(spark, str(tmp_path)).collect())) == sorted(map(str, out.collect()))
    empty = d.where("false")
    for _, stage in c.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_language(spark):
    rng = random.Random(3)
    words = {"en": "the of and this with house".split(), "de": "der die und nicht haus ist".split(), "fr": "le la des maison est pas".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(40)), x) for i in range(150) for x in [rng.choice(["en", "de", "fr"])]]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "das haus ist nicht die maison", None), (2, None, None), (3, "123 !!", None), (4, "the house and this " * 40 + "le la des maison " * 40, None), (5, "", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    assert got[1].lang_pred == "de" and {got[i].lang_pred for i in (2, 3, 5)} == {"und"} and set(got[4].languages) == {"en", "fr"}
    empty = language.learn(spark.createDataFrame([], "text string, lang string"))
    assert language.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), empty).where("lang_pred <> 'und'").count() == 0


def naive_mixture(prob, text: str) -> np.ndarray:
    """EM by its definition, one text, one trigram after the other."""
    folded = bytes([32]) + bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()) + bytes([32])
    n = Counter(((a << 16 | b << 8 | c) * 2654435769 % 2**32) >> 16 for a, b, c in zip(folded, folded[1:], folded[2:]) if (a, b, c) != (32, 32, 32))
    total, k = sum(n.values()), prob.shape[1]

    def em(pi, steps):
        for _ in range(steps):
            new = np.zeros(k)
            for g, c in n.items():
                part = prob[g] * pi
                new += c * part / part.sum()
            pi = new / total
        return pi, sum(c * np.log((prob[g] * pi).sum()) for g, c in n.items())

    pi, _ = em(np.full(k, 1 / k), language.STEPS)
    order, best, score = np.argsort(-pi, kind="stable"), None, -np.inf
    for size in range(1, k + 1):
        if size > 1 and pi[order[size - 1]] * total < 1:
            break
        sub = np.zeros(k)
        sub[order[:size]] = np.maximum(pi[order[:size]], 1e-6)
        fit, ll = em(sub / sub.sum(), 0 if size == 1 else language.SET_STEPS)
        if (gain := ll - language.PENALTY * (size - 1) * np.log(total)) > score:
            best, score = fit, gain
    return best


def test_language_by_naive_em(spark):
    rng = random.Random(7)
    words = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(60)] for x, a in zip("pqrstu", ("abcdeg", "defghik", "ghijklm", "lmnopqr", "aeioustr", "vwxyzab"))}
    text = lambda *kinds: " ".join(rng.choice(words[rng.choice(kinds)]) for _ in range(120))
    langs, prob = language.learn(spark.createDataFrame([(text(x), x) for x in words for _ in range(8)], "text string, lang string"))
    asked = [text(*"pqrstu"[:k]) for k in range(1, 7)] + [text("u"), "ab", "É " + text("s")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), (langs, prob)).collect()}
    sizes = set()
    for i, t in enumerate(asked):
        want = naive_mixture(prob.astype(float), t)
        sizes.add(int((want > 0).sum()))
        assert got[i].lang_pred == langs[int(want.argmax())] and got[i].score == pytest.approx(want.max(), abs=2e-3)
        assert set(got[i].languages) == {langs[k] for k in np.flatnonzero(want)}
    assert max(sizes) > 4


def test_toxicity_by_naive_forward_pass(spark):
    """The network by its definition: word after word, window after window, in plain Python."""
    net = toxicity.Network(3)
    texts = ["one two three bad words", "x " * 70, " ".join(f"w{i}" for i in range(100)), "Éa, b!c", "ab"]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def naive(text: str) -> float:
        raw = np.frombuffer(text.encode(), np.uint8)
        w = toxicity.Words(raw, np.array([0, len(raw)]))
        vec, scores = net.vectors(w), []
        for win in w.windows:
            ids, hidden = win[win >= 0], {}
            for way, run in (("f", ids), ("b", ids[::-1])):
                s, states = np.zeros(toxicity.HIDDEN), []
                for t in run:
                    x, y, h = vec[t] @ net.p[f"x{way}"] + net.p[f"c{way}"], s @ net.p[f"u{way}"], toxicity.HIDDEN
                    z, r = sig(x[:h] + y[:h]), sig(x[h : 2 * h] + y[h : 2 * h])
                    c = np.tanh(x[2 * h :] + r * y[2 * h :])
                    s = (1 - z) * c + z * s
                    states.append(s)
                hidden[way] = states if way == "f" else states[::-1]
            both = np.array([np.concatenate(p) for p in zip(hidden["f"], hidden["b"], strict=True)])
            e = np.tanh(both @ net.p["a"]) @ net.p["v"]
            a = np.exp(e - e.max())
            scores.append((a / a.sum()) @ both @ net.p["o"] + net.p["k"][0])
        return float(sig(max(scores)))

    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(naive(t), abs=1e-4)


def test_queries_equal_their_sql(spark):
    """Every query of this subpackage that has SQL, on the smallest test tables."""
    import duckdb
    import pandas as pd

    from sparkloom.llm import catalog

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cell = lambda x: "null" if pd.isna(x) else repr(round(float(x), 6) + 0.0) if not isinstance(x, str) else x
    for name, sql in catalog.ORACLES.items():
        got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(sql).df()
        a, b = (sorted(tuple(map(cell, r)) for r in f[sorted(f.columns)].itertuples(index=False)) for f in (got, want))
        assert sorted(got.columns) == sorted(want.columns) and a == b, name


def test_held_out_is_crc32(spark):
    got = spark.range(50).select("id", language.held(F.col("id"), 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_toxicity(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(500):
        ws = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        if i % 3 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(ws), int(i % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(d.where("doc_id % 5 <> 0"), d.select("doc_id", "toxic"))
    got = toxicity.score(d.where("doc_id % 5 = 0"), net).toPandas()
    assert ((got.score >= 0.5) == (got.doc_id % 3 == 0)).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "..."), (4, "x " * 50000)], "doc_id long, text string")
    assert toxicity.score(odd, net).where("score between 0 and 1").count() == 4
    assert toxicity.fit(d.where("false"), d.select("doc_id", "toxic")) is None


def test_gradients():
    net, raw = toxicity.Network(1), b"some words to read again and words to forget"
    w = toxicity.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    for k, x in net.p.items():
        net.p[k] = x.astype(np.float64)
    kept = {}
    vec = net.vectors(w).astype(np.float64)
    net.forward(vec, w.windows, kept)
    grads = net.backward(w, vec, w.windows, kept, np.ones(1))
    for name, place in (("uf", (1, 3)), ("xb", (2, 20)), ("a", (0, 1)), ("o", (3,)), ("cf", (5,))):
        out = []
        for step in (1e-3, -1e-3):
            net.p[name][place] += step
            out.append(net.forward(vec, w.windows)[0])
            net.p[name][place] -= step
        assert grads[name][place] == pytest.approx((out[0] - out[1]) / 2e-3, abs=2e-3)

"""Whitening, the Merkle manifest and retrieval packing against plain versions, and on odd inputs."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lintlake.llm import merkle, retrieval_packing, whitening, wordids
from lintlake.llm.queries import QUERIES, WORD_TOKENIZER

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path(WORD_TOKENIZER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, row int, at int, key int"
VECTORS = "vec_id long, embedding array<float>, x int, n string, component int"


# Whitening


def plain_whitening(rows):
    """Eigenvectors of the covariance of the distinct integer vectors, all in one array."""
    good = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in good}), np.float64)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    order = values.argsort()[::-1]
    return good, x, values[order], axes[:, order]


def check_whitening(got, rows):
    good, x, values, axes = plain_whitening(rows)
    n, s = len(x), x.sum(axis=0).astype(int).tolist()
    want = collections.Counter((i, k, n, sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True))) for i, v in good for k in range(1, 5))
    assert collections.Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == want
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    vectors = collections.defaultdict(list)
    for i, v in good:
        vectors[i].append(np.array(v, float))
    signs = {}
    for r in got:
        k = r.component - 1
        assert abs(r.explained - values[k] / values.sum()) < 1e-12
        options = [float((v - x.mean(axis=0)) @ axes[:, k] / np.sqrt(values[k])) for v in vectors[r.vec_id]]
        near = min(options, key=lambda o, r=r: abs(abs(o) - abs(r.whitened)))
        if abs(near) > 1e-3:
            assert signs.setdefault(k, np.sign(near) * np.sign(r.whitened)) == np.sign(near) * np.sign(r.whitened)
        assert abs(abs(near) - abs(r.whitened)) < 1e-8


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op11_embedding_whitening"](spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=7) * np.arange(1, 8)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 7), (103, [float("inf")] + [0.0] * 6), (104, [-0.0] * 7)]
    rows += [rows[0], (None, rows[1][1]), *((200 + i, rows[2][1]) for i in range(40))]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    check_whitening(whitening.whiten(df).collect(), rows)
    short = spark.createDataFrame([(900, [1.0, 2.0], 1, "x", 2), (901, [], 1, "x", 2)], VECTORS)
    check_whitening(whitening.whiten(df.union(short)).collect(), rows)


def test_whitening_where_dimensions_depend_on_each_other(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-500, 500, (80, 5))
    x = np.hstack([a, a[:, :1] + a[:, 1:2], np.zeros((80, 1), int), 1000 * a[:, 2:3], a[:, :1]])
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)).collect()
    check_whitening(got, rows)
    w = whitening.fit(whitening.integer_vectors(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)).select("x").distinct())
    assert len(w.variances) == 5 and np.allclose(w.components.T @ w.components, np.eye(5))


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "x", 2), (2, [1.0, 2.0], 1, "x", 2)], VECTORS)
    assert whitening.whiten(one).count() == 0
    empty = whitening.whiten(one.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(one.limit(0).union(spark.createDataFrame([(1, None, 1, "x", 2)], VECTORS))).count() == 0


def test_a_step_makes_rows_orthonormal():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(300, 6)) * 10.0 ** np.arange(6)
    r, triangular = whitening.factor(a.T @ a, 0.0)
    assert triangular and np.allclose(np.triu(r), r)
    q = whitening.right_solve(a, r)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(6), atol=1e-6)


def test_deviation_is_exact_or_null():
    x = np.array([[3, -5], [2**40, 7], [2**62, 0]])
    assert whitening.deviations(x, 10, [11, -3]) == [(30 - 11) ** 2 + (-50 + 3) ** 2, None, None]
    assert whitening.deviations(x[:2], 1, [2**40 - 2**31, 0]) == [(3 - 2**40 + 2**31) ** 2 + 25 if (3 - 2**40 + 2**31) ** 2 + 25 < 2**63 else None, 2**62 + 49]


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, n_chars):
    doc_id, text, lang, source = row[:4]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(("-", "") if j >= len(level) else ("L" if j < i else "R", level[j]))
        i //= 2
    return out


def plain_proofs(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(row, row[4]), row))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in keys:
        groups[g].sort(key=lambda t: t[:3])
        trees[g] = plain_levels([t[2] for t in groups[g]])
    upper = plain_levels([trees[g][-1][0] for g in keys])
    out = collections.Counter()
    for g in keys:
        for i, (_, _, leaf, row) in enumerate(groups[g]):
            path = plain_path(trees[g], i) + plain_path(upper, keys.index(g))
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            end = plain_leaf(row, row[4] + 1) if hit else leaf
            for side, sibling in path:
                end = h(sibling, end) if side == "L" else h(end, sibling)
            out[row[0], leaf, trees[g][-1][0], upper[-1][0], h(*(s for _, s in path)), end, end == upper[-1][0]] += 1
    return out


def manifest(df):
    got = merkle.proofs(df, merkle.COLUMNS, "lang", "doc_id", changed=merkle.tampered(df))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return collections.Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("band", [2, 12])
def test_proofs(spark, monkeypatch, band):
    """Trees of many sizes, with bands that several levels of buckets need, and with the production one."""
    monkeypatch.setattr(merkle, "BAND", band)
    rows = []
    for g, n in (("en", 41), ("de", 16), ("", 1), (None, 5), ("é", 2), ("z", 17), ("Z", 3)):
        rows += [(1000 * len(rows) + k, f"text {k} é🙂" * (k % 3), g, None if k % 4 == 0 else "s", None if k % 5 == 0 else k) for k in range(n)]
    rows += [(7, None, "en", "s", 1), (7, "", "en", "s", 1), (7, "", "en", "s", 1), (None, "t", "en", None, 3), (None, "u" * 200_000, None, None, None)]
    df = spark.createDataFrame([(*r, "t", "d", 1, 2, 3) for r in rows], DOCS)
    got = manifest(df)
    assert got == plain_proofs(rows) and any(not r[-1] for r in got)


def test_proofs_of_small_tables(spark):
    df = spark.createDataFrame([(5, "a", None, None, None, "t", "d", 1, 2, 3)], DOCS)
    assert manifest(df.limit(0)) == {}
    assert manifest(df) == plain_proofs([(5, "a", None, None, None)])
    again = merkle.proofs(df, ["text"], "lang", "doc_id").first()
    assert again.verified and again.root == again.leaf == h("1:a")


def test_nodes_cover_their_leaves(spark):
    docs = spark.range(77).select(F.lit("t").alias("tree"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(0).alias("row"))
    nodes = merkle.nodes(merkle.ranked(docs, ["key"])).collect()
    levels = plain_levels([hashlib.sha256(str(i).encode()).hexdigest() for i in range(77)])
    want = {(level, i << level, min(77, (i + 1) << level), d) for level, row in enumerate(levels) for i, d in enumerate(row)}
    assert {(r.level, r.lo, r.hi, r.digest) for r in nodes} == want and len(nodes) == len(want)


def test_manifest_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = collections.Counter(con.sql(merkle.oracle()).fetchall())
    assert collections.Counter(map(tuple, QUERIES["op13_merkle_manifest"](spark, SF).collect())) == want


# Retrieval packing


def reference_ids(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_have_the_tokenizers_ids():
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyzABCÄÖÜéñ0123456789'.,-_") + ["'ll", "…", "日", "ß", "🙂", "́", "İ", "ǅ", "ÿ", "²", "ͅ"]
    texts = [" ".join("".join(rng.choice(letters, int(rng.integers(1, 12)))) for _ in range(40)) for _ in range(60)]
    texts += ["", " \t\r\n\x0b\x0c ", "<|endoftext|> a<|startoftext|>b", "a\x1cb c\x85d \xa0e　f", "x" * 3000, "'s don't I'LL", "é ΟΔΟΣ ẞ"]
    words = wordids.EndedWords(VOCABULARY)
    assert [np.frombuffer(x, words.dtype).tolist() for x in words(texts)] == reference_ids(texts)


def test_words_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(wordids, "MEMORY_WORDS", 3)
    words = wordids.EndedWords(VOCABULARY)
    texts = ["one two three four five one two", "six one"]
    assert [np.frombuffer(x, words.dtype).tolist() for x in words(texts)] == reference_ids(texts) and len(words.memory) <= 3


def check_packing(got, rows, window):
    """Every id of every document in exactly one piece, sequences without gaps, full or a power of two."""
    ids = [x + [2] for x in reference_ids([t or "" for _, t in rows])]
    want = collections.Counter((doc_id, tuple(x)) for (doc_id, _), x in zip(rows, ids, strict=True))
    copies = collections.defaultdict(list)
    for (doc_id, _), x in zip(rows, ids, strict=True):
        copies[doc_id, len(x)].append(x)
    tokens = collections.Counter()
    for r in got:
        options = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in copies[r.doc_id, r.doc_tokens]}
        assert r.ids_crc32 in options and r.length > 0 and r.start + r.length <= r.doc_tokens
        tokens[r.doc_id] += r.length
    assert tokens == collections.Counter({k: n for k, n in ((d, sum(len(x) * c for (e, x), c in want.items() if e == d)) for d, _ in want) if n})
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window and end & (end - 1) == 0
    return sequences


def test_packing_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(QUERIES["op12_retrieval_packing"](spark, SF).collect(), rows, 4096)


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "three"), (5, "word " * 900), (6, "x" * 20_000)] + [(10 + i, f"w{i % 3} common text") for i in range(50)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "t", "d", 1, 2, 3) for i, t in rows], DOCS).drop("lang").withColumn("ids", F.lit(1)).withColumn("lead", F.lit(1))
    check_packing(retrieval_packing.pack_documents(df, VOCABULARY, 2, 64).collect(), rows, 64)
    assert retrieval_packing.pack_documents(df.limit(0), VOCABULARY, 2).count() == 0


def test_a_shard_is_filled_with_neighbours():
    """Scores are BM25's, and a window takes the seed's own kind first."""
    rng = np.random.default_rng(2)
    ids = [np.append(rng.integers(100 * kind, 100 * kind + 30, int(rng.integers(5, 20))), 999) for kind in rng.integers(0, 4, 120)]
    holders = collections.Counter(t for x in ids for t in set(x.tolist()))
    rarity = np.array([np.log(1 + (120 - holders[t] + 0.5) / (holders[t] + 0.5)) for t in range(1000)])
    average = sum(map(len, ids)) / 120
    terms = retrieval_packing.Terms(rarity, average)
    scores = retrieval_packing.Index(ids, terms).scores(7)
    for j, x in enumerate(ids):
        tf = collections.Counter(x.tolist())
        want = sum(rarity[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / average)) for t in set(ids[7].tolist()))
        assert abs(scores[j] - want) < 1e-9
    kinds = [int(x[0]) // 100 for x in ids]
    sequences = list(retrieval_packing.fill(ids, terms, 64))
    assert sorted((d, s + k) for q in sequences for d, s, n in q for k in range(n)) == [(d, k) for d, x in enumerate(ids) for k in range(len(x))]
    same = [len({kinds[d] for d, _, _ in q}) == 1 for q in sequences if sum(n for _, _, n in q) == 64]
    assert sum(same) > 0.7 * len(same)


def test_shards_end_within_a_partition(spark, monkeypatch):
    monkeypatch.setattr(retrieval_packing, "SHARD_DOCS", 5)
    rows = [(i, f"alpha beta w{i % 7} " * (i % 9 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(retrieval_packing.pack_documents(df, VOCABULARY, 2, 32).collect(), rows, 32)

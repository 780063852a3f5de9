"""Search indexes against brute-force versions: words alike, ranked search, text vectors, vectors in blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import blocks
from tessera.operators import latent, ranked, search, typos
from tessera.plans import search_queries

DATA = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def alike(a, b, share=0.7, slack=2):
    if abs(len(a) - len(b)) > slack:
        return None
    s = 1.0 if a == b else 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b))
    return s if s >= share else None


def mistyped(rng, w, n):
    for _ in range(n):
        i = rng.randrange(len(w) + 1)
        w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]])
    return w


@pytest.mark.parametrize(("share", "slack"), [(0.7, 2), (0.8, 1), (0.6, 3)])
def test_similar_words_are_all_found(spark, share, slack):
    rng = random.Random(int(share * 100))
    base = ["".join(rng.choice("abcd") for _ in range(n)) for n in [*range(1, 30), 12, 13, 14, 15, 60, 120]]
    known = base + [mistyped(rng, rng.choice(base), rng.randrange(5)) for _ in range(80)] + ["", "a" * 40, "a" * 41, "é" * 9, None, base[3]]
    asked = base[::2] + [mistyped(rng, w, max(1, len(w) // 4)) for w in base for _ in range(2)] + ["", "a" * 42, "éé" + "e" * 7, None]
    a, k = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in (asked, known))
    want = {(x, y): s for x in set(asked) - {None} for y in set(known) - {None} if (s := alike(x, y, share, slack)) is not None}
    got = {(r.asked, r.known): r.similarity for r in typos.similar_words(a, k, share, slack).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert typos.similar_words(a.limit(0), k).count() == 0 and typos.similar_words(a, k.limit(0)).count() == 0


def test_hot_posts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(typos, "PART", 3)
    words = [f"word{c}{d}" for c in "abcdef" for d in "uvwxyz"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.asked, r.known) for r in typos.similar_words(frame, frame).collect()}
    assert got == {(x, y) for x in words for y in words if alike(x, y) is not None}


TEXTS = [
    "Customer orders table", "customers and their addresses", "order lines of an order", "product catalogue", "prodcut catalog of the warehouse", None, "",
    "the of and", "invoice lines, invoice totals and invoices", "Orders orders orders", "zzz", "addresses", "custmoer adress", "warehouse stock levels",
]


@pytest.mark.parametrize("named", [False, True])
def test_ranked_search_is_that_of_each_query(spark, monkeypatch, named):
    """As the search of a single query says, for a table of queries; with tiny blocks and lanes, and with synonyms."""
    for constant, value in (("BLOCK", 2), ("GROUP", 2), ("STRONGEST", 2)):
        monkeypatch.setattr(ranked, constant, value)
    syn = [["customer", "client"], ["product", "item", "prodcut"]]
    rng = random.Random(4)
    words = "customer order client item product address invoice stock level line name code".split()
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    rows = [(i, i, t, None if i % 4 == 0 else (t or "")[:12]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, doc_ord long, text string, name string")
    docs = docs if named else docs.withColumn("name", F.lit(None).cast("string"))
    asked = ["customer order", "custommer adress", "items", "zzz zzz unknown", "", "the of", None, "invoice lines of orders and products", texts[20]]
    index = ranked.build_index(docs if named else docs.drop("name"), synonyms=syn)
    queries = spark.createDataFrame(list(enumerate(asked)), "q_id long, text string")
    for k in (3, 100):
        got = {}
        for r in ranked.ranked_top(index, queries, k).collect():
            got.setdefault(r.q_id, []).append((r["rank"], r.doc_id, r.score))
        for q, text in enumerate(asked):
            one = search.lexical_scores(docs, text or "", syn).collect()
            best = sorted((-round(r.score, 9), r.doc_id) for r in one if round(r.score, 9) > 0.15)[:k]
            assert [(n + 1, i) for n, (_, i) in enumerate(best)] == [x[:2] for x in sorted(got.get(q, []))], (q, text)
            assert all(abs(a[2] + b[0]) < 1e-8 for a, b in zip(sorted(got.get(q, [])), best))


def test_ranked_index_is_stored(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ranked.build_index(docs, str(tmp_path / "index"))
    index = ranked.open_index(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "order lines")], "q_id long, text string")
    assert index.n_docs == len(TEXTS) and [r.doc_id for r in ranked.ranked_top(index, q, 2).collect()][0] == 2
    none = ranked.build_index(docs.limit(0))
    assert ranked.ranked_top(none, q).count() == 0 and ranked.ranked_top(index, q.limit(0)).count() == 0


def full_model(spark, docs, rank, features):
    """Vectors by a full singular value decomposition of the same matrix."""
    rows = latent.hashed_features(docs, features).collect()
    a = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        np.add.at(a[i], np.array(r.whole, int), 1.0)
        np.add.at(a[i], np.array(r.part, int), 0.7)
    a *= np.log(1 + len(rows) / (1 + (a > 0).sum(0)))
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    x = u[:, :rank] * s[:rank]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return [r.doc_id for r in rows], np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9), s


def test_latent_vectors_against_the_full_decomposition(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").repartition(5)
    ids, x, s = full_model(spark, docs, 32, 4096)
    model = latent.fit(docs, rank=32, features=4096)
    assert np.allclose(model.strength, s[:32], atol=1e-3) and np.allclose(model.basis.T @ model.basis, np.eye(32), atol=1e-4)
    got = {r.doc_id: np.array(r.embedding) for r in latent.encode(docs, model).collect()}
    y = np.array([got[i] for i in ids])
    assert np.abs(x @ x.T - y @ y.T).max() < 0.05
    near = {}
    for r in latent.semantic_top(docs, docs.filter("doc_id % 10 = 0"), model, 10).collect():
        near.setdefault(r.q_id, set()).add(r.vec_id)
    hits = 0
    for q, found in near.items():
        sim = x @ x[ids.index(q)]
        sim[ids.index(q)] = -9
        hits += len(found & {ids[i] for i in np.argsort(-sim)[:10]})
    assert hits >= 0.9 * 10 * len(near)


def test_latent_edge_cases(spark, tmp_path):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta"), (3, "alpha beta"), (None, "beta gamma"), (4, "delta " * 50_000), (5, "the of")], "doc_id long, text string")
    model = latent.fit(d, rank=8, features=64)
    v = {r.doc_id: r.embedding for r in latent.encode(d.withColumn("extra", F.lit(1)), model).collect()}
    assert len(v) == 6 and all(len(x) == 8 for x in v.values())
    assert [round(math.hypot(*v[i]), 6) for i in (1, 2, 3, 4, 5, None)] == [0, 0, 1, 1, 0, 1]
    model.save(spark, str(tmp_path / "m"))
    again = latent.load(spark, str(tmp_path / "m"))
    assert latent.embed("alpha beta", again, spark) == v[3]
    assert latent.encode(d.limit(0), model).count() == 0
    empty = latent.fit(d.limit(0), rank=4, features=64)
    assert latent.embed("alpha", empty, spark) == [0.0] * 4


def test_latent_model_serves_hybrid_search(spark):
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(TEXTS)], "doc_id long, doc_ord long, text string").withColumn("name", F.col("text"))
    model = latent.fit(docs, rank=10, features=1024)
    hits = search.hybrid_search(docs, latent.encode(docs, model), "order lines", latent.embed("order lines", model, spark)).collect()
    assert hits[0].doc_id == 2 and hits[0].score == 1.0


def test_vectors_meet_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = [rng.integers(-2, 3, rng.choice([4, 4, 4, 2])).astype(float).tolist() for _ in range(90)]
    rows = [(i, v) for i, v in enumerate(x)] + [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0]), (203, [math.nan] * 4), (None, [1.0] * 4), (204, [0.0] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in blocks.cosine_top(d, d.filter("vec_id % 7 = 0"), 5, block=1, components=40).collect():
        got.setdefault(r.q_id, []).append((-r.score, r.vec_id))
    fine = {i: np.array(v) for i, v in rows if i is not None and v and not any(c is None or math.isnan(c) for c in v)}
    for q in (i for i in fine if i % 7 == 0):
        cos = lambda a, b: 0.0 if not a.any() or not b.any() else round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6) + 0.0
        want = sorted((-cos(fine[q], v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:5]
        assert sorted(got[q]) == want
    assert blocks.cosine_top(d.limit(0), d, 3).count() == 0


def test_sums_over_tasks(spark):
    parts = spark.createDataFrame([(i % 3, np.arange(4.0) + i) for i in range(0)], "block int, data binary")
    assert blocks.summed(parts) == {}
    many = spark.createDataFrame([(i % 3, bytearray((np.arange(4.0) + i).tobytes())) for i in range(40)], "block int, data binary").repartition(20)
    got = blocks.summed(many)
    assert {b: x.tolist() for b, x in got.items()} == {b: sum(np.arange(4.0) + i for i in range(40) if i % 3 == b).tolist() for b in range(3)}


def test_registered(spark):
    assert {"ranked_search", "similar_words", "latent_neighbours", "text_vectors"} <= set(search_queries.query.__globals__["QUERIES"])

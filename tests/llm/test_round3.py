"""Centroid clustering, fill-in-middle and exact top-k search against brute-force versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import arrays as A, fill_in_middle, impact_search, language_id, queries, sort_means

DATA = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle


def fim(doc_id, text):
    """The contract, line by line."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(lines), sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(lines[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, len(prefix), len(middle), sha(out), sha(text))


ODD_TEXTS = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (5, "one line"), (None, "a\nb\nc"), (None, None), (6, "é😀\nß\r\n\ttail"), (7, "has <S> inside\nx"),
    (8, "<P>"), (9, "<\nP>\n<S\n>M>"), (10, "a<\nS>b<\n<\nM>"), (11, "line\n" * 20_000 + "end"), (12, "x" * 300_000),
]


def test_fill_in_middle_is_as_stated(spark, tmp_path):
    rows = [(i, t, "q", 1, [1]) for i, t in ODD_TEXTS]
    d = spark.createDataFrame(rows, "doc_id long, text string, fim_output string, fim_cut int, n array<int>")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_fill_in_middle(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(fim(i, t)) for i, t in ODD_TEXTS)
    kept = fill_in_middle.fill_in_middle(d)
    assert kept.columns[:3] == ["doc_id", "text", "fim_output"] and kept.filter("text = 'has <S> inside\nx'").first().fim_output == "has <S> inside\nx"
    assert queries.op12_fill_in_middle(spark, DATA).limit(0).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert fill_in_middle.fill_in_middle(d.limit(0)).count() == 0


def test_fill_in_middle_on_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = queries.op12_fill_in_middle(spark, DATA).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(fim(r.doc_id, r.text)) for r in docs)
    forms = [r.form for r in got]
    assert {forms.count(f) > len(forms) // 4 for f in ("psm", "spm")} == {True}


def test_rates_and_sentinels_are_parameters(spark):
    d = spark.createDataFrame([(i, f"a{i}\nb\nc\nd") for i in range(200)], "doc_id long, text string")
    some = fill_in_middle.fill_in_middle(d, seed=3, rate=30, spm=0, sentinels=("[pre]", "[suf]", "[mid]"))
    r = some.withColumn("back", fill_in_middle.restored(some.fim_output, some.fim_form, ("[pre]", "[suf]", "[mid]"))).collect()
    assert all(x.back == x.text for x in r) and {x.fim_form for x in r} == {"plain", "psm"} and 30 < sum(x.fim_form == "psm" for x in r) < 90


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="<PSM>\n é", max_size=30), min_size=8, max_size=30))
def test_any_text_comes_back(spark, texts):
    d = fill_in_middle.fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in d.select("doc_id", "text", fill_in_middle.restored(d.fim_output, d.fim_form).alias("back")).collect():
        assert r.back == r.text == texts[r.doc_id]


# centroid clustering


def lloyd(rows, k, rounds, size=64, scale=64, seed=1):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    c = [x for _, x in sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        mine = [[x for (_, x), j in zip(kept, (nearest(x)[1] for _, x in kept)) if j == n] for n in range(len(c))]
        c = [[sum(v) // len(m) for v in zip(*m)] if m else old for m, old in zip(mine, c)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    each = {j: sum(d for _, g, d in found if g == j) for j in range(len(c))}
    return [(i, j, d, each[j], sum(each.values()), sha(",".join(map(str, c[j])))) for i, j, d in found]


def same(a, b):
    return sorted(map(str, map(tuple, a))) == sorted(map(str, map(tuple, b)))


def test_clustering_is_exact(spark, vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert same(queries.op11_centroid_clustering(spark, DATA).collect(), lloyd(rows, 16, 3))


def test_clustering_of_odd_vectors(spark):
    rng = random.Random(2)
    grid = [[float(rng.randrange(-2, 3)) for _ in range(4)] for _ in range(40)]  # many ties and equal rows
    rows = [(i, grid[rng.randrange(40)]) for i in range(150)] + [(7, grid[0]), (7, grid[0]), (None, grid[1]), (901, None), (902, []), (903, [1.0] * 3), (904, [1.0, None, 1.0, 1.0])]
    rows += [(905, [math.nan] * 4), (906, [math.inf, 0.0, 0.0, 0.0]), (907, [0.0] * 4), (908, [-0.1, 0.1, -1e-9, 0.0])]
    d = spark.createDataFrame([(*r, 3, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster int, start string, n int").repartition(5)
    as_float = [(i, x and [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    for k, rounds, replay in ((9, 4, 8), (9, 4, 2), (200, 2, 8), (1, 1, 8)):
        got = sort_means.cluster_report(d, k=k, rounds=rounds, size=4, scale=3, replay=replay).collect()
        assert same(got, lloyd(as_float, k, rounds, 4, 3)), (k, rounds, replay)
    assert sort_means.cluster_report(d.limit(0)).collect() == []
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 64) for i in range(40)], "vec_id long, embedding array<float>")
    far = sort_means.cluster_report(huge, k=2).collect()
    assert len(far) == 40 and {r.distance for r in far} == {0} or all(r.distance >= 0 for r in far)


def test_scans_stop_early_but_not_at_ties():
    c = np.array([[0, 0], [10, 0], [-10, 0], [40, 0]])
    x = np.array([[5, 0], [-5, 0], [0, 0], [21, 0], [25, 0]])
    at, best = sort_means.nearest(x, np.array([1, 2, 3, 0, 1]), c)
    assert at.tolist() == [0, 0, 0, 1, 1] and best.tolist() == [25, 25, 0, 121, 225]


# exact top-k search


def top(rows, asked, k, scale):
    whole = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out, done = [], set()
    for q, x in sorted((r for r in whole if asked(r[0]))):
        if q not in done:
            done.add(q)
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_search_is_exact(spark, vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = top(rows, lambda i: i % 50 == 0, 5, 256)
    assert same(queries.op13_exact_top_k(spark, DATA).collect(), want)
    # several shards, a few of them first, small blocks of queries
    got = impact_search.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), shard=64 * 40, block=3, head=4)
    assert same(got.collect(), want)


def test_search_of_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(rng.choice([1, 6, 6, 6]))]) for i in range(120)]
    rows += [(3, [1.0] * 6), (10, [2.0] * 6), (10, [2.0] * 6), (None, [1.0] * 6), (130, None), (140, []), (150, [1.0, None]), (160, [math.nan, 1.0]), (170, [math.inf]), (180, [0.0] * 6)]
    d = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], VEC + ", shard string, mark int").repartition(3)
    for settings_ in ({}, {"shard": 60, "block": 2, "head": 3}, {"k": 500, "shard": 60}, {"k": 1, "scale": 7, "shard": 30, "head": 1}):
        got = impact_search.exact_top_k(d, d.filter("vec_id % 10 = 0"), **settings_).collect()
        assert same(got, top(rows, lambda i: i % 10 == 0, settings_.get("k", 5), settings_.get("scale", 256))), settings_
    assert impact_search.exact_top_k(d.limit(0), d.filter("vec_id % 10 = 0")).count() == 0
    assert impact_search.exact_top_k(d, d.limit(0)).count() == 0
    alone = d.filter("vec_id = 180")
    assert impact_search.exact_top_k(alone, alone).count() == 0


def test_proof_leaves_rows_unscored(vectors):
    """On vectors with a near copy of the query, the search of a shard ends before all segments are added."""
    x = np.floor(256 * np.array([r.embedding for r in vectors.collect()], np.float64)).astype(np.int32)
    near = x[:8] + 1
    shard = impact_search.Shard(impact_search.shard_row(0, np.concatenate([x, near]), np.arange(len(x) + 8)))
    ids, score = shard.best(0, x[0].astype(np.int64), 1, impact_search.LEAST)
    assert ids.tolist() == [len(x)] and score.tolist() == [int(x[0].astype(np.int64) @ near[0])]
    assert shard.added < 0.9 * shard.rows.size


def test_stretches_are_those_of_a_scan_of_all_numbers():
    rng = np.random.default_rng(4)
    for n, most in ((0, 5), (1, 1), (40, 7), (40, 10**9)):
        x = np.sort(rng.integers(0, most, n)).astype(np.uint64)
        for also in {0, int(x[0]) if n else 3}:
            want = [(b, int((x < b).sum()), int((x <= b).sum())) for b in sorted({*x.tolist(), also})]
            assert A.stretches(x, also) == want


def test_units_of_short_texts_have_few_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "ab", "x" * 3_000_000, *["short"] * 20_000])], ["text"])
    cut = list(A.units([batch, batch.slice(0, 0)], rows=1000))
    assert max(u.num_rows for u in cut) <= 1001 and pa.Table.from_batches(cut).column("text").to_pylist() == batch.column("text").to_pylist()


# language identification


def grams(text):
    """Hashed pairs and triples of the bytes of a text's letters and single spaces, one before and one after it, counted one by one."""
    x, out = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", f" {(text or '').lower()} ".encode()), np.zeros(language_id.DIMS)
    for k in range(len(x) - 1):
        out[((x[k] << 8 | x[k + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    for k in range(len(x) - 2):
        out[((x[k] << 16 | x[k + 1] << 8 | x[k + 2] | 1 << 24) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    return out


def test_language_terms_are_counted_one_by_one():
    texts = [None, "", "a", "  A b", "it's 12 o'clock", "Straße, déjà vu!", "日本 x", "\n\t!", "word " * 50]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        got = language_id.term_counts(pa.array(order, pa.string()))
        assert all((row == grams(t)).all() for row, t in zip(got, order))
    assert language_id.term_counts(pa.array([], pa.string())).shape == (0, language_id.DIMS)


def test_language_is_that_of_the_nearest_centroid(spark):
    """Every cosine worked out for one text at a time, from counts made one by one."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: r for r in language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10_000).collect()}
    learn = sorted((i, t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 and t is not None and lang is not None)
    counts = {i: grams(t) for i, t, _ in rows}
    all_learn = [i for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 and lang is not None]
    idf = np.log((1 + len(all_learn)) / (1 + sum((counts[i] > 0).astype(int) for i in all_learn))) + 1

    def unit(i):
        x = np.log1p(counts[i]) * idf
        return x / max(np.linalg.norm(x), 1e-12)

    centres = []
    for lang in sorted({x for _, _, x in learn}):
        own = np.stack([unit(i) for i, _, x in learn if x == lang])
        centres += [(lang, c) for c in language_id.centroids_of(own, 4)[0]]
    centres.sort(key=lambda x: (x[0], x[1].tobytes()))
    near = [max(range(len(centres)), key=lambda j: centres[j][1] @ unit(i)) for i, _, _ in learn]
    votes = [[sum(near[k] == j and r[2] == lang for k, r in enumerate(learn)), near.count(j)] for j, (lang, _) in enumerate(centres)]
    langs = [lang for lang, _ in centres]
    kept = []
    for j, lang in enumerate(langs):
        own, total = votes[j]
        mine = [votes[m][0] for m in range(len(langs)) if langs[m] == lang]
        best = next(m for m in range(len(langs)) if langs[m] == lang and votes[m][0] == max(mine))
        if own > 0.5 * total and own >= 0.08 * sum(mine) or j == best:
            kept.append(centres[j])
    for i, text, _ in rows:
        letters = any(ch.isalpha() for ch in text or "")
        cos = [c @ unit(i) for _, c in kept]
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if letters:
            assert abs(r.score - max(cos)) < 1e-6 and cos[langs_at(kept, r.lang_pred, cos)] > max(cos) - 1e-6
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def langs_at(kept, lang, cos):
    return max((j for j in range(len(kept)) if kept[j][0] == lang), key=lambda j: cos[j])

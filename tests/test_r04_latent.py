"""a text's features are made once, a row a word, and are those of its tokens; a model encodes what it was made of without its texts."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import latent

TEXTS = ["Customer orders and theOrderLines", None, "", "of the", "XMLParser addresses 12 a b", "s's classes buses; pies", "customer " * 50 + "client", "ñandú Ärger"]


@pytest.mark.parametrize("synonyms", [None, [["client", "customer"], ["pie", "cake"], ["orders", "order"]]])
def test_entries_are_those_of_the_tokens(spark, synonyms):
    docs = spark.createDataFrame([(f"d{i}" if i != 3 else None, t) for i, t in enumerate(TEXTS)], "doc_id string, text string").coalesce(1)
    got = [(r.doc_id, dict(zip(r.feature, r.weight))) for r in latent.entries(docs, 500, synonyms).collect()]
    want = []
    for r in latent.hashed_features(docs, 500, synonyms).collect():
        w = {}
        for x, share in [*((x, 1.0) for x in r.whole), *((x, 0.7) for x in r.part)]:
            w[x] = w.get(x, 0) + share
        want.append((r.doc_id, w))
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, g), (_, w) in zip(got, want):
        assert g.keys() == w.keys() and all(abs(g[k] - w[k]) < 1e-9 for k in w)


def test_words_of_a_text_in_several_batches(monkeypatch):
    monkeypatch.setattr(latent, "CHUNK", 1)
    words = [[1, 2, 2], [], [3] * 40, [4, 1], []]
    flat = [(f"d{i}", 0, -1, -1) if k == 0 else (None, k, ws[k - 1], -1) for i, ws in enumerate(words) for k in range(len(ws) + 1)]
    columns = dict(zip(("doc_id", "place", "whole", "part"), zip(*flat)))
    t = pa.table({c: pa.array(v, pa.string() if c == "doc_id" else pa.int32()) for c, v in columns.items()})
    for size in (1, 3, 7, 100):
        out = [r for b in latent.added_words(10)(iter(t.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert [r["doc_id"] for r in out] == [f"d{i}" for i in range(5)]
        assert [dict(zip(r["feature"], r["weight"])) for r in out] == [{x: float(ws.count(x)) for x in ws} for ws in words]


def test_vectors_of_stored_entries(spark, monkeypatch):
    texts = [f"alpha beta w{i % 7} w{i % 5} w{i % 3}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = latent.materialise(latent.entries(docs, 256))
    monkeypatch.setattr(latent, "split_identifier", None)  # texts aren't looked at again
    model = latent.fit_entries(rows, rank=4, features=256, extra=4, passes=2)
    got = {r.doc_id: r.embedding for r in latent.encode_entries(rows, model).collect()}
    assert set(got) == set(range(60)) and np.allclose([np.linalg.norm(v) for v in got.values()], 1)


def test_words_are_found_without_a_split(spark, capsys):
    """Splitting at what stands between words took eight times as long as finding the words."""
    from tessera.functions.text import split_identifier

    texts = ["  orderLines_of XMLParser--12 ", "", None, "ñandú", "a", "__"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split_identifier("t").alias("w"))
    assert [r.w for r in df.orderBy("i").collect()] == [["order", "Lines", "of", "XML", "Parser", "12"], [], None, ["and"], ["a"], []]
    capsys.readouterr()
    df.explain()
    assert "split(" not in capsys.readouterr().out

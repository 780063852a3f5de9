"""Language identification: nearest centroid over normalised TF-IDF vectors of hashed byte n-grams.

Vectors hold the hashed byte trigrams and bigrams of the lower-cased text, weighted by log(1 + count) times the inverse
document frequency over all training documents, at length 1. Each language has several centroids from spherical k-means over
a bounded sample of its labelled documents; a centroid that attracts mostly sample documents of other languages (from
wrong labels) is dropped, unless it is its language's best. The nearest centroid by cosine names the language; a document farther from it
than nearly all of the centroid's own training documents is marked rejected.

Edge cases: a null text, or one without a letter, is `und` with score 0, as is every text when nothing could be learned; a
null id is hashed as the empty text; extra columns are ignored; repeated rows get equal results; ties go to the first language in order of name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays as A
from .spread import spread_join, vector_sum

DIMS = 4096
UNIT_ROWS = 1000  # a row's counts take 32 KB whatever its text, so the rows of a unit are bounded too
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def term_counts(texts: pa.Array) -> np.ndarray:
    """Rows of hashed n-gram counts, one per text, over its letters and single spaces."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    data, off = A.flat(pc.binary_join_element_wise(pa.scalar(" ", lower.type), lower, pa.scalar("", lower.type)))
    # one space for any run of other characters, and one before every text, so that no term reaches into the text before
    gap = NOT_LETTER[data]
    after_gap = np.concatenate([[False], gap[:-1]])
    after_gap[off[:-1]] = False
    keep = ~(gap & after_gap)
    n, x = len(off) - 1, np.where(gap, 32, data)[keep].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(off))[keep]
    out = np.zeros(n * DIMS)
    two, one_text = x[:-1] << 8 | x[1:], doc[:-1] == doc[1:]
    for code, whose, inside in ((two, doc[1:], one_text), (two[:-1] << 8 | x[2:] | np.uint32(1 << 24), doc[2:], one_text[:-1] & one_text[1:])):
        code = (code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out += np.bincount(whose[inside] * DIMS + code, minlength=n * DIMS)
    return out.reshape(n, DIMS)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(term_counts(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids_of(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts; each centroid's rejection bound is the lowest cosine but for 1 %."""
    at = [0]
    near = x @ x[0]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    cos = x @ c.T
    own = cos.argmax(1)
    low = np.array([np.quantile(cos[own == j, j], 0.01) if (own == j).any() else 1.0 for j in range(len(c))])
    return c, low


def trusted_centroids(sample: DataFrame, model: list, idf: np.ndarray) -> list:
    """The centroids whose nearest sample documents are mostly of their own language and more than a few of it (8 %; fewer
    are likely wrong labels), and each language's best."""
    centres = np.array([np.frombuffer(r.centre) for r in model])

    def vote(batches):
        for u in A.units(batches, rows=UNIT_ROWS):
            near = (vectors(u.column("text"), idf) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([A.longs(near), u.column("lang")], ["near", "lang"])

    if not model:
        return model
    votes = sample.select("text", "lang").mapInArrow(vote, "near long, lang string").groupBy("near", "lang").count().collect()
    total, own = np.zeros(len(model)), np.zeros(len(model))
    for v in votes:
        total[v.near] += v["count"]
        own[v.near] += v["count"] * (v.lang == model[v.near].lang)
    langs = np.array([r.lang for r in model], object)
    lang_votes = np.array([own[langs == r.lang].sum() for r in model])
    best = {r.lang: max((own[j], -j) for j in np.flatnonzero(langs == r.lang)) for r in model}
    good = (own > 0.5 * total) & (own >= 0.08 * lang_votes)
    return [r for j, r in enumerate(model) if good[j] or (own[j], -j) == best[r.lang]]


def smallest_hashes(ids: DataFrame, most: int) -> DataFrame:
    """Of each language's distinct ids the `most` with the smallest hashes. Hashes are spread evenly, so all but about twice that
    many are left out by their hash alone, and only the rest is ranked: no language's rows meet in one task."""
    ids = ids.withColumn("hash", F.xxhash64("doc_id"))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("hash").cast("double") + 2.0**63) / 2.0**64
    near = spread_join(ids, sizes, ["lang"], ["doc_id"]).filter(share * F.col("n") <= 2 * most + 50)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", F.col("doc_id").asc_nulls_last()))
    return near.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "lang")


def identify_languages(docs: DataFrame, sample_per_lang: int = 300, clusters: int = 4, folds: int = 5) -> DataFrame:
    """Predicts the language of every document, learning from rows whose crc32(doc_id as text) mod folds is not 0.

    sample_per_lang: centroids are fitted on at most so many labelled documents of each language, those with the smallest hash
    of their id; document frequencies cover all training documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    train = docs.filter((fold != 0) & F.col("lang").isNotNull())

    def frequencies(batches):
        df, n = np.zeros(DIMS), 0
        for u in A.units(batches, rows=UNIT_ROWS):
            df += (term_counts(u.column("text")) > 0).sum(0)
            n += u.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([np.append(df, n).tobytes()], pa.binary())], ["df"])

    total = vector_sum(train.select("text").mapInArrow(frequencies, "df binary"))
    df, n = (total[0][:-1], total[0][-1]) if total else (np.zeros(DIMS), 0)
    idf = np.log((1 + n) / (1 + df)) + 1
    picked = smallest_hashes(train.select("doc_id", "lang").distinct(), sample_per_lang)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = vectors(pa.array(rows.sort_values("doc_id")["text"], pa.string()), idf)
        c, low = centroids_of(x, clusters)
        return pd.DataFrame({"lang": key[0], "centre": [r.tobytes() for r in c], "low": low})

    # the sample has at most sample_per_lang rows a language, so both the join's small side and each group are bounded
    sample = train.filter(F.col("text").isNotNull()).join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")
    sample = sample.dropDuplicates(["doc_id", "lang"])
    model = sample.groupBy("lang").applyInPandas(fit, "lang string, centre binary, low double").collect()
    model.sort(key=lambda r: (r.lang, bytes(r.centre)))
    model = trusted_centroids(sample, model, idf)
    names = np.array([r.lang for r in model] or ["und"], object)
    centres = np.array([np.frombuffer(r.centre) for r in model]) if model else np.zeros((1, DIMS))
    low = np.array([r.low for r in model] or [1.0])

    def predict(batches):
        for u in A.units(batches, rows=UNIT_ROWS):
            cos = vectors(u.column("text"), idf) @ centres.T
            best = cos.argmax(1)
            score = np.clip(cos[np.arange(len(best)), best], 0, 1)
            blank = np.array([t is None or not LETTER.search(t) for t in u.column("text").to_pylist()], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    u.column("doc_id"), pa.array(A.crc_mod(u.column("doc_id"), folds) == 0),
                    pa.array(np.where(blank, "und", names[best]), pa.string()), pa.array(np.where(blank, 0.0, score)),
                    pa.array(blank | (score < low[best])),
                ],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, SCHEMA)

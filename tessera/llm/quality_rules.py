"""Quality rules: counted base rules, and a hashed n-gram log-likelihood ratio between a trusted and a raw multinomial.

Each text is a bag of hashed byte trigrams. The trusted multinomial counts the trigrams of documents labelled good, the raw
one those of all documents; both are smoothed. A document's verdict is the mean over its trigrams of
log p_trusted - log p_raw, against a fixed threshold: no sampling, no random choice.

Edge cases: a null text counts as empty and fails the base rule; repeated rows get equal verdicts; a null id is kept as a
null id; extra columns are ignored by the verdicts and kept by `drop_low_quality`; without any labelled document both multinomials are uniform over the raw counts' smoothing, so the ratio is 0 or
above the threshold and only the base rules decide; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .spread import vector_sum

BUCKETS, THRESHOLD, UNIT = 1 << 16, -0.25, 2.0**-32
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, llr double"
)


def trigram_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of texts as `flat` lays them, with each text's closing space; and offsets into them."""
    x = data.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) if len(x) > 2 else np.empty(0, np.uint32)
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ok = np.ones(len(code), bool)
    for back in (2, 1):  # a trigram that reaches into the next text
        at = off[1:-1] - back
        ok[at[(at >= 0) & (at < len(code))]] = False
    acc = np.zeros(len(ok) + 1, np.int64)
    np.cumsum(ok, out=acc[1:])
    return code[ok], acc[np.minimum(off, len(ok))]


def base_counts(w: A.Words) -> dict[str, np.ndarray]:
    n_docs, n = len(w.off) - 1, len(w.starts)
    gap, acc = A.SPACE[w.data], A.prefix(w.data)
    # lines: cut at \n and at each text's own closing space
    stop = w.data == 10
    stop[w.off[1:] - 1] = True
    ends = np.flatnonzero(stop)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    doc = np.searchsorted(w.off, starts, side="right") - 1
    dark = np.zeros(len(gap) + 1, np.int64)
    np.cumsum(~gap, out=dark[1:])
    full = dark[ends] > dark[starts]
    starts, ends, doc = starts[full], ends[full], doc[full]
    key = A.mix(A.span_hashes(acc, starts, ends) + doc.astype(A.U64) * A.GOLD)
    _, at = np.unique(key, return_index=True)
    dup = np.bincount(doc, minlength=n_docs) - np.bincount(doc[at], minlength=n_docs)
    # words in 5-word windows found twice or more in the text
    ok, texts = A.inside(w.first, 5), w.doc_of
    places = np.flatnonzero(ok)
    win = A.window_hashes(A.span_hashes(acc, w.starts, w.ends), 5)[places]
    win = A.mix(win + texts[places].astype(A.U64) * A.GOLD)
    order = np.argsort(win)
    same = win[order][1:] == win[order][:-1]
    again = np.zeros(len(places), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return {
        "n_words": w.counts,
        "word_chars": A.per_text(~gap & ((w.data & 0xC0) != 0x80), w.off),
        "n_symbols": A.per_text(SYMBOLS[w.data], w.off),
        "n_dup_lines": dup,
        "n_repeat_words": A.per_text(A.covered(n, places[again], 5), w.first),
    }


def trigram_counts(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all documents and over the trusted ones. trusted: at most some thousand ids, broadcast."""
    flagged = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id").distinct().withColumn("good", F.lit(True))), "doc_id", "left"
    )

    def count(batches):
        raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for u in A.units(batches):
            data, off = A.flat(u.column("text"))
            code, at = trigram_buckets(data, off)
            raw += np.bincount(code, minlength=BUCKETS)
            yes = np.repeat(u.column("good").fill_null(False).to_numpy(zero_copy_only=False), np.diff(at))
            good += np.bincount(code[yes], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([raw.tobytes()], pa.binary()), pa.array([good.tobytes()], pa.binary())], ["raw", "good"])

    total = vector_sum(flagged.mapInArrow(count, "raw binary, good binary"))
    return (np.zeros(BUCKETS), np.zeros(BUCKETS)) if total is None else (total[0], total[1])


def llr_table(docs: DataFrame, labels: DataFrame, most_trusted: int = 20_000, smoothing: float = 1.0) -> np.ndarray:
    """log p_trusted - log p_raw of every bucket.

    most_trusted: the classifier's trusted side learns from at most so many documents labelled good, those with the smallest
    hash of their id; the raw side counts all documents.
    """
    trusted = (
        labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_trusted)
    )
    raw, good = trigram_counts(docs, trusted)
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + smoothing) / (good.sum() + smoothing * BUCKETS)) - np.log((raw + smoothing) / (raw.sum() + smoothing * BUCKETS))


def judged(texts: pa.Array, table: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    w = A.scan(texts)
    c = base_counts(w)
    code, at = trigram_buckets(w.data, w.off)
    # whole multiples of UNIT: sums don't depend on the order of documents or on what shares a batch
    steps = np.round(table / UNIT).astype(np.int64)[code]
    llr = A.per_text(steps, at) * UNIT / np.maximum(np.diff(at), 1)
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    return c | {"base_failed": failed, "kept": ~failed & (llr >= threshold), "llr": llr}


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with the base counts, the verdicts and llr."""
    table = llr_table(docs, labels)

    def judge(batches):
        for u in A.units(batches):
            found = judged(u.column("text"), table, threshold)
            yield pa.RecordBatch.from_arrays([u.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, SCHEMA)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that quality_verdicts keeps."""
    table = llr_table(docs, labels)

    def sift(batches):
        for u in A.units(batches):
            yield u.filter(pa.array(judged(u.column("text"), table, threshold)["kept"]))

    return docs.mapInArrow(sift, docs.schema)

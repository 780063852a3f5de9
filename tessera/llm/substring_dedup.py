"""Substring dedup: fixed-block anchors, rolling probes, and extension to maximal exact repeats.

A passage repeats if a window of 50 consecutive words of one document starts in a document with a smaller id too. Documents are
cut into blocks of 25 words; any window of 50 words holds a whole block. The blocks are the index, and every rolling window of
25 words of every document is a probe. Probes travel packed, by hash bucket: four bytes of hash, and the steps between
places. A bucket reports the places whose hash is that of a block and that occurs twice or more: the hits.

Hits are extended: all windows of 50 words around a hit are hashed (80 bits) and travel packed to the bucket of their hash,
which keeps the smallest document of each sequence; windows of any larger document are repeats, and their union is the maximal
repeats. Work and traffic grow with the words, never with pairs of documents: places that share a hash inside a unit of text
are answered there, and only one of them, or those of the smallest document, travels. The number of buckets follows the size of
the input, so a bucket, which is one group in memory, holds the entries of a bounded stretch of text.

Edge cases: a null text has no words; a null id is larger than any other and null ids are equal; rows with equal ids don't
remove each other's words, also where they repeat; windows are judged on the input; a text of fewer than 50 words stays; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .spread import buckets_for, materialise, small_batches

WINDOW, BLOCK = 50, 25
LAST = 2**63 - 1  # stands for a null id
UNIT_WORDS = 500_000  # entries of so many words are packed together
BUCKET_BYTES = 16 << 20  # text whose entries meet in one bucket, about
BATCH_ROWS = 1000  # texts cross to Python and back three times, and each crossing holds whole batches outside the heap


SENT = {"bucket": pa.int32(), "unit": pa.int64(), "entries": pa.binary(), "keys": pa.binary()}
SENT_SCHEMA = "bucket int, unit long, entries binary, keys binary"
PLACES_SCHEMA = "unit long, places binary, keys binary"


def gathered(pieces: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    """Joins pieces until they hold UNIT_WORDS words: `at` and `counts` number the words of the whole unit."""
    held, words = [], 0
    for piece in pieces:
        held.append(piece | {"at": piece["at"] + words})
        words += int(piece["counts"].sum())
        if words >= UNIT_WORDS:
            yield {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            held, words = [], 0
    if held:
        yield {k: np.concatenate([x[k] for x in held]) for k in held[0]}


def named(units: Iterator[dict[str, np.ndarray]]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Units with names that no other unit of the stage has: the task's partition number and a counter, mixed one to one."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for n, x in enumerate(units):
        yield int(A.mix(np.array([task << 32 | n], np.uint64)).view(np.int64)[0]), x


def by_bucket(
    unit: int, h: np.ndarray, buckets: int, columns: list[np.ndarray], x: dict[str, np.ndarray], local: np.ndarray
) -> pa.RecordBatch:
    """One row per bucket that has entries: `columns` and steps between places, packed. The row of one bucket, which is there
    in any case, carries the keys and word counts of the unit's documents; a row beyond the buckets carries the places that the
    unit has answered itself."""
    bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows = [(buckets + unit % buckets, unit, A.pack(np.diff(local, prepend=0)), None)] if len(local) else []
    for b, lo, hi in A.stretches(bucket[order], unit % buckets):
        keys = A.pack(x["keys"], x["counts"]) if b == unit % buckets else None
        rows.append((b, unit, A.pack(*(c(order[lo:hi]) for c in columns)), keys))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(SENT.values())], list(SENT))


def answers(table: pa.Table, columns: int, found) -> pa.Table:
    """Places per row of a bucket. found: from the columns, end to end, which entries are answered; the last column, which it
    doesn't get, holds the steps between places."""
    parts_ = [A.unpack(e, columns + 1) for e in table.column("entries").to_pylist()]
    cut = np.cumsum([0, *(len(p[0]) for p in parts_)])
    ok = found(*(np.concatenate(c) for c in list(zip(*parts_))[:columns]), cut)
    blobs = [A.pack(np.diff(np.cumsum(p[-1]).astype(np.int64)[ok[lo:hi]], prepend=0)) for p, lo, hi in zip(parts_, cut, cut[1:])]
    return pa.Table.from_arrays([table.column("unit"), pa.array(blobs, pa.binary()), table.column("keys")], ["unit", "places", "keys"])


def passed_on(table: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([table.column(c) for c in ("unit", "entries", "keys")], ["unit", "places", "keys"])


def per_document(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(key, places): packed places per document, from the packed places of a unit."""
    keys, counts = A.unpack(next(k for k in table.column("keys").to_pylist() if k is not None), 2)
    off = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    at = np.sort(np.concatenate([np.cumsum(A.unpack(b, 1)[0]).astype(np.int64) for b in table.column("places").to_pylist()]))
    cut = np.searchsorted(at, off)
    docs = np.flatnonzero(np.diff(cut))
    blobs = [A.pack(np.diff(at[cut[k] : cut[k + 1]] - off[k], prepend=0)) for k in docs]
    return pa.Table.from_arrays([pa.array(keys[docs].view(np.int64)), pa.array(blobs, pa.binary())], ["key", "places"])


def runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of equal rows in sorted columns, and the number of its run for each row."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new), np.cumsum(new) - 1


def probe_hits(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, places): per document, by id or LAST, the packed places where a probe met a block, or a block was met."""

    def pieces(batches):
        for u in A.units(batches):
            w = A.scan(u.column("text"))
            at = np.flatnonzero(A.inside(w.first, BLOCK))
            h = A.window_hashes(A.word_hashes(w), BLOCK)[at] if len(at) else np.empty(0, np.uint64)
            anchor = (at - np.repeat(w.first[:-1], w.counts)[at]) % BLOCK == 0
            yield {"h": h, "anchor": anchor, "at": at, "keys": u.column("doc_id").fill_null(LAST).to_numpy().view(np.uint64), "counts": w.counts}

    def probe(batches):
        for unit, x in named(gathered(pieces(batches))):
            h, anchor, at = x["h"], x["anchor"], x["at"]
            # places that this unit answers: their hash is that of a block here, and occurs twice or more here
            order = np.argsort(h)
            first, run = runs_of(h[order])
            answered, sent = np.zeros(len(h), bool), np.ones(len(h), bool)
            if len(h):
                several = np.diff(np.append(first, len(h))) > 1
                answered[order] = (several & np.bitwise_or.reduceat(anchor[order], first))[run]
                sent = ~answered
                sent[order[first]] = True  # one of each answered hash travels, as a block
            s = np.flatnonzero(sent)
            h, flag, place = h[s], (anchor | answered)[s], at[s]
            columns = [lambda i: h[i] & np.uint64(0xFFFFFFFF), lambda i: flag[i], lambda i: np.diff(place[i], prepend=0)]
            yield by_bucket(unit, h, buckets, columns, x, at[answered])

    def met(h: np.ndarray, block: np.ndarray, cut: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(h), bool)
        if len(h):
            order = np.argsort(h)
            first, run = runs_of(h[order])
            several = np.diff(np.append(first, len(h))) > 1
            ok[order] = (several & (np.bitwise_or.reduceat(block[order], first) > 0))[run]
        return ok

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return passed_on(table) if key[0].as_py() >= buckets else answers(table, 2, met)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = d.mapInArrow(probe, SENT_SCHEMA).groupBy("bucket").applyInArrow(meet, PLACES_SCHEMA)
    return found.groupBy("unit").applyInArrow(per_document, "key long, places binary")


def repeated_windows(docs: DataFrame, hits: DataFrame, buckets: int) -> DataFrame:
    """Hits and repeats grow with the input, so they are merged with the documents at any size, never broadcast.

    (key, places): packed starts of the windows whose sequence of words starts in a document with a smaller id too, by the
    key of the document's id and text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    near = hits.groupBy("key").agg(F.collect_list("places").alias("hits")).withColumnRenamed("key", "doc")

    def pieces(batches):
        for u in A.units(batches):
            w = A.scan(u.column("text"))
            n, ok = len(w.starts), A.inside(w.first, WINDOW)
            hit = [w.first[k] + np.cumsum(A.unpack(b, 1)[0]).astype(np.int64) for k, x in enumerate(u.column("hits").to_pylist()) for b in x]
            hit = np.concatenate(hit) if hit else np.empty(0, np.int64)
            step = np.zeros(n + 1, np.int64)  # starts of the windows that hold a hit's block
            np.add.at(step, np.minimum(np.maximum(hit - (WINDOW - BLOCK), 0), n), 1)
            np.subtract.at(step, np.minimum(hit + 1, n), 1)
            at = np.flatnonzero((np.cumsum(step)[: len(ok)] > 0) & ok)
            h, check = ((A.window_hashes(A.word_hashes(w, seed), WINDOW, seed)[at] if len(at) else np.empty(0, np.uint64)) for seed in (0, 1))
            keys = A.row_keys(u.column("doc_id"), A.span_hashes(A.prefix(w.data), w.off[:-1], w.off[1:]))
            yield {"h": h, "check": check & np.uint64(0xFFFF), "at": at, "ids": u.column("doc").to_numpy()[w.doc_of[at]], "keys": keys, "counts": w.counts}

    def larger(h: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which entries are of a document larger than the smallest with the same sequence."""
        out = np.zeros(len(h), bool)
        if len(h):
            order = np.lexsort((ids, check, h))
            first, run = runs_of(h[order], check[order])
            out[order] = ids[order] > ids[order][first][run]
        return out

    def extend(batches):
        for unit, x in named(gathered(pieces(batches))):
            known = larger(x["h"], x["check"], x["ids"])  # in this unit; the rest, of the smallest documents, travels
            s = np.flatnonzero(~known)
            h, check, ids, place = (x[c][s] for c in ("h", "check", "ids", "at"))
            columns = [
                lambda i: h[i], lambda i: check[i], lambda i: np.diff(ids[i].view(np.uint64), prepend=np.uint64(0)),
                lambda i: np.diff(place[i], prepend=0),
            ]
            yield by_bucket(unit, h, buckets, columns, x, x["at"][known])

    def judged(h: np.ndarray, check: np.ndarray, steps: np.ndarray, cut: np.ndarray) -> np.ndarray:
        ids = [np.cumsum(steps[lo:hi], dtype=np.uint64).view(np.int64) for lo, hi in zip(cut, cut[1:])]
        return larger(h, check, np.concatenate(ids))

    def judge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return passed_on(table) if key[0].as_py() >= buckets else answers(table, 3, judged)

    sent = d.join(near.hint("merge"), "doc").select("doc_id", "doc", "text", "hits").mapInArrow(extend, SENT_SCHEMA)
    places = sent.groupBy("bucket").applyInArrow(judge, PLACES_SCHEMA)
    return places.groupBy("unit").applyInArrow(per_document, "key long, places binary")


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, the words left, joined by single spaces."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets_for(docs, BUCKET_BYTES)
    with small_batches(docs.sparkSession, BATCH_ROWS):
        hits = materialise(probe_hits(docs, buckets))
        repeats = materialise(repeated_windows(docs, hits, buckets))
    found = repeats.groupBy(F.col("key").alias("row")).agg(F.collect_list("places").alias("starts"))

    def key(batches):
        for u in A.units(batches):
            data, off = A.flat(u.column("text"))
            keys = A.row_keys(u.column("doc_id"), A.span_hashes(A.prefix(data), off[:-1], off[1:]))
            yield pa.RecordBatch.from_arrays([*u.columns, pa.array(keys.view(np.int64))], ["doc_id", "text", "row"])

    def cut(batches):
        for u in A.units(batches):
            w = A.scan(u.column("text"))
            gone = np.zeros(len(w.starts), bool)
            lists = u.column("starts").to_pylist()
            at = [w.first[k] + np.cumsum(A.unpack(b, 1)[0]).astype(np.int64) for k, x in enumerate(lists) for b in x or ()]
            if at:
                gone = A.covered(len(w.starts), np.concatenate(at), WINDOW)
            # bytes of the kept words and one space after each
            keep = ~A.SPACE[w.data]
            size = w.ends - w.starts
            owner = np.repeat(np.arange(len(size)), size)
            body = np.flatnonzero(keep)[~gone[owner]]
            data = w.data.copy()
            data[w.ends] = 32
            mask = np.zeros(len(data), bool)
            mask[body] = True
            mask[w.ends[~gone]] = True
            acc = np.concatenate([[0], np.cumsum(mask)])[w.off]
            raw = data[mask].tobytes()
            text = [raw[a : max(a, b - 1)] for a, b in zip(acc[:-1].tolist(), acc[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [u.column("doc_id"), A.longs(w.counts), A.longs(A.per_text(gone, w.first)), pa.array(text, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    rows = docs.mapInArrow(key, "doc_id long, text string, row long").join(found.hint("merge"), "row", "left").select("doc_id", "text", "starts")
    out = rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))

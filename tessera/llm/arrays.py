"""Array helpers that run inside Spark tasks: Arrow text columns become numpy word, byte and hash arrays.

A word is a maximal run of bytes outside ASCII white space (0x20, 0x09-0x0D). Hashes are 64-bit polynomial hashes over a
random byte table, so that the hash of any word, line or word window comes from two prefix sums, then a bit mixer.

Edge cases: a null text counts as empty, and an empty one has no words; a text of any length is one unit of work at least (`units` never
cuts a text); a null id hashes apart from every other; empty batches give empty arrays; columns are asked for by name, so others don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
STEP, GOLD = 0x9E3779B97F4A7C15 | 1, U64(0x9E3779B97F4A7C15)
GLUE = [pa.scalar(x, pa.large_string()) for x in ("", " ")]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, modulo 2**64."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        base = (STEP + 2 * 0xD1B54A32D192ED03 * seed) % 2**64 | 1
        size = max(1 << 16, n + n // 8)
        have = []
        for m in (base, pow(base, -1, 2**64)):
            row = np.full(size, m, U64)
            row[0] = 1
            have.append(np.cumprod(row, dtype=U64))
        _powers[seed] = have = tuple(have)
    return have[0][:n], have[1][:n]


def byte_table(seed: int = 0) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = np.random.default_rng(7919 + seed).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
    return _tables[seed]


class Words(NamedTuple):
    """Texts of a batch laid end to end, each followed by one space."""

    data: np.ndarray  # bytes
    off: np.ndarray  # text k holds bytes off[k] to off[k + 1] - 1, then its space
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # text k holds words first[k] to first[k + 1] - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, each followed by one space; a null text is empty."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    padded = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), *GLUE)
    off = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    return np.frombuffer(padded.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def scan(texts: pa.Array, lower: bool = False) -> Words:
    data, off = flat(texts)
    data = LOWER[data] if lower else data
    gap = np.concatenate([[True], SPACE[data]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return Words(data, off, edge[::2], edge[1::2], np.searchsorted(edge[::2], off))


def prefix(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums of the polynomial hash over bytes."""
    acc = np.zeros(len(data) + 1, U64)
    np.cumsum(byte_table(seed)[data] * powers(len(data) + 1, seed)[0][:-1], out=acc[1:])
    return acc


def span_hashes(acc: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    inv = powers(len(acc), seed)[1]
    return mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(U64) * GOLD)


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    return span_hashes(prefix(w.data, seed), w.starts, w.ends, seed)


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of k neighbouring words, whatever text they are in; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.empty(0, U64)
    pw, inv = powers(len(h) + 1, seed)
    acc = np.zeros(len(h) + 1, U64)
    np.cumsum(h * pw[:-1], out=acc[1:])
    return mix((acc[k:] - acc[:-k]) * inv[: len(h) - k + 1] + U64(k * int(GOLD) % 2**64))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words lie in one text."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))
    return last[: n - k + 1] >= np.arange(k, n + 1)


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of the places `at`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.subtract.at(step, np.minimum(at + k, n), 1)
    return np.cumsum(step[:-1]) > 0


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a mask over off[k] to off[k + 1]."""
    acc = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=acc[1:])
    return np.diff(acc[off])


def units(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of text, and about `rows` rows at most; a longer text stays whole, alone or with the
    next few."""
    try:
        yield from _cut(batches, column, most, most // rows if rows else 1)
    finally:
        release_memory()


def release_memory() -> None:
    """Gives freed memory back: workers are reused, and idle ones stand beside the executor's JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _cut(batches: Iterator[pa.RecordBatch], column: str, most: int, row: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size + row) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


def stretches(numbers: np.ndarray, also: int) -> list[tuple[int, int, int]]:
    """(number, first place, end) of each number in sorted `numbers`, and of `also`, which may have no place; takes time by what is there, however
    large the numbers are."""
    at = numbers.astype(np.int64)
    met = np.union1d(at, [also])
    return list(zip(met.tolist(), np.searchsorted(at, met).tolist(), np.searchsorted(at, met, "right").tolist()))


def crc_mod(ids: pa.Array, m: int) -> np.ndarray:
    """crc32 of each id as text, modulo m; a null id has the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % m for i in ids.to_pylist()], np.int64)


def longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64))


def row_keys(ids: pa.Array, text_hash: np.ndarray) -> np.ndarray:
    """One key for a document's id and text; only rows that are alike in both share it."""
    x = ids.fill_null(-1).to_numpy().view(np.uint64) * GOLD + ids.is_null().to_numpy(zero_copy_only=False)
    return mix(text_hash + x)


def pack(*columns: np.ndarray) -> bytes:
    """Byte planes of the columns, so that small numbers compress; all columns are unsigned 64-bit."""
    raw = b"".join(np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), np.uint8)
    n = len(raw) // 8 // n_columns
    return [np.ascontiguousarray(raw[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T).view(np.uint64).ravel() for i in range(n_columns)]

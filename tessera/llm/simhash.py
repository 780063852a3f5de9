"""SimHash near-duplicates: a byte-position inverted index with count filtering, then verification.

Fingerprints of 64 bits are eight bytes. Two of them that differ in at most 4 bits differ in at most 4 bytes, so they share at
least 4 positional bytes: that is the guaranteed minimum of the count filter. Posting lists of one positional byte would hold
one in 256 of all fingerprints, so the index posts combinations of three positions instead: 20 of the 56 triples, chosen so
that every set of four positions holds one of them. Any pair with four shared positional bytes meets in at least one posting
list. Within a list the shared positional bytes of each pair are tallied, pairs with fewer than four are dropped, and the rest
is verified on all bits.

`drop_near_duplicates` looks for a Jaccard similarity of 0.8 of five-word shingles. There two fingerprints differ in 15 % of
their bits, which no 64-bit fingerprint tells apart well, so it takes 1024 bits (128 positional bytes), 160 posted triples, a
minimum of 3 shared positional bytes and verifies at most 166 differing bits. Here the index is not exhaustive: of pairs at 0.8
to 0.85 some 94 % are found, above that nearly all; tests/llm/measure_near_duplicates.py measures this. Groups are closed over
their links.

Equal fingerprints become one entry first. Posts carry only an entry's number; those of lists with a single entry go before
fingerprints are attached. A posting list is compared in blocks of bounded size, so a list that holds a large
part of all entries is spread over many groups, and each group returns a spanning forest of its links rather than all pairs.

Edge cases: a text without a word (null, empty, white space) has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle; null ids have their fingerprint and a null component; repeated rows share a component; extra
columns of any name are kept by `drop_near_duplicates` and ignored by `simhash_components`; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .components import components
from .spread import materialise, salted_join


def covering(most_positions: int = 8, shared: int = 4, size: int = 3) -> list[tuple[int, ...]]:
    """Triples of positions such that any `shared` positions hold one: with positions in three near-equal classes in a ring,
    those inside a class, and those with two in a class and one in the next."""
    classes = [list(range(i, most_positions, size)) for i in range(size)]
    where = {p: i for i, c in enumerate(classes) for p in c}
    out = []
    for t in combinations(range(most_positions), size):
        k = sorted(where[p] for p in t)
        two = next((c for c in k if k.count(c) == 2), None)
        if k[0] == k[2] or two is not None and (two + 1) % 3 == next(c for c in k if c != two):
            out.append(t)
    assert all(any(set(t) <= set(q) for t in out) for q in combinations(range(most_positions), shared))
    return out


def scattered(positions: int, n: int) -> list[tuple[int, ...]]:
    """n different triples of positions, fixed, each position in about as many."""
    rng, out = np.random.default_rng(3), []
    while len(out) < n:
        for t in rng.permutation(positions)[: positions // 3 * 3].reshape(-1, 3):
            if (key := tuple(sorted(t.tolist()))) not in out and len(out) < n:
                out.append(key)
    return out


def majority(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For every text the 64 bits that are set in over half of its hashes h[off[k]:off[k + 1]]; 0 without a hash."""
    n = np.diff(off)
    has = np.flatnonzero(n)
    # counters of 16 bits, four to a number, so stretches of at most 65535 hashes are summed up
    cuts = np.union1d(off[:-1][has], np.arange(0, len(h), 65_535)).astype(np.int64)
    out = np.zeros(len(n), np.uint64)
    if not len(has):
        return out
    whose = np.searchsorted(cuts, off[:-1][has])
    for shift in range(16):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & np.uint64(0x0001000100010001), cuts)
        for lane in range(4):
            ones = np.add.reduceat((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF), whose)
            out[has] |= (2 * ones > n[has].astype(np.uint64)).astype(np.uint64) << np.uint64(16 * lane + shift)
    return out


def shingle_places(w: A.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each shingle, and offsets per text; a text of fewer than k words is one shingle."""
    n = w.counts
    many = np.where(n >= k, n - k + 1, n > 0)
    off = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(w.first[:-1] - off[:-1], many) + np.arange(off[-1])
    return first, np.minimum(first + k, np.repeat(w.first[1:], many)) - 1, off


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every document; fp is 8 bytes, little-endian; bit k is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""

    def make(batches):
        from xxhash import xxh64_intdigest

        for u in A.units(batches):
            w = A.scan(u.column("text"), lower=True)
            # the words joined by single spaces
            joined = w.data.copy()
            keep = ~A.SPACE[joined]
            keep[w.ends] = True
            joined[w.ends] = 32
            place = np.cumsum(keep)
            text = joined[keep].tobytes()
            starts, ends = place[w.starts] - 1, place[w.ends - 1]
            first, last, off = shingle_places(w, shingle)
            h = np.fromiter((xxh64_intdigest(text[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
            yield pa.RecordBatch.from_arrays([u.column("doc_id"), as_binary(majority(h, off)[:, None])], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp binary")


def wide_fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, fp) of every document, with `words` times 64 bits from hashes of its shingles."""

    def make(batches):
        for u in A.units(batches):
            w = A.scan(u.column("text"), lower=True)
            h, (first, last, off) = A.word_hashes(w), shingle_places(w, shingle)
            acc, (pw, inv) = np.zeros(len(h) + 1, np.uint64), A.powers(len(h) + 1)
            np.cumsum(h * pw[:-1], out=acc[1:])
            s = A.mix((acc[last + 1] - acc[first]) * inv[first])
            fp = np.stack([majority(A.mix(s + np.uint64((i + 1) * int(A.GOLD) % 2**64)), off) for i in range(words)], 1)
            yield pa.RecordBatch.from_arrays([u.column("doc_id"), as_binary(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp binary")


def as_binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x.astype("<u8"))
    width = x.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x)])


def links(distinct: DataFrame, triples: list[tuple[int, ...]], least_bytes: int, most_bits: int, block: int = 2048) -> DataFrame:
    """Links (u, v) between the entries (id long, fp binary) of `distinct` whose components are those of all pairs that meet in
    the posting list of a triple, share least_bytes positional bytes and differ in at most most_bits bits. Where `distinct` has a
    component too, links inside it are known already: lists that hold one component only are left out."""
    known = ["component"] if "component" in distinct.columns else []

    def post(batches):
        at = np.array(triples)
        for batch in batches:
            fp = batch.column("fp")
            width = len(fp[0].as_py())
            raw = np.frombuffer(fp.buffers()[2], np.uint8)[fp[0:1].offset * width :][: batch.num_rows * width].reshape(-1, width)
            key = raw[:, at].astype(np.int64) @ np.array([1, 256, 65536]) + (np.arange(len(at)) << 24)
            for i in range(len(at)):
                yield pa.RecordBatch.from_arrays([pa.array(key[:, i]), *(batch.column(c) for c in ("id", *known))], ["list", "id", *known])

    posts = distinct.select("id", "fp", *known).mapInArrow(post, "list long, id long" + ", component long" * len(known))
    several = F.min(known[0]) != F.max(known[0]) if known else F.count(F.lit(1)) > 1
    sizes = materialise(posts.groupBy("list").agg(F.count(F.lit(1)).alias("n"), several.alias("several")).filter("several").drop("several"))
    posts = posts.select("list", "id")
    # blocks of a list meet in pairs: an entry of block x goes to the groups (x, y) and (y, x) of all y
    in_lists = salted_join(posts, sizes, ["list"], ["id"]).select("id", F.struct("list", F.ceil(F.col("n") / block).cast("int").alias("n")).alias("l"))
    # an entry has at most one row a triple; its fingerprint joins it once
    in_lists = in_lists.groupBy("id").agg(F.collect_list("l").alias("l")).join(distinct.select("id", "fp"), "id").withColumn("l", F.explode("l"))
    in_lists = in_lists.select("id", "fp", "l.list", "l.n").withColumn("x", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    placed = in_lists.select("list", "id", "fp", "x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("y"))
    gathered = placed.groupBy("list", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.collect_list(F.struct("id", "fp")).alias("g"))

    def compare(batches):
        for batch in batches:
            lists = batch.column("g")
            off, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            ids = flat.field("id").to_numpy()
            f = np.frombuffer(b"".join(flat.field("fp").to_pylist()), "<u8").reshape(len(ids), -1)
            size = np.diff(off)
            at = off[:-1][size == 2]
            ok = linked(f[at], f[at + 1], least_bytes, most_bits)
            us, vs = [ids[at][ok]], [ids[at + 1][ok]]
            for k in np.flatnonzero(size > 2):
                s = slice(off[k], off[k + 1])
                u, v = spanning(ids[s], f[s], least_bytes, most_bits)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])

    return gathered.select("g").mapInArrow(compare, "u long, v long").distinct()


def linked(a: np.ndarray, b: np.ndarray, least_bytes: int, most_bits: int) -> np.ndarray:
    """Count filter, then verification, row by row."""
    x = np.ascontiguousarray(a ^ b)
    tally = (x.view(np.uint8) == 0).sum(-1)
    out = tally >= least_bytes
    out[out] = np.bitwise_count(x[out]).sum(-1) <= most_bits
    return out


def spanning(ids: np.ndarray, f: np.ndarray, least_bytes: int, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among entries: breadth first from each one not reached yet."""
    us, vs, todo = [ids[:0]], [ids[:0]], np.arange(len(ids))
    while len(todo) > 1:
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            head = front.pop()
            hit = linked(f[todo], f[head], least_bytes, most_bits)
            us.append(np.full(hit.sum(), ids[head]))
            vs.append(ids[todo[hit]])
            front += todo[hit].tolist()
            todo = todo[~hit]
    return np.concatenate(us), np.concatenate(vs)


def grouped(prints: DataFrame, triples: list[tuple[int, ...]], least_bytes: int, most_bits: int, first: int = 0) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp). first: so many triples are posted before the others, so that for these the
    members of a large group of near copies, which meet in nearly all lists, are known to belong together."""
    prints = materialise(prints)
    entries = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("id", F.xxhash64("fp")))
    known, late = None, entries
    if first:
        known = materialise(links(entries, triples[:first], least_bytes, most_bits))
        late = materialise(entries.join(components(known), "id", "left").select("id", "fp", F.coalesce("component", "id").alias("component")))
    more = links(late, triples[first:], least_bytes, most_bits)
    found = components(more if known is None else known.union(more))
    # an entry without a link is its own component
    joined = entries.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = materialise(salted_join(joined.select("fp", "id", "component", F.col("n").alias("rows")), least, ["component"], ["id"]).select("fp", "component_id", F.col("rows").alias("n")))
    return salted_join(prints, named, ["fp"], ["doc_id"]).drop("n").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def simhash_components(docs: DataFrame, shingle: int = 4, most_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links of at
    most most_bits (4 or fewer) differing bits; exact."""
    out = grouped(fingerprints(docs, shingle), covering(), 4, most_bits)
    return out.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def hex_of(fp: str):
    """The hex digits of a little-endian number of eight bytes."""
    return F.lower(F.concat(*(F.hex(F.substring(fp, 8 - i, 1)) for i in range(8))))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, words: int = 16, least_bytes: int = 3, most_bits: int = 166, triples: int = 160, first: int = 16) -> DataFrame:
    """The documents with one of each group left: the smallest doc_id; repeated rows of that id all stay, and so do rows with a
    null id. With the defaults two documents link at a similarity of 0.8 of their five-word shingles."""
    named = grouped(wide_fingerprints(docs, shingle, words), scattered(8 * words, triples), least_bytes, most_bits, first)
    kept = named.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("kept_id"))
    stays = rows.join(kept, "kept_id", "left_semi").unionByName(rows.filter("kept_id IS NULL"))
    return stays.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))

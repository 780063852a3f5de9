"""Packing: documents or instruction examples become sequences of at most a given number of tokens.

Vector bin packing: an item asks for tokens, one segment and its loss-bearing tokens; a sequence offers what is left of the
three. Of all items of a block that fit, the one with the largest dot product of its demand and the offer, each dimension
divided by the limit, goes in next. Documents may be cut: whole sequences are cut off first, the rest is packed by the
heuristic, and where nothing fits any more a piece of the largest item fills the sequence, so sequences are full. What is left
at the end of a Spark task is cut into sequences whose lengths are powers of two, which need no padding. Conversations are not
cut: an example longer than a limit is returned as a sequence of its own, marked oversize.

Every task packs its own rows, block by block of bounded size, so nothing is shuffled and a lost task can be run again alone;
sequence ids carry the task's partition number in their upper bits.

Edge cases: a null text counts as empty and is the single end token; null ids are kept; repeated rows are packed each; an
empty table gives an empty result; a very long text is cut into many whole sequences; extra columns are ignored. Every token of a
document bears loss and a segment is at least one token, so with equal limits only that on tokens binds for documents; for
conversations all three do.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A

END_ID = 1
#: The public pre-tokenizer pattern of the byte-level vocabulary, with the letters and numbers below U+0100.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
OTHER = re.compile("[^\x00-\x1b\x20-\xff]")
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long"
)
_tokenizers: dict[str, "PretokenMemory"] = {}


class _Places(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = k = len(self)
        self.new.append(key)
        return k


class PretokenMemory:
    """Token ids by the tokenizers library, remembered per pre-token, which is what the library encodes one by one.

    Texts with a character that the pattern above doesn't classify, or with an added token such as <|endoftext|>, which the
    library takes out of a text before it splits it, are given to the library whole. The memory is emptied when it has grown
    beyond `most` pre-tokens.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most
        added = [t.content for t in self.model.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.other = re.compile("|".join([OTHER.pattern, *map(re.escape, added)]))
        self.begins = np.zeros(self.model.get_vocab_size(), bool)
        self.begins[[i for token, i in self.model.get_vocab().items() if token[0] == "\u0120"]] = True
        self.clear()

    def clear(self) -> None:
        self.places, self.used = _Places(), 0
        self.ids, self.starts, self.sizes = np.empty(1 << 20, np.uint32), np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def store(self, at: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Ids, end to end, of the pre-tokens numbered `at`."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.places) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at], self.sizes[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def learn(self) -> None:
        new, base = self.places.new, len(self.places) - len(self.places.new)
        # a space with letters: many in one text, as every id that begins such a pre-token, and no other, begins with a space
        spaced = [k for k, p in enumerate(new) if p[0] == " " and p[1:2].isalpha()]
        for lo in range(0, len(spaced), 4096):
            at = spaced[lo : lo + 4096]
            joined = "".join([new[k] for k in at])
            if self.added.search(joined):  # made by the joining: one by one below
                del spaced[lo:]
                break
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            heads = np.flatnonzero(self.begins[ids])
            self.store(np.array(at) + base, np.diff(np.append(heads, len(ids))), ids)
        single = set(spaced)
        other = [k for k in range(len(new)) if k not in single]
        for lo in range(0, len(other), 4096):
            at = other[lo : lo + 4096]
            ids = [e.ids for e in self.model.encode_batch_fast([new[k] for k in at], add_special_tokens=False)]
            self.store(np.array(at) + base, np.array([len(x) for x in ids]), np.array([i for x in ids for i in x]))
        self.places.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > self.most:
            self.clear()
        known = []
        for t in texts:
            found = None if self.other.search(t) else PRETOKEN.findall(t)
            known.append(None if found is None else np.fromiter(map(self.places.__getitem__, found), np.int64, len(found)))
        if self.places.new:
            self.learn()
        out = []
        for t, at in zip(texts, known):
            if at is None:
                out.append(np.array(self.model.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            out.append(self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)])
        return out


def tokenizer(path: str) -> PretokenMemory:
    """One for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = PretokenMemory(path)
    return _tokenizers[path]


class Packer:
    """Packs the items of one Spark task. Pieces come out as (item, start, length, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, first_id: int):
        self.limits, self.cut, self.next_id = np.array(limits, np.int64), cut, first_id
        self.open: list[tuple[int, int, int, int]] = []  # item, start, tokens, loss: left over from the block before
        self.full = int(limits[0])

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def pack(self, tokens: np.ndarray, loss: np.ndarray, last: bool = False, first_item: int = 0) -> list[tuple[int, int, int, int, int]]:
        """Places the given items, which are numbered from first_item, and keeps what doesn't fill a sequence for the next
        call, or with `last` places that too."""
        out, todo = [], self.open
        self.open = []
        for i, (n, m) in enumerate(zip(tokens.tolist(), loss.tolist())):
            at = 0
            while self.cut and n - at >= self.full and m == n and self.full <= self.limits[2]:
                out.append((first_item + i, at, self.full, self.new_id(), 0))
                at += self.full
            if n > at:
                todo.append((first_item + i, at, n - at, m - at if m == n else m))
        items = np.array(todo, np.int64).reshape(-1, 4)
        demand = np.stack([items[:, 2], np.ones(len(items), np.int64), items[:, 3]], 1)
        left = np.ones(len(items), bool)
        while left.any():
            offer, here, seq = self.limits.copy(), [], None
            while True:
                fits = left & (demand <= offer).all(1)
                if fits.any():
                    score = np.where(fits, demand @ (offer / self.limits**2), -1.0)
                    k = int(score.argmax())
                    here.append((k, int(items[k, 1]), int(demand[k, 0])))
                    offer -= demand[k]
                    left[k] = False
                elif self.cut and left.any() and (n := int(min(offer[0], offer[2]))) > 0 and offer[1] > 0:
                    k = int(np.where(left & (items[:, 2] == items[:, 3]), demand[:, 0], -1).argmax())
                    if not left[k] or items[k, 2] != items[k, 3]:
                        break
                    here.append((k, int(items[k, 1]), n))
                    items[k] += (0, n, -n, -n)
                    demand[k] -= (n, 0, n)
                    offer -= (n, 1, n)
                else:
                    break
            if not here:  # larger than a limit, and not to be cut
                k = int(left.argmax())
                here, left[k] = [(k, int(items[k, 1]), int(demand[k, 0]))], False
            elif offer[0] > 0 and not left.any():
                back = [(int(items[k, 0]), at, n, n if items[k, 2] == items[k, 3] else int(items[k, 3])) for k, at, n in here]
                if not last:
                    self.open = back
                    break
                if self.cut and all(b[2] == b[3] for b in back):
                    out += self.powers(back)
                    break
            seq, at = self.new_id(), 0
            for k, start, n in here:
                out.append((int(items[k, 0]), start, n, seq, at))
                at += n
        return out

    def powers(self, pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Cuts the last pieces into sequences whose lengths are powers of two, largest first."""
        out, total, k, at = [], sum(p[2] for p in pieces), 0, 0
        while total:
            size, offset, seq = 1 << (total.bit_length() - 1), 0, self.new_id()
            total -= size
            while offset < size:
                item, start, n, _ = pieces[k]
                take = min(n - at, size - offset)
                out.append((item, start + at, take, seq, offset))
                offset, at = offset + take, at + take
                if at == n:
                    k, at = k + 1, 0
        return out


def first_sequence() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 36


def pack_documents(
    docs: DataFrame, vocabulary: str, most_tokens: int = 2048, most_segments: int = 2048, most_loss: int = 2048, block: int = 1024
) -> DataFrame:
    """One row per piece of a document. A document's ids are those of its text and then id 1; all of them bear loss.

    vocabulary: path of a byte-level BPE file of the tokenizers library, present on every machine. block: documents that are
    packed together at a time, whatever the size of the input; what doesn't fill a sequence goes on to the next block.
    """

    def pack(batches):
        t, packer, waiting = tokenizer(vocabulary), Packer((most_tokens, most_segments, most_loss), True, first_sequence()), {}
        held: list[tuple] = []
        count = 0

        def pieces(last: bool):
            nonlocal held, count
            n = np.array([len(x[1]) for x in held], np.int64)
            for j, x in enumerate(held):
                waiting[count + j] = x
            rows = packer.pack(n, n, last, count)
            count, held = count + len(held), []
            cols = list(zip(*[
                (waiting[i][0], start, size, zlib.crc32(waiting[i][1][start : start + size].tobytes()), len(waiting[i][1]), seq, at, size)
                for i, start, size, seq, at in rows
            ]))
            still = {p[0] for p in packer.open}
            for i in [i for i in waiting if i not in still]:
                del waiting[i]
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

        for u in A.units(batches):
            texts = [x or "" for x in u.column("text").to_pylist()]
            for i, ids in zip(u.column("doc_id").to_pylist(), t.encode(texts)):
                held.append((i, np.append(ids, np.uint32(END_ID)).astype("<u4")))
            if len(held) >= block:
                yield from pieces(False)
        yield from pieces(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)


def pack_conversations(
    turns: DataFrame, vocabulary: str, most_tokens: int = 2048, most_segments: int = 16, most_loss: int = 1536, block: int = 1024
) -> DataFrame:
    """Packs whole conversations (conv_id, turn, role, text); the assistant's tokens bear loss. One row per conversation:
    conv_id, tokens, loss_tokens, sequence_id, offset, oversize. Turns are counted per conversation before packing, so a
    conversation of any length needs one sum. Turns with a null conv_id are one conversation."""

    def measure(batches):
        t = tokenizer(vocabulary)
        for batch in batches:
            n = [len(x) + 1 for x in t.encode([x or "" for x in batch.column("text").to_pylist()])]
            m = [k if r == "assistant" else 0 for k, r in zip(n, batch.column("role").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), A.longs(n), A.longs(m)], ["conv_id", "n", "m"])

    sizes = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text").mapInArrow(measure, "conv_id long, n long, m long")
        .groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum("m").alias("loss_tokens"))
    )

    def pack(batches):
        packer, seen, base = Packer((most_tokens, most_segments, most_loss), False, first_sequence()), {}, 0

        def out(rows):
            cols = list(zip(*[(seen[i][0], n, seen[i][2], seq, at) for i, _, n, seq, at in rows]))
            for r in rows:
                del seen[r[0]]
            over = [n > most_tokens or m > most_loss for n, m in zip(cols[1], cols[2])]
            arrays = [*(pa.array(c, pa.int64()) for c in cols), pa.array(over)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "tokens", "loss_tokens", "sequence_id", "offset", "oversize"])

        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                seen |= {base + j: row for j, row in enumerate(zip(*(c.to_pylist() for c in part.columns)))}
                rows = packer.pack(*(part.column(c).to_numpy() for c in ("tokens", "loss_tokens")), False, base)
                base += part.num_rows
                if rows:
                    yield out(rows)
        if rows := packer.pack(np.empty(0, np.int64), np.empty(0, np.int64), True):
            yield out(rows)

    return sizes.mapInArrow(pack, "conv_id long, tokens long, loss_tokens long, sequence_id long, offset long, oversize boolean")

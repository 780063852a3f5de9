"""Language-model scoring: a log-bilinear model with noise-contrastive training, and an add-0.1 unigram base beside it.

Tokens are the words of the text with A-Z lower-cased, then one end token. The model predicts an output symbol from the three
tokens before: r = sum of C_i * R[token i back] and score(symbol) = r . Q[symbol] + b[symbol]. The output has two levels. The
end token and the OWN most frequent words are symbols of the first level; every other word belongs to a class, by its last two
bytes. Inside a class the words of the LISTED most frequent have vectors and biases of their own, so that the model learns which
of them follows which context; the words that are not listed share one row, in which a word has its add-0.1 unigram share, with
one share for all unseen words. Both levels are normalised, so the probabilities of all words sum to one. The number of words
with vectors and of classes grows with the corpus up to LISTED, a bound that keeps the cost of a token the same at every size.
Training is noise-contrastive, in numpy inside Spark tasks over every training document: each task runs through
its own documents from the round's common parameters, and the parameters are averaged by tokens seen. A scoring task gets
the log-probabilities of all symbols by one matrix product per block of tokens, and those inside a class by one per class.

Word counts are exact over all training documents: frequent words (a bounded list) are counted in vectors, all other words
travel once, packed in hash buckets, with the document they are in, so that the bucket that counts a word also returns, packed
per unit of text, each document's sum of log counts.

Edge cases: a null text counts as empty and has only the end token; a null id hashes as the empty text and gets a row of its
own; repeated rows and rows with equal ids each count in the word counts and each get the score of their own text; an empty table gives an empty
result; without a training document counts and N are 0 and the base score is that of a uniform unseen word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .spread import buckets_for, materialise, vector_sum

OWN, LISTED, IN_CLASS, CONTEXT = 64, 16_384, 128, 2048
DEPTH, BACK, NOISE, BLOCK = 16, 3, 8, 1024
RATE, RATE_IN_CLASS = 0.1, 0.05
BUCKET_BYTES = 64 << 20  # text whose rare words meet in one bucket, about
END = np.array([0x1234567890ABCDEF], np.uint64)[0]  # the end token's place among the word hashes
ALPHA = 0.1
UNIT = 4 << 20
SENT = {"bucket": pa.int32(), "unit": pa.int64(), "words": pa.binary(), "docs": pa.binary(), "keys": pa.binary()}
SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with each text's end token, their last two bytes, offsets per text, and a hash of each text."""
    w = A.scan(texts, lower=True)
    acc = A.prefix(w.data)
    last = w.data[w.ends - 1].astype(np.int64) << 8 | w.data[np.maximum(w.ends - 2, w.starts)]
    at = w.first[1:]
    h = np.insert(A.span_hashes(acc, w.starts, w.ends), at, END)
    return h, np.insert(last, at, 0), w.first + np.arange(len(w.first)), A.span_hashes(acc, w.off[:-1], w.off[1:])


class Lexicon:
    """The frequent words: hashes in sorted order and ranks by count (the end token has rank 0), and the classes of words.

    The first `listed` words have output vectors. Those below rank OWN are symbols of the first level; the others are dealt to
    classes by their last two bytes, so that a class holds about IN_CLASS of them: an ending with more has several classes, by
    hash, and neighbouring rarer endings share one. Any word, seen or not, has a class. Rows of the second level lie class by
    class; the last row of a class stands for all its words that are not listed."""

    def __init__(self, hashes: np.ndarray, endings: np.ndarray):
        order = np.argsort(hashes)
        self.keys, self.rank, self.listed = hashes[order], order.astype(np.int64), min(LISTED, len(hashes))
        own = np.bincount(endings[OWN : self.listed], minlength=1 << 16)
        self.base, self.ways = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
        at = held = 0  # class that is being filled, and its words
        for k, n in enumerate(own.tolist()):
            if n >= IN_CLASS:
                at, held = at + (held > 0), 0
                self.base[k], self.ways[k] = at, round(n / IN_CLASS)
                at += self.ways[k]
            else:
                if held and held + n > IN_CLASS:
                    at, held = at + 1, 0
                self.base[k] = at
                held += n
        self.classes = int((self.base + self.ways).max())
        of = self.class_of(hashes, endings)[OWN : self.listed]
        sizes = np.bincount(of, minlength=self.classes) + 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.row_of_rank = np.zeros(self.listed, np.int64)
        turn = np.argsort(of, kind="stable")
        self.row_of_rank[OWN + turn] = self.starts[of[turn]] + np.arange(len(of)) - (np.cumsum(sizes - 1) - (sizes - 1))[of[turn]]

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word by frequency, or the number of words where it isn't one of them."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.rank[at], len(self.keys))

    def class_of(self, h: np.ndarray, endings: np.ndarray) -> np.ndarray:
        return self.base[endings] + ((h >> np.uint64(33)).astype(np.int64) & 0x7FFFFFFF) % self.ways[endings]

    def rows(self, rank: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Rows of the second level of words that have one (rank OWN or more)."""
        return np.where(rank < self.listed, self.row_of_rank[np.minimum(rank, self.listed - 1)], self.starts[cls + 1] - 1)

    @property
    def symbols(self) -> int:
        return OWN + self.classes

    @property
    def shapes(self) -> tuple[tuple[int, ...], ...]:
        rows = int(self.starts[-1])
        return (CONTEXT + self.classes + 1, DEPTH), (BACK, DEPTH), (self.symbols, DEPTH), (self.symbols,), (rows, DEPTH), (rows,)


def inputs_and_symbols(rank: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(rank < CONTEXT, rank, CONTEXT + cls), np.where(rank < OWN, rank, OWN + cls)


def contexts(x: np.ndarray, off: np.ndarray, none: int) -> np.ndarray:
    """For every token the BACK input ids before it in its text, nearest first; `none` stands before the text."""
    place = np.arange(len(x)) - np.repeat(off[:-1], np.diff(off))
    out = np.full((BACK, len(x)), none)
    for i in range(BACK):
        out[i, i + 1 :] = np.where(place[i + 1 :] > i, x[: len(x) - i - 1], none)
    return out


class LogBilinear:
    """Parameters in one flat vector: R inputs x DEPTH, C BACK x DEPTH, Q symbols x DEPTH, b symbols, and for the words inside
    their class Q2 rows x DEPTH and b2 rows."""

    def __init__(self, flat: np.ndarray, shapes: tuple[tuple[int, ...], ...]):
        self.flat, self.views, self.shapes, at = flat.astype(np.float32), [], shapes, 0
        for shape in shapes:
            n = math.prod(shape)
            self.views.append(self.flat[at : at + n].reshape(shape))
            at += n
        self.R, self.C, self.Q, self.b, self.Q2, self.b2 = self.views

    @classmethod
    def start(cls, shapes: tuple[tuple[int, ...], ...], share: np.ndarray, share2: np.ndarray) -> "LogBilinear":
        m = cls(np.random.default_rng(11).normal(0, 0.1, sum(map(math.prod, shapes))), shapes)
        m.C[:] = 1 / np.arange(1, BACK + 1)[:, None]
        m.b[:], m.b2[:] = np.log(share), np.log(share2)
        return m

    def log10_words(self, ctx: np.ndarray, symbols: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each symbol after its context and, for a class, of the row inside it."""
        tables = [self.R * c for c in self.C]
        r = tables[0][ctx[0]]
        for i in range(1, BACK):
            r += tables[i][ctx[i]]
        out = np.empty(len(symbols))
        for lo in range(0, len(symbols), BLOCK):
            out[lo : lo + BLOCK] = chosen(r[lo : lo + BLOCK] @ self.Q.T + self.b, symbols[lo : lo + BLOCK])
        # tokens of one class together
        tail = np.flatnonzero(symbols >= OWN)
        tail = tail[np.argsort((symbols[tail] - OWN).astype(np.uint16), kind="stable")]
        cuts = np.searchsorted(symbols[tail], np.arange(OWN, OWN + len(starts)))
        for k in np.flatnonzero(np.diff(cuts)):
            words = slice(starts[k], starts[k + 1])
            for lo in range(cuts[k], cuts[k + 1], BLOCK):
                at = tail[lo : min(lo + BLOCK, cuts[k + 1])]
                out[at] += chosen(r[at] @ self.Q2[words].T + self.b2[words], rows[at] - starts[k])
        return out / math.log(10)


def chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of each row at one place."""
    z -= z.max(1)[:, None]
    own = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return own - np.log(z.sum(1))


class Trainer:
    """Noise-contrastive estimation with Adagrad steps over blocks of tokens, for symbols and, with noise from all words that are
    in classes, for the words themselves: scores of words in one class then differ as their log probabilities do."""

    def __init__(self, model: LogBilinear, share: np.ndarray, share2: np.ndarray, rate: float = RATE, seed: int = 5):
        self.m, self.share, self.rate, self.seen = model, share, rate, 0
        self.rng, self.sums = np.random.default_rng(seed), [np.full(s, 1e-6, np.float32) for s in model.shapes[:4]]
        self.sums2 = np.full((len(share2), DEPTH + 1), 0.1, np.float32)
        self.prior, self.prior2 = (np.log(x * NOISE).astype(np.float32) for x in (share, share2))
        self.cdf2 = np.cumsum(share2)

    def run(self, ctx: np.ndarray, symbols: np.ndarray, rows: np.ndarray) -> None:
        for lo in range(0, len(symbols), BLOCK):
            self.step(ctx[:, lo : lo + BLOCK], symbols[lo : lo + BLOCK], rows[lo : lo + BLOCK])
        self.seen += len(symbols)

    def step(self, ctx: np.ndarray, s: np.ndarray, rows: np.ndarray) -> None:
        m = self.m
        parts_ = [m.R[c] for c in ctx]
        r = sum(p * c for p, c in zip(parts_, m.C))
        noise = self.rng.choice(len(self.share), NOISE, p=self.share)
        d_r, d_true, d_false = contrast(r, m.Q[s], m.b[s] - self.prior[s], m.Q[noise], m.b[noise] - self.prior[noise])
        g = scatter(s, np.column_stack([d_true[:, None] * r, d_true]), len(self.share))
        np.add.at(g, noise, np.column_stack([d_false.T @ r, d_false.sum(0)]))
        tail = np.flatnonzero(s >= OWN)
        if len(tail):
            d_r[tail] += self.step_in_classes(r[tail], rows[tail])
        g_C = np.stack([np.einsum("ij,ij->j", d_r, p) for p in parts_])
        g_R = scatter(ctx.ravel(), np.concatenate([d_r * c for c in m.C]), len(m.R))
        for v, grad, total in zip(m.views, (g_R, g_C, g[:, :DEPTH], g[:, DEPTH]), self.sums):
            grad = (grad / len(s)).astype(np.float32)
            total += grad * grad
            v += self.rate * grad / np.sqrt(total)

    def step_in_classes(self, r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A step of the words' own vectors; the gradient for r."""
        m = self.m
        noise = np.minimum(np.searchsorted(self.cdf2, self.rng.random(NOISE)), len(self.cdf2) - 1)
        d_r, d_true, d_false = contrast(r, m.Q2[rows], m.b2[rows] - self.prior2[rows], m.Q2[noise], m.b2[noise] - self.prior2[noise])
        kinds, which = np.unique(np.concatenate([rows, noise]), return_inverse=True)
        g = np.concatenate([np.column_stack([d_true[:, None] * r, d_true]), np.column_stack([d_false.T @ r, d_false.sum(0)])])
        g = scatter(which, g, len(kinds)).astype(np.float32)
        self.sums2[kinds] += g * g
        g *= RATE_IN_CLASS / np.sqrt(self.sums2[kinds])
        m.Q2[kinds] += g[:, :DEPTH]
        m.b2[kinds] += g[:, DEPTH]
        return d_r


def contrast(r: np.ndarray, q: np.ndarray, offset: np.ndarray, q_noise: np.ndarray, offset_noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the noise-contrastive log likelihood for r and for the scores of the tokens and of the noise; offsets hold the
    bias less the log of the noise's rate."""
    d_true = 1 / (1 + np.exp(np.einsum("ij,ij->i", r, q) + offset))
    d_false = -1 / (1 + np.exp(-(r @ q_noise.T + offset_noise)))
    return d_true[:, None] * q + d_false @ q_noise, d_true, d_false


def scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by place."""
    width = values.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), values.ravel(), n * width).reshape(n, width)


def frequent_words(docs: DataFrame, most: int, per_unit: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` words, most frequent first, with their last two bytes, by the sums of what units of text report as their own most frequent ones.
    The list only decides which words are counted in vectors and which in buckets; all counts are exact."""

    def report(batches):
        for u in A.units(batches, most=UNIT):
            h, ending, *_ = tokens(u.column("text"))
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            keep = np.argsort(-n, kind="stable")[:per_unit]
            keep = keep[n[keep] > 2]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), A.longs(ending[at[keep]]), A.longs(n[keep])], ["h", "ending", "n"])

    top = docs.select("text").mapInArrow(report, "h long, ending long, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    rows = top.orderBy(F.desc("n"), "h").limit(most).collect()
    rows = [(int(END.view(np.int64)), 0), *((r.h, r.ending) for r in rows if r.h != int(END.view(np.int64)))][: max(most, 1)]
    return np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows])


def score_documents(docs: DataFrame, folds: int = 10, frequent: int = 65_536, rounds: int = 2) -> DataFrame:
    """Scores every document, learning from those whose crc32(doc_id as text) mod folds is not 0.

    frequent: bound of the list of words that are counted in vectors. rounds: each round trains on the training documents
    whose fold number modulo rounds is its own, from the average of the round before; every training token is used once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds).cast("int")
    train = docs.filter(fold != 0)
    top, top_endings = frequent_words(train, frequent)
    words = Lexicon(top, top_endings)
    n_words, n_classes = len(words.keys), words.classes
    buckets = buckets_for(docs, BUCKET_BYTES)

    # the frequent words' counts, and what each class holds of words that are not listed
    def count(batches):
        n, shared = np.zeros(n_words + 1), np.zeros(n_classes)
        for u in A.units(batches):
            h, ending, *_ = tokens(u.column("text"))
            rank = words.ranks(h)
            n += np.bincount(rank, minlength=n_words + 1)
            other = rank >= max(words.listed, OWN)
            shared += np.bincount(words.class_of(h[other], ending[other]), minlength=n_classes)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (n, shared)], ["n", "shared"])

    total = vector_sum(train.select("text").mapInArrow(count, "n binary, shared binary"))
    counts, shared = (total[0], total[1]) if total else (np.zeros(n_words + 1), np.zeros(n_classes))
    own = counts[:OWN] if n_words >= OWN else np.append(counts[:-1], np.zeros(OWN - n_words))
    by_row = np.zeros(words.starts[-1])
    by_row[words.row_of_rank[OWN:]] = counts[OWN : words.listed]
    by_row[words.starts[1:] - 1] = shared
    share = np.concatenate([own, np.add.reduceat(by_row, words.starts[:-1])]) + 1.0
    share, share2 = share / share.sum(), (by_row + 1.0) / (by_row + 1.0).sum()

    # all other words: packed by hash bucket with their documents; a bucket counts them and sums up for each document
    def send(batches):
        for u in A.units(batches, most=UNIT):
            h, ending, off, text_hash = tokens(u.column("text"))
            keys = A.row_keys(u.column("doc_id"), text_hash)
            doc = np.repeat(np.arange(u.num_rows), np.diff(off))
            rare = words.ranks(h) == n_words
            h, doc, cls = h[rare], doc[rare], words.class_of(h[rare], ending[rare])
            bucket = (h >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((doc, bucket))
            h, cls, doc, bucket = h[order], cls[order], doc[order], bucket[order]
            learn = A.crc_mod(u.column("doc_id"), folds) != 0
            unit = int(A.mix(np.array([keys.sum()], np.uint64)).view(np.int64)[0])
            home, flags, rows = unit % buckets, A.pack(learn), []
            for b, lo, hi in A.stretches(bucket, home):
                s = slice(lo, hi)
                step = np.diff(doc[s], prepend=0)
                rows.append((b, unit, A.pack(h[s], step * n_classes + cls[s]), flags, A.pack(keys) if b == home else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SENT.values())], list(SENT))

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hs, classes, owner, learn, at = [], [], [], [], [0]
        for words_blob, flags in zip(table.column("words").to_pylist(), table.column("docs").to_pylist()):
            h, x = A.unpack(words_blob, 2)
            hs.append(h)
            classes.append((x % np.uint64(n_classes)).astype(np.int64))
            owner.append(np.cumsum(x // np.uint64(n_classes)).astype(np.int64) + at[-1])
            learn.append(A.unpack(flags, 1)[0] == 1)
            at.append(at[-1] + len(learn[-1]))
        h, cls, doc, learn = map(np.concatenate, (hs, classes, owner, learn))
        kinds, which = np.unique(h, return_inverse=True)
        c = np.bincount(which, weights=learn[doc], minlength=len(kinds))
        kind_class = np.zeros(len(kinds), np.int64)
        kind_class[which] = cls
        logs = np.bincount(doc, weights=np.log10(c + ALPHA)[which], minlength=at[-1])
        known = np.bincount(doc, weights=c[which] > 0, minlength=at[-1]).astype(np.int64)
        rare = np.bincount(doc, minlength=at[-1])
        sums = []
        for lo, hi in zip(at, at[1:]):
            has = np.flatnonzero(rare[lo:hi])
            sums.append(A.pack(np.diff(has, prepend=0), logs[lo:hi][has].view(np.uint64), known[lo:hi][has], rare[lo:hi][has]))
        stats = np.stack([np.bincount(kind_class, weights=x, minlength=n_classes) for x in (c, c > 0)])
        names = ["unit", "sums", "keys", "stats"]
        own = [table.column("unit"), pa.array(sums, pa.binary()), table.column("keys"), pa.nulls(len(sums), pa.binary())]
        one = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([stats.tobytes()], pa.binary())]
        return pa.concat_tables([pa.Table.from_arrays(own, names), pa.Table.from_arrays(one, names)])

    def combine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = A.unpack(next(k for k in table.column("keys").to_pylist() if k is not None), 1)[0]
        logs, known, rare = np.zeros(len(keys)), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for blob in table.column("sums").to_pylist():
            step, x, k, r = A.unpack(blob, 4)
            doc = np.cumsum(step).astype(np.int64)
            logs[doc] += x.view(np.float64)
            known[doc] += k.astype(np.int64)
            rare[doc] += r.astype(np.int64)
        return pa.Table.from_arrays([pa.array(keys.view(np.int64)), pa.array(logs), pa.array(known), pa.array(rare)], ["row", "logs", "known", "rare"])

    sent = docs.mapInArrow(send, "bucket int, unit long, words binary, docs binary, keys binary")
    answers = materialise(sent.groupBy("bucket").applyInArrow(answer, "unit long, sums binary, keys binary, stats binary"))
    found = vector_sum(answers.filter("stats IS NOT NULL").select("stats"))
    rare = found[0].reshape(2, n_classes) if found else np.zeros((2, n_classes))
    by_row = answers.filter("stats IS NULL").groupBy("unit").applyInArrow(combine, "row long, logs double, known long, rare long")
    partial = by_row.groupBy("row").agg(*(F.sum(x).alias(f"p_{x}") for x in ("logs", "known", "rare")))

    # totals: N tokens, V words, and per class of its words that are not listed
    c = counts[:-1]
    n_total, v_total = c.sum() + rare[0].sum(), (c > 0).sum() + rare[1].sum()
    more = slice(max(words.listed, OWN), None)
    shared_kinds = np.bincount(words.class_of(top[more], top_endings[more]), weights=c[more] > 0, minlength=n_classes)
    class_mass = np.log10(shared + ALPHA * (shared_kinds + rare[1] + 1))
    z_base = math.log10(n_total + ALPHA * (v_total + 1))
    log_c, seen = np.append(np.log10(c + ALPHA), 0.0), np.append(c > 0, False)

    # training, a round at a time
    model, shapes = LogBilinear.start(words.shapes, share, share2), words.shapes
    for k in range(rounds):
        flat = model.flat.copy()

        def learn(batches, flat=flat):
            t = Trainer(LogBilinear(flat, shapes), share, share2)
            for u in A.units(batches):
                h, ending, off, _ = tokens(u.column("text"))
                rank, cls = words.ranks(h), words.class_of(h, ending)
                x, s = inputs_and_symbols(rank, cls)
                t.run(contexts(x, off, shapes[0][0] - 1), s, words.rows(rank, cls))
            w = float(t.seen)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(t.m.flat.astype(np.float64) * w, w).tobytes()], pa.binary())], ["m"])

        mean = vector_sum(train.filter(fold % rounds == k).select("text").mapInArrow(learn, "m binary"))
        if mean is not None and mean[0][-1] > 0:
            model = LogBilinear(mean[0][:-1] / mean[0][-1], shapes)

    flat = model.flat

    def score(batches):
        m = LogBilinear(flat, shapes)
        for u in A.units(batches):
            h, ending, off, text_hash = tokens(u.column("text"))
            rank, cls = words.ranks(h), words.class_of(h, ending)
            x, s = inputs_and_symbols(rank, cls)
            # a word that is not listed has its add-0.1 share of those of its class
            other = rank >= max(words.listed, OWN)
            lp = m.log10_words(contexts(x, off, shapes[0][0] - 1), s, words.rows(rank, cls), words.starts) - np.where(other, class_mass[cls], 0.0)
            logs = log_c[rank]
            sums = [np.add.reduceat(v, off[:-1]) for v in (logs, lp + np.where(other, logs, 0.0))]
            counted = [A.per_text(seen[rank], off), A.per_text(rank == n_words, off)]
            yield pa.RecordBatch.from_arrays(
                [
                    u.column("doc_id"), pa.array(A.row_keys(u.column("doc_id"), text_hash).view(np.int64)),
                    pa.array(A.crc_mod(u.column("doc_id"), folds) == 0), A.longs(np.diff(off)), *map(A.longs, counted), *map(pa.array, sums),
                ],
                ["doc_id", "row", "held_out", "n_tokens", "known", "rare", "logs", "score"],
            )

    head = docs.mapInArrow(score, "doc_id long, row long, held_out boolean, n_tokens long, known long, rare long, logs double, score double")
    both = head.join(partial, "row", "left")
    # rows alike in id and text have sent their rare words together: each takes its own share of the sums
    share_of = F.coalesce(F.try_divide("rare", "p_rare"), F.lit(0.0))
    more = share_of * F.coalesce("p_logs", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.round(share_of * F.coalesce("p_known", F.lit(0)))).cast("long").alias("n_known"),
        F.lit(int(n_total)).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * z_base).alias("base_score"), (F.col("score") + more).alias("score"),
    )

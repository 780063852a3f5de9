"""Text vectors by latent semantic analysis: a randomised singular value decomposition of the TF-IDF matrix.

The features of a text are those of the lexical index (tokens weigh 1, canonical forms 0.7), hashed into a fixed number of
columns. They are made once, a row a word in the JVM, added up by text and written down as arrays; every pass reads these, and so does the encoding of the texts that
a model was made of. A pass multiplies the rows of a
task with a dense matrix of `rank + extra` columns (a few texts at a time, as a dense block over the features that they have) and, for the range
of the matrix, back with their transpose; tasks add up their products in memory and hand on a row for each block of 1024 features, which
Spark sums; there are two tasks a core at most, so that these products don't grow with the table. So the matrix itself is never moved, and what the driver holds is features * (rank + extra) numbers, fixed by parameters.

The model goes to every executor once, as a broadcast of features * rank single-precision numbers (16 MB by default), and texts are
encoded by an Arrow function. Vectors have length 1; their dot product is the cosine of texts in the latent space.

Edge cases: a null text is empty; a text without a feature has a zero vector, and so has every text under a model without texts; a null id is
kept; repeated rows count each; a text of any length is one row; extra columns are ignored; ranks beyond that of the matrix give
components that are zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..blocks import cosine_top, summed
from ..functions.text import is_word, split_identifier, token_of, tokenize
from ..session import materialise

STEP, CHUNK, ROWS = 1024, 1 << 14, 128
#: A text's features, each once, with their weights.
ENTRIES = "feature array<int>, weight array<double>"


@dataclass(frozen=True)
class LatentModel:
    idf: np.ndarray  # by feature
    basis: np.ndarray  # features by rank
    strength: np.ndarray  # singular values, falling

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("idf", self.idf.astype(np.float64).tobytes()), ("basis", self.basis.astype(np.float64).tobytes()), ("strength", self.strength.tobytes())]
        spark.createDataFrame(rows, "part string, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> LatentModel:
    part = {r.part: np.frombuffer(r.data) for r in spark.read.parquet(path).collect()}
    return LatentModel(part["idf"], part["basis"].reshape(len(part["idf"]), -1).astype(np.float32), part["strength"])


def hashed_features(docs: DataFrame, features: int, synonyms: list[list[str]] | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, whole, part): numbers of the features with weight 1 and of those with 0.7, repeats included."""
    t = tokenize(F.coalesce(F.col(text), F.lit("")), synonyms)
    number = lambda x: F.pmod(F.xxhash64(x), F.lit(features)).cast("int")
    d = docs.select(F.col(ident).alias("doc_id"), t.alias("t"))
    other = F.filter("t", lambda x: x["token"] != x["canonical"])
    return d.select("doc_id", F.transform("t", lambda x: number(x["token"])).alias("whole"), F.transform(other, lambda x: number(x["canonical"])).alias("part"))


def sparse_rows(batch: pa.RecordBatch, features: int):
    """(first row, rows, row, feature, weight) of stretches of the batch: entries by row and feature, each once."""
    n = batch.num_rows
    size = sum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("whole", "part"))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1).tolist(), n] if n else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        part = batch.slice(lo, hi - lo)
        keys, weights = [], []
        for column, w in (("whole", 1.0), ("part", 0.7)):
            lists = part.column(column)
            row = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
            keys.append(row * features + lists.flatten().to_numpy())
            weights.append(np.full(len(row), w))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        yield lo, hi - lo, key // features, key % features, np.bincount(at, np.concatenate(weights), len(key))


def added_up(features: int):
    """Arrow function from (whole, part) to ENTRIES."""

    def run(batches):
        for batch in batches:
            for _, n, row, feature, weight in sparse_rows(batch, features):
                ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feature.astype(np.int32), weight)], ["feature", "weight"])

    return run


def added_words(features: int):
    """Arrow function from rows (doc_id, place, whole, part) to doc_id and ENTRIES: a text begins at place 0, and what follows are its words' features."""

    def rows(ids: pa.Array, starts: np.ndarray, whole: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        n, row = len(starts), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(whole))))
        keys = [row[x >= 0] * features + x[x >= 0] for x in (whole, part)]
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.bincount(at, np.repeat([1.0, 0.7], [len(k) for k in keys]), len(key))
        ends = pa.array(np.searchsorted(key // features, np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key % features).astype(np.int32), weight)]
        return pa.RecordBatch.from_arrays([ids, *lists], ["doc_id", "feature", "weight"])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            # whole texts leave as soon as they are many words, or one text that is longer
            begins = np.flatnonzero(batch.column("place").to_numpy() == 0)
            if size >= 16 * CHUNK and len(begins) and size > batch.num_rows - begins[-1]:
                yield done([*waiting[:-1], batch.slice(0, begins[-1])])
                waiting = [batch.slice(begins[-1])]
                size = waiting[0].num_rows
        if size:
            yield done(waiting)

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        starts = np.flatnonzero(t.column("place").to_numpy() == 0)
        ids = pa.concat_arrays(t.column("doc_id").take(pa.array(starts)).chunks)
        return rows(ids, starts, *(t.column(c).to_numpy() for c in ("whole", "part")))

    return run


def entries(docs: DataFrame, features: int = 1 << 16, synonyms: list[list[str]] | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ENTRIES) of every text, its features as `hashed_features` has them. Words are rows, as work on rows is compiled and that on the elements of an array isn't."""
    number = lambda x: F.pmod(F.xxhash64(x), F.lit(features)).cast("int")
    kind = dict(docs.dtypes)[ident]
    # before the words of a text stands an empty one, which every text has
    words = F.concat(F.array(F.lit("")), split_identifier(F.coalesce(F.col(text), F.lit(""))))
    d = docs.select(F.col(ident).alias("doc_id"), F.posexplode(words).alias("place", "w"))
    d = d.select(F.when(F.col("place") == 0, F.col("doc_id")).alias("doc_id"), "place", F.lower("w").alias("w")).filter((F.col("place") == 0) | is_word(F.col("w")))
    token, canonical = token_of(F.col("w"), synonyms)
    d = d.select("doc_id", "place", token.alias("token"), canonical.alias("canonical")).filter((F.col("place") == 0) | is_word(F.col("token")))
    whole = F.when(F.col("place") == 0, -1).otherwise(number(F.col("token")))
    other = (F.col("place") > 0) & (F.col("token") != F.col("canonical"))
    part = F.when(other, number(F.col("canonical"))).otherwise(-1) if synonyms else F.lit(-1)  # without synonyms a token is its canonical form
    return d.select("doc_id", "place", whole.alias("whole"), part.alias("part")).mapInArrow(added_words(features), f"doc_id {kind}, {ENTRIES}")


def entries_of(batch: pa.RecordBatch):
    """(rows, row, feature, weight) of stretches of a batch of ENTRIES, as `sparse_rows` has them."""
    size = batch.column("feature").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = np.concatenate([[0], np.cumsum(size)]), batch.num_rows
    feature, weight = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("feature", "weight"))
    lo = 0
    while lo < n:
        hi = min(lo + ROWS, n, max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1))
        part = slice(at[lo], at[hi])
        yield hi - lo, np.repeat(np.arange(hi - lo), size[lo:hi]), feature[part], weight[part]
        lo = hi


def dense_block(rows: int, row: np.ndarray, feature: np.ndarray, v: np.ndarray, features: int, kind: type = float) -> tuple[np.ndarray, np.ndarray]:
    """(used, block): the features that the rows have, rising, and the rows over these."""
    seen = np.zeros(features, bool)
    seen[feature] = True
    used = np.flatnonzero(seen)
    block = np.zeros((rows, len(used)), kind)
    block[row, (np.cumsum(seen) - 1)[feature]] = v
    return used, block


def unit_entries(rows: int, row: np.ndarray, feature: np.ndarray, weight: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of the entries, each row of length 1."""
    v = weight * idf[feature]
    norm = np.sqrt(np.bincount(row, v * v, rows))
    return v / np.where(norm > 0, norm, 1)[row]


def added_by(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group (rising), n of them."""
    out = np.zeros((n, rows.shape[1]))
    if len(group):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _times(rows, row, feature, v, dense):
    return added_by(row, v[:, None] * dense[feature], rows)


def _blocks(total: np.ndarray):
    """Rows (block, data) of a matrix with a row a feature; blocks of zeros are left out."""
    for b in range(0, len(total), STEP):
        part = total[b : b + STEP]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([b // STEP], pa.int32()), pa.array([np.ascontiguousarray(part, float).tobytes()], pa.binary())], ["block", "data"])


def _whole(parts: dict[int, np.ndarray], features: int, width: int) -> np.ndarray:
    out = np.zeros((features, width))
    for b, data in parts.items():
        out[b * STEP : b * STEP + STEP] = data.reshape(-1, width)
    return out


def fit(docs: DataFrame, rank: int = 64, features: int = 1 << 16, extra: int = 16, passes: int = 6, seed: int = 1, synonyms: list[list[str]] | None = None) -> LatentModel:
    """Model of docs (text): the leading `rank` right singular vectors of its TF-IDF matrix, rows of length 1. passes: products with the matrix and
    its transpose before the last one; each brings the range found nearer to the leading vectors."""
    return fit_entries(materialise(entries(docs.withColumn("doc_id", F.lit(0)), features, synonyms)), rank, features, extra, passes, seed)


def fit_entries(rows: DataFrame, rank: int = 64, features: int = 1 << 16, extra: int = 16, passes: int = 6, seed: int = 1) -> LatentModel:
    """The model of stored `entries`."""
    spark, width = rows.sparkSession, rank + extra
    rows = rows.select("feature", "weight").coalesce(2 * spark.sparkContext.defaultParallelism)

    def count(batches):
        df = np.zeros((features, 1))
        for batch in batches:
            for _, _, feature, _ in entries_of(batch):
                df[:, 0] += np.bincount(feature, minlength=features)
        yield from _blocks(df)

    df = _whole(summed(rows.mapInArrow(count, "block int, data binary")), features, 1)[:, 0]
    idf = np.log(1 + rows.count() / (1 + df))
    q = np.random.default_rng(seed).normal(size=(features, width)).astype(np.float32)
    krylov: list[np.ndarray] = []
    for _ in range(passes):
        sent = spark.sparkContext.broadcast((idf, q))

        def there_and_back(batches, sent=sent):
            idf, q = sent.value
            total = np.zeros(q.shape)
            for batch in batches:
                for n, row, feature, weight in entries_of(batch):
                    used, block = dense_block(n, row, feature, unit_entries(n, row, feature, weight, idf), features, np.float32)
                    total[used] += block.T @ (block @ q[used])
            yield from _blocks(total)

        z = _whole(summed(rows.mapInArrow(there_and_back, "block int, data binary")), features, width)
        sent.unpersist()
        q = np.linalg.qr(z)[0].astype(np.float32)
        krylov.append(q)
    # the range is that of all passes together
    q = np.linalg.qr(np.concatenate(krylov, axis=1))[0].astype(np.float32) if krylov else q
    width = q.shape[1]
    sent = spark.sparkContext.broadcast((idf, q))

    def gram(batches):
        idf, q = sent.value
        total = np.zeros((width, width))
        for batch in batches:
            for n, row, feature, weight in entries_of(batch):
                used, block = dense_block(n, row, feature, unit_entries(n, row, feature, weight, idf), features, np.float32)
                y = (block @ q[used]).astype(float)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

    g = summed(rows.mapInArrow(gram, "block int, data binary")).get(0, np.zeros(width * width)).reshape(width, width)
    sent.unpersist()
    power, vectors = np.linalg.eigh(g)
    order = np.argsort(-power)[:rank]
    strength = np.sqrt(np.maximum(power[order], 0))
    basis = (q @ vectors[:, order]) * (strength > 1e-9 * max(1e-300, strength[0] if len(strength) else 0))
    # a singular vector has no sign of its own: its largest component is positive
    sign = np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return LatentModel(idf, (basis * np.where(sign < 0, -1, 1)).astype(np.float32), strength)


def encode(texts: DataFrame, model: LatentModel, ident: str = "doc_id", text: str = "text", synonyms: list[list[str]] | None = None) -> DataFrame:
    """(doc_id, embedding): the vector of every text, of length 1, or of zeros for a text without a known feature."""
    return encode_entries(entries(texts, len(model.idf), synonyms, ident, text), model)


def encode_entries(rows: DataFrame, model: LatentModel) -> DataFrame:
    """(doc_id, embedding) of `entries`."""
    features = len(model.idf)
    sent, kind = rows.sparkSession.sparkContext.broadcast((model.idf, model.basis)), dict(rows.dtypes)["doc_id"]

    def run(batches):
        idf, basis = sent.value
        for batch in batches:
            lo = 0
            for n, row, feature, weight in entries_of(batch):
                y = _times(n, row, feature, unit_entries(n, row, feature, weight, idf), basis)
                norm = np.linalg.norm(y, axis=1, keepdims=True)
                y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-12)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["doc_id", "embedding"])
                lo += n

    return rows.mapInArrow(run, f"doc_id {kind}, embedding array<double>")


def semantic_top(docs: DataFrame, queries: DataFrame, model: LatentModel, k: int = 10) -> DataFrame:
    """(q_id, vec_id, score): for every query (doc_id, text) the k texts nearest in the latent space, itself left out. The texts are encoded once."""
    as_vectors = lambda df: materialise(encode(df, model)).withColumnRenamed("doc_id", "vec_id")
    return cosine_top(as_vectors(docs), as_vectors(queries), k)


def embed(text: str, model: LatentModel, spark: SparkSession, synonyms: list[list[str]] | None = None) -> list[float]:
    """The vector of one text, as `search.hybrid_search` takes it."""
    return encode(spark.createDataFrame([(0, text)], "doc_id long, text string"), model, synonyms=synonyms).first().embedding

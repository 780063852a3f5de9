"""Recall of the near-duplicate stage by similarity: `python -m tests.llm.measure_near_duplicates [pairs]`.

Every text has one partner with some words replaced; a pair is found if one of the two is dropped. Prints, per band of the
Jaccard similarity of five-word shingles, the share of pairs found and their number.
"""

from __future__ import annotations

import collections
import random
import sys

from pyspark.sql import SparkSession

from tessera.llm import simhash


def pairs(n: int, seed: int = 5) -> list[tuple[str, str, float]]:
    """Texts of 60 to 600 words and their partners, with their similarity, from 0.5 to 1."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        words = [f"w{rng.randrange(20_000)}" for _ in range(rng.randrange(60, 600))]
        other = list(words)
        for k in rng.sample(range(len(words)), max(1, int(len(words) * rng.random() * 0.07))):
            other[k] = f"v{rng.randrange(20_000)}"
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        out.append((" ".join(words), " ".join(other), len(a & b) / len(a | b)))
    return out


def found(spark: SparkSession, n: int) -> dict[float, tuple[int, int]]:
    """(pairs found, pairs) by the lower end of the band."""
    made = pairs(n)
    rows = [(2 * i + k, p[k]) for i, p in enumerate(made) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    out: dict[float, tuple[int, int]] = collections.defaultdict(lambda: (0, 0))
    for i, (_, _, similarity) in enumerate(made):
        band = int(similarity * 20 + 1e-9) / 20
        got, all_ = out[band]
        out[band] = got + (2 * i + 1 not in kept), all_ + 1
    return dict(sorted(out.items()))


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    for band, (got, all_) in found(session, int(sys.argv[1]) if len(sys.argv) > 1 else 20_000).items():
        print(f"{band:.2f} {got / all_:.3f} {all_}")

"""Duplicate tables: pairs that are alike in name or columns are scored by name, columns and types.

A score of 0.55 or more of tables without a common column key takes a Jaccard similarity of their vocabularies of 4/9, however alike the names are. With a
common key it takes a likeness of names plus one of columns of at least 1, so one of the two is at least 0.5: the vocabularies, the column
keys or the name terms have a Jaccard similarity (of keys: a share of the larger set) of 0.5, or the codes' trigrams a Dice coefficient of 0.5.
So name terms and trigrams are posted together with each of the table's keys: names of one pattern alone don't make a pair.
Pairs come from a set-similarity join over these four sets. Of each set only the rarest elements are posted, so many that two sets
which share enough must meet in one (an element that most tables have is hardly ever among them); sets that meet are paired only if their
sizes allow the similarity and if what follows the common element in both is enough to reach it. All pairs found are scored in full.

Tables that post an element which more than PART sets post are compared with each other as a whole, as where elements are so common nearly all tables meet anyhow, each
pair many times: they are packed into blocks, and a pair of blocks is one row of a shuffle, in which a task counts what sets have in common by matrix products,
TILE tables of a side at a time. Only pairs that can reach the score leave the task, with their counts, so no pair is written down before it is known
to be one. The work still grows with the square of such tables, but at tens of nanoseconds a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import Catalog
from ..session import cut_lineage, materialise
from ..functions.text import canonical_terms, trigrams

KEEP, HIGH = 0.55, 0.72
#: Of each kind of set: the share of its own size that a set has in common with another one that is alike enough; how many times larger than the
#: other one it is at most; and the share of both sizes together that is common at least.
SHARES = {"vocabulary": (4 / 9, 9 / 4, 4 / 13), "keys": (1 / 2, 2, 1 / 4), "name_terms": (1 / 2, 2, 1 / 3), "grams": (1 / 3, 3, 1 / 4)}
#: Kinds that count only for tables with a common key.
WITH_KEY = ["name_terms", "grams"]
PART = 512
#: Tables of a block at most, and of a side that are compared at once; how many elements a matrix product takes.
BLOCK, TILE, WIDE = 8192, 1024, 2048
#: Sets that are counted in blocks.
COUNTED = ("grams", "name_terms", "vocabulary", "keys", "typed")
#: What is counted of a pair of tables: of grams, name terms and vocabulary how many are common and how many both have together; common keys, the
#: keys of the table with more of them, and common keys of one type.
COUNTS = ("grams", "grams_both", "names", "names_both", "words", "words_both", "exact", "largest", "alike")


def profiles(c: Catalog, synonyms: list[list[str]] | None = None) -> DataFrame:
    """One row per table: name terms (of name, code and comment), vocabulary (these and the columns' terms), distinct column keys, and the last type of each key."""
    terms = canonical_terms(F.col("code"), synonyms)
    cols = c.columns.select("table_id", "col_ord", terms.alias("t"), F.lower(F.coalesce("data_type", F.lit(""))).alias("type"))
    cols = cols.withColumn("key", F.array_join(F.array_sort("t"), "+"))
    last = cols.groupBy("table_id", "key").agg(F.max_by("type", "col_ord").alias("type"))
    types = last.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "type"))).alias("types"), F.collect_list("key").alias("keys"))
    words = cols.groupBy("table_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("of_columns"))
    none = F.array().cast("array<string>")
    comment = [] if "comment" not in c.tables.columns else [F.coalesce("comment", F.lit(""))]
    names = canonical_terms(F.concat_ws(" ", "name", "code", *comment), synonyms)
    t = c.tables.join(types, "table_id", "left").join(words, "table_id", "left").withColumn("names", names)
    plain = F.regexp_replace(F.lower("code"), "[^a-z0-9]", "")
    return t.select(
        "table_ord", "table_id", F.col("names").alias("name_terms"), plain.alias("plain"),
        F.when(plain != "", trigrams(plain)).otherwise(F.array(F.lit(""))).alias("grams"), F.array_union("names", F.coalesce("of_columns", none)).alias("vocabulary"),
        F.coalesce("keys", none).alias("keys"), F.coalesce("types", F.create_map().cast("map<string,string>")).alias("types"),
    )


def rarest(p: DataFrame) -> DataFrame:
    """(table_ord, table_id, kind, term, size, at): of each set of a table the rarest terms, by all tables, that it must share with a set alike."""
    own = [p.select("table_ord", "table_id", F.lit(k).alias("kind"), F.size(k).alias("size"), F.explode(k).alias("term")) for k in SHARES]
    posts = reduce(DataFrame.union, own)
    df = posts.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df"))
    share = F.coalesce(*(F.when(F.col("kind") == k, F.ceil(F.col("size") * v[0] - 1e-9)) for k, v in SHARES.items()))
    at = F.row_number().over(Window.partitionBy("table_id", "kind").orderBy("df", "term"))
    kept = posts.join(df, ["kind", "term"]).withColumn("at", at).filter((F.col("at") <= F.col("size") - share + 1) & (F.col("df") > 1))
    keys = p.select("table_id", F.explode("keys").alias("key")).withColumn("kind", F.explode(F.array(*map(F.lit, WITH_KEY))))
    keyed = kept.join(keys, ["table_id", "kind"]).withColumn("term", F.concat("term", F.lit("\x01"), "key"))
    shown = ["table_ord", "table_id", "kind", "term", "size", "at"]
    return kept.filter(~F.col("kind").isin(WITH_KEY)).select(*shown).union(keyed.select(*shown))


def candidate_pairs(posts: DataFrame) -> DataFrame:
    """(ord_a, table_a, ord_b, table_b) of tables that may be alike enough in one kind of set, each once; two tables whose posts are marked as `apart`, where
    there is such a column, make no pair."""
    posts = posts if "apart" in posts.columns else posts.withColumn("apart", F.lit(False))
    blocks = posts.groupBy("kind", "term").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("n")).filter("n > 1")
    placed = posts.join(blocks, ["kind", "term"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    placed = cut_lineage(placed.withColumn("x", F.pmod(F.xxhash64("table_id"), F.col("n")).cast("int")))
    side = lambda s, others, own, other: placed.select("kind", "term", F.col("x").alias(own), F.explode(others).alias(other), *(F.col(c).alias(f"{c}_{s}") for c in ("table_ord", "table_id", "size", "at", "apart")))
    # blocks x <= y of a term meet once; inside a block the order of the tables tells pairs from their mirror images
    met = side("l", F.sequence("x", F.col("n") - 1), "lo", "hi").join(side("r", F.sequence(F.lit(0), "x"), "hi", "lo"), ["kind", "term", "lo", "hi"])
    met = met.filter(((F.col("lo") < F.col("hi")) | (F.col("table_ord_l") < F.col("table_ord_r"))) & ~(F.col("apart_l") & F.col("apart_r")))
    rest = F.least(F.col("size_l") - F.col("at_l"), F.col("size_r") - F.col("at_r")) + 1

    def possible(times: float, share: float) -> Column:
        # this is the first common element in one of a pair's rows, so all other ones come after it in both sets
        return (F.col("size_l") <= times * F.col("size_r")) & (F.col("size_r") <= times * F.col("size_l")) & (rest >= share * (F.col("size_l") + F.col("size_r")) - 1e-9)

    met = met.filter(F.coalesce(*(F.when(F.col("kind") == k, possible(v[1], v[2])) for k, v in SHARES.items())))
    first = F.col("table_ord_l") < F.col("table_ord_r")
    ends = [F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")) for x, y in ("lr", "rl") for c in ("table_ord", "table_id")]
    return met.select(*(e.alias(n) for e, n in zip(ends, ("ord_a", "table_a", "ord_b", "table_b")))).distinct()


def compared_pairs(c: Catalog) -> DataFrame:
    """One row, compared: the number of pairs of tables, all of which are judged, most of them by sharing nothing."""
    n = F.count(F.lit(1))
    return c.tables.agg(F.call_function("div", n * (n - 1), F.lit(2).cast("long")).alias("compared"))


def _counted_pairs(p: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with COUNTS."""
    side = [p.drop("table_ord").select(*(F.col(n).alias(f"{n}_{x}" if n != "table_id" else f"table_{x}") for n in p.columns if n != "table_ord")) for x in "ab"]
    s = pairs.join(side[0], "table_a").join(side[1], "table_b")
    common = lambda of: F.size(F.array_intersect(f"{of}_a", f"{of}_b"))
    both = lambda of: F.size(f"{of}_a") + F.size(f"{of}_b")
    counts = [f(of) for of in ("grams", "name_terms", "vocabulary") for f in (common, both)]
    counts += [common("keys"), F.greatest(F.size("keys_a"), F.size("keys_b"), F.lit(1)), common("typed")]
    return s.select("ord_a", "table_a", "ord_b", "table_b", *(c.cast("int").alias(n) for n, c in zip(COUNTS, counts)))


def _lists(size: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)


PACKED = ["x int, ord array<bigint>, id array<string>", *(f"{k}_names array<string>, {k}_size array<int>, {k} array<int>" for k in COUNTED)]


def _pack(tables: pa.Table) -> pa.Table:
    """A block's tables as one row: for each kind of set its different elements, and the sets as sizes and numbers of elements."""
    t = tables.combine_chunks()
    column = lambda c: pa.concat_arrays(t.column(c).chunks)
    n = t.num_rows
    out = {"x": column("x").slice(0, 1), "ord": _lists([n], column("table_ord")), "id": _lists([n], column("table_id"))}
    for k in COUNTED:
        sets = column(k)
        found = sets.flatten().dictionary_encode()
        out[f"{k}_names"] = _lists([len(found.dictionary)], found.dictionary)
        out[f"{k}_size"] = _lists([n], sets.value_lengths())
        out[k] = _lists([len(found)], found.indices)
    return pa.table(out)


class _Side:
    """A block of tables, and the tiles of its sets."""

    def __init__(self, row: pa.RecordBatch, s: str):
        of = lambda c: row.column(f"{c}_{s}")[0].values
        self.ord, self.id = of("ord").to_numpy(), of("id")
        self.names = {k: of(f"{k}_names") for k in COUNTED}
        self.size = {k: of(f"{k}_size").to_numpy() for k in COUNTED}
        self.number = {k: of(k).to_numpy() for k in COUNTED}
        self.at = {k: np.concatenate([[0], np.cumsum(self.size[k], dtype=np.int64)]) for k in COUNTED}

    def entries(self, kind: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of the element) of a tile's sets."""
        at = self.at[kind]
        return np.repeat(np.arange(hi - lo), self.size[kind][lo:hi]), self.number[kind][at[lo] : at[hi]]


class _Tile:
    """Two tiles, and what their sets have in common."""

    def __init__(self, a: _Side, b: _Side, i: tuple[int, int], j: tuple[int, int], known: dict[str, np.ndarray]):
        self.a, self.b, self.i, self.j, self.known = a, b, i, j, known
        self.shape = (i[1] - i[0], j[1] - j[0])

    def _wide(self, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sets of both sides as matrices of zeros and ones over the elements that both sides have, WIDE of them at a time."""
        (ra, na), (rb, nb) = self.a.entries(kind, *self.i), self.b.entries(kind, *self.j)
        na = self.known[kind][na]
        seen = [np.zeros(len(self.b.names[kind]) + 1, bool) for _ in "ab"]
        seen[0][na], seen[1][nb] = True, True
        both = seen[0] & seen[1]
        both[-1] = False  # an element that only the left side has
        place = np.where(both, np.cumsum(both) - 1, -1)
        pa_, pb_ = place[na], place[nb]
        for lo in range(0, int(both.sum()), WIDE):
            x = [np.zeros((n, min(WIDE, int(both.sum()) - lo)), np.float32) for n in self.shape]
            for m, r, p in zip(x, (ra, rb), (pa_, pb_)):
                here = (p >= lo) & (p < lo + WIDE)
                m[r[here], p[here] - lo] = 1
            yield x[0], x[1]

    def all(self, kind: str) -> np.ndarray:
        total = np.zeros(self.shape, np.float32)
        for x, y in self._wide(kind):
            total += x @ y.T
        return total

    def of(self, kind: str, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of the pairs (r, c) alone: one by one where they are few."""
        if len(r) * 20 > self.shape[0] * self.shape[1]:
            return self.all(kind)[r, c]
        total = np.zeros(len(r), np.float32)
        for x, y in self._wide(kind):
            for lo in range(0, len(r), TILE):
                total[lo : lo + TILE] += np.einsum("ij,ij->i", x[r[lo : lo + TILE]], y[c[lo : lo + TILE]])
        return total

    def both(self, kind: str) -> np.ndarray:
        size = lambda s, at: s.size[kind][at[0] : at[1]].astype(np.float32)
        return size(self.a, self.i)[:, None] + size(self.b, self.j)

    def found(self, same: bool) -> pa.RecordBatch:
        """Pairs that can reach KEEP, with COUNTS; what is compared here leaves room for rounding, the score itself is worked out later."""
        keys, words, names = (self.all(k) for k in ("keys", "vocabulary", "name_terms"))
        size = [s.size["keys"][at[0] : at[1]].astype(np.float32) for s, at in ((self.a, self.i), (self.b, self.j))]
        largest = np.maximum(np.maximum(size[0][:, None], size[1]), 1)
        j = names / np.maximum(self.both("name_terms") - names, 1)
        rest = 0.45 * (0.5 * keys / largest + 0.5 * words / np.maximum(self.both("vocabulary") - words, 1)) + 0.1 * (keys > 0)
        least = KEEP - 1e-4
        ord_a, ord_b = self.a.ord[self.i[0] : self.i[1]], self.b.ord[self.j[0] : self.j[1]]
        wanted = rest + 0.45 * (0.6 + 0.4 * j) >= least
        wanted &= ord_a[:, None] < ord_b if same else ord_a[:, None] != ord_b
        r, c = np.nonzero(wanted)
        grams, grams_both = self.of("grams", r, c), self.both("grams")[r, c]
        name = np.maximum(j[r, c], 0.6 * 2 * grams / np.maximum(grams_both, 1) + 0.4 * j[r, c])
        kept = rest[r, c] + 0.45 * name >= least
        r, c, grams, grams_both = r[kept], c[kept], grams[kept], grams_both[kept]
        counts = [grams, grams_both, names[r, c], self.both("name_terms")[r, c], words[r, c], self.both("vocabulary")[r, c], keys[r, c], largest[r, c], self.of("typed", r, c)]
        ends = [(o[x], s.id.slice(at[0], at[1] - at[0]).take(pa.array(x))) for o, s, at, x in ((ord_a, self.a, self.i, r), (ord_b, self.b, self.j, c))]
        first = pa.array(ends[0][0] < ends[1][0])
        values = [pc.if_else(first, pa.array(x[k]), pa.array(y[k])) for x, y in (ends, ends[::-1]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*values, *(pa.array(x.astype(np.int32)) for x in counts)], ["ord_a", "table_a", "ord_b", "table_b", *COUNTS])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of the pairs of two blocks that can be alike enough."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            a, b = _Side(row, "a"), _Side(row, "b")
            lo, hi = row.column("lo")[0].as_py(), row.column("hi")[0].as_py()
            # the place of each element of the left side on the right one, where it is there
            known = {n: pc.fill_null(pc.index_in(a.names[n], value_set=b.names[n]), len(b.names[n])).to_numpy(zero_copy_only=False) for n in COUNTED}
            for i in range(0, len(a.ord), TILE):
                for j in range(0, len(b.ord), TILE):
                    tile = _Tile(a, b, (i, min(i + TILE, len(a.ord))), (j, min(j + TILE, len(b.ord))), known)
                    yield tile.found(lo == hi)


def dense_pairs(p: DataFrame) -> DataFrame:
    """(ord_a, table_a, ord_b, table_b, COUNTS) of the pairs of all tables of p that can be alike enough."""
    spark = p.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = p.count()
    # so many blocks that their pairs keep all tasks busy, unless they get small
    n = max(1, math.ceil(size / BLOCK), min(math.ceil(size / (BLOCK // 32)), math.ceil(math.sqrt(4 * n_parts))))
    rows = p.select(F.pmod(F.xxhash64("table_id"), F.lit(n)).cast("int").alias("x"), "table_ord", "table_id", *COUNTED)
    packed = materialise(rows.groupBy("x").applyInArrow(_pack, ", ".join(PACKED)))
    sets = [c for c in packed.columns if c != "x"]
    side = lambda s, own, other, others: packed.select(F.col("x").alias(own), F.explode(others).alias(other), *(F.col(c).alias(f"{c}_{s}") for c in sets)).repartition(2 * n * n, "lo", "hi")
    met = side("a", "lo", "hi", F.sequence("x", F.lit(n - 1))).join(side("b", "hi", "lo", F.sequence(F.lit(0), "x")), ["lo", "hi"])
    return met.mapInArrow(_compared, "ord_a long, table_a string, ord_b long, table_b string, " + ", ".join(f"{c} int" for c in COUNTS))


def duplicate_tables(c: Catalog, synonyms: list[list[str]] | None = None, ordered: bool = True) -> DataFrame:
    """(table_a, table_b, score, verdict, reasons) in order of score, then of the tables. ordered=False leaves them in any order, which saves a sort of all of them."""
    p = cut_lineage(profiles(c, synonyms).withColumn("typed", F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("\x01"), e["value"]))).drop("types"))
    posts = cut_lineage(rarest(p))
    by_term = posts.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df"))
    hot = by_term.filter(F.col("df") > PART).select("kind", "term")
    apart = materialise(posts.join(hot, ["kind", "term"], "left_semi").select("table_id").distinct())
    # posts of other elements are joined row by row, but for those of elements that only the tables compared apart have
    marked = posts.join(hot, ["kind", "term"], "left_anti").join(apart.withColumn("apart", F.lit(True)), "table_id", "left").withColumn("apart", F.col("apart").isNotNull())
    mixed = marked.groupBy("kind", "term").agg(F.min("apart").alias("only")).filter("NOT only").select("kind", "term")
    s = _counted_pairs(p, candidate_pairs(marked.join(mixed, ["kind", "term"], "left_semi")))
    if not apart.isEmpty():
        s = s.union(dense_pairs(p.join(apart, "table_id", "left_semi")))
    j = F.col("names") / F.greatest(F.lit(1), F.col("names_both") - F.col("names"))
    dice = 2.0 * F.col("grams") / F.greatest(F.lit(1), F.col("grams_both"))
    s = s.withColumn("name", F.greatest(j, 0.6 * dice + 0.4 * j))
    columns = 0.5 * F.col("exact") / F.col("largest") + 0.5 * F.col("words") / F.greatest(F.lit(1), F.col("words_both") - F.col("words"))
    s = s.withColumn("columns", columns).withColumn("types", F.when(F.col("exact") > 0, F.col("alike") / F.greatest("exact", F.lit(1))).otherwise(0.0))
    s = s.withColumn("raw", 0.45 * F.col("name") + 0.45 * F.col("columns") + 0.1 * F.col("types")).filter(F.col("raw") >= KEEP)
    reasons = F.filter(F.array(
        F.when(F.col("name") >= 0.8, "Nombres prácticamente idénticos").when(F.col("name") >= 0.5, "Nombres relacionados semánticamente"),
        F.when(F.col("exact") > 0, F.concat(F.col("exact").cast("string"), F.when(F.col("exact") == 1, " columna").otherwise(" columnas"), F.lit(" con el mismo nombre"))),
        F.when(F.col("columns") >= 0.6, "Vocabulario de columnas muy solapado"),
        F.when((F.col("types") >= 0.8) & (F.col("exact") > 0), "Tipos de dato coincidentes"),
    ), lambda x: x.isNotNull())
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("Similitud estructural moderada"))).otherwise(reasons)
    out = s.select("table_a", "table_b", F.round("raw", 3).alias("score"), F.when(F.col("raw") >= HIGH, "high").otherwise("medium").alias("verdict"), F.array_join(reasons, "; ").alias("reasons"), "ord_a", "ord_b")
    return (out.orderBy(F.desc("score"), "ord_a", "ord_b") if ordered else out).drop("ord_a", "ord_b")

"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Every document is its sequence of lines that hold a word. Suffixes are ranked by their first line (only lines found at least
twice stay in play), then by their first 2, 4, 8, ... lines: the rank of h + d lines comes from the ranks of h lines at a place
and d places on. A rank is an order-preserving number given after a range sort of the distinct pairs. Suffixes of equal rank at
a depth are an interval of the suffix array whose longest common prefix is at least that depth; doubling goes on until no
rank is found at two places. A place that is not the first one (by document and line) of an interval of min_lines or more is a
copy; its source is the first place of the deepest such interval. Copies on neighbouring lines with neighbouring sources are
one maximal repeated run. `repeated_runs` returns the runs, `drop_repeated_lines` deletes their lines, so of every run its first
place stays.

A line or interval that holds a large part of all places meets its rank in several salted tasks (`spread_join`).

Edge cases: a null text stays null; blank lines are in no run and stay; the order of documents is that of doc_id, null last,
then of a hash of the text; rows alike in id and text are one document and are treated alike; a repeat inside one document
counts; an empty table gives an empty result; extra columns of any name are kept, but for n_lines and n_removed, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .spread import let, materialise, spread_join

WORD = r"[^\x20\x09-\x0D]"
KEY = ["no_id", "doc", "text_hash"]


def key_columns(doc_id: Column, text: Column) -> list[Column]:
    key = doc_id.isNull(), F.coalesce(doc_id.cast("long"), F.lit(0)), F.xxhash64(text)
    return [c.alias(name) for c, name in zip(key, KEY)]


def line_places(docs: DataFrame) -> DataFrame:
    """(no_id, doc, text_hash, k, h1, h2): the k-th line that holds a word, by two 64-bit hashes."""
    lines = F.transform(
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")),
    )
    d = docs.select(*key_columns(F.col("doc_id"), F.col("text")), lines.alias("lines"))
    return d.select(*KEY, F.posexplode("lines").alias("k", "h")).select(*KEY, "k", "h.*")


def ranked(places: DataFrame, by: list[str]) -> DataFrame:
    """The values of `by` found at two places or more, with next_rank, a number in their order, n, and their first place;
    written down, so that the numbers stay as they are."""
    here = F.struct(*KEY, "k")
    groups = places.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first"), F.max(here).alias("last"))
    groups = groups.filter("first <> last").drop("last")
    return materialise(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("next_rank", F.monotonically_increasing_id()))


def intervals(docs: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """For every depth from min_lines on: (no_id, doc, text_hash, k, rank, first), the suffixes whose rank is found twice or more."""
    places, depth, by, levels = line_places(docs), 1, ["h1", "h2"], []
    while True:
        groups = ranked(places, by)
        if groups.isEmpty():
            return levels
        level = materialise(spread_join(places, groups, by, [*KEY, "k"]).select(*KEY, "k", F.col("next_rank").alias("rank"), "first"))
        if depth >= min_lines:
            levels.append((depth, level))
        d = depth if depth >= min_lines else min(depth, min_lines - depth)
        ahead = Window.partitionBy(*KEY).orderBy("k").rangeBetween(d, d)
        places = level.drop("first").withColumn("rank2", F.max("rank").over(ahead)).filter("rank2 IS NOT NULL")
        by, depth = ["rank", "rank2"], depth + d


def repeated_runs(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(no_id, doc, text_hash, k, lines, source): maximal runs of `lines` lines from the k-th on that stand at an earlier place
    too, source (no_id, doc, text_hash, k)."""
    here, copies = F.struct(*KEY, "k"), None
    for depth, level in intervals(docs, min_lines):
        new = level.filter(here != F.col("first")).select(*KEY, "k", F.struct(F.lit(depth).alias("depth"), "first").alias("found"))
        copies = new if copies is None else copies.unionByName(new)
    if copies is None:
        copies = line_places(docs.limit(0)).select(*KEY, "k", F.struct(F.lit(0).alias("depth"), here.alias("first")).alias("found"))
    copies = copies.groupBy(*KEY, "k").agg(F.max_by("found.first", "found.depth").alias("source"))
    # lines of one document whose sources move along with them have one offset
    offset = F.struct(F.col("source.no_id"), F.col("source.doc"), F.col("source.text_hash"), (F.col("k") - F.col("source.k")).alias("by"))
    order = Window.partitionBy(*KEY).orderBy("k")
    copies = copies.withColumn("offset", offset).withColumn("starts", F.coalesce(
        (F.lag("k").over(order) != F.col("k") - 1) | (F.lag("offset").over(order) != F.col("offset")), F.lit(True)
    ))
    runs = copies.withColumn("run", F.sum(F.col("starts").cast("long")).over(order))
    runs = runs.groupBy(*KEY, "run").agg(F.min("k").alias("k"), (F.count(F.lit(1)) + min_lines - 1).alias("lines"), F.min_by("source", "k").alias("source"))
    return runs.drop("run")


def drop_repeated_lines(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines (lines with a word) and n_removed."""
    gone = repeated_runs(docs, min_lines).select(*KEY, F.explode(F.sequence("k", (F.col("k") + F.col("lines") - 1).cast("int"))).alias("k"))
    gone = gone.groupBy(*KEY).agg(F.collect_set("k").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key_columns(F.col("doc_id"), F.col("text")))
    d, text = rows.join(gone, KEY, "left"), F.col("row.text")

    def with_words(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())

    def without(lines: Column, full: Column) -> Column:
        out = F.transform("gone", lambda k: F.get(full, k))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out), lambda i: F.get(lines, i)), "\n")

    kept = let(F.split(text, "\n"), lambda lines: let(with_words(lines), lambda full: without(lines, full)))
    n_lines = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    counts = {"n_lines": F.coalesce(n_lines, F.lit(0)), "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))}
    columns = [
        F.when(F.col("gone").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns if c not in counts
    ]
    return d.select(*columns, *(c.cast("long").alias(name) for name, c in counts.items()))

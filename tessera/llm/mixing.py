"""Mixing sources to target weights, in DataFrame functions only: Pfair scheduling of source blocks, earliest deadline first.

A source's documents, in a fixed pseudo-random order, fill blocks of equal text size. With the share a of all H shares, block
j of a source is released at slot floor(j * H / a) and due at slot ceil((j + 1) * H / a); every slot takes the released block
with the earliest deadline (ties: the first source in order of name). Shares are the target weights in units of 2**-40, so
their rounding moves no block: after any number of slots, each source that has blocks left is less than one block from its
target. All blocks of the input are scheduled; the schedule does not repeat. A document is placed whole where its first block
is, so the text of whole documents is less than one block plus the source's longest document from the target.

A source that has run out takes no slots, and slots in which no block is released stay empty; `on_target` marks the documents
before the first slot that is empty or after which a source that has run out is a block or more behind its target.

The schedule is a run over the blocks, one step each, on one row: first the state at every STEPS-th block, then all stretches
in between side by side. A step looks at every source, so this is made for thousands of sources, not for millions; the number
of blocks is bounded (`most_blocks`), beyond which blocks grow with the input.

Ranks inside a source come from 4096 buckets of the order's hash: sums per bucket, their running totals, and a running sum
inside the bucket, so that a source with a third of all rows is spread like any other.

Edge cases: a null source is a source of its own; a null or empty text has size 0 and shares its neighbour's block; repeated
rows get neighbouring places; ties in the order are broken by id and text; one source gets all slots; an empty table gives an
empty result; target weights of sources that have no document are left out; documents of a source with weight 0, or not named
in the weights where `other` is 0, have no slot (null) and are not on target; a null id is ordered by a hash of its text; extra
columns of any name are kept, but for the four that are added, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .spread import materialise, parts

NO_SOURCE = "\x00"
ADDED = ["mix_block", "mix_slot", "mix_start", "on_target"]
STEPS = 256  # blocks of a stretch of the schedule


def shares_of(sizes: DataFrame, weights: dict[str, float] | None, total: int, other: float = 0.0) -> DataFrame:
    """(mix_source, share) and the other columns of sizes, from (mix_source, size): shares of about `total`, at least 1 for a
    weight above 0; sources of weight 0 are left out. Without weights, the target of a source is in proportion to the square root of
    its size. One window over all sources: they are counted in thousands at most, never in rows."""
    if weights is None:
        w = F.sqrt(F.greatest("size", F.lit(1)).cast("double"))
    else:
        w = F.coalesce(*(F.when(F.col("mix_source") == k, float(v)) for k, v in weights.items()), F.lit(float(other)))
    all_ = Window.partitionBy(F.lit(0))
    share = F.greatest(F.lit(1), F.round(total * F.col("w") / F.sum("w").over(all_))).cast("long")
    return sizes.withColumn("w", w).filter("w > 0").withColumn("share", share).drop("w", "size")


def schedule(shares: DataFrame) -> DataFrame:
    """(mix_source, share, turn, place, ends): the slot number `place` of the source's block number `turn`, for its first
    `blocks` blocks (without that column: one period, as many blocks as shares). ends: the first slot off target."""
    if "blocks" not in shares.columns:
        shares = shares.withColumn("blocks", F.col("share"))
    one = shares.agg(F.array_sort(F.collect_list(F.struct("mix_source", "share", "blocks"))).alias("s"))
    one = one.withColumns({"a": F.transform("s", lambda x: x["share"]), "n": F.transform("s", lambda x: x["blocks"])})
    one = one.withColumns({c: F.aggregate(x, F.lit(0).cast("long"), lambda p, q: p + q) for c, x in (("h", "a"), ("m", "n"))}).filter("h > 0 AND m > 0")

    def div(x: Column, y: Column) -> Column:
        return F.call_function("div", x, y)

    def after(c: Column, a: Column, h: Column) -> Column:
        """Due slot of block c: ceil((c + 1) * h / a)."""
        return div(c + 1, a) * h + div((c + 1) % a * h + a - 1, a)

    def release(c: Column, a: Column, h: Column) -> Column:
        return div(c, a) * h + div(c % a * h, a)

    def step(counts: Column, t: Column) -> tuple[Column, Column]:
        """The slot of the next block and its source's number, from the blocks placed and the next free slot."""
        def window(c: Column, i: Column) -> Column:
            a = F.get("a", i)
            return F.when(c < F.get("n", i), F.struct(F.greatest(release(c, a, F.col("h")), t).alias("at"), after(c, a, F.col("h")).alias("due"), i.alias("i")))

        # the earliest slot in which a block is released, and there the earliest deadline
        return F.array_min(F.transform(counts, window))

    def moved(state: Column) -> Column:
        return F.aggregate(F.array(step(state["counts"], state["t"])), state, lambda s, p: F.struct(
            F.transform(s["counts"], lambda c, k: F.when(k == p["i"], c + 1).otherwise(c)).alias("counts"), (p["at"] + 1).alias("t"), p["i"].alias("i")
        ))

    zero = F.lit(0).cast("long")
    start = F.struct(F.transform("a", lambda x: zero).alias("counts"), zero.alias("t"), F.lit(0).alias("i"))
    few = lambda k: F.sequence(F.lit(1).cast("long"), F.least(F.lit(STEPS).cast("long"), F.col("m") - k * STEPS))
    last = lambda x: F.element_at(x, -1)
    stretches = F.sequence(zero, div(F.col("m") - 1, F.lit(STEPS).cast("long")))
    states = F.aggregate(stretches, F.array(start), lambda x, k: F.concat(x, F.array(F.aggregate(few(k), last(x), lambda s, _: moved(s)))))
    part = one.select("s", "a", "n", "h", "m", F.posexplode(states).alias("k", "state")).filter(F.col("k") * STEPS < F.col("m"))
    part = part.repartition("k")
    placed = F.aggregate(few(F.col("k").cast("long")), F.array("state"), lambda x, _: F.concat(x, F.array(moved(last(x)))))
    rows = part.select("s", "k", F.posexplode(placed).alias("o", "x")).filter("o > 0")
    rows = rows.select(
        F.get("s", F.col("x.i")).alias("y"), (F.get("x.counts", F.col("x.i")) - 1).alias("turn"), (F.col("x.t") - 1).alias("place"),
        (F.col("k").cast("long") * STEPS + F.col("o") - 1).alias("rank"),
    ).select("y.mix_source", "y.share", "turn", "place", "rank")
    late = one.select(F.array_min(F.transform("s", lambda x: after(x["blocks"], x["share"], F.col("h")) - 1)).alias("late"))
    gap = rows.agg(F.min(F.when(F.col("place") > F.col("rank"), F.col("rank"))).alias("gap"))
    ends = gap.crossJoin(late).select(F.least("gap", "late").alias("ends"))
    return rows.drop("rank").crossJoin(F.broadcast(ends))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, other: float = 0.0, block_chars: int = 65_536, shares: int = 1 << 40,
    most_blocks: int = 1 << 20,
) -> DataFrame:
    """All rows of docs with mix_block, mix_slot, mix_start (characters of its source before the document) and on_target.
    The mixed order is that of mix_slot, then mix_start.

    other: weight of every source that weights doesn't name. Blocks have block_chars characters, or more where the input has
    more than most_blocks blocks of that size, so that the schedule, which is one task's work, has a bounded length."""
    # columns of the documents get numbered names, so that none clashes and what the caller doesn't take is never shuffled
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    text, doc_id = F.col(own["text"]), F.col(own["doc_id"])
    order = F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), F.xxhash64(text).cast("string"))))
    d = docs.toDF(*own.values())
    d = d.withColumns({
        "mix_source": F.coalesce(own["source"], F.lit(NO_SOURCE)), "mix_size": F.coalesce(F.length(text), F.lit(0)).cast("long"),
        "mix_order": order, "mix_hash": F.xxhash64(text), "mix_bucket": F.substring(order, 1, 3),
    })
    sums = materialise(d.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("size")))
    total = sums.agg(F.sum("size")).first()[0] or 0
    block_chars = max(block_chars, -(-total // most_blocks))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("mix_source", "mix_bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("mix_offset"))
    sizes = sums.groupBy("mix_source").agg(F.sum("size").alias("size"))
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("size") / block_chars)).cast("long"))
    plan = schedule(shares_of(sizes, weights, shares, other))
    inner = (
        Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_order", doc_id.asc_nulls_last(), "mix_hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = d.withColumn("mix_inner", F.coalesce(F.sum("mix_size").over(inner), F.lit(0)))
    placed = placed.join(offsets, ["mix_source", "mix_bucket"]).withColumn("mix_start", F.col("mix_offset") + F.col("mix_inner"))
    # a document of size 0 is in the block of the character before it, so that none starts behind the last block
    first = F.greatest(F.lit(0), F.col("mix_start") - (F.col("mix_size") == 0).cast("long"))
    placed = placed.withColumn("mix_block", F.floor(first / block_chars))
    slots = plan.select("mix_source", F.col("turn").alias("mix_block"), F.col("place").alias("mix_slot"), "ends")
    placed = placed.join(F.broadcast(slots), ["mix_source", "mix_block"], "left")  # at most most_blocks rows and one a source
    on_target = F.coalesce(F.col("mix_slot") < F.col("ends"), F.lit(False))
    kept = [F.col(name).alias(c) for c, name in own.items() if c not in ADDED]
    return placed.select(*kept, "mix_block", "mix_slot", "mix_start", on_target.alias("on_target"))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """All rows of docs, in files and rows in the mixed order."""
    n = parts(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    mixed = mix_sources(docs.select("doc_id", "text", "source", row), **options).repartitionByRange(n, F.asc_nulls_last("mix_slot"), "mix_start")
    return mixed.sortWithinPartitions(F.asc_nulls_last("mix_slot"), "mix_start", "doc_id").select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))

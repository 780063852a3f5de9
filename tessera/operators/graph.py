"""Foreign-key graph: tables are vertices, references edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import Catalog
from ..session import cut_lineage, materialise

#: Tables in the cycles of a piece, and how many times its trail they are at least, so that few whole trails are written; tables in a batch of listed cycles.
PIECE, WHOLE_TRAIL, BATCH = 1_000_000, 32, 200_000


def both_ways(refs: DataFrame) -> DataFrame:
    """(a, b) for each end of each reference."""
    return refs.select(F.col("parent_table").alias("a"), F.col("child_table").alias("b")).union(refs.select("child_table", "parent_table"))


def relation_counts(c: Catalog) -> DataFrame:
    """Degree of every table with parallel references, a self-reference counting twice; unresolved ends are listed too."""
    ends = both_ways(c.refs).groupBy(F.col("a").alias("table_id")).agg(F.count(F.lit(1)).alias("relations"))
    return c.tables.select("table_id").join(ends, "table_id", "full").select("table_id", F.coalesce("relations", F.lit(0)).alias("relations"))


def distinct_degree(c: Catalog) -> DataFrame:
    near = both_ways(c.refs).distinct().groupBy(F.col("a").alias("table_id")).agg(F.count(F.lit(1)).alias("degree"))
    return c.tables.select("table_id").join(near, "table_id", "left").select("table_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def adjacency(c: Catalog) -> DataFrame:
    """(table_id, neighbours): the distinct neighbours of every table; tables without references have none, and ends of
    references that are no table are listed too."""
    near = both_ways(c.refs).groupBy(F.col("a").alias("table_id")).agg(F.array_sort(F.collect_set("b")).alias("neighbours"))
    return c.tables.select("table_id").join(near, "table_id", "full").select("table_id", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))


def neighbours_within(c: Catalog, start: str, hops: int) -> DataFrame:
    """(table_id, hop): tables at most `hops` references away, without the start; one join per hop, no loop over rows. From the
    second hop on what was found is written down, so that no hop repeats those before."""
    edges = both_ways(c.refs).distinct()
    seen = c.tables.sparkSession.createDataFrame([(start, 0)], "table_id string, hop int")
    if hops > 1:
        edges = cut_lineage(edges)
    for hop in range(1, hops + 1):
        front = seen.filter(F.col("hop") == hop - 1).join(edges, F.col("table_id") == F.col("a")).select(F.col("b").alias("table_id")).distinct()
        seen = seen.union(front.join(seen, "table_id", "left_anti").withColumn("hop", F.lit(hop)))
        if hop < hops:
            seen = cut_lineage(seen)
    return seen.filter("hop > 0")


def heat_bin(value: Column, low: Column, high: Column) -> Column:
    share = (value - low) / F.nullif(high - low, F.lit(0))
    return F.when(high <= low, 0).when(share < 0.25, 0).when(share < 0.5, 1).when(share < 0.75, 2).otherwise(3)


def heat(values: DataFrame, value: str) -> DataFrame:
    """Adds `bin` 0..3 by the range of the values over all rows."""
    ends = values.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return values.crossJoin(F.broadcast(ends)).withColumn("bin", heat_bin(F.col(value), F.col("low"), F.col("high"))).drop("low", "high")


def prefix_groups(c: Catalog) -> DataFrame:
    """(prefix, table_ord, table_id): tables by what stands before the first underscore of their code."""
    prefix = F.when(F.instr("code", "_") > 0, F.substring_index("code", "_", 1)).otherwise("(sin prefijo)")
    return c.tables.select(prefix.alias("prefix"), "table_ord", "table_id")


def semantic_flags(c: Catalog) -> DataFrame:
    """no_pk, orphan, god, fk_no_index and nullable_key per table."""
    from .lint import effective_pk

    pk = effective_pk(c).select("table_id", "pk")
    n = c.columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    fk = c.refs.select(F.explode("joins").alias("j")).select(F.col("j.child_column").alias("column_id")).distinct()
    covered = c.indexes.select(F.get("columns", F.lit(0)).alias("column_id")).union(c.keys.select(F.explode("columns")))
    bare = c.columns.join(fk, "column_id", "left_semi").join(covered, "column_id", "left_anti").select("table_id").distinct().withColumn("bare", F.lit(True))
    loose = c.columns.join(pk, "table_id").filter(F.array_contains("pk", F.col("column_id")) & ~F.col("mandatory")).select("table_id").distinct().withColumn("loose", F.lit(True))
    many = c.tables.agg((F.count(F.lit(1)) > 1).alias("many"))
    t = pk.join(n, "table_id", "left").join(distinct_degree(c), "table_id").join(bare, "table_id", "left").join(loose, "table_id", "left").crossJoin(F.broadcast(many))
    no = F.lit(False)
    return t.select(
        "table_id", ((F.size("pk") == 0) & (F.coalesce("n", F.lit(0)) > 0)).alias("no_pk"), ((F.col("degree") == 0) & F.col("many")).alias("orphan"),
        (F.col("degree") >= 8).alias("god"), F.coalesce("bare", no).alias("fk_no_index"), F.coalesce("loose", no).alias("nullable_key"),
    )


def shortest_path(c: Catalog, start: str, end: str) -> DataFrame:
    """(step, table_id) of a shortest way over references in either direction, empty if there is none. Of equal ways the first
    in breadth-first order is taken, neighbours in the order of their references: a way's key is the list of the orders of its
    steps, so the least key wins and no table has to be numbered."""
    spark = c.tables.sparkSession
    ends = [c.refs.select(F.col(a).alias("a"), F.col(b).alias("b"), "ref_ord") for a, b in (("parent_table", "child_table"), ("child_table", "parent_table"))]
    edges = cut_lineage(ends[0].union(ends[1]).filter("a <> b").groupBy("a", "b").agg(F.min("ref_ord").alias("ref_ord")))
    front = spark.createDataFrame([(start, [start], [])], "b string, path array<string>, key array<long>")
    seen = front.select("b")
    while True:
        found = front.filter(F.col("b") == end).select("path")
        if not found.isEmpty() or front.isEmpty():
            return found.select(F.posexplode("path").alias("step", "table_id"))
        key = F.concat("key", F.array("ref_ord"))
        ways = front.withColumnRenamed("b", "a").join(edges, "a").join(seen, "b", "left_anti").select("b", F.concat("path", F.array("b")).alias("path"), key.alias("key"))
        front = cut_lineage(ways.groupBy("b").agg(F.min_by("path", "key").alias("path"), F.min("key").alias("key")))
        seen = cut_lineage(seen.union(front.select("b")))


def shortest_paths(c: Catalog, pairs: DataFrame) -> DataFrame:
    """(start, end, length, path) for every pair (start, end: table ids) with a way over references in either direction; of equal ways the one that
    `shortest_path` takes. A pair of a table with itself has length 0. Repeated pairs count once; pairs with a null or without a way have no row.

    All pairs are searched at once, from both ends: the starts share one front and the ends another, and in each step the front with fewer rows moves on
    by one reference. A pair whose way has as many references as both fronts have gone is met where the two now stand, for the first time, so only
    the fronts meet, never all that was seen. Pairs that are met, and pairs one of whose fronts has come to its end, leave, and their fronts with them."""
    ends = [c.refs.select(F.col(a).alias("node"), F.col(b).alias("next"), "ref_ord") for a, b in (("parent_table", "child_table"), ("child_table", "parent_table"))]
    edges = materialise(ends[0].union(ends[1]).filter("node <> next").groupBy("node", "next").agg(F.min("ref_ord").alias("ref_ord")))
    open_ = materialise(pairs.select("start", "end").filter("start IS NOT NULL AND end IS NOT NULL").distinct())
    none = F.array().cast("array<long>")
    fronts = {side: open_.select(side, F.col(side).alias("node"), F.array(side).alias("path"), none.alias("key")).distinct() for side in ("start", "end")}
    fronts = {side: materialise(f) for side, f in fronts.items()}
    seen = {side: f.select(side, "node") for side, f in fronts.items()}
    results, length = None, 0
    while True:
        there = fronts["end"].withColumnsRenamed({"path": "rest", "key": "rest_key"})
        ways = open_.join(fronts["start"], "start").join(there, ["end", "node"])
        path, key = F.concat("path", F.slice("rest", F.lit(2), F.size("rest"))), F.concat("key", "rest_key")
        # keys have one length, so the least of a pair is that of the first way
        met = materialise(ways.groupBy("start", "end").agg(F.min_by(path, key).alias("path")).select("start", "end", F.lit(length).alias("length"), "path"))
        results = met if results is None else results.union(met)
        open_ = open_.join(met, ["start", "end"], "left_anti")
        for side, f in fronts.items():
            open_ = open_.join(f.select(side).distinct(), side, "left_semi").select("start", "end")
        open_ = materialise(open_)
        if open_.isEmpty():
            return results
        fronts = {side: f.join(open_.select(side).distinct(), side, "left_semi") for side, f in fronts.items()}
        side = min(fronts, key=lambda x: fronts[x].count())
        step = [F.concat("path", F.array("next")), F.concat("key", F.array("ref_ord"))]
        if side == "end":
            step = [F.concat(F.array("next"), "path"), F.concat(F.array("ref_ord"), "key")]
        moved = fronts[side].join(edges, "node").select(side, F.col("next").alias("node"), step[0].alias("path"), step[1].alias("key"))
        moved = moved.join(seen[side], [side, "node"], "left_anti")
        fronts[side] = materialise(moved.groupBy(side, "node").agg(F.min_by("path", "key").alias("path"), F.min("key").alias("key")))
        seen[side] = seen[side].union(fronts[side].select(side, "node"))
        length += 1


def path_edges(c: Catalog, path: DataFrame) -> DataFrame:
    """(ref_id) of all references, parallel ones too, between neighbours on the path (step, table_id)."""
    nxt = path.select((F.col("step") - 1).alias("step"), F.col("table_id").alias("b"))
    pairs = path.withColumnRenamed("table_id", "a").join(nxt, "step").select("a", "b")
    both = pairs.union(pairs.select("b", "a")).toDF("parent_table", "child_table").distinct()
    return c.refs.join(both, ["parent_table", "child_table"], "left_semi").select("ref_id")


def _walk(part: pd.DataFrame, piece: int) -> pd.DataFrame:
    """Depth-first walk of one connected part (kind 0: tables by rank; kind 1: references by rank). A cycle is the end of the walk's trail from `first` on; of the
    trail a row has only what was added beyond the first `keep` tables of the row before, so that rows are about as many words as there are tables, however
    long the cycles. A piece of rows, whose cycles have some `piece` tables, begins with a whole trail and can be listed by itself."""
    part = part.sort_values(["kind", "rank"])
    ranks = dict(part.loc[part.kind == 0, ["a", "rank"]].itertuples(index=False))
    near: dict[str, list[str]] = {t: [] for t in ranks}
    for a, b in part.loc[part.kind == 1, ["a", "b"]].itertuples(index=False):
        near[a].append(b)
    seen, depth, found = set(), {}, []
    number = size = keep = 0
    for start in ranks:
        trail = [] if start in seen else [iter(near[start])]
        names = [start] if trail else []
        keep, before = 0, len(found)
        while trail:
            at = names[-1]
            if at not in seen:
                seen.add(at)
                depth[at] = len(names) - 1
            for b in trail[-1]:
                if b not in seen:
                    trail.append(iter(near[b]))
                    names.append(b)
                    break
                if b in depth:
                    if size > max(piece, WHOLE_TRAIL * len(names)):
                        number, size, keep = number + 1, 0, 0
                    found.append((ranks[start], len(found) - before, number, len(found), keep, depth[b], names[keep:]))
                    keep, size = len(names), size + len(names) - depth[b]
            else:
                trail.pop()
                depth.pop(names.pop(), None)
                keep = min(keep, len(names))
    out = pd.DataFrame(found, columns=["start", "nth", "piece", "at", "keep", "first", "added"])
    return out.assign(model_id=part.model_id.iloc[0], part=part.part.iloc[0])[["model_id", "part", *out.columns]]


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(model_id, cycle, tables) of rows of `_walk`, piece by piece in their order."""
    trail, rows, size = [], [], 0
    for batch in batches:
        for model, cycle, keep, first, added in batch.itertuples(index=False):
            del trail[keep:]
            trail.extend(added)
            rows.append((model, cycle, trail[first:]))
            size += len(trail) - first
            if size > BATCH:
                yield pd.DataFrame(rows, columns=["model_id", "cycle", "tables"])
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["model_id", "cycle", "tables"])


def _trimmed(edges: DataFrame, passes: int | None = None) -> DataFrame:
    """Edges (model_id, a, b, ...) whose head has an edge on, again and again (or so many times): those between tables from which a way of any length
    leads on. All cycles lie among them, and no walk through them is changed by what is left out. An edge from a table to itself stays. (Each step is
    a written table: a checkpoint keeps its plan's estimated size, which a loop of joins multiplies until planning takes longer than the work.)"""
    while passes is None or passes > 0:
        kept = materialise(edges.join(edges.select("model_id", F.col("a").alias("b")).distinct(), ["model_id", "b"], "left_semi").select(edges.columns))
        if kept.count() == edges.count():
            return kept
        edges, passes = kept, None if passes is None else passes - 1
    return edges


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select("model_id", F.col("b").alias("a"), F.col("a").alias("b"))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (model_id, a, b) with each stretch of tables that have at most one way in and one way out drawn together into one, and (model_id, a, path) for every
    end of an edge. All tables of such a stretch are on the same cycles, or on none; a ring becomes an edge from a table to itself."""
    each = edges.select("model_id", "a", F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("model_id", "b", F.lit(0), F.lit(1)))
    simple = materialise(each.groupBy("model_id", "a").agg(((F.sum("o") <= 1) & (F.sum("i") <= 1)).alias("simple")))
    plain = simple.filter("simple").select("model_id", "a")
    inner = edges.join(plain, ["model_id", "a"], "left_semi").join(plain.withColumnRenamed("a", "b"), ["model_id", "b"], "left_semi")
    path = simple.select("model_id", "a").join(_parts(materialise(inner)), ["model_id", "a"], "left")
    path = materialise(path.select("model_id", "a", F.coalesce("part", "a").alias("path")))
    head, tail = path.withColumnsRenamed({"a": "b", "path": "p_b"}), path.withColumnRenamed("path", "p_a")
    named = edges.join(tail, ["model_id", "a"]).join(head, ["model_id", "b"])
    # inside a stretch only the edge that closes a ring is left: there the stretch has as many edges as tables
    tables = path.groupBy("model_id", "path").agg(F.count(F.lit(1)).alias("n"))
    rings = named.filter("p_a = p_b").groupBy("model_id", F.col("p_a").alias("path")).agg(F.count(F.lit(1)).alias("m")).join(tables, ["model_id", "path"]).filter("m >= n")
    between = named.filter("p_a <> p_b").select("model_id", F.col("p_a").alias("a"), F.col("p_b").alias("b"))
    return materialise(between.union(rings.select("model_id", "path", "path")).distinct()), path


def _least_ways(edges: DataFrame, seed: int) -> DataFrame:
    """(model_id, a, f, b): of random numbers of the tables, the least one of the tables that lead to a table, and of those that it leads to. Numbers are handed
    on along the edges, and from the table that has the number known so far, so that the way they come at a time grows."""
    ends = edges.select("model_id", "a").union(edges.select("model_id", "b")).distinct()
    p = F.xxhash64("model_id", "a", F.lit(seed))
    label = materialise(ends.select("model_id", "a", p.alias("p"), p.alias("f"), p.alias("b")))
    while True:
        of = label.select("model_id", F.col("a").alias("x"), "f", "b")
        into = edges.withColumnsRenamed({"a": "x", "b": "a"}).join(of, ["model_id", "x"]).groupBy("model_id", "a").agg(F.min("f").alias("in_f"))
        out = edges.withColumnRenamed("b", "x").join(of, ["model_id", "x"]).groupBy("model_id", "a").agg(F.min("b").alias("out_b"))
        far = [label.select("model_id", F.col("p").alias(c), F.col(c).alias(f"far_{c}")) for c in "fb"]
        new = label.join(into, ["model_id", "a"], "left").join(out, ["model_id", "a"], "left").join(far[0], ["model_id", "f"], "left").join(far[1], ["model_id", "b"], "left")
        f, b = F.least("f", "in_f", "far_f"), F.least("b", "out_b", "far_b")
        new = materialise(new.select("model_id", "a", "p", f.alias("f"), b.alias("b"), ((f < F.col("f")) | (b < F.col("b"))).alias("moved")))
        label = new.drop("moved")
        if new.filter("moved").isEmpty():
            return label.select("model_id", "a", "f", "b")


def strong_components(edges: DataFrame) -> DataFrame:
    """(model_id, a, component) of every end of the edges (model_id, a, b): the least table among those that it leads to and that lead to it.

    Stretches without branches are drawn together, and ends outside cycles trimmed. Then every table learns the least of the tables
    that lead to it and of those that it leads to. Where both are the same one, the table is in that one's component; tables that differ in either are
    in different components, so edges between them are left out, and the rest is done again with other numbers. At least the component of the
    least table of each connected part is settled each time. Null ends are left out. (Stretches are found by handing labels on, which takes more steps the
    longer they are: 130 steps in all for a chain and a ring of 300 tables in random order.)"""
    edges = materialise(edges.filter("a <> b").select("model_id", "a", "b").distinct())
    drawn, path = _contracted(edges)
    rest, seed, settled = _reversed(_trimmed(_reversed(_trimmed(drawn, 2)), 2)), 0, None
    while not rest.isEmpty():
        label = materialise(_least_ways(rest, seed))
        found = label.filter("f = b").select("model_id", F.col("a").alias("path"), F.struct(F.lit(seed).alias("seed"), F.col("f").alias("root")).alias("root"))
        settled = found if settled is None else settled.union(found)
        open_ = label.filter("f <> b")
        tail, head = open_, open_.toDF("model_id", "b", "f_b", "b_b").withColumnsRenamed({"f_b": "f2", "b_b": "b2"})
        tail = tail.toDF("model_id", "a", "f1", "b1")
        same = rest.join(tail, ["model_id", "a"]).join(head, ["model_id", "b"]).filter("f1 = f2 AND b1 = b2")
        rest, seed = materialise(same.select("model_id", "a", "b")), seed + 1
    if settled is None:
        return path.select("model_id", "a", F.col("a").alias("component"))
    # a stretch alone in its component is on a cycle only if it is a ring
    loops = drawn.filter("a = b").select("model_id", F.col("a").alias("path"), F.lit(True).alias("loop"))
    sizes = settled.groupBy("model_id", "root").agg(F.count(F.lit(1)).alias("n"))
    cyclic = settled.join(sizes, ["model_id", "root"]).join(loops, ["model_id", "path"], "left").filter("n > 1 OR loop").select("model_id", "path", "root")
    members = path.join(cyclic, ["model_id", "path"])
    least = members.groupBy("model_id", "root").agg(F.min("a").alias("component"))
    named = members.join(least, ["model_id", "root"]).select("model_id", "a", "component")
    return path.select("model_id", "a").join(named, ["model_id", "a"], "left").withColumn("component", F.coalesce("component", "a"))


def _parts(edges: DataFrame) -> DataFrame:
    """(model_id, a, part): the connected part of every end of an edge, by the least name in it. Labels are handed on to
    neighbours, and to those of the label's own label, until none changes."""
    both = edges.select("model_id", "a", "b").union(edges.select("model_id", "b", "a")).distinct()
    label = materialise(both.groupBy("model_id", "a").agg(F.least(F.min("b"), F.first("a")).alias("part")))
    while True:
        near = both.join(label.select("model_id", F.col("a").alias("b"), "part"), ["model_id", "b"]).groupBy("model_id", "a").agg(F.min("part").alias("near"))
        jump = label.select("model_id", F.col("a").alias("part"), F.col("part").alias("jump"))
        new = label.join(near, ["model_id", "a"]).join(jump, ["model_id", "part"])
        new = materialise(new.select("model_id", "a", F.least("part", "near", "jump").alias("part"), (F.least("part", "near", "jump") < F.col("part")).alias("moved")))
        label = new.drop("moved")
        if new.filter("moved").isEmpty():
            return label


def fk_cycles(tables: DataFrame, refs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(model_id, cycle, tables): one cycle per reference that leads back into the walk from parents to children. Which cycles
    are found depends on the order of the walk, so each connected part of the tables from which ways lead on is walked in one task, which reads its references
    and writes down little more than the tables. Cycles are numbered by counts and listed in pieces of some `piece` tables over all tasks, as
    they can be far more than the references. Frames without model_id are one model."""
    tables, refs = (f if "model_id" in f.columns else f.withColumn("model_id", F.lit("model")) for f in (tables, refs))
    known = tables.select("model_id", F.col("table_id").alias("a"), F.col("table_ord").alias("t_rank"))
    edges = refs.select("model_id", F.col("parent_table").alias("a"), F.col("child_table").alias("b"), F.col("ref_ord").alias("rank")).filter("a <> b")
    edges = edges.join(known.select("model_id", "a"), ["model_id", "a"], "left_semi")
    edges = _trimmed(cut_lineage(edges))
    part = _parts(edges)
    rows = edges.join(part, ["model_id", "a"]).select("model_id", "part", F.lit(1).alias("kind"), "rank", "a", "b")
    rows = rows.union(part.join(known, ["model_id", "a"]).select("model_id", "part", F.lit(0), "t_rank", "a", F.lit(None).cast("string")))
    schema = "model_id string, part string, start long, nth long, piece long, at long, keep long, first long, added array<string>"
    found = materialise(rows.groupBy("model_id", "part").applyInPandas(lambda x: _walk(x, piece), schema))
    counts = found.groupBy("model_id", "part", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("model_id").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = found.join(counts.select("model_id", "part", "start", before.alias("before")), ["model_id", "part", "start"])
    numbered = numbered.select("model_id", "part", "piece", "at", (F.col("before") + F.col("nth")).alias("cycle"), "keep", "first", "added")
    n_parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = numbered.repartition(n_parts, "model_id", "part", "piece").sortWithinPartitions("model_id", "part", "piece", "at")
    return pieces.select("model_id", "cycle", "keep", "first", "added").mapInPandas(_listed, "model_id string, cycle long, tables array<string>")


def cycle_members(cycles: DataFrame) -> DataFrame:
    return cycles.select("model_id", F.explode("tables").alias("table_id")).distinct()


def heat_values(c: Catalog, metric: str, issues: DataFrame | None = None) -> DataFrame:
    """(table_id, value): columns, indexes, relations or issues of every table."""
    if metric == "relations":
        counted = relation_counts(c).withColumnRenamed("relations", "value")
    else:
        rows = {"columns": c.columns, "indexes": c.indexes, "issues": issues}[metric]
        counted = rows.filter("table_id IS NOT NULL").groupBy("table_id").agg(F.count(F.lit(1)).alias("value"))
    return c.tables.select("table_id").join(counted, "table_id", "left").select("table_id", F.coalesce("value", F.lit(0)).alias("value"))


def relations_of(c: Catalog) -> DataFrame:
    """(table_id, ref_ord, ref_id, direction, other_table, joins, covering) for each table and each of its references, a reference
    of a table to itself once. joins: columns by code; covering: indexes and keys of the child with a column of the reference."""
    t, k = c.tables.select("table_id"), c.columns.select("table_id", "column_id", "code")
    r = c.refs.join(t.toDF("parent_table"), "parent_table").join(t.toDF("child_table"), "child_table")
    j = r.select("ref_id", "parent_table", "child_table", F.posexplode("joins").alias("at", "j")).select("*", "j.*")
    j = j.join(k.toDF("parent_table", "parent_column", "pc"), ["parent_table", "parent_column"], "left").join(k.toDF("child_table", "child_column", "cc"), ["child_table", "child_column"], "left")
    label = F.concat(F.coalesce("pc", "parent_column"), F.lit(" → "), F.coalesce("cc", "child_column"))
    labels = j.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("at", label.alias("l")))).alias("l"))
    held = c.indexes.select("table_id", F.lit(0).alias("g"), F.col("index_ord").alias("o"), "name", F.explode("columns").alias("child_column"))
    held = held.union(c.keys.select("table_id", F.lit(1), "key_ord", "name", F.explode("columns"))).withColumnRenamed("table_id", "child_table")
    over = j.join(held, ["child_table", "child_column"]).groupBy("ref_id").agg(F.array_sort(F.collect_set(F.struct("g", "o", "name"))).alias("c"))
    r = r.join(labels, "ref_id", "left").join(over, "ref_id", "left")
    names = [F.coalesce(F.array_join(F.transform(x, lambda s: s[f]), ", "), F.lit("")) for x, f in (("l", "l"), ("c", "name"))]
    side = lambda own, other, name: r.select(F.col(own).alias("table_id"), "ref_ord", "ref_id", F.lit(name).alias("direction"), F.col(other).alias("other_table"), names[0].alias("joins"), names[1].alias("covering"))
    return side("parent_table", "child_table", "child").union(side("child_table", "parent_table", "parent").filter("table_id <> other_table"))


def first_columns(c: Catalog, shown: int) -> DataFrame:
    """(table_id, columns, more): the codes of a table's first columns and how many follow."""
    at = F.row_number().over(Window.partitionBy("table_id").orderBy("col_ord"))
    ranked = c.columns.withColumn("at", at)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= shown, F.struct("at", "code")))), lambda x: x["code"])
    return ranked.groupBy("table_id").agg(F.array_join(listed, ",").alias("columns"), F.greatest(F.lit(0), F.count(F.lit(1)) - shown).alias("more"))


def radial_positions(rows: DataFrame, at: str, n: Column, radius_x: float = 420.0, radius_y: float = 280.0) -> DataFrame:
    """Adds x and y on an ellipse, from the top, for row `at` of `n`."""
    angle = -F.pi() / 2 + 2 * F.pi() * F.col(at) / F.greatest(n, F.lit(1))
    return rows.withColumns({"x": F.cos(angle) * radius_x, "y": F.sin(angle) * radius_y})


def grid_positions(c: Catalog) -> DataFrame:
    """(table_id, x, y): a table's own position, else a cell of a grid of three columns."""
    t = c.complete().tables
    cell = [F.pmod("table_ord", F.lit(3)) * 340.0, F.floor(F.col("table_ord") / 3) * 260.0]
    return t.select("table_id", F.coalesce("position.x", cell[0]).alias("x"), F.coalesce("position.y", cell[1]).alias("y"))

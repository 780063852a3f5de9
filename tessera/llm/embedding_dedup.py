"""Embedding near-dedup by NN-descent: a neighbour graph, refined through neighbours of neighbours, whose edges of cosine at
least the threshold are links.

Equal vectors become one node with a count. Start: several orders of the nodes by random hyperplane codes, cut into leaves of
bounded size; each node takes its nearest neighbours from its leaves. Refinement: around each node its neighbours, and a sample
of the nodes that list it, are compared with each other, and what is nearer than a node's farthest neighbour enters its list,
until a round finds no new link. Wherever nodes are compared, in leaves and in refinement, the groups that all their links form
are kept too, so links beyond a full list join what they should. Lists that are full of links are saturated: they are enlarged to all nodes
reachable by links, which are compared in blocks of bounded size, counting links without listing them. Audit: a number of nodes that
grows with the table, half of them from all nodes and half from those with links, is compared with all nodes; if part of their
links lies outside what was found, the found links are added and the search goes on with new orders and longer lists. When the
audited recall stays below the aim, that is an error; else it is returned beside the result. All cosines are taken in double
precision.

Edge cases: vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing; vectors of
different lengths don't link; rows alike in vector link with each other; a null id keeps a null component; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .spread import materialise, spread_join

EDGE = "u long, v long, sim double"


def valid(c):
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0), F.lit(False))


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Rows of length 1 from lists of one size."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def edge_batch(u: list, v: list, sim: list) -> pa.RecordBatch:
    cat = [np.concatenate(x) if x else np.empty(0) for x in (u, v, sim)]
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in cat[:2]), pa.array(cat[2].astype(float), from_pandas=True)], ["u", "v", "sim"])


def joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of places that a symmetric matrix of links joins: every place but the first, and the first."""
    label = np.arange(len(near))
    linked = np.flatnonzero(near.any(1))
    if len(linked):
        near = near[np.ix_(linked, linked)]
        np.fill_diagonal(near, True)
        own = np.arange(len(linked))
        while True:
            # the least label among links, and among those of that place
            new = np.where(near, own[None, :], len(linked)).min(1)
            new = new[new]
            if (new == own).all():
                break
            own = new
        label[linked] = linked[own]
    at = np.flatnonzero(label != np.arange(len(label)))
    return at, label[at]


def leaf_neighbours(nodes: DataFrame, tables: int, k: int, seed: int, threshold: float, leaf: int = 256) -> DataFrame:
    """(u, v, sim): the k nearest of each node in its leaf of each table; and, with a sim that is null, what links join there."""

    def codes(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                rows = np.flatnonzero(batch.column("dim").to_numpy() == dim)
                part = batch.take(pa.array(rows))
                if dim not in planes:
                    planes[dim] = np.random.default_rng((seed, dim)).normal(size=(dim, tables * 32))
                bits = (unit_rows(part.column("vec")) @ planes[dim] > 0).reshape(len(rows), tables, 32)
                code = bits @ (1 << np.arange(31, -1, -1, dtype=np.int64))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("dim"), pa.array(np.full(len(rows), t, np.int32)), pa.array(code[:, t]), part.column("node"), part.column("vec")],
                        ["dim", "t", "code", "node", "vec"],
                    )

    kind = dict(nodes.dtypes)["vec"]
    coded = nodes.select("node", "dim", "vec").mapInArrow(codes, f"dim int, t int, code long, node long, vec {kind}")
    order = ["dim", "t", "code", "node"]

    def compare(batches):
        for batch in batches:
            us, vs, sims = [], [], []
            key = batch.column("dim").to_numpy().astype(np.int64) << 20 | batch.column("t").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                for lo in range(a, b, leaf):
                    part = batch.slice(lo, min(leaf, b - lo))
                    if part.num_rows < 2:
                        continue
                    ids, x = part.column("node").to_numpy(), unit_rows(part.column("vec"))
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    at, first = joined(s >= threshold)
                    us.append(ids[at])
                    vs.append(ids[first])
                    sims.append(np.full(len(at), np.nan))
                    n = min(k, len(ids) - 1)
                    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    us.append(np.repeat(ids, n))
                    vs.append(ids[top].ravel())
                    sims.append(np.take_along_axis(s, top, 1).ravel())
            yield edge_batch(us, vs, sims)

    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, EDGE)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """(u, v, sim): the k nearest of each u, each v once."""
    once = edges.filter("sim IS NOT NULL").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def refine(nodes: DataFrame, lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u, v, sim): pairs that meet around a common neighbour and are nearer than u's farthest neighbour; and, with a sim that
    is null, what links join there. Around a node are its k neighbours and at most k of those that list it, by a hash."""
    far = lists.groupBy("u").agg(F.min("sim").alias("far"), F.count(F.lit(1)).alias("n"))
    far = far.withColumn("far", F.when(F.col("n") >= k, F.col("far")).otherwise(-2.0))
    back = lists.select(F.col("v").alias("p"), F.col("u").alias("m"))
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64("m", "p")))).filter(F.col("r") <= k).drop("r")
    around = lists.select(F.col("u").alias("p"), F.col("v").alias("m")).union(back).union(lists.select("u", "u").distinct()).distinct()
    with_vec = nodes.join(far, nodes["node"] == far["u"]).select(F.col("node").alias("m"), "dim", "vec", "far")
    groups = around.join(with_vec, "m").groupBy("p", "dim").agg(F.collect_list(F.struct("m", "vec", "far")).alias("g"))

    def meet(batches):
        for batch in batches:
            us, vs, sims = [], [], []
            g = batch.column("g")
            off, flat = g.offsets.to_numpy(), g.flatten()
            off = off - off[0]
            ids, far_ = flat.field("m").to_numpy(), flat.field("far").to_numpy()
            vec, dims = flat.field("vec"), batch.column("dim").to_numpy()
            for i in range(batch.num_rows):
                a, b = off[i], off[i + 1]
                if b - a < 2:
                    continue
                x = unit_rows(vec.slice(a, b - a))
                s = x @ x.T
                np.fill_diagonal(s, -3)
                at, first = joined(s >= threshold)
                r, c = np.nonzero(s > far_[a:b, None])
                us.append(ids[a:b][at])
                vs.append(ids[a:b][first])
                sims.append(np.full(len(at), np.nan))
                us.append(ids[a:b][r])
                vs.append(ids[a:b][c])
                sims.append(s[r, c])
            yield edge_batch(us, vs, sims)

    return groups.mapInArrow(meet, EDGE)


def count_links(nodes: DataFrame, member: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """(node, links): for nodes of components (node, component) of more than one node, the counts of the other nodes of its
    component within the threshold, compared in groups of two blocks of about `block` nodes. A component of m nodes sends each of
    them to m / block groups: this is the cost of counting every link of every node."""
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = spread_join(member, sizes, ["component"], ["node"]).withColumn("n", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("x", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    placed = placed.join(nodes.select("node", "vec", "copies"), "node")
    placed = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = placed.groupBy("component", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(
        F.collect_list(F.struct("node", "x", "vec", "copies")).alias("g")
    )

    def compare(batches):
        for batch in batches:
            g = batch.column("g")
            off, flat = g.offsets.to_numpy(), g.flatten()
            off = off - off[0]
            ids, side, copies, vec = (flat.field(c) for c in ("node", "x", "copies", "vec"))
            ids, side, copies = ids.to_numpy(), side.to_numpy(), copies.to_numpy()
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            out = np.zeros(len(ids), np.int64)
            for i in range(batch.num_rows):
                a, b = off[i], off[i + 1]
                x, w = unit_rows(vec.slice(a, b - a)), copies[a:b]
                if lo[i] == hi[i]:
                    near = x @ x.T >= threshold
                    np.fill_diagonal(near, False)
                    out[a:b] = near @ w
                else:
                    p, q = np.flatnonzero(side[a:b] == lo[i]), np.flatnonzero(side[a:b] == hi[i])
                    near = x[p] @ x[q].T >= threshold
                    out[a + p], out[a + q] = near @ w[q], w[p] @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], ["node", "links"])

    counted = placed.select("lo", "hi", "g").mapInArrow(compare, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, member: DataFrame, threshold: float, seed: int, sample: int) -> DataFrame:
    """(u, v, sim): all links of at most 2 * sample nodes, each compared with every node: half are drawn from all nodes, half from
    those that are in a component."""

    def drawn(some: DataFrame) -> DataFrame:
        return some.select("node", "dim", "vec").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(sample)

    picked = drawn(nodes).union(drawn(nodes.join(member.select("node"), "node", "left_semi"))).collect()
    picked = list({r.node: r for r in picked}.values())
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in picked}:
        rows = [r for r in picked if r.dim == dim]
        x = np.array([r.vec for r in rows], np.float64)
        by_dim[dim] = np.array([r.node for r in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)

    def compare(batches):
        for batch in batches:
            us, vs, sims = [], [], []
            dims = batch.column("dim").to_numpy()
            for dim, (ids, q) in by_dim.items():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if part.num_rows:
                    s = q @ unit_rows(part.column("vec")).T
                    r, c = np.nonzero(s >= threshold)
                    us.append(ids[r])
                    vs.append(part.column("node").to_numpy()[c])
                    sims.append(s[r, c])
            yield edge_batch(us, vs, sims)

    return nodes.select("node", "dim", "vec").mapInArrow(compare, EDGE).filter("u <> v")


def embedding_components(
    vectors: DataFrame, threshold: float = 0.95, k: int = 10, tables: int = 10, most_rounds: int = 4, recall: float = 0.999, searches: int = 6
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links), kept (it is its own), and
    audited_recall, the share of the audited links whose ends the last search had found to be in one component (1 where the
    audit met no link).

    k: neighbours listed at first. recall: share of the audited links that must lie inside the found components. `searches`
    bounds how often the search goes on when it is lower; if it is lower still after the last, that is a RuntimeError.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    rows = rows.withColumn("vec", F.when(valid(F.col("vec")), F.col("vec")))
    # nodes are told apart by the vectors themselves; their numbers are written down with them
    nodes = materialise(
        rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("node"), "vec", "copies", "least", F.size("vec").alias("dim"))
    )
    sample = max(128, math.isqrt(nodes.count()))
    links, member, got = None, None, 0.0
    for search in range(searches):
        start = materialise(leaf_neighbours(nodes, tables, k, search, threshold))
        lists = materialise(nearest(start, k))
        found = start.filter(F.col("sim").isNull() | (F.col("sim") >= threshold)).select("u", "v")
        had = -1
        for _ in range(most_rounds):
            new = materialise(refine(nodes, lists, k, threshold))
            found = found.union(new.filter(F.col("sim").isNull() | (F.col("sim") >= threshold)).select("u", "v"))
            lists = materialise(nearest(lists.union(new), k))
            now = new.filter(F.col("sim") >= threshold).join(lists.select("u", "v"), ["u", "v"]).count()
            if now == 0 or now == had:
                break
            had = now
        links = found if links is None else links.union(found)
        links = materialise(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        member = materialise(components(links).withColumnRenamed("id", "node"))
        true = materialise(audit(nodes, member, threshold, search, sample))
        a, b = (member.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
        inside, total = true.join(a, "u").join(b, "v").filter("cu = cv").count(), true.count()
        got = inside / total if total else 1.0
        if inside == total:
            break
        links = links.union(true.select("u", "v"))
        member = materialise(components(links).withColumnRenamed("id", "node"))
        if got >= recall:
            break
        k, tables = 2 * k, tables + 4
    else:
        raise RuntimeError(f"audited recall {got:.4f} is below {recall} after {searches} searches")
    least = member.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_node = spread_join(member, least, ["component"], ["node"]).select("node", "component_id")
    named = nodes.join(of_node, "node", "left").join(count_links(nodes, member, threshold), "node", "left").select(
        "vec", F.col("copies").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    # the vectors of rows meet those of nodes; a vector that many rows share is spread over several tasks
    out = spread_join(rows.filter("vec IS NOT NULL"), named, ["vec"], ["vec_id"]).select("vec_id", "links", "component_id")
    none = F.lit(None).cast("long")
    out = out.unionByName(rows.filter("vec IS NULL").select("vec_id", none.alias("links"), none.alias("component_id")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(float(got)).alias("audited_recall"),
    )

"""Embedding near-dedup by cover trees and their dual traversal.

Per label the unit vectors form a tree. What fits one task, LEAF vectors, is a cover tree (covertree.py): levels nest, a node's
point is its first child's, covering radii halve from level to level, children are farther apart than that. A label with more
vectors is first dealt from the top: a node's centers are its own and, from a bounded sample, others farthest first, until all
of the sample lies within half of the node's radius or there are FAN; each vector goes to the nearest. There radii are those
measured, which may be more than half. The dual traversal starts with each root against itself and expands pairs of nodes level
by level, in Spark down to the cover trees, then within each pair of those; a pair whose centers are farther apart than both
radii and the threshold distance cannot hold a link and is pruned. Only what leaves hold that remain is compared.

In data without near neighbours every vector is a child of its root, and the pairs of those are what is tested: then the work
is quadratic per label, in blocks, as no radius can prune more. It falls with the share of vectors that lie in clusters. Points
that remain are compared by heads first, a bound on the cosine from part of the dimensions, then in full (covertree.settle).

Trees are dealt by hash to groups of about TILE bytes; the pairs of trees of two groups that remain are one task, which gets each
of these trees once. So vectors shuffle once for each group they have to meet.

Equal vectors of a label are one point with a count. Links are not emitted: a pair of trees gives each vector's number of
links and a spanning forest of the links, so a group of very many near copies yields rows in proportion to its size.

Defined results: a null label, or a vector that is null, zero, or holds a null or a non-finite number, links with nothing.
Vectors of different length never link. Each row is a vector of its own, also where a vec_id is null or repeats: links of one
say nothing of the other. component_id is the smallest id of the component that is not null, so it is null where all are null;
kept is whether it is the row's own vec_id, or both are null.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table
from .components import components
from .covertree import Links, Tree, traverse

LEAF, FAN, SAMPLE, DEPTH = 4096, 16, 512, 12
#: Bytes of vectors in a group of trees.
TILE = 16_000_000


def distance(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def rows_of(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable() -> Column:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.col("label").isNotNull() & fine


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, size, v): vectors as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array(x, np.float64) + 0.0 for x in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([len(x) for x in out], pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], ["vec_id", "label", "size", "v"])

    return rows.mapInArrow(run, "vec_id long, label string, size int, v binary")


def split(t: pa.Table) -> pa.Table:
    """Centers for one node from its sample: its own, then farthest first, to half the sample's radius."""
    x = np.concatenate([rows_of(t.column("center").slice(0, 1)), rows_of(t.column("v"))])
    x = unit(x)
    near = np.sqrt(((x - x[0]) ** 2).sum(1))
    half, picked = near.max() / 2, [0]
    while len(picked) < FAN and near.max() > half:
        picked.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((x - x[picked[-1]]) ** 2).sum(1)))
    return pa.table({"root": t.column("root").slice(0, 1), "node": t.column("node").slice(0, 1), "centers": pa.array([x[picked].tobytes()], pa.binary())})


def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, size, nodes = batch.column("v").to_pylist(), batch.column("size").to_numpy(), batch.column("node").to_numpy()
        centers = batch.column("centers").to_pylist()
        child, far, at = np.zeros(len(raw), np.int64), np.zeros(len(raw)), np.zeros(len(raw), object)
        groups: dict[bytes, list[int]] = {}
        for k, c in enumerate(centers):
            groups.setdefault(c, []).append(k)
        for c, own in groups.items():
            x = unit(np.frombuffer(b"".join(raw[k] for k in own), np.float64).reshape(len(own), -1))
            y = np.frombuffer(c, np.float64).reshape(-1, size[own[0]])
            d = np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))
            best = d.argmin(1)
            child[own], far[own] = best, d[np.arange(len(own)), best]
            at[own] = [y[b].tobytes() for b in best]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), batch.column("size"), batch.column("v"), batch.column("copies"), pa.array(nodes * FAN + child), batch.column("node"), pa.array(far), pa.array(list(at), pa.binary())], ["id", "root", "size", "v", "copies", "node", "up", "far", "center"])


def planted(t: pa.Table, cosine: float) -> pa.Table:
    """(root, node, block, tree): a block's vectors as a cover tree."""
    raw = rows_of(t.column("v"))
    tree = Tree(unit(raw), distance(cosine) / 4)
    x, tree.x = raw, None
    packed = pickle.dumps((t.column("id").to_numpy(), t.column("copies").to_numpy(), x, tree), protocol=5)
    return pa.table({"root": t.column("root").slice(0, 1), "node": t.column("node").slice(0, 1), "block": t.column("block").slice(0, 1), "tree": pa.array([packed], pa.binary())})


def compare(t: pa.Table, cosine: float) -> pa.Table:
    """(id, links, other, compared, pairs): for each pair of trees of a tile each vector's number of links, and edges of a forest of
    the links; and one row, without id, of how many pairs of vectors were compared, and of all of them."""
    nodes, blocks, packed, others = (t.column(x) for x in ("node", "block", "tree", "others"))
    at = {(n, b): k for k, (n, b) in enumerate(zip(nodes.to_pylist(), blocks.to_pylist(), strict=True))}
    sides: dict[int, tuple] = {}

    def side(k: int) -> tuple:
        if k not in sides:
            ids, copies, raw, tree = pickle.loads(packed[k].as_buffer())
            tree.x = unit(raw)
            sides[k] = ids, copies, raw, tree
        return sides[k]

    out = [[] for _ in range(3)]
    compared = pairs = 0
    for i, met in enumerate(others.to_pylist()):
        for other in met:
            (ia, wa, ra, ta), (ib, wb, rb, tb) = side(i), side(at[other["node"], other["block"]])
            found = Links(ta, tb, wa, wb)

            def exact(i: np.ndarray, j: np.ndarray, x: np.ndarray = ra, y: np.ndarray = rb) -> np.ndarray:
                return (x[i] * y[j]).sum(1) / (np.sqrt((x[i] ** 2).sum(1)) * np.sqrt((y[j] ** 2).sum(1)))

            traverse(ta, tb, found, cosine, exact)
            first = found.forest()
            if found.same:
                ids, n = ia, found.count[0] + found.count[1]
                pairs += len(ia) * (len(ia) - 1) // 2
            else:
                ids, n = np.concatenate([ia, ib]), np.concatenate(found.count)
                pairs += len(ia) * len(ib)
            compared += found.compared
            keep = (n > 0) | (first != np.arange(len(ids)))
            for column, x in zip(out, (ids[keep], n[keep], ids[first[keep]]), strict=True):
                column.append(x)
    ids, n, first = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
    none, zero = pa.nulls(1, pa.int64()), np.zeros(len(ids), np.int64)
    columns = [pa.chunked_array([pa.array(ids), none]), pa.array(np.append(n, 0)), pa.chunked_array([pa.array(first), none]), pa.array(np.append(zero, compared)), pa.array(np.append(zero, pairs))]
    return pa.table(columns, ["id", "links", "other", "compared", "pairs"]).combine_chunks()


def found_links(classes: DataFrame, cosine: float, leaf: int, tile: int = TILE) -> DataFrame:
    """compare() of all pairs of trees that no bound prunes; classes: (id, root, size, v, copies)."""
    members = classes.withColumns({"node": F.lit(1).cast("long"), "up": F.lit(0).cast("long"), "far": F.lit(2.0), "center": F.col("v")})
    key = ["root", "node"]
    root_center = stage(members.groupBy("root").agg(F.min("id").alias("id")), "op2-roots")
    tree = stage(members.join(root_center, ["root", "id"]).select("root", "node", F.lit(0).cast("long").alias("up"), F.col("v").alias("center"), F.lit(2.0).alias("radius")), "op2-top")
    level, leaves, nodes = members.drop("center").join(tree.select("root", "center"), "root"), [], [tree]
    for depth in range(DEPTH):
        n = stage(level.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "op2-sizes")
        big = n.where(F.col("n") > leaf).select(*key)
        if depth == DEPTH - 1 or big.isEmpty():
            leaves.append(level)
            break
        leaves.append(level.join(big, key, "left_anti"))
        inner = level.join(big, key)
        # the least SAMPLE hashes of each node
        sample = inner.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("id"), "id"))).where(F.col("turn") <= SAMPLE)
        centers = stage(sample.select("root", "node", "center", "v").groupBy(*key).applyInArrow(split, "root string, node long, centers binary"), "op2-centers")
        level = stage(inner.drop("up", "far", "center").join(centers, key).mapInArrow(descend, "id long, root string, size int, v binary, copies long, node long, up long, far double, center binary"), "op2-level")
        nodes.append(stage(level.groupBy(*key).agg(F.first("up").alias("up"), F.first("center").alias("center"), F.max("far").alias("radius")), "op2-nodes"))
    tree = nodes[0]
    for x in nodes[1:]:
        tree = tree.unionByName(x)
    inside = tree.select("root", F.col("up").alias("node")).distinct().withColumn("split", F.lit(True))
    tree = stage(tree.join(inside, key, "left").withColumn("split", F.coalesce("split", F.lit(False))), "op2-tree")
    # children of a node; a leaf stands for itself
    steps = tree.where("up > 0").select("root", F.col("up").alias("node"), F.col("node").alias("next"), "center", "radius", "split").unionByName(tree.where("NOT split").select("root", "node", F.col("node").alias("next"), "center", "radius", "split"))
    side = lambda s: steps.select("root", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "next", "center", "radius", "split")))

    @F.pandas_udf("double")
    def apart(a, b):
        import pandas as pd

        return pd.Series([float(np.sqrt(((unit(np.frombuffer(x)[None])[0] - unit(np.frombuffer(y)[None])[0]) ** 2).sum())) for x, y in zip(a, b, strict=True)])

    pairs = tree.where("up = 0").select("root", F.col("node").alias("node_a"), F.col("node").alias("node_b"), F.col("split").alias("open"))
    done = []
    while True:
        done.append(pairs.where("NOT open").select("root", "node_a", "node_b"))
        pairs = pairs.where("open")
        if len(nodes) == 1 or pairs.isEmpty():
            break
        grown = pairs.select("root", "node_a", "node_b").join(side("a"), ["root", "node_a"]).join(side("b"), ["root", "node_b"]).where("node_a != node_b OR next_a <= next_b")
        grown = grown.where((F.col("next_a") == F.col("next_b")) | (apart("center_a", "center_b") <= F.col("radius_a") + F.col("radius_b") + distance(cosine) + 1e-6))
        pairs = stage(grown.select("root", F.col("next_a").alias("node_a"), F.col("next_b").alias("node_b"), (F.col("split_a") | F.col("split_b")).alias("open")), "op2-pairs")
    meet = done[0]
    for x in done[1:]:
        meet = meet.unionByName(x)

    flat = leaves[0].select("id", *key, "v", "copies")
    for x in leaves[1:]:
        flat = flat.unionByName(x.select("id", *key, "v", "copies"))
    # a leaf that could not be split further is cut into blocks, so a block never has many more than `leaf` rows
    sizes = stage(flat.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "op2-cuts")
    flat = flat.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / leaf)))
    trees = stage(flat.select("id", *key, "block", "v", "copies").groupBy(*key, "block").applyInArrow(lambda t: planted(t.sort_by("id"), cosine), "root string, node long, block long, tree binary"), "op2-trees")
    # trees are dealt to groups, and two groups meet in a tile: a tree goes out once for each group it has to meet, not once a tree
    groups = sizes.groupBy("root").agg(F.sum("n").alias("n")).join(classes.groupBy("root").agg(F.first("size").alias("size")), "root").select("root", F.ceil(F.col("n") * F.col("size") * 8 / tile).alias("groups"))
    names = trees.select(*key, "block").join(groups, "root").withColumn("group", F.pmod(F.xxhash64("node", "block"), F.col("groups")))
    one = lambda s: names.select("root", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "block", "group")))
    ready = meet.join(one("a"), ["root", "node_a"]).join(one("b"), ["root", "node_b"]).where("node_a != node_b OR block_a <= block_b")
    tiles = ["root", "low", "high"]
    ready = ready.select(
        "root",
        F.least("group_a", "group_b").alias("low"),
        F.greatest("group_a", "group_b").alias("high"),
        F.expr("struct(node_b AS node, block_b AS block)").alias("other"),
        "node_a",
        "block_a",
    )
    ready = ready.select(
        *tiles,
        F.expr("inline(array(struct(node_a AS node, block_a AS block, other), struct(other.node AS node, other.block AS block, IF(true, null, other) AS other)))"),
    )
    sent = ready.groupBy(*tiles, "node", "block").agg(F.collect_list("other").alias("others"))
    sent = sent.join(trees, [*key, "block"]).select(*tiles, "node", "block", "others", "tree")
    return stage(sent.groupBy(*tiles).applyInArrow(lambda t: compare(t, cosine), "id long, links long, other long, compared long, pairs long"), "op2-links")


def near_vectors(rows: DataFrame, cosine: float = 0.93, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    fine = F.coalesce(usable(), F.lit(False))
    own = stage(vectors(rows.where(fine)), "op2-vectors").withColumn("root", F.concat_ws(":", "label", "size"))
    classes = own.groupBy("root", "size", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "op2-classes")  # written, so an id stays
    got = found_links(classes.select("id", "root", "size", "v", "copies"), cosine, leaf, tile).where("id IS NOT NULL")
    links = got.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(got.where("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of = classes.select("id", "root", "v", "least", "copies").join(links, "id", "left").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = stage(of.select("root", "v", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "op2-known")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("root", "v", "n_links", "component_id")
    linked = own.select("vec_id", "root", "v").join(of, ["root", "v"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON a = vec_id
"""

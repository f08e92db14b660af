"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

Rotations that make balanced binary codes are learned on a bounded sample. The codes are cut into substrings, each the
key of a table; every vector is entered into all tables. Vectors that meet in a table are compared exactly, and a pair
is counted only in the first table where it meets, so that counts need no list of pairs: a bucket gives the number of
links per vector and one star per local group. A large bucket is cut into blocks that are compared two by two."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import components
from pagemill.llm.shared import received, saved, ship

COSINE = 0.95
SAMPLE = 8_192  # vectors the rotations are learned on, at most
ROUNDS = 30
RECALL = 0.97  # aimed at for pairs just at the threshold
BLOCK = 1_024  # rows of a block of a bucket


def learn_rotation(sample: np.ndarray, bits: int, seed: int, centred: bool = True, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Origin and projection (dim x bits) of an iterative quantisation: principal axes, turned so that signs lose least.

    Around the mean the codes are balanced, but a narrow cloud is cut in the middle every time; around zero near vectors
    agree in a bit with a chance that depends on their angle alone."""
    mean = sample.mean(axis=0) if centred else np.zeros(sample.shape[1])
    moved = sample - mean
    _, _, axes = np.linalg.svd(moved, full_matrices=False)
    axes = axes[:bits].T
    flat = moved @ axes
    dice = np.random.default_rng(seed)
    turn = np.linalg.qr(dice.standard_normal((flat.shape[1], flat.shape[1])))[0]
    for _ in range(rounds):
        signs = np.where(flat @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ flat)
        turn = (left @ right).T
    return mean, axes @ turn


class Tables:
    """Rotations and the substrings of their codes that serve as tables."""

    def __init__(self, sample: np.ndarray, distinct: int, threshold: float, recall: float):
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        bits = min(sample.shape[1], 64, len(sample))
        # as many buckets as keep a few vectors in each; what fits into one block is one bucket
        self.width = min(bits, max(12, math.ceil(math.log2(distinct / 16)))) if distinct > BLOCK else 0
        meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** self.width  # a pair at the threshold, in one table
        self.count = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1
        each = bits // self.width if self.width else 1
        self.rotations = [learn_rotation(sample, bits, seed, seed % 2 == 0) for seed in range(max(2, -(-self.count // each)))]
        self.count = max(2, self.count)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Bucket of every vector in every table."""
        weights = 1 << np.arange(self.width, dtype=np.int64)
        out = []
        if not self.width:
            return np.zeros((len(unit), 1), np.int64)
        for mean, projection in self.rotations:
            code = (unit - mean) @ projection >= 0
            out.append([code[:, a : a + self.width] @ weights for a in range(0, code.shape[1] - self.width + 1, self.width)])
        by_turns = [table for tables in zip(*out, strict=True) for table in tables]
        return np.stack(by_turns[: self.count], axis=1).astype(np.int64)


def compare(table: int, left: tuple, right: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of the vectors of a block (with each other, or with another block's) that first meet in ``table``: weight
    linked to each left and each right vector, and the linked places."""
    unit, keys, weight = left
    other, other_keys, other_weight = right or left
    linked = unit @ other.T >= threshold
    for earlier in range(table):
        linked &= keys[:, earlier][:, None] != other_keys[:, earlier][None, :]
    if right is None:
        np.fill_diagonal(linked, False)
    return linked @ other_weight, linked.T @ weight, [np.nonzero(linked)]


def link_embeddings(vectors: DataFrame, threshold: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept, by cosine >= ``threshold`` in double precision.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different length. Equal vectors are compared once and weigh their number. Rows without id are counted as links but
    give no component id unless they are alone (then null). Every pair reported is exact; pairs may be missed with a
    probability of about 1 - ``recall`` at the threshold and less above it. An empty table gives an empty one."""
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    own = own.withColumn("v", F.when(good, F.col("v")))
    single = saved(own.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight")).withColumn("node", F.xxhash64("v")), "vectors")
    counts, edges = [], []
    for dim, n in sorted((r.dim, r.n) for r in single.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()):
        c, e = _one_length(single.where(F.size("v") == dim), n, threshold, recall)
        counts.append(c)
        edges.append(e)
    if not counts:
        return own.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found, linked = counts[0], edges[0]
    for c, e in zip(counts[1:], edges[1:], strict=True):
        found, linked = found.union(c), linked.union(e)
    groups = components(linked)
    of_node = single.join(groups, "node", "left").join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = of_node.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = of_node.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"), "component_id")
    out = own.join(of_node, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _one_length(single: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Links of distinct vectors of one length: (node, links) and edges (a, b)."""
    spark = single.sparkSession
    sample = np.array([r.v for r in single.orderBy("node").limit(SAMPLE).select("v").collect()])
    held = ship(spark, Tables(sample, n, threshold, recall))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = received(held)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column("v"))
            keys = tables.keys(unit)
            many = keys.shape[1]
            rows = np.repeat(np.arange(len(unit)), many)
            yield pa.RecordBatch.from_pydict({
                "tab": pa.array(np.tile(np.arange(many), len(unit)), pa.int32()), "bucket": pa.array(keys.ravel(), pa.int64()),
                "node": batch.column("node").take(pa.array(rows)), "weight": batch.column("weight").take(pa.array(rows)),
                "keys": pa.array(list(keys[rows]), pa.list_(pa.int64())), "v": pa.array(list(unit[rows]), pa.list_(pa.float64()))})

    entered = single.select("node", "weight", "v").mapInArrow(enter, "tab int, bucket bigint, node bigint, weight bigint, keys array<bigint>, v array<double>")
    sizes = single.select("node", "weight", "v").mapInArrow(enter, entered.schema).groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = entered.join(sizes, ["tab", "bucket"]).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    # block i meets every block: a row goes to the pairs (i, own) and (own, j)
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(pairs)).select("tab", "bucket", "pair.i", "pair.j", "own", "node", "weight", "keys", "v")

    def meet(group: pa.Table) -> pa.Table:
        table, i, j = (group.column(c)[0].as_py() for c in ("tab", "i", "j"))
        own = group.column("own").to_numpy()
        unit = np.array(group.column("v").combine_chunks().flatten()).reshape(len(own), -1)
        keys = np.array(group.column("keys").combine_chunks().flatten()).reshape(len(own), -1)
        weight, node = group.column("weight").to_numpy(), group.column("node").to_numpy()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        left = (unit[a], keys[a], weight[a])
        to_left, to_right, places = compare(table, left, None if i == j else (unit[b], keys[b], weight[b]), threshold)
        links = np.zeros(len(own), np.int64)
        links[a] = to_left
        if i != j:
            links[b] += to_right
        root = np.arange(len(own))
        for x, y in places:
            root = _joined(root, a[x], b[y])
        hit = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[hit]), "links": pa.array(links[hit]), "root": pa.array(node[root[hit]])})

    met = saved(dealt.groupBy("tab", "bucket", "i", "j").applyInArrow(meet, "node bigint, links bigint, root bigint"), "links")
    return met.groupBy("node").agg(F.sum("links").alias("links")), met.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _unit(column: pa.Array) -> np.ndarray:
    v = np.array(column.flatten()).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable, by repeated minimum over the links and shortcuts."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return new
        root = new

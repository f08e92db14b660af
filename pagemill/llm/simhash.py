"""SimHash near-duplicates: 64-bit fingerprints of word shingles, and exact pairs within a Hamming distance by
vantage-point trees.

The top of the tree is built from a bounded sample of the distinct fingerprints and broadcast; it deals every
fingerprint to one shard (leaf). A fingerprint whose ball crosses a boundary also visits the shards on the other side.
Inside a shard a vantage-point tree of its own prunes by the triangle inequality. A shard gives a star per local group,
never all pairs; the stars are joined into components by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import components
from pagemill.llm.shared import parts_for, rank_of, received, saved, ship, slices, whole_row

SHINGLE = 3
DISTANCE = 3
SHARD = 1_000_000  # fingerprints aimed at per shard, at most
LEAST = 32_768  # and at least, where smaller shards would keep more tasks busy
SAMPLE = 65_536  # fingerprints the top of the tree is built from, at most
LEAF = 96  # fingerprints compared one by one inside a shard


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is set where over half of the shingles' hashes have it; no words: zero. Words are what ASCII white space
    separates; A-Z alone are lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return _majority(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n))


def _majority(hashes: np.ndarray) -> int:
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        set_ += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(doc_id, fp) of every row, and the bigint columns ``more``; fp is the 64-bit pattern as bigint. Null and blank texts
    have fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps, pa.int64())} | {c: batch.column(c) for c in more})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *more).mapInArrow(work, "doc_id bigint, fp bigint" + "".join(f", {c} bigint" for c in more))


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Top of a vantage-point tree: inner nodes (vantage point, radius), leaves numbered as shards."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 7):
        self.nodes: list[tuple[np.uint64, int, int, int]] = []  # point, radius, inside, outside; negative: shard -k - 1
        self.shards = 0
        self.dice = np.random.default_rng(seed)
        self.root = self._grow(sample, shards)

    def _leaf(self) -> int:
        self.shards += 1
        return -self.shards

    def _grow(self, own: np.ndarray, shards: int) -> int:
        if shards < 2 or len(own) < 4:
            return self._leaf()
        point = own[self.dice.integers(len(own))]
        far = _distance(own, point)
        radius = min(int(np.median(far)), int(far.max()) - 1)  # the point itself is inside, the farthest is not
        inside = far <= radius
        place = len(self.nodes)
        self.nodes.append((point, radius, 0, 0))
        a = self._grow(own[inside], shards // 2)
        b = self._grow(own[~inside], shards - shards // 2)
        self.nodes[place] = (point, radius, a, b)
        return place

    def deal(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, shard and whether the shard is the row's home. Of two near rows on either side of a boundary only the
        outer one visits the other side; a visitor goes wherever a near row may be at home."""
        out, todo = [], [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, np.full(len(rows), -node - 1), home))
                continue
            point, radius, a, b = self.nodes[node]
            far = _distance(fps[rows], point).astype(np.int64)
            near = far <= radius
            for child, goes, own in ((a, far - reach <= radius, near), (b, ~near | ~home & (far + reach > radius), ~near)):
                todo.append((child, rows[goes], home[goes] & own[goes]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def local_groups(home: np.ndarray, visiting: np.ndarray, reach: int, seed: int = 7) -> np.ndarray:
    """For the distinct fingerprints of a shard and its visitors (in that order): the place of a smaller member of the
    same group (itself for the first), by links with one end at home. A vantage-point tree over the home fingerprints;
    links are joined as they are found, so memory is linear also where a group is large."""
    every = np.concatenate([home, visiting])
    root = np.arange(len(every))

    def join(linked: np.ndarray) -> None:
        own = root[linked]
        while len(up := np.flatnonzero(root[own] != own)):
            own[up] = root[own[up]]
        least = own.min()
        root[own] = least
        root[linked] = least

    dice = np.random.default_rng(seed)
    todo = [(np.arange(len(home)), np.arange(len(every)))]
    while todo:
        own, asking = todo.pop()
        if len(own) <= LEAF:
            for at in range(0, len(asking), 1 << 15):
                part = asking[at : at + (1 << 15)]
                near = _distance(every[part][None, :], every[own][:, None]) <= reach
                for i in np.flatnonzero(near.sum(axis=1)).tolist():
                    join(np.append(part[near[i]], own[i]))
            continue
        point = every[own[dice.integers(len(own))]]
        near, far = _distance(every[own], point).astype(np.int64), _distance(every[asking], point).astype(np.int64)
        radius = min(int(np.median(near)), int(near.max()) - 1)
        inside = near <= radius
        todo.append((own[inside], asking[far - reach <= radius]))
        todo.append((own[~inside], asking[far + reach > radius]))
    while len(up := np.flatnonzero(root[root] != root)):
        root[up] = root[root[up]]
    return root


def fingerprint_groups(single: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of distinct fingerprints (column fp): root is the same for all that links of at most ``distance`` bits
    connect."""
    spark = single.sparkSession
    n = single.count()
    shards = max(1, -(-n // SHARD), min(parts_for(spark), n // LEAST))
    sample = [r.fp for r in single.orderBy(F.xxhash64("fp")).limit(min(SAMPLE, 256 * shards)).collect()]
    held = ship(spark, Tree(np.array(sample, np.int64).view(np.uint64), shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = received(held)
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            rows, shard, home = tree.deal(fps.view(np.uint64), distance)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "fp": pa.array(fps[rows], pa.int64()), "home": pa.array(home)})

    def link(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        home = group.column("home").to_numpy()
        every = np.concatenate([fps[home], fps[~home]])
        root = local_groups(fps[home], fps[~home], distance)
        linked = np.flatnonzero(root != np.arange(len(every)))
        return pa.table({"a": pa.array(every[linked].view(np.int64)), "b": pa.array(every[root[linked]].view(np.int64))})

    visits = single.mapInArrow(deal, "shard int, fp bigint, home boolean")
    groups = components(visits.groupBy("shard").applyInArrow(link, "a bigint, b bigint"))
    return single.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id that can
    be reached over links of at most ``distance`` differing bits.

    Null and blank texts have fingerprint zero and are linked like any other. Rows without id get the component of
    their fingerprint (null if no row of it has an id). Repeated rows stay. Other columns are not looked at. An empty
    table gives an empty one."""
    marked = saved(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    single = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    of_fp = single.join(fingerprint_groups(single.select("fp"), distance), "fp")
    least = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = of_fp.join(least, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: of each group the row with the smallest id
    stays (of several with that id, or without any, the one whose text has the smallest hash; of repeated rows, one)."""
    keys = docs.select(rank_of(id_col).alias("rank"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    marked = saved(fingerprints(keys, shingle, "rank", "text", ["key"]).withColumnRenamed("doc_id", "rank"), "fingerprints")
    groups = fingerprint_groups(saved(marked.select("fp").distinct(), "distinct"), distance)
    stay = marked.join(groups, "fp").groupBy("root").agg(F.min(F.struct("rank", "key")).alias("w")).select("w.*")
    keyed = docs.select(whole_row(docs).alias("doc"), rank_of(id_col).alias("rank"), F.xxhash64(text_col).alias("key"))
    return keyed.join(stay, ["rank", "key"], "left_semi").dropDuplicates(["rank", "key"]).select("doc.*")

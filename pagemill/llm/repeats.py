"""Where texts repeat: the part that substring and suffix-array dedup share.

A text is a sequence of units (words or bytes). Every window of ``window`` units has an anchor, the piece of ``size``
units in it with the smallest hash (the leftmost of equals), so equal windows have equal anchors in equal places. Only
anchors are shuffled, about two in ``window - size`` units, packed by bucket of their hash, each with a hash of its
context (all windows that have it as their anchor). An anchor whose context started earlier is settled: all of its windows are repeats. Of
the rest, those whose anchor alone is repeated are left open, one per different context, for the operators to decide
exactly. What is settled inside a slice is not sent to its bucket, so copies add nothing to a hot bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import parts_for, rank_of, slices

MULTIPLIER = 0x9E3779B97F4A7C15  # odd
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
PLACE_BITS = 36
BUCKETS_PER_PART = 3
DOCUMENTS = 1 << 20  # hash classes of documents; bound of the table that is broadcast


@dataclass(frozen=True)
class Shape:
    window: int
    size: int
    within: bool  # whether a repeat inside one document counts


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sums:
    """Hashes of any stretch of a sequence of 64-bit unit hashes, from running sums."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        powers = np.full(n, MULTIPLIER, np.uint64)
        back = np.full(n + 1, INVERSE, np.uint64)
        if n:
            powers[0] = 1
        back[0] = 1
        self.back = np.cumprod(back)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * np.cumprod(powers))])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start])


def anchors(units: np.ndarray, sizes: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Anchors of the windows of the texts of a slice, whose unit hashes follow each other: doc, pos (in its text),
    anchor, context, start and end of the context."""
    window, size = shape.window, shape.size
    ends = np.cumsum(sizes)
    pieces = len(units) - size + 1
    wide = window - size + 1  # pieces in a window
    if len(units) < window:
        none = np.zeros(0, np.int64)
        return {"doc": none, "pos": none, "anchor": none.astype(np.uint64), "context": none.astype(np.uint64), "start": none, "end": none}
    sums = Sums(units)
    at = np.arange(pieces)
    piece = sums.of(at, at + size)
    least = (piece >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    reach = 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if wide > reach:
        least = np.minimum(least[: -(wide - reach)], least[wide - reach :])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)  # per window start
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    windows = np.flatnonzero(np.arange(len(place)) + window <= ends[doc])
    first = np.flatnonzero(_runs(place[windows]))
    last = np.append(first[1:], len(windows))[: len(first)] - 1
    start, end, place, doc = windows[first], windows[last] + window, place[windows[first]], doc[windows[first]]
    begin = ends[doc] - sizes[doc]
    context = mix(sums.of(start, end) + (place - start).astype(np.uint64) * np.uint64(MULTIPLIER) + (end - place).astype(np.uint64))
    return {"doc": doc, "pos": place - begin, "anchor": piece[place], "context": context, "start": start - begin, "end": end - begin}


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rank, key, text): the text as bytes, null as empty; rank and key stand for a document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), rank_of(id_col).alias("rank"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


_KINDS = {"anchor": np.uint64, "context": np.uint64, "rank": np.int64, "key": np.int64, "pos": np.int32, "start": np.int32, "end": np.int32}


def _order(rank: np.ndarray, key: np.ndarray, pos: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """Sort keys of "earlier", the most important one first."""
    return [rank, key, pos] if shape.within else [rank]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether a row (of sorted ones) differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def settle(rows: dict[str, np.ndarray], shape: Shape) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows sorted by anchor, context and order; for each whether an earlier one has its context, and whether it is
    open: first of its context, with the anchor in another context too and not first of all by right."""
    order = _order(rows["rank"], rows["key"], rows["pos"], shape)
    by = np.lexsort((*reversed(order), rows["context"], rows["anchor"]))
    rows = {c: v[by] for c, v in rows.items()}
    order = _order(rows["rank"], rows["key"], rows["pos"], shape)
    new_anchor, new_context = _runs(rows["anchor"]), _runs(rows["anchor"], rows["context"])
    head = np.maximum.accumulate(np.where(new_context, np.arange(len(by)), 0)) if len(by) else by
    copied = np.logical_or.reduce([c != c[head] for c in order]) if len(by) else np.zeros(0, bool)
    group = np.cumsum(new_anchor) - 1
    contexts = np.bincount(group[new_context], minlength=int(group[-1]) + 1 if len(by) else 0)
    return rows, copied, ~copied & (contexts[group] > 1) if len(by) else copied


def find_repeats(docs: DataFrame, hash_units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], shape: Shape, slice_bytes: int) -> DataFrame:
    """(rank, key, pos, start, end, anchor, open) from :func:`keyed` rows: anchors settled as repeats (open is false:
    every window inside start..end is one) and those left open. Rows of one document give equal rows."""
    buckets = BUCKETS_PER_PART * parts_for(docs.sparkSession)
    fields = list(_KINDS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=slice_bytes):
            units, sizes = hash_units(batch.column("text").to_pylist())
            found = anchors(units, sizes, shape)
            doc = found.pop("doc")
            found |= {c: batch.column(c).to_numpy()[doc] for c in ("rank", "key")}
            found, copied, _ = settle(found, shape)
            bucket = (found["anchor"] % np.uint64(buckets)).astype(np.int64)
            if len(copied):
                bucket[copied] = buckets + int(found["context"][0] % np.uint64(buckets))  # settled: only passed on
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(_runs(bucket[by]))
            stops = [*cuts[1:].tolist(), len(by)]
            out = {"bucket": pa.array(bucket[by][cuts], pa.int32())}
            for c in fields:
                values = found[c][by].astype(_KINDS[c])
                out[c] = pa.array([values[a:b].tobytes() for a, b in zip(cuts.tolist(), stops, strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    def decide(group: pa.Table) -> pa.Table:
        rows = {c: np.frombuffer(b"".join(group.column(c).to_pylist()), _KINDS[c]) for c in fields}
        if group.column("bucket")[0].as_py() >= buckets:
            keep, open_ = np.arange(len(rows["rank"])), np.zeros(len(rows["rank"]), bool)
        else:
            rows, copied, open_ = settle(rows, shape)
            keep = np.flatnonzero(copied | open_)
        out = {c: pa.array(rows[c][keep].astype(np.int64)) for c in ("rank", "key", "pos", "start", "end")}
        return pa.table(out | {"anchor": pa.array(rows["anchor"][keep].view(np.int64)), "open": pa.array(open_[keep])})

    packed = docs.mapInArrow(pack, "bucket int, " + ", ".join(f"`{c}` binary" for c in fields))
    return packed.groupBy("bucket").applyInArrow(decide, "rank bigint, key bigint, pos bigint, start bigint, end bigint, anchor bigint, open boolean")


def document_class() -> Column:
    return F.pmod(F.xxhash64("rank", "key"), F.lit(DOCUMENTS))


def documents_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that ``rows`` (rank, key) speak of, and a few more: a filter on hash classes, of bounded size, that
    keeps most other texts out of the shuffle that follows."""
    wanted = rows.select(document_class().alias("class")).distinct()
    return docs.withColumn("class", document_class()).join(F.broadcast(wanted), "class", "left_semi").drop("class")


def span_lists(spans: DataFrame) -> DataFrame:
    """(rank, key, spans): all (start, end) of a document as one array."""
    return spans.groupBy("rank", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def covered(spans: list[dict] | None, size: int) -> np.ndarray:
    """Which of ``size`` units a span covers."""
    change = np.zeros(size + 1, np.int64)
    if spans:
        np.add.at(change, [s["start"] for s in spans], 1)
        np.add.at(change, [s["end"] for s in spans], -1)
    return np.cumsum(change[:-1]) > 0

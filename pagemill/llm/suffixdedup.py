"""Suffix-array dedup: bytes covered by a long string that also starts earlier go.

Copies with equal surroundings are settled by :mod:`pagemill.llm.repeats`. What is left, one stretch of bytes per
different surrounding of a repeated anchor, is sorted in shards by a linear suffix sort by grouping: suffixes are
grouped by their Lyndon prefixes, groups are worked off in descending order along pointers to the previous smaller
suffix, and the final order is read out group by group, without renaming and recursion. Neighbours in that order that
share a whole window are one class; all but its earliest window go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.repeats import Shape, covered, documents_of, find_repeats, keyed, mix, span_lists
from pagemill.llm.shared import parts_for, saved, slices

WINDOW = 100
ANCHOR = 32  # bytes of an anchor
SLICE = 1 << 20
SHARD = 256  # stretches sorted together; those of an anchor with more are dealt by their content
UNITS = mix(np.arange(1, 257, dtype=np.uint64))


def hash_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return UNITS[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def suffix_order(symbols: list[int] | np.ndarray) -> list[int]:
    """Suffix array of ``symbols``, whose last one must be smaller than all others.

    First phase: a group is a stretch of ``order`` of suffixes with the same prefix known so far, at first their first
    symbol. From the highest group down, every member points to the nearest suffix before it in a lower group. Suffixes
    that are pointed to by the same number of members have their prefixes extended alike, so those of one group move
    together into a new group right above it, those pointed to most often the highest. Second phase: from the lowest
    suffix up, the suffix before each and those along its pointers take the next free place of their groups."""
    n = len(symbols)
    values = np.asarray(symbols, np.int64)
    by = np.argsort(values, kind="stable")
    new = np.ones(n, bool)
    new[1:] = values[by[1:]] != values[by[:-1]]
    starts = np.flatnonzero(new)
    own_start, places, lengths = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    own_start[by] = starts[np.cumsum(new) - 1]
    places[by] = np.arange(n)
    lengths[starts] = np.diff(np.append(starts, n))
    # group: its first place; length by first place
    order, group, where, length = by.tolist(), own_start.tolist(), places.tolist(), lengths.tolist()
    before = [-1] * n
    end = n
    while end:
        own = group[order[end - 1]]
        members = order[own:end]
        if len(members) > 1:
            members.sort()
        end = own
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= own:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if not pointed:
            continue
        sets: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            sets.setdefault((-times, group[p]), []).append(p)
        for (_, old), moved in sorted(sets.items()) if len(sets) > 1 else sets.items():
            rest = length[old] - len(moved)
            if not rest:
                continue
            new = old + rest
            length[old], length[new] = rest, len(moved)
            to = new
            for p in moved:
                # change places with what stands at the upper end of the old group
                other, at = order[to], where[p]
                order[at], where[other] = other, at
                order[to], where[p] = p, to
                group[p] = new
                to += 1
    placed = [False] * n
    result, free = [0] * n, list(range(n))
    result[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        s = result[at] - 1
        while s >= 0 and not placed[s]:
            own = group[s]
            result[free[own]] = s
            free[own] += 1
            placed[s] = True
            s = before[s]
    return result


def classes(stretches: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the stretches, in suffix order: number of the stretch, offset in it, class of equal windows."""
    sizes = np.array([len(s) for s in stretches])
    symbols = np.full(int(sizes.sum()) + len(stretches) + 1, 1, np.int64)  # 0: the end, 1: between stretches
    symbols[-1] = 0
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    for at, s in zip(starts.tolist(), stretches, strict=True):
        symbols[at : at + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + 2
    order = np.array(suffix_order(symbols))
    order = order[order < len(symbols) - 1]
    which = np.searchsorted(ends, order, side="right")
    whole = order + window < ends[which]
    order, which = order[whole], which[whole]
    if not len(order):
        return order, order, order
    view = np.lib.stride_tricks.sliding_window_view(symbols, window)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 1 << 14):
        b = min(len(order), a + (1 << 14))
        new[a:b] = (view[order[a:b]] != view[order[a - 1 : b - 1]]).any(axis=1)
    return which, order - starts[which], np.cumsum(new) - 1


def shared_parts(texts: list[bytes], place: np.ndarray, anchors: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches with their anchor at ``place``: first byte and end of the part that may hold a window of another stretch.

    Equal windows have their anchor in equal places, so all bytes from it to either end of such a window agree with one other
    stretch of the anchor. The longest such agreement of a stretch, on each side, is with a neighbour in sorted order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    centre = np.cumsum(sizes) - sizes + place

    def agreement(step: np.ndarray, most: np.ndarray) -> np.ndarray:
        inside = np.arange(len(step)) < most[:, None]
        rows = np.where(inside, data[np.where(inside, centre[:, None] + step, 0)], 0).astype(np.uint8)
        order = np.lexsort((rows.view(f"S{len(step)}")[:, 0], anchors))
        rows = rows[order]
        differ = np.ones((max(0, len(rows) - 1), len(step) + 1), bool)
        differ[:, :-1] = rows[1:] != rows[:-1]
        alike = np.where(anchors[order][1:] == anchors[order][:-1], differ.argmax(axis=1), 0)
        out = np.empty(len(rows), np.int64)
        out[order] = np.maximum(np.append(alike, 0), np.append(0, alike))
        return np.minimum(out, most)

    steps = np.arange(window)
    return place - agreement(-1 - steps, place), place + agreement(steps, sizes - place)


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(rank, key, start, end), byte numbers, of :func:`keyed` rows: bytes covered by windows that start earlier too."""
    found = saved(find_repeats(docs, hash_bytes, Shape(window, anchor, within=True), SLICE), "repeats")
    settled = found.where(f"NOT open AND end - start >= {window}").select("rank", "key", "start", "end")
    open_ = found.where(f"open AND end - start >= {window}")
    asked = open_.select("rank", "key", F.struct("anchor", "pos", "start", "end").alias("a")).groupBy("rank", "key").agg(F.collect_set("a").alias("asked"))
    texts = documents_of(docs, open_).join(asked, ["rank", "key"]).select("rank", "key", "text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in ("rank", "key", "at", "anchor", "pos", "bytes")}
            for rank, key, text, asked in zip(*(batch.column(c).to_pylist() for c in ("rank", "key", "text", "asked")), strict=True):
                for a in asked:
                    for c, v in zip(out, (rank, key, a["start"], a["anchor"], a["pos"], text[a["start"] : a["end"]]), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "bytes" else pa.int64()) for c, v in out.items()})

    entries = saved(texts.mapInArrow(cut, "rank bigint, key bigint, at bigint, anchor bigint, pos bigint, bytes binary").distinct(), "stretches")
    many = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("anchor", F.lit(True).alias("many"))
    marked = entries.join(many, "anchor", "left")
    halves = saved(_halves(marked.where("many"), window, anchor), "halves")
    least = halves.groupBy("anchor", "bytes").agg(F.min(F.struct("rank", "key", "at", "place")).alias("least"))
    same = halves.join(least, ["anchor", "bytes"]).where("struct(rank, key, at, place) > least").select("rank", "key", F.col("at").alias("start"), (F.col("at") + F.length("bytes")).alias("end"))
    ones = least.select("least.*", "anchor", "bytes")
    different = ones.join(ones.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchor")
    shards = parts_for(docs.sparkSession) * 4
    columns = ["rank", "key", "at", "place", "anchor", "bytes", "n"]
    dealt = marked.where("many IS NULL").withColumn("place", F.col("pos") - F.col("at")).withColumn("n", F.lit(0).cast("bigint")).select(*columns).union(different.select(*columns)).select(
        "*", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), F.when(F.col("n") > SHARD, F.col("anchor")).alias("hot"),
        F.when(F.col("n") > SHARD, F.pmod(F.xxhash64("rank", "key", "at"), F.ceil(F.col("n") / SHARD))).alias("part"))

    def sort(group: pa.Table) -> pa.Table:
        """Spans of windows that are not first in their shard; of an anchor that its content leaves in several shards also the
        first windows, with a digest, to be compared across shards."""
        hot = group.column("hot")[0].as_py() is not None
        if not hot:  # all of an anchor are here
            begin, end = shared_parts(group.column("bytes").to_pylist(), group.column("place").to_numpy(), group.column("anchor").to_numpy(), window)
            keep = np.flatnonzero(end - begin >= window)
            group, begin, end = group.take(keep), begin[keep], end[keep]
        rank, key, at, anchors = (group.column(c).to_numpy() for c in ("rank", "key", "at", "anchor"))
        texts = group.column("bytes").to_pylist()
        if not hot:
            at = at + begin
            texts = [t[a:b] for t, a, b in zip(texts, begin.tolist(), end.tolist(), strict=True)]
        out: dict[str, list] = {c: [] for c in ("rank", "key", "start", "end", "h1", "h2")}
        by = np.argsort(anchors, kind="stable")
        for rows in _packs(anchors[by], by):
            which, offset, kind = classes([texts[r] for r in rows.tolist()], window)
            row = rows[which]
            place = at[row] + offset
            order = np.lexsort((place, key[row], rank[row], kind))
            row, place, kind = row[order], place[order], kind[order]
            first = np.ones(len(kind), bool)
            first[1:] = kind[1:] != kind[:-1]
            head = np.maximum.accumulate(np.where(first, np.arange(len(kind)), 0)) if len(kind) else kind
            later = (rank[row] != rank[row[head]]) | (key[row] != key[row[head]]) | (place != place[head])
            gone_row, gone = row[later], place[later]
            run = np.lexsort((gone, gone_row))
            gone_row, gone = gone_row[run], gone[run]
            new = np.ones(len(gone), bool)
            new[1:] = (gone_row[1:] != gone_row[:-1]) | (gone[1:] > gone[:-1] + 1)
            cuts = np.flatnonzero(new)
            last = np.append(cuts[1:], len(gone))[: len(cuts)] - 1
            r = gone_row[cuts]
            for c, v in (("rank", rank[r]), ("key", key[r]), ("start", gone[cuts]), ("end", gone[last] + window), ("h1", np.zeros(len(r))), ("h2", np.zeros(len(r)))):
                out[c] += v.astype(np.int64).tolist()
            if hot:
                for i in np.flatnonzero(first).tolist():
                    offset_ = place[i] - at[row[i]]
                    digest = xxhash.xxh3_128_digest(texts[row[i]][offset_ : offset_ + window])
                    h1, h2 = np.frombuffer(digest, np.int64).tolist()
                    for c, v in zip(out, (int(rank[row[i]]), int(key[row[i]]), int(place[i]), None, h1, h2), strict=True):
                        out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    spans = saved(dealt.groupBy("shard", "hot", "part").applyInArrow(sort, "rank bigint, key bigint, start bigint, end bigint, h1 bigint, h2 bigint"), "spans")
    heads = spans.where("end IS NULL")
    least = heads.groupBy("h1", "h2").agg(F.min(F.struct("rank", "key", "start")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    across = heads.join(least, ["h1", "h2"]).where("struct(rank, key, start) > least").select("rank", "key", "start", (F.col("start") + window).alias("end"))
    return settled.union(same).union(spans.where("end IS NOT NULL").select("rank", "key", "start", "end")).union(across)


def _halves(stretches: DataFrame, window: int, anchor: int) -> DataFrame:
    """Each stretch as two (rank, key, at, place, anchor, bytes): the windows with half of their other bytes before the anchor, and
    the rest. Equal windows hold their anchor in the same place, so those of the first kind agree in the bytes right before it
    and those of the second in the bytes right after it; ``anchor`` then stands for the anchor with these bytes. Equal
    windows so meet under one key, and a stretch on its own under its key has no equal."""
    half = (window - anchor) // 2
    place = F.col("pos") - F.col("at")
    split = place - half + 1  # the first window of the second kind
    after = F.greatest(split, F.lit(0))
    before = F.struct(
        F.col("at"), place.alias("place"), F.xxhash64("anchor", F.lit(0), F.substring("bytes", split, F.lit(half))).alias("anchor"),
        F.substring("bytes", F.lit(1), split - 1 + window).alias("bytes"))
    behind = F.struct(
        (F.col("at") + after).alias("at"), (place - after).alias("place"),
        F.xxhash64("anchor", F.lit(1), F.substring("bytes", place + anchor + 1, F.lit(window - anchor - half + 1))).alias("anchor"),
        F.substring("bytes", after + 1, F.length("bytes")).alias("bytes"))
    parts = F.array(F.when(split >= 1, before), F.when(after + window <= F.length("bytes"), behind))
    return stretches.select("rank", "key", F.inline(F.filter(parts, lambda p: p.isNotNull())))


def _packs(anchors: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows, sorted by anchor, in packs of whole anchors of about SHARD rows."""
    if not len(rows):
        return
    begin = 0
    cuts = [*np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(rows)]
    for before, cut in zip([0, *cuts[:-1]], cuts, strict=True):
        if cut - begin > SHARD and before > begin:
            yield rows[begin:before]
            begin = before
    yield rows[begin:]


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``with_text``, ``removed`` (array of (start, end), byte numbers) and ``kept`` (binary).

    A byte goes if a ``window``-byte string that covers it also starts earlier: in a document with a smaller id, or in the
    same document at a smaller place; overlaps count, and strings are judged on the input. Rows without id come last;
    texts that share an id, or have none, are ordered by a hash of the text; a row repeated with id and text is one
    document and each row is returned. A null text is empty. Other columns are not looked at; an empty table gives an
    empty one."""
    own = keyed(docs, id_col, text_col)
    spans = span_lists(repeated_spans(own, window, anchor))
    joined = own.join(spans, ["rank", "key"], "left").select("doc_id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, runs, kept, cuts = [], [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if not gone:
                    removed.append(0), runs.append(0), kept.append(text), cuts.append([])
                    continue
                out = covered(gone, len(text))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                removed.append(int(out.sum())), runs.append(len(edge) // 2)
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes())
                cuts.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            columns = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
            more = {"removed": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | (more if with_text else {}))

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.mapInArrow(keep, schema + ", removed array<struct<start: bigint, end: bigint>>, kept binary" * with_text)

"""Substring dedup on words by level-wise doubling.

The shortest level is the anchors of :mod:`pagemill.llm.repeats`: a repeated window has a repeated anchor. Anchors whose
whole context is a copy are settled there. The windows around the others are extended from one length to twice that
length (at last to the window itself), and only those that occur in different documents at one length go on to the next,
until none is left or the window's length is reached."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.repeats import Shape, covered, documents_of, find_repeats, keyed, span_lists
from pagemill.llm.shared import saved, slices

WINDOW = 13
FIRST = 4  # words of the shortest level
SLICE = 4 << 20


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for own in words for w in own), np.uint64, int(sizes.sum())), sizes


def _levels(first: int, window: int) -> list[int]:
    sizes = [first]
    while sizes[-1] < window:
        sizes.append(min(2 * sizes[-1], window))
    return sizes[1:]


def repeated_spans(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(rank, key, start, end), word numbers, of :func:`keyed` rows: windows that start in a document of smaller rank too."""
    shape = Shape(window, first, within=False)
    found = saved(find_repeats(docs, hash_words, shape, SLICE), "repeats")
    settled = found.where(f"NOT open AND end - start >= {window}").select("rank", "key", "start", "end")
    asked = found.where("open").select("rank", "key", F.struct("pos", "start", "end").alias("a")).groupBy("rank", "key").agg(F.collect_set("a").alias("asked"))
    texts = documents_of(docs, found.where("open")).join(asked, ["rank", "key"]).select("rank", "key", "text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in ("rank", "key", "at", "lead", "words")}
            for rank, key, text, asked in zip(*(batch.column(c).to_pylist() for c in ("rank", "key", "text", "asked")), strict=True):
                words = text.split()
                for a in asked:
                    for c, v in (("rank", rank), ("key", key), ("at", a["start"]), ("lead", a["pos"] - a["start"]), ("words", b" ".join(words[a["start"] : a["end"]]))):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "words" else pa.int64()) for c, v in out.items()})

    # an entry: the words around an open anchor, from word number ``at`` of the document; the anchor starts ``lead`` words in
    entries = saved(texts.mapInArrow(cut, "rank bigint, key bigint, at bigint, lead bigint, words binary").distinct(), "entries")
    alive = entries.withColumn("offsets", F.lit(None).cast("array<bigint>"))
    spans, size = None, first
    for longer in _levels(first, window):
        stretches = alive.mapInArrow(_stretches(size, longer, first), "h1 bigint, h2 bigint, rank bigint, key bigint, at bigint, lead bigint, off bigint")
        least = stretches.groupBy("h1", "h2").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most").select("h1", "h2", "least")
        kept = saved(stretches.join(least, ["h1", "h2"]).drop("h1", "h2"), "level")
        if longer == window:
            spans = kept.where("rank > least").select("rank", "key", (F.col("at") + F.col("off")).alias("start"), (F.col("at") + F.col("off") + window).alias("end"))
            break
        offsets = kept.groupBy("rank", "key", "at", "lead").agg(F.collect_set("off").alias("offsets"))
        alive, size = entries.join(offsets, ["rank", "key", "at", "lead"]), longer
    return settled if spans is None else settled.union(spans)


def _stretches(size: int, longer: int, first: int):
    """Task that extends: all stretches of ``longer`` words around the anchor whose stretches of ``size`` words around it
    all survived (``offsets``; null: only the anchor itself was looked at)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("h1", "h2", "rank", "key", "at", "lead", "off")}
            for rank, key, at, lead, joined, offsets in zip(*(batch.column(c).to_pylist() for c in ("rank", "key", "at", "lead", "words", "offsets")), strict=True):
                words, alive = joined.split(), None if offsets is None else set(offsets)
                for off in range(max(0, lead + first - longer), min(lead, len(words) - longer) + 1):
                    if alive is not None and not all(o in alive for o in range(max(off, lead + first - size), min(lead, off + longer - size) + 1)):
                        continue
                    digest = xxhash.xxh3_128_intdigest(b" ".join(words[off : off + longer]))
                    for c, v in zip(out, (_signed(digest & (1 << 64) - 1), _signed(digest >> 64), rank, key, at, lead, off), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return work


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dedup_substrings(docs: DataFrame, window: int = WINDOW, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, ``kept`` (the words left,
    joined by one blank).

    Words are what ASCII white space separates. A word goes if a window of ``window`` words that covers it also starts in
    a document with a smaller id; windows are judged on the input. Rows without id come after all others and not before
    each other, nor do different texts that share an id; repeated rows are one document, each row is returned. Null and
    empty texts have no words. Other columns are not looked at; an empty table gives an empty one."""
    own = keyed(docs, id_col, text_col)
    spans = span_lists(repeated_spans(own, window, first))
    joined = own.join(spans, ["rank", "key"], "left").select("doc_id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, removed, kept = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                out = covered(gone, len(words))
                total.append(len(words))
                removed.append(int(out.sum()))
                kept.append(b" ".join(w for w, o in zip(words, out.tolist(), strict=True) if not o) if gone else b" ".join(words))
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    out = joined.mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out

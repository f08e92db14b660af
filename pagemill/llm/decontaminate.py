"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a slice of texts inside one task. Its words become numbers (the vocabulary of the phrases searched for; all
other words are one separator, since no phrase can run across them), its suffix array gives the Burrows-Wheeler
transform, a wavelet matrix answers rank queries on it, all phrases are searched backwards at once, and occurrences are
located by walking to the next sampled suffix position. Removal spans of one text are merged."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import LOWER, received, ship, slices, small_batches, whole_row

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SAMPLE = 8  # every so many text positions keep their suffix position
BLOCK_BYTES = 16 << 20  # benchmark text searched for in one pass over the documents


#: Bytes as words see them: A-Z lower-cased, 0-9, a-z and all of UTF-8 beyond ASCII kept, the rest a blank.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(BYTES).split() if text else []


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``values`` in order, by doubling the compared length; only ties are sorted again."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    order, length = np.argsort(rank, kind="stable"), 1
    while True:
        sorted_rank = rank[order]
        tied = np.zeros(n, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at]
        after = own + length
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first, second = rank[own], following
        by = np.lexsort((second, first))
        order[at] = own[by]
        first, second = first[by], second[by]
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        # the rank of a tie class is the place of its first member in the order
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        if length == 1:
            loose = np.flatnonzero(~tied)
            rank[order[loose]] = loose
        length *= 2


class FmIndex:
    """FM-index of one shard: BWT in a wavelet matrix, counts of smaller symbols, sampled suffix positions."""

    def __init__(self, values: np.ndarray, symbols: int):
        """``values``: numbers from 1 to ``symbols`` - 1; 0 is kept for the end of the shard."""
        text = np.append(values, 0)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.size, self.depth = len(text), max(1, int(symbols - 1).bit_length())
        counts = np.bincount(text, minlength=symbols)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.ones, self.zeros = [], []
        level = bwt
        for bit in range(self.depth - 1, -1, -1):
            up = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(up)]).astype(np.int32))
            self.zeros.append(int(len(up) - up.sum()))
            level = np.concatenate([level[up == 0], level[up == 1]])
        self.bwt = bwt
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.before = np.concatenate([[0], np.cumsum(self.sampled)]).astype(np.int32)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first ``upto`` places of the BWT."""
        low, high = np.zeros(len(upto), np.int64), upto.astype(np.int64)
        for ones, zeros, bit in zip(self.ones, self.zeros, range(self.depth - 1, -1, -1), strict=True):
            up = (symbol >> bit) & 1 == 1
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length, a row each: their intervals in the suffix order."""
        n = len(phrases)
        low, high, open_ = np.zeros(n, np.int64), np.full(n, self.size, np.int64), np.arange(n)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[open_, column]
            base = self.smaller[symbol]
            low[open_], high[open_] = base + self.rank(symbol, low[open_]), base + self.rank(symbol, high[open_])
            open_ = open_[high[open_] > low[open_]]
            if not len(open_):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order: steps back until a sampled position is met."""
        steps, rows, found = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.sampled[rows[open_]]
            done = open_[hit]
            found[done] = self.samples[self.before[rows[done]]] + steps[done]
            open_ = open_[~hit]
            symbol = self.bwt[rows[open_]]
            rows[open_] = self.smaller[symbol] + self.rank(symbol, rows[open_])
            steps[open_] += 1
        return found


class Phrases:
    """The windows of one block of items: distinct word sequences, by length, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names: list[str] = []
        number: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.vocabulary: dict[bytes, int] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            item = number.setdefault(name, len(number))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]  # 0: end, 1: separator
            for i in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.names = list(number)
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for phrase in owners:
            by_size.setdefault(len(phrase), []).append(phrase)
        self.by_size = {size: np.array(ps, np.int64) for size, ps in by_size.items()}
        self.owners = {size: [sorted(owners[p]) for p in ps] for size, ps in by_size.items()}
        self.shortest = min(by_size, default=0)
        self.symbols = len(self.vocabulary) + 2

    def shard(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a shard and, for each, its place among all words of the shard (-1: separator).

        Runs of known words shorter than the shortest phrase can't hold one and are left out."""
        get, sizes = self.vocabulary.get, [len(t) for t in texts]
        ids = np.fromiter((get(w, 1) for t in texts for w in t), np.int64, sum(sizes))
        if not len(ids):
            return ids, ids
        known = ids > 1
        starts = np.zeros(len(ids) + 1, bool)
        starts[np.cumsum([0, *sizes])] = True  # a run ends with its text
        new = starts[:-1] | np.concatenate([[True], known[1:] != known[:-1]])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(ids)))
        keep = known[at] & (length >= max(1, self.shortest))
        at, length = at[keep], length[keep]
        if not len(at):
            return ids[:0], ids[:0]
        total = length + 1  # a separator after each run
        first = np.cumsum(total) - total
        where = np.repeat(at - first, total) + np.arange(int(total.sum()))
        place = where.copy()
        place[first + length] = -1
        return np.where(place >= 0, ids[np.minimum(where, len(ids) - 1)], 1), place

    def find(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in a shard: place of the first word among all words, number of words, item number."""
        none = np.zeros(0, np.int64)
        symbols, place = self.shard(texts)
        if not len(symbols):
            return none, none, none
        index, out = FmIndex(symbols, self.symbols), []
        for size, phrases in self.by_size.items():
            low, high = index.search(phrases)
            count = high - low
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            which = np.repeat(hit, count[hit])
            within = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            position = place[index.locate(low[which] + within)]
            owners = [self.owners[size][w] for w in which.tolist()]
            many = np.array([len(o) for o in owners])
            out.append((np.repeat(position, many), np.full(int(many.sum()), size), np.array([i for o in owners for i in o], np.int64)))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (none, none, none)


def _merged(firsts: list[int], ends: list[int]) -> list[dict[str, int]]:
    """Union of word spans, in order."""
    spans: list[dict[str, int]] = []
    for first, end in sorted(set(zip(firsts, ends, strict=True))):
        if spans and first <= spans[-1]["end"]:
            spans[-1]["end"] = max(end, spans[-1]["end"])
        else:
            spans.append({"first": first, "end": end})
    return spans


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of bounded size; each is fetched only when its turn comes."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    n = -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    return [own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [own]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, with_cut: bool = False) -> DataFrame:
    """Per row of ``docs``: its id as doc_id (or the ``keep`` columns, which may hold the text too), n_words, ``spans``
    (array of (first word, end) in order, merged) and ``items`` (sorted ids of the items with a window in the text); with
    ``with_cut`` also ``cut``, the text without its spans (null where there are none).

    ``benchmark`` (item_id, text) is searched for in blocks of ``block_bytes``; each block is one more narrow step over
    the documents that adds to the spans found so far, so nothing is shuffled. Texts that are null or have no words
    give 0 words and no spans; items without words have no window; items without id hit words and are one
    item, a null at the end of ``items``; repeated items count once; repeated rows of
    ``docs`` are judged each; other columns are not looked at; an empty benchmark finds nothing."""
    spark = docs.sparkSession
    own = docs.select(*([F.col(id_col).cast("bigint").alias("doc_id")] if keep is None else keep), F.col(text_col).cast("string").cast("binary").alias("__text"))
    names = own.columns[:-1]
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    state = own.select("*", F.expr("cast(array() AS array<struct<first: bigint, end: bigint>>)").alias("spans"), F.expr("cast(array() AS array<string>)").alias("items"))
    blocks = _blocks(benchmark, block_bytes)
    for k, block in enumerate(blocks):
        held = ship(spark, Phrases([(r.item_id, bytes(r.text)) for r in block.collect()], window))
        carried = [*names, *["__text"] * (k + 1 < len(blocks))]

        def search(batches: Iterator[pa.RecordBatch], held=held, carried=carried) -> Iterator[pa.RecordBatch]:
            phrases = received(held)
            for batch in slices(batches, "__text"):
                texts = [words_of(t) for t in batch.column("__text").to_pylist()]
                starts, lengths, items = phrases.find(texts)
                edges = np.cumsum([0, *map(len, texts)])
                row = np.searchsorted(edges, starts, side="right") - 1
                spans, found = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for r in np.unique(row).tolist():
                    hit = row == r
                    firsts = [*(starts[hit] - edges[r]).tolist(), *(s["first"] for s in spans[r])]
                    ends = [*(starts[hit] - edges[r] + lengths[hit]).tolist(), *(s["end"] for s in spans[r])]
                    spans[r] = _merged(firsts, ends)
                    found[r] = sorted({*found[r], *(phrases.names[i] for i in np.unique(items[hit]).tolist())}, key=lambda name: (name is None, name or ""))
                out = {c: batch.column(c) for c in carried} | {"n_words": pa.array(map(len, texts), pa.int64())}
                out |= {"spans": pa.array(spans, span_type), "items": pa.array(found, pa.list_(pa.string()))}
                if with_cut:
                    out["cut"] = pa.array([removed_text(t.decode(), s) if s else None for t, s in zip(batch.column("__text").to_pylist(), spans, strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict(out)

        state = state.select(*names, "__text", "spans", "items")
        more = [T.StructField("n_words", T.LongType()), state.schema["spans"], state.schema["items"], *[T.StructField("cut", T.StringType())] * with_cut]
        state = state.mapInArrow(search, T.StructType([*(state.schema[c] for c in carried), *more]))
    return state


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of benchmark windows taken out of the text; all other columns stay. Rows of whose text no
    word is left go; texts without a hit stay as they are, also null and empty ones."""
    small_batches(docs.sparkSession)
    whole = docs.select(whole_row(docs).alias("__doc"), F.col(text_col).alias("__own"))
    found = find_contamination(whole, benchmark, window, text_col="__own", keep=["__doc"], with_cut=True)
    left = found.where(F.col("cut").isNull() | F.col("cut").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).withColumn("__doc", F.when(F.col("cut").isNull(), F.col("__doc")).otherwise(F.col("__doc").withField(f"`{text_col}`", F.col("cut"))))
    return left.select("__doc.*")


def removed_text(text: str, spans: list[dict[str, int]]) -> str:
    """``text`` without the words of ``spans`` and what lies between them; the pieces left are stripped and joined by one blank."""
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    left, at = [], 0
    for s in spans:
        left.append(text[at : places[s["first"]][0]].strip())
        at = places[s["end"] - 1][1]
    left.append(text[at:].strip())
    return " ".join(x for x in left if x)

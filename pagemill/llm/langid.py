"""Language identification, words first: per-language log frequencies of known words, and for unseen words those of
progressively shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import parts_for, received, ship, slices, small_batches, whole_row

WORD = regex.compile(r"\p{L}+")
CACHE = 300_000  # words whose scores a task remembers before it starts anew
STEP = 20_000  # unseen words scored at once


@dataclass(frozen=True)
class Settings:
    """The classifier is fitted on at most ``sample_docs`` labelled rows per language, those with the smallest hash of
    their id; everything counted in them is kept."""

    sample_docs: int = 1500
    longest: int = 5
    sharpness: float = 8.0  # score = softmax of the mean log frequency per word times this
    low: float = -12.0  # natural log frequency of what a language never showed


class Items:
    """Log frequencies per language of the items of one kind: sorted 64-bit hashes, a second hash that confirms a
    match, and one row of a float matrix each. A few dozen bytes per item, whatever the items are."""

    def __init__(self, items: list[str], rows: np.ndarray):
        first, second = self.hashes(items)
        order = np.argsort(first, kind="stable")
        self.first, self.second, self.rows = first[order], second[order], rows[order]

    @staticmethod
    def hashes(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(i) for i in items]), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def find(self, items: list[str]) -> np.ndarray:
        """Row of each item, or -1."""
        if not len(self.first) or not items:
            return np.full(len(items), -1, np.int64)
        first, second = self.hashes(items)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)


def _grams(word: str, size: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Counts over the bounded sample, gathered by Spark: rows (lang, kind, item, n), kind 0 for words, else n-gram size.

    Rows with a null text or language are left out. The result grows with the languages and the bounded sample alone."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    hashed = F.xxhash64("doc_id")
    ids = own.select("lang", "doc_id", hashed.alias("h"), F.pmod(hashed, F.lit(parts_for(docs.sparkSession))).alias("part"))
    # in two steps, so that no task sorts all rows of a language: the first of every part, then of those
    ahead = ids.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))).where(F.col("nth") <= settings.sample_docs)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = ahead.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= settings.sample_docs).select("lang", "doc_id")
    sample = own.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")
    longest = settings.longest

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: Counter = Counter()
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            for lang, found in words.items():
                for word, n in found.items():
                    counts[lang, 0, word] += n
                    for size in range(1, longest + 1):
                        for gram in _grams(word, size):
                            counts[lang, size, gram] += n
            if counts:
                langs, kinds, items = zip(*counts, strict=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "kind": pa.array(kinds, pa.int32()), "item": pa.array(items, pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    totals = sample.mapInArrow(count, "lang string, kind int, item string, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    rows = totals.toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    return {"langs": langs, "tables": tables_of(rows, langs, settings), "settings": settings}


def tables_of(counts: pa.Table, langs: list[str], settings: Settings) -> list[Items]:
    """The compiled tables, by kind, of counted rows (lang, kind, item, n)."""
    lang = pc.index_in(counts.column("lang"), pa.array(langs, pa.string())).to_numpy()
    kind, n = counts.column("kind").to_numpy(), counts.column("n").to_numpy().astype(np.float64)
    tables = []
    for own in range(settings.longest + 1):
        mine = kind == own
        coded = pc.dictionary_encode(counts.column("item").filter(pa.array(mine)).combine_chunks())
        rows = np.full((len(coded.dictionary), len(langs)), settings.low, np.float32)
        sums = np.bincount(lang[mine], n[mine], minlength=len(langs))
        share = n[mine] / sums[lang[mine]] if mine.any() else n[mine]
        rows[coded.indices.to_numpy(), lang[mine]] = np.maximum(np.log(share), settings.low)
        tables.append(Items(coded.dictionary.to_pylist(), rows))
    return tables


class Scorer:
    """A fitted model with the scores of words met so far, as rows of one matrix that grows by doubling."""

    def __init__(self, model: dict):
        self.langs, self.tables, self.settings = model["langs"], model["tables"], model["settings"]
        self.start()

    def start(self) -> None:
        self.place: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs)), np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Log frequencies per language (rows as ``words``). An unseen word gets the mean over the longest n-grams of
        which any is known."""
        low, known = self.settings.low, self.tables[0].find(words)
        out = np.full((len(words), len(self.langs)), low, np.float32)
        out[known >= 0] = self.tables[0].rows[known[known >= 0]]
        unseen = np.flatnonzero(known < 0)
        for size in range(self.settings.longest, 0, -1):
            grams = [_grams(words[i], size) for i in unseen.tolist()]
            counts = np.fromiter(map(len, grams), np.int64, len(grams))
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            at = self.tables[size].find([g for own in grams for g in own])
            starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            hits = np.add.reduceat((at >= 0).astype(np.int64), starts)
            rows = self.tables[size].rows if len(self.tables[size].rows) else np.full((1, len(self.langs)), low, np.float32)
            sums = np.add.reduceat(np.where(at[:, None] >= 0, rows[np.maximum(at, 0)], np.float32(low)).astype(np.float64), starts, axis=0)
            told = hits > 0
            out[unseen[some[told]]] = (sums[told] / counts[some[told]][:, None]).astype(np.float32)
            unseen = np.delete(unseen, some[told])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(self.place) > CACHE:
            self.start()
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = list(set().union(*words).difference(self.place))
        if new:
            first, most = len(self.place), len(self.place) + len(new)
            if most > len(self.matrix):
                grown = np.zeros((max(most, 2 * len(self.matrix)), len(self.langs)), np.float32)
                grown[:first] = self.matrix[:first]
                self.matrix = grown
            for at in range(0, len(new), STEP):
                self.matrix[first + at : first + at + STEP][: len(new) - at] = self.words(new[at : at + STEP])
            self.place.update(zip(new, range(first, most), strict=True))
        sizes = np.array([len(w) for w in words])
        best, score = ["und"] * len(texts), [0.0] * len(texts)
        full = np.flatnonzero(sizes)
        if not len(full):
            return best, score
        get = self.place.__getitem__
        ids = np.fromiter((get(w) for own in words for w in own), np.int64, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        total = np.add.reduceat(self.matrix[ids].astype(np.float64), starts, axis=0) / sizes[full][:, None]
        scaled = (total - total.max(axis=1, keepdims=True)) * self.settings.sharpness
        odds = np.exp(scaled)
        odds /= odds.sum(axis=1, keepdims=True)
        for at, k in zip(full.tolist(), odds.argmax(axis=1).tolist(), strict=True):
            best[at] = self.langs[k]
        for at, p in zip(full.tolist(), odds.max(axis=1).tolist(), strict=True):
            score[at] = p if math.isfinite(p) else 0.0
        return best, score


def predict(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``lang_pred``, ``score`` of every row: one narrow pass with the model broadcast.

    ``und`` with score 0 for a null text, a text without letters, or an empty model; ties go to the language first in
    alphabetical order. Only the text is looked at, whole at any length; repeated rows are each told; ``keep`` may hold
    columns of any name but ``__text``, ``lang_pred`` and ``score``. An empty table gives an empty one."""
    held = ship(docs.sparkSession, model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(received(held))
        for batch in slices(batches, "__text"):
            langs, scores = scorer.predict(batch.column("__text").to_pylist())
            columns = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    own = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(label, schema)


def keep_identified(docs: DataFrame, model: dict, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, whose language the model tells with at least
    ``min_score``; ``und`` (null, empty and letterless texts) goes. Repeated rows are kept or go together; columns may
    have any names; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    whole = docs.select(whole_row(docs).alias("__doc"), F.col(text_col).alias("__own"))
    return predict(whole, model, ["__doc"], "__own").where(f"lang_pred <> 'und' AND score >= {min_score}").select("__doc.*")

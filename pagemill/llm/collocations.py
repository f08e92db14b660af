"""Phrases whose words occur together more often than apart, per language.

Counting starts at the top order alone: at every word there is one window of three lead columns, padded with nulls where
its piece ends, and only these windows are counted: within each task first, then after one shuffle by the first two
words, where a row holds all third words that follow them equally often in the task. There the pairs are sums over windows that already lie together, and ROLLUP sums the shorter prefixes, words and
languages, so no n-gram of another length is ever made from the texts. Whatever a phrase is divided by occurs at least
as often as the phrase itself, so everything below the least count goes right after the counting and the joins that
follow are small.

Words that occur less than the least count in their language can be in no phrase. A first pass counts the words alone and
sets a bit for each that occurs often enough; a word without its bit ends a window as a break does, and only adds to the
words of its language. The table of bits has a fixed size; words that share a bit with a frequent one are counted on."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import parts_for, received, saved, ship, slices

LEAST, TOP, COVERED = 10, 2_000, 50  # least occurrences, rows of a language, per cent of a phrase inside a longer one
BREAKS = list(".,;:!?\n\x0b\x0c\r")
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + 9 * b"\n" + b" ")  # a line per piece
SCALE = 1_000_000
WIDE = "decimal(20,0)"  # counts; products of two have 40 digits and are held in 38, enough for 10^16 occurrences
HELD, WORDS = 4_000_000, 400_000  # tokens and different words a task counts together; 2^21 words would fit a key
BITS = 21
CLASSES, BUCKET = 1 << 26, 1 << 15  # bits for frequent words in all, and in a row (of bitmap_construct_agg)
FLUSH = 1_000_000  # words that a task counting words alone holds, different in each slice of its texts


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each piece has; a piece ends at its text's end at the latest."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer(data.to_pybytes().translate(PLAIN) if data else b"")
    lists = pc.ascii_split_whitespace(pc.split_pattern(pa.StringArray.from_buffers(len(texts), offsets, plain, offset=texts.offset), "\n").flatten())
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # blanks at either end of a piece leave an empty one
    return words.filter(full), np.bincount(pc.list_parent_indices(lists).to_numpy()[full.to_numpy(zero_copy_only=False)], minlength=len(lists))


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = pc.fill_null(batch.column("lang"), "und")
    for lang in pc.unique(langs):
        yield lang.as_py(), batch.column("text").filter(pc.equal(langs, lang))


class WindowCounts:
    """Windows of the texts seen since the last flush, as numbers of words; number 0 pads, and stands for words without a bit
    in ``frequent`` (of :func:`frequent_words`; all words count if there is none), of which only the number is kept."""

    def __init__(self, frequent: np.ndarray | None = None) -> None:
        self.frequent = frequent
        self.start()

    def start(self) -> None:
        self.words: dict[str, int] = dict.fromkeys(BREAKS, 0)
        self.numbers: dict[str, dict[str, int]] = {}
        self.tokens: dict[str, list[np.ndarray]] = {}
        self.rare: Counter = Counter()
        self.held = 0

    def add(self, lang: str | None, text: str | None) -> None:
        self.add_all("und" if lang is None else lang, pa.array([text], pa.string()))

    def add_all(self, lang: str, texts: pa.Array) -> None:
        words, sizes = words_of(texts)
        coded = words.dictionary_encode()
        known, numbers = coded.dictionary.to_pylist(), self.numbers.setdefault(lang, {})
        for new in known:
            if new not in numbers:
                numbers[new] = self.words.setdefault(new, len(self.words)) if self._counts(new, lang) else 0
        own = np.fromiter(map(numbers.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        self.rare[lang] += int(len(own) - np.count_nonzero(own))
        out = np.zeros(len(own) + len(sizes), np.int64)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        out[inner] = own
        self.tokens.setdefault(lang, []).append(out)
        self.held += len(out)

    def _counts(self, word: str, lang: str) -> bool:
        if self.frequent is None:
            return True
        place = xxhash.xxh64_intdigest(f"{word} {lang}".encode(), 42) % CLASSES
        return bool(self.frequent[place >> 3] >> (place & 7) & 1)

    def _counted(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Language, numbers of windows in order, how often each occurs."""
        for lang, held in self.tokens.items():
            one = np.concatenate([*held, [0, 0]])
            two, three = one[1:-1], one[2:]
            one = one[:-2]
            key = one << 2 * BITS | two << BITS | np.where(two > 0, three, 0)
            yield lang, *np.unique(key[one > 0], return_counts=True)
        self.start()

    def _names(self) -> pa.Array:
        return pa.array([None, *list(self.words)[len(BREAKS) :]], pa.string())

    def flush(self) -> Iterator[pa.RecordBatch]:
        names = self._names()
        for lang, keys, counts in self._counted():
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                columns = [names.take(pa.array(self._place(part >> shift & (1 << BITS) - 1))) for shift in (2 * BITS, BITS, 0)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), *columns, pa.array(counts[at : at + 100_000], pa.int64())], names=["lang", "w1", "w2", "w3", "c"])

    def flush_followers(self) -> Iterator[pa.RecordBatch]:
        """(first, w2, followers, c): first word, blank and language; second word; with blanks between all third words of their
        windows that occur ``c`` times, where one beyond the end of the piece is empty. Words that stand for themselves in no
        window are counted together, as an empty word."""
        names = self._names()
        rare = [(f" {lang}", None, "", n) for lang, n in self.rare.items() if n]
        if rare:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rare, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["first", "w2", "followers", "c"])
        thirds = pc.fill_null(names, "")
        for lang, keys, counts in self._counted():
            pair = keys >> BITS
            order = np.argsort(pair << BITS | np.minimum(counts, (1 << BITS) - 1), kind="stable")  # nearly sorted already
            pair, last, counts = pair[order], self._place(keys[order] & (1 << BITS) - 1), counts[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (counts[1:] != counts[:-1])
            cuts = np.append(np.flatnonzero(new), len(pair))
            for at in range(0, len(cuts) - 1, 50_000):
                begins = cuts[at : at + 50_001]
                head = pair[begins[:-1]]
                first, second = (names.take(pa.array(self._place(x))) for x in (head >> BITS, head & (1 << BITS) - 1))
                lists = pa.ListArray.from_arrays(pa.array(begins - begins[0], pa.int32()), thirds.take(pa.array(last[begins[0] : begins[-1]])))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, lang, " "), second, pc.binary_join(lists, " "), pa.array(counts[begins[:-1]], pa.int64())], names=["first", "w2", "followers", "c"])

    @staticmethod
    def _place(numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers > 0, numbers - len(BREAKS) + 1, 0)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))


def frequent_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> np.ndarray:
    """``CLASSES`` bits, in bytes: those of all words that occur ``least`` times or more in their language are set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for lang, texts in by_language(batch):
                values, n = words_of(texts)[0].value_counts().flatten()
                held.append(pa.table({"first": pc.binary_join_element_wise(values, lang, " "), "n": n}))
                size += len(values)
            if size > FLUSH:
                yield from _counts(held)
                held, size = [], 0
        if held:
            yield from _counts(held)

    place = F.col("h").bitwiseAND(CLASSES - 1)
    found = _texts(docs, text_col, lang_col).mapInArrow(count, "first string, n bigint").select(F.xxhash64("first").alias("h"), "n")
    dealt = found.select(F.shiftright(place, BUCKET.bit_length() - 1).alias("bucket"), "h", "n").repartition("bucket")
    often = dealt.groupBy("bucket", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = np.zeros((CLASSES // BUCKET, BUCKET // 8), np.uint8)
    for row in often.groupBy("bucket").agg(F.bitmap_construct_agg(place.bitwiseAND(BUCKET - 1)).alias("bits")).collect():
        out[row.bucket] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def _counts(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    total = pa.concat_tables(held).group_by("first").aggregate([("n", "sum")])
    yield from total.rename_columns(["first", "n"]).to_batches(max_chunksize=50_000)


def windows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """(first, w2, followers, c): the windows at every word of every text, counted within each task, without words that occur
    less than ``least`` times; see :meth:`WindowCounts.flush_followers`."""
    frequent = ship(docs.sparkSession, frequent_words(docs, text_col, lang_col, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WindowCounts(received(frequent))
        for batch in slices(batches):
            for lang, texts in by_language(batch):
                counts.add_all(lang, texts)
            if counts.held >= HELD or len(counts.words) >= WORDS:
                yield from counts.flush_followers()
        yield from counts.flush_followers()

    return _texts(docs, text_col, lang_col).mapInArrow(count, "first string, w2 string, followers string, c bigint")


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, f) of all phrases of one to three words that occur ``least`` times or more, and (lang, n)."""
    dealt = windows(docs, text_col, lang_col, least).repartition("first", "w2")
    none = F.lit(None).cast("string")
    parts = F.split("first", " ", 2)  # a word, which holds no blank, and the language
    named = [F.get(parts, F.lit(1)).alias("lang"), F.get(parts, F.lit(0)).alias("w1")]
    # all three branches use every column, so they read one shuffle
    each = dealt.select("first", "w2", "c", F.explode_outer(F.split("followers", " ")).alias("w3"))
    counted = each.groupBy("first", "w2", "w3").agg(F.sum("c").alias("f"))
    # a condition on the count keeps the filter above the aggregate, also where it asks for a word
    longest = counted.where(F.when(F.col("w3") != "", F.col("f")) >= least).select(*named, "w2", "w3", "f")
    many = F.octet_length("followers") - F.octet_length(F.replace(F.col("followers"), F.lit(" "), F.lit(""))) + 1
    n = F.sum(F.col("c") * many).alias("f")
    enough = dealt.groupBy("first", "w2").agg(n).where(F.when(F.col("w2").isNotNull(), F.col("f")) >= least).select(*named, "w2", none.alias("w3"), "f")
    words = dealt.groupBy("first").agg(n).select(*named, "f")
    shorter = words.rollup("lang", "w1").agg(F.sum("f").alias("f"), F.grouping_id().alias("level"))
    shorter = shorter.where(F.expr(f"level = 1 OR (level = 0 AND f >= {least})")).select("lang", "w1", none.alias("w2"), none.alias("w3"), "f")
    kept = saved(longest.unionByName(enough).unionByName(shorter), "grams")
    return kept.where("w1 <> ''"), kept.where("w1 IS NULL").select("lang", F.col("f").alias("n"))


def _score(a: str, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) in exact decimals."""
    wide = F.col(a).cast(WIDE)
    product = (F.lit(SCALE).cast("decimal(7,0)") * wide * wide).cast("decimal(38,0)")
    divisor = (left.cast(WIDE) * right.cast(WIDE)).cast("decimal(38,0)")
    return F.call_function("div", product, divisor)


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Per language the first ``top`` phrases of two and three words by score, then occurrences (both descending), then
    phrase: lang, rank, phrase, a (occurrences), l and r (of its parts at the weakest cut), n (words of the language), score.

    A text that is null has no words; a null language is ``und``. Repeated rows count each, texts are taken whole at any
    length, other columns are not looked at. Equal scores and counts are in byte order of the phrases, so ranks are
    unique. An empty table gives an empty one."""
    grams, totals = gram_counts(docs, text_col, lang_col, least)
    ones = grams.where("w2 IS NULL").select("lang", F.col("w1").alias("w"), F.col("f").alias("f1"))
    twos = grams.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", F.col("f").alias("a"))
    threes = grams.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))

    def one(df: DataFrame, word: str, name: str) -> DataFrame:
        return df.join(ones.select("lang", F.col("w").alias(word), F.col("f1").alias(name)), ["lang", word])

    pairs = one(one(twos, "w1", "l1"), "w2", "r1")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "w1", "w2", F.col("l1").alias("l"), F.col("r1").alias("r"), _score("a", F.col("l1"), F.col("r1")).alias("score"))
    # a pair goes if a longer phrase around it holds enough of its occurrences, whatever becomes of that phrase
    inside = threes.select("lang", F.inline(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))))
    around = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("around"))
    pairs = pairs.join(around, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("around") < covered * F.col("a"), F.lit(True)))

    front = twos.withColumnRenamed("a", "l2")
    back = twos.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"))
    triples = one(one(threes, "w1", "l1"), "w3", "r2").join(front, ["lang", "w1", "w2"]).join(back, ["lang", "w2", "w3"])
    triples = triples.select("*", _score("a", F.col("l1"), F.col("r1")).alias("s1"), _score("a", F.col("l2"), F.col("r2")).alias("s2"))
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))

    found = pairs.select("lang", "phrase", "a", "l", "r", "score").unionByName(triples)
    # ranks in two steps, so that no task sorts a whole language: the first rows of every part, then of those
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts_for(docs.sparkSession)))
    ahead = found.withColumn("__part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))

"""Language-model scoring with a weighted backoff automaton.

States are contexts of no word, one word and two words. Every trigram and bigram of the training texts is an arc, none is
pruned; a state without an arc for a word passes along its failure arc, with the failure arc's weight, to the state of the
next shorter context. Probabilities are interpolated, so a state's arcs and its failure arc share out exactly one:

    p(c)      = (n(c) + 0.5) / (N + 0.5 * (V + 1))
    p(c|b)    = (n(b c) + priors[0] * p(c)) / (n(b) + priors[0])
    p(c|a b)  = (n(a b c) + priors[1] * p(c|b)) / (n(a b) + priors[1])

Texts are packed as numbers of words into shards of bounded size. A shard asks once for the count of each of its different
n-grams, with its own share of it: they are dealt by their first two words to groups of bounded size, in blocks of one shard
and group each, where the shares are summed; the sums go back in the order in which they were asked for. A block names a pair
of words once, for the pair and all that follows it in the shard; words with a share of the tokens are a short number, other
ones 63 bits of their hash. Pairs of two frequent words are split by what follows them, into the more parts the more often
both words occur in the texts, so that no group holds more than its share. In a group an n-gram is known by 64 bits
of hashes; as groups do not grow, neither does the chance that two n-grams are taken for one (1e-13 for each of them). A shard
then builds the part of the automaton its texts can reach and takes every text from left to right: the state before a word
is known by which n-grams end there, so all words of a shard are walked together. What is counted grows with the input; only
words with a share of at least ``word_share`` of the tokens (so at most 1 / share) are broadcast, as short numbers with their
counts. Other words are counted like the longer n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.repeats import MULTIPLIER, mix
from pagemill.llm.shared import received, saved, ship, slices, small_batches

END = b" "  # no word holds a blank
FLUSH = 1_000_000  # words a counting task holds, different in each slice of its texts, before it hands them on
ALONE = 1 << 62  # in place of the words that a shorter n-gram lacks


@dataclass(frozen=True)
class Settings:
    word_share: float = 1e-6
    priors: tuple[float, float] = (100.0, 20.0)  # tokens that the next shorter context weighs against what followed a context
    shard_bytes: int = 4 << 20  # of text; a longer text is a shard of its own size
    group_bytes: int = 4 << 20  # of all texts, per group of n-grams


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end."""
    return [*text.lower().split(), END] if text else [END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of :func:`tokens_of` for all texts in a row, without the ends, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string(), safe=False), "")))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty one
    own = pc.list_parent_indices(lists).to_numpy()[full.to_numpy(zero_copy_only=False)]
    return words.filter(full).cast(pa.binary()), np.bincount(own, minlength=len(texts))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n, seen) over a binary column ``text``: how often each word occurs in the texts that are ``learnt``, and in all;
    added up in each task before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            learnt = batch.column("learnt").to_numpy(zero_copy_only=False)
            words, sizes = split(batch.column("text"))
            held.append(pa.table({"word": pa.array([END], pa.binary()), "n": [int(learnt.sum())], "seen": [len(learnt)]}))
            for of, name, other in ((words, "seen", "n"), (words.filter(pa.array(np.repeat(learnt, sizes))), "n", "seen")):
                values, n = of.value_counts().flatten()
                held.append(pa.table({"word": values, name: n, other: np.zeros(len(n), np.int64)}).select(["word", "n", "seen"]))
                size += len(values)
            if size > FLUSH:
                yield from _counts(held)
                held, size = [], 0
        if held:
            yield from _counts(held)

    return texts.mapInArrow(count, "word binary, n bigint, seen bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _counts(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    total = pa.concat_tables(held).group_by("word").aggregate([("n", "sum"), ("seen", "sum")])
    yield from total.rename_columns(["word", "n", "seen"]).to_batches(max_chunksize=50_000)


class Shard:
    """The texts of a shard as numbers, and its different n-grams in an order that depends on the texts alone.

    ``names``: its words' numbers, sorted; ``tokens``: places in ``names``, all texts in a row; ``pairs`` and ``grams``: its
    different bigrams and trigrams, each as place of the front times the number of words plus place of the last word."""

    def __init__(self, texts: list[bytes | None] | pa.Array, ranks: dict[bytes, int]):
        words, sizes = split(pa.array(texts, pa.binary()) if isinstance(texts, list) else texts)
        coded = words.dictionary_encode()
        known = [*coded.dictionary.to_pylist(), END]
        number = np.fromiter((ranks[w] if w in ranks else -1 - (xxhash.xxh64_intdigest(w, 42) >> 1) for w in known), np.int64, len(known))
        self.names, place = np.unique(number, return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        tokens = np.full(len(words) + len(sizes), place[-1])
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = place[coded.indices.to_numpy()]
        self._index(sizes + 1, tokens)

    def _index(self, sizes: np.ndarray, tokens: np.ndarray) -> None:
        self.sizes, self.tokens = sizes, tokens
        self.rare, width = np.flatnonzero(self.names < 0), len(self.names)
        left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.tokens))  # words from here to the end of the text
        self.pair_at = np.flatnonzero(left >= 2)
        self.pairs, self.pair_of = np.unique(self.tokens[self.pair_at] * width + self.tokens[self.pair_at + 1], return_inverse=True)
        more = left[self.pair_at] >= 3
        self.gram_at = self.pair_at[more]
        self.grams, self.gram_of = np.unique(self.pair_of[more] * width + self.tokens[self.gram_at + 2], return_inverse=True)

    def stored(self) -> bytes:
        """The shard without what follows from its words and texts."""
        return blocks(self.sizes, *named(self.names, True), np.where((own := self.tokens - len(self.rare)) < 0, -2 * own - 1, 2 * own))

    @classmethod
    def restored(cls, data: bytes) -> Shard:
        self = cls.__new__(cls)
        sizes, short, rare, own = unblocks(data)
        self.names = names_of(short, rare, True)
        self._index(sizes, np.where(own & 1, -(own >> 1) - 1, own >> 1) + len(rare))
        return self

    def wanted(self) -> np.ndarray:
        """What is to be counted: words without a rank, then bigrams, then trigrams, as three rows of numbers of words."""
        first, second = np.divmod(self.pairs, len(self.names))
        pair, last = np.divmod(self.grams, len(self.names))
        lone = np.full(len(self.rare) + len(self.pairs), ALONE)
        return np.stack([
            self.names[np.concatenate([self.rare, first, first[pair]])],
            np.concatenate([lone[: len(self.rare)], self.names[second], self.names[second[pair]]]),
            np.concatenate([lone, self.names[last]]),
        ])

    def dealt(self, parts: int, seen: np.ndarray, least: float) -> Dealt:
        """What is asked of each of ``parts`` groups; ``seen``: how often the ranked words occur in all texts, ``least``: tokens
        of a group. All that begins with a rare word goes to one group."""
        width, lone = len(self.names), len(self.rare)
        keys = self.wanted()
        pair, last = np.divmod(self.grams, width)
        known = np.zeros(width)
        known[lone:] = seen[self.names[lone:]]
        first, second = np.divmod(self.pairs, width)
        into = 1 + (np.minimum(known[first], known[second]) // least).astype(np.int64)  # parts of a pair
        by = keys[:2, : lone + len(self.pairs)].copy()
        by[1, by[0] < 0] = ALONE
        part = (hashes(by, 1) % np.uint64(parts)).astype(np.int64)  # of rare words and pairs
        gram_part = part[lone + pair]
        apart = np.flatnonzero(into[pair] > 1)
        where = pair[apart]
        salt = hashes(self.names[None, last[apart]], 3) % into[where].astype(np.uint64)
        salted = hashes(np.stack([self.names[first[where]], self.names[second[where]], salt.view(np.int64)]), 1) % np.uint64(parts)
        gram_part[apart] = np.where(salt > 0, salted.astype(np.int64), gram_part[apart])
        # pairs whose grams are partly elsewhere are named there once more
        moved = np.flatnonzero(gram_part != part[lone + pair])
        again = np.unique(gram_part[moved] * len(self.pairs) + pair[moved]) if len(moved) else moved
        again_part, again_pair = np.divmod(again, max(1, len(self.pairs)))
        heads = np.concatenate([np.arange(lone + len(self.pairs)), lone + again_pair])
        head_part = np.concatenate([part, again_part])
        kind = np.min_scalar_type(parts)  # short numbers are sorted fast
        order = np.lexsort((heads, head_part)) if len(again) else np.argsort(head_part.astype(kind), kind="stable")
        return Dealt(keys, lone, heads[order], head_part[order], order < len(part), order_g := np.argsort(gram_part.astype(kind), kind="stable"), gram_part[order_g], lone + pair[order_g])

    def shares(self, learnt: np.ndarray) -> np.ndarray:
        """How often each of what is wanted occurs in the texts that are ``learnt``."""
        own = np.repeat(learnt, self.sizes).astype(np.float64)
        parts = [(self.tokens, own, len(self.names)), (self.pair_of, own[self.pair_at], len(self.pairs)), (self.gram_of, own[self.gram_at], len(self.grams))]
        words, pairs, grams = (np.bincount(of, n, size) for of, n, size in parts)
        return np.concatenate([words[self.rare], pairs, grams]).astype(np.int64)


def hashes(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number per column of three numbers."""
    out = np.full(keys.shape[1], seed, np.uint64)
    for row in keys:
        out = mix(out * np.uint64(MULTIPLIER) + row.view(np.uint64))
    return out


@dataclass
class Dealt:
    """What a shard asks for, in order of the groups.

    ``heads``: places in ``wanted`` of rare words and pairs, of which only those marked ``own`` are asked for, the others
    being there for the grams behind them; ``grams``: places among the grams; ``behind``: the head of each."""

    wanted: np.ndarray
    lone: int
    heads: np.ndarray
    head_part: np.ndarray
    own: np.ndarray
    grams: np.ndarray
    gram_part: np.ndarray
    behind: np.ndarray

    def asked(self, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """A group and a block for it; ``n`` is the shard's own share of all that is wanted."""
        parts, begins = np.unique(self.head_part, return_index=True)
        ends = np.append(begins[1:], len(self.heads))
        cuts = np.searchsorted(self.gram_part, np.append(parts, self.gram_part[-1] + 1 if len(self.gram_part) else 0))
        first = len(self.wanted[0]) - len(self.grams)  # place of the first gram
        for part, i, j, g, h in zip(parts.tolist(), begins.tolist(), ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            heads, grams = self.heads[i:j], self.grams[g:h] + first
            rare, pairs = np.split(heads, [np.searchsorted(heads, self.lone)])
            rare, front = self.wanted[0][rare], self.wanted[0][pairs]
            front = np.where(front < 0, np.searchsorted(rare, front), len(rare) + front)
            width = np.diff(np.searchsorted(self.behind[g:h], np.append(pairs, self.lone + first)))
            share = np.where(self.own[i:j], n[heads], 0)
            yield part, blocks(np.diff(rare, prepend=0), np.diff(front, prepend=0), *named(self.wanted[1][pairs]), width, *named(self.wanted[2][grams]), share, n[grams])

    def found(self, answers: list[np.ndarray]) -> np.ndarray:
        """The counts of all that is wanted, from what the groups answered, in their order: heads and grams of each."""
        out = np.zeros(len(self.wanted[0]))
        if answers:
            heads, grams = np.concatenate(answers[::2]), np.concatenate(answers[1::2])
            out[self.heads[self.own]] = heads[self.own]
            out[len(out) - len(self.grams) + self.grams] = grams
        return out


def named(names: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Names of words as short numbers, with zero for rare words, and the rare ones; as steps if they are nearly ``ordered``."""
    short, rare = np.maximum(names + 1, 0), names[names < 0]
    return (np.diff(short, prepend=0), np.diff(rare, prepend=0)) if ordered else (short, rare)


def names_of(short: np.ndarray, rare: np.ndarray, ordered: bool = False) -> np.ndarray:
    if ordered:
        short, rare = np.cumsum(short), np.cumsum(rare)
    out = short - 1
    out[short == 0] = rare
    return out


def block(numbers: np.ndarray) -> bytes:
    """64-bit numbers, cut into all first bytes, all second bytes and so on, each compressed apart as far as any is set. Below
    bytes that are like random ones all others are taken for such, too."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers, np.int64).reshape(-1, 1).view(np.uint8).T)
    packed, shrinks = [], True
    for plane in planes[: planes.any(axis=1).nonzero()[0].max(initial=-1) + 1][::-1]:
        data = pa.compress(plane, codec="zstd", asbytes=True) if shrinks else b""
        shrinks = shrinks and len(data) < len(plane)
        packed.insert(0, data if shrinks else plane.tobytes())
    return b"".join([np.array([len(packed), *map(len, packed)], "<u4").tobytes(), *packed])


def unblock(data: bytes, n: int) -> np.ndarray:
    used = int.from_bytes(data[:4], "little")
    planes, at = np.zeros((n, 8), np.uint8), 4 + 4 * used
    for i, size in enumerate(np.frombuffer(data, "<u4", used, 4).tolist()):
        plane = data[at : at + size]
        planes[:, i] = np.frombuffer(plane if size == n else pa.decompress(plane, decompressed_size=n, codec="zstd"), np.uint8)
        at += size
    return planes.view(np.int64).reshape(n)


def blocks(*columns: np.ndarray) -> bytes:
    """Columns of any length, one after the other."""
    packed = [block(column) for column in columns]
    return b"".join(x for column, data in zip(columns, packed, strict=True) for x in (np.array([len(column), len(data)], "<u4").tobytes(), data))


def unblocks(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = np.frombuffer(data, "<u4", 2, at).tolist()
        out.append(unblock(data[at + 8 : at + 8 + size], n))
        at += 8 + size
    return out


def summed(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For every key the sum of ``n`` over all that are equal to it."""
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(n), np.int64)
    out[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


class Automaton:
    """The part of the automaton that the texts of a shard can reach, from the counts of its words, bigrams and trigrams.

    A state is how many of the last words count as context (none, one, two); which words these are is known by the place
    in the text, as are the arcs that may leave it: its word, bigram and trigram, numbered as in the shard. An arc is there if
    its n-gram was counted."""

    def __init__(self, shard: Shard, n_word: np.ndarray, n_pair: np.ndarray, n_gram: np.ndarray, floor: float, priors: tuple[float, float]):
        words = len(shard.names)
        single = (n_word + 0.5) / floor
        self.base = np.log10(single)
        first, second = np.divmod(shard.pairs, words)
        at = np.searchsorted(shard.pair_at, shard.gram_at)
        pair, rest = np.zeros((2, len(shard.grams)), np.int64)  # of the first and of the last two words
        pair[shard.gram_of], rest[shard.gram_of] = shard.pair_of[at], shard.pair_of[at + 1]
        likely = (n_pair + priors[0] * single[second]) / (n_word[first] + priors[0])
        chance = (n_gram + priors[1] * likely[rest]) / (n_pair[pair] + priors[1])
        self.front, self.arcs = pair, (n_pair > 0, n_gram > 0)
        self.gain = (self.base, np.log10(likely), np.log10(chance))
        self.weight = tuple(np.log10(prior / (n + prior)) for prior, n in zip(priors, (n_word, n_pair), strict=True))

    def walk(self, tokens: np.ndarray, pair_at: np.ndarray, pairs: np.ndarray, gram_at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Three numbers per word, whose sum is its log probability: the weights of the failure arcs taken from the state of two
        and of one word, and that of the arc. ``pairs`` and ``grams`` begin at the words ``pair_at`` and ``gram_at``.

        Before a word the state is two words if their bigram was counted, else one if that word is known, else none; a
        failure arc from a context that was not counted weighs nothing. So what is counted tells every arc."""
        (one, two, three), (after_word, after_pair), (counted, longer) = self.gain, self.weight, self.arcs
        steps = np.zeros((len(tokens), 3))
        steps[:, 2] = one[tokens]
        there = counted[pairs]
        steps[pair_at + 1, 1] = np.where(there, 0, after_word[tokens[pair_at]])
        steps[pair_at[there] + 1, 2] = two[pairs[there]]
        there = longer[grams]
        steps[gram_at + 2, 0] = np.where(there, 0, after_pair[self.front[grams]])
        steps[gram_at[there] + 2, 1] = 0
        steps[gram_at[there] + 2, 2] = three[grams[there]]
        return steps

    def score(self, tokens: list[int], pairs: list[int], grams: list[int]) -> float:
        """Log probability of a text; ``pairs`` and ``grams`` begin at each word that has one and two words after it."""
        n = len(tokens)
        pair_at, gram_at = np.arange(max(0, n - 1)), np.arange(max(0, n - 2))
        return added(self.walk(np.array(tokens, int), pair_at, np.array(pairs, int)[: len(pair_at)], gram_at, np.array(grams, int)[: len(gram_at)]))


def added(steps: np.ndarray) -> float:
    """The sum, from the first number to the last."""
    return float(np.cumsum(steps.ravel())[-1]) if len(steps) else 0.0


ASKED = "part bigint, shard bigint, asked binary"
ANSWERED = "part bigint, shard bigint, n binary"
SCORED = "doc_id bigint, learnt boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def pack(texts: DataFrame, most: int, ranking: Broadcast) -> DataFrame:
    """(shard, packed, words): the rows of ``texts`` without their text in a compressed Arrow stream, and the words of about
    ``most`` bytes of text, one row at least; dealt by shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, kept, size = received(ranking), [], 0
        for batch in slices(batches, most=max(1, most // 4)):
            if kept and size + batch.nbytes > most:
                yield _packed(kept, ranks)
                kept, size = [], 0
            kept.append(batch)
            size += batch.nbytes
        if kept:
            yield _packed(kept, ranks)

    return texts.mapInArrow(work, "packed binary, words binary").withColumn("shard", F.monotonically_increasing_id()).repartition("shard")


def _packed(batches: list[pa.RecordBatch], ranks: dict[bytes, int]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    sink = pa.BufferOutputStream()
    rows = table.drop_columns("text")
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    words = Shard(table.column("text").combine_chunks(), ranks).stored()
    return pa.RecordBatch.from_pydict({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "words": pa.array([words], pa.binary())})


def count_asked(table: pa.Table) -> pa.Table:
    """The blocks of one group of n-grams, answered: the sums over all of them, in the order of each block."""
    heads, grams = [], []
    for data in table.column("asked").to_pylist():
        rare, front, second, rare_second, width, third, rare_third, share, n = unblocks(data)
        rare, front, lone = np.cumsum(rare), np.cumsum(front), len(rare)
        inside = front < lone
        front[inside] = rare[front[inside]]
        front[~inside] -= lone
        first, second = np.append(rare, front), np.append(np.full(lone, ALONE), names_of(second, rare_second))
        third = names_of(third, rare_third)
        behind = np.repeat(np.arange(lone, len(first)), width)
        heads.append((hashes(np.stack([first, second, np.full(len(first), ALONE)]), 2), share))
        grams.append((hashes(np.stack([first[behind], second[behind], third]), 2), n))
    key, n = (np.concatenate(x) for x in zip(*heads, *grams, strict=True))
    total = np.split(summed(key, n), np.cumsum([len(x) for x, _ in heads + grams])[:-1])
    answers = [blocks(*x) for x in zip(total[: len(heads)], total[len(heads) :], strict=True)]
    return pa.table({"part": table.column("part"), "shard": table.column("shard"), "n": pa.array(answers, pa.binary())})


def score_texts(docs: DataFrame, learn_from: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score and the ``learn_from`` column as
    ``learnt`` (SQL expression over ``docs``: whether to learn from the row; null is no).

    score: log10 probability of the text's tokens (its words and one end) under the backoff model; base_score: under the
    smoothed word frequencies alone. A null text is an empty one: its end is its only token. Rows are scored each, also
    repeated ones; other columns are not looked at. Without any row to learn from every token is unknown. An empty table
    gives an empty one."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(F.expr(learn_from), F.lit(False)).alias("learnt"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    parts = 1 + size // settings.group_bytes
    counts = saved(count_words(own.select("text", "learnt")), "words")
    tokens, kinds, total = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n"), (F.col("n") > 0).cast("bigint"), F.col("seen")))).first()
    floor = float(tokens + 0.5 * (kinds + 1))
    rows = counts.where(F.col("seen") >= max(1.0, settings.word_share * total)).orderBy(F.desc("seen"), "word").toArrow()
    ranking = ship(docs.sparkSession, {w: i for i, w in enumerate(rows.column("word").to_pylist())})
    held = ship(docs.sparkSession, tuple(rows.column(c).to_numpy().astype(np.float64) for c in ("n", "seen")))
    shards = pack(own, settings.shard_bytes, ranking)
    least = max(1.0, total / parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = received(held)[1]
        for batch in batches:
            for number, packed, words in zip(batch.column("shard").to_pylist(), batch.column("packed"), batch.column("words"), strict=True):
                shard = Shard.restored(words.as_py())
                learnt = pa.ipc.open_stream(packed.as_buffer()).read_all().column("learnt").to_numpy().astype(bool)
                rows = [{"part": part, "shard": number, "asked": data} for part, data in shard.dealt(parts, seen, least).asked(shard.shares(learnt))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("asked", pa.binary())]))

    def walk(packed: pa.Table, answers: pa.Table) -> pa.Table:
        often, seen = received(held)
        texts = pa.ipc.open_stream(packed.column("packed")[0].as_buffer()).read_all()
        shard = Shard.restored(packed.column("words")[0].as_py())
        answered = [n for data in answers.sort_by("part").column("n").to_pylist() for n in unblocks(data)]
        n_rare, n_pair, n_gram = np.split(shard.dealt(parts, seen, least).found(answered), np.cumsum([len(shard.rare), len(shard.pairs)]))
        n_word = np.zeros(len(shard.names))
        n_word[shard.rare] = n_rare
        ranked = shard.names >= 0
        n_word[ranked] = often[shard.names[ranked]]
        automaton = Automaton(shard, n_word, n_pair, n_gram, floor, settings.priors)
        ends = np.cumsum(shard.sizes)
        begins = ends - shard.sizes
        known, base = (n_word > 0).astype(np.int64)[shard.tokens], automaton.base[shard.tokens].tolist()
        steps = automaton.walk(shard.tokens, shard.pair_at, shard.pair_of, shard.gram_at, shard.gram_of)
        each = list(zip(begins.tolist(), ends.tolist(), strict=True))
        return pa.table({
            "doc_id": texts.column("doc_id"), "learnt": texts.column("learnt"), "n_tokens": shard.sizes, "n_known": np.add.reduceat(known, begins),
            "base_score": [math.fsum(base[i:j]) for i, j in each], "score": [added(steps[i:j]) for i, j in each]})

    answers = shards.mapInArrow(ask, ASKED).groupBy("part").applyInArrow(count_asked, ANSWERED)
    scored = shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(walk, SCORED)
    return scored.select("doc_id", "learnt", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")

"""What the operators put on disk: shuffles and filters of bounded share."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.llm import collocations, linededup, ngramlm, suffixdedup


def test_line_keys_are_shuffled_once(spark):
    lines = spark.createDataFrame([(f"the line of number {n} with words",) for n in range(300)] + [("a line that is like none of these",)], "line string")
    marks = linededup._sharing(lines, 2)
    assert 0 < marks.count() and marks.select("mark").distinct().count() == 300
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_line_classes_outgrow_the_buckets(spark, monkeypatch):
    """With as many wanted lines as buckets most other lines still stay out."""
    monkeypatch.setattr(linededup, "BUCKETS", 1 << 10)
    monkeypatch.setattr(linededup, "BUCKET_BITS", 10)
    texts = spark.range(20_000).select("id", F.xxhash64("id").alias("h1"))
    marks = texts.where("id < 1000").select(F.shiftright("h1", 1).bitwiseAND((1 << 47) - 1).alias("mark"))
    got = linededup._in_classes(texts, marks)
    assert got.columns == ["id", "h1"]
    assert got.where("id < 1000").count() == 1000
    assert got.count() < 1000 + 19_000 * 0.03


def test_only_shared_parts_are_sorted():
    """The parts hold every window that two stretches of an anchor share, and little else."""
    dice = random.Random(3)
    window, size = 20, 4
    for _ in range(200):
        texts, place, anchors = [], [], []
        bases = [bytes(dice.choices(b"ab\0", k=40)) for _ in range(2)]
        for _ in range(dice.randint(1, 12)):
            which = dice.randrange(2)
            text = bytearray(bases[which])
            for _ in range(dice.randint(0, 3)):
                at = dice.choice([*range(18), *range(22, 40)])
                text[at] = dice.choice(b"xyz\0")
            begin, end = dice.randint(2, 18), dice.randint(22, 38)
            texts.append(bytes(text[begin:end])), place.append(18 - begin), anchors.append(which)
        begin, end = (x.tolist() for x in suffixdedup.shared_parts(texts, np.array(place), np.array(anchors), window))
        for i, text in enumerate(texts):
            shared = [
                a for a in range(len(text) - window + 1) if a <= place[i] and a + window >= place[i] + size
                and any(j != i and anchors[j] == anchors[i] and 0 <= (b := place[j] - place[i] + a) and texts[j][b : b + window] == text[a : a + window] for j in range(len(texts)))]
            assert all(begin[i] <= a and a + window <= end[i] for a in shared)
            assert 0 <= begin[i] <= place[i] <= end[i] <= len(text)
    alone = suffixdedup.shared_parts([b"l" * 60 + b"anchor" + b"r" * 60, b"m" * 60 + b"anchor" + b"s" * 60], np.array([60, 60]), np.array([7, 7]), 100)
    assert (alone[1] - alone[0]).tolist() == [6, 6]


def test_followers_hold_all_windows_in_fewer_bytes():
    dice = random.Random(9)
    words = [f"word{n}" for n in range(12)] + ["\u00a0", "\u3000x", "\0"]
    texts = [(dice.choice(["en", "a b", "", None]), " ".join(dice.choices([*words, "the", "the", "of", ",", "\n"], k=400))) for _ in range(30)]
    plain, packed = collocations.WindowCounts(), collocations.WindowCounts()
    for row in texts:
        plain.add(*row), packed.add(*row)
    want, got = Counter(), Counter()
    batches = list(plain.flush()), list(packed.flush_followers())
    for b in batches[0]:
        for r in b.to_pylist():
            want[r["lang"], r["w1"], r["w2"], r["w3"]] += r["c"]
    for b in batches[1]:
        for r in b.to_pylist():
            w1, lang = r["first"].split(" ", 1)
            for w3 in r["followers"].split(" "):
                got[lang, w1, r["w2"], w3 or None] += r["c"]
    assert got == want
    assert sum(b.nbytes for b in batches[1]) < 0.6 * sum(b.nbytes for b in batches[0])
    assert not packed.tokens and not list(packed.flush_followers())


def _asked(shards, parts, seen, least):
    """What every shard finds after all groups have answered, and the bytes of each block."""
    dealt = [s.dealt(parts, seen, least) for s in shards]
    rows = [{"part": part, "shard": i, "asked": data} for i, (s, d) in enumerate(zip(shards, dealt, strict=True)) for part, data in d.asked(s.shares(np.ones(len(s.sizes), bool)))]
    answers = {}
    for part in {r["part"] for r in rows}:
        for r in ngramlm.count_asked(pa.Table.from_pylist([r for r in rows if r["part"] == part])).to_pylist():
            answers[r["shard"], r["part"]] = ngramlm.unblocks(r["n"])
    return [d.found([n for key in sorted(answers) if key[0] == i for n in answers[key]]) for i, d in enumerate(dealt)], rows


def test_grams_of_a_frequent_pair_are_dealt_apart_and_counted_together():
    dice = random.Random(4)
    words = ["of", "the", *(f"w{n}" for n in range(60))]
    texts = [[(" ".join(f"of the {dice.choice(words)}" if dice.random() < 0.5 else dice.choice(words) for _ in range(150))).encode() for _ in range(4)] + [None, b"", b"of", b" \t"] for _ in range(3)]
    n = Counter(tuple(t[i : i + k]) for text in sum(texts, []) for t in [ngramlm.tokens_of(text)] for k in (1, 2, 3) for i in range(len(t) - k + 1))
    ranked = [b"of", b"the", b"w1", b"w2", b"w3", ngramlm.END]
    ranks, seen = {w: i for i, w in enumerate(ranked)}, np.array([float(n[w,]) for w in ranked])
    shards = [ngramlm.Shard.restored(ngramlm.Shard(t, ranks).stored()) for t in texts]
    name = {-1 - (ngramlm.xxhash.xxh64_intdigest(w.encode(), 42) >> 1): w.encode() for w in words} | dict(enumerate(ranked))
    for parts, least in [(1, 1e9), (50, 1e9), (50, 20.0), (300, 3.0)]:
        found, _ = _asked(shards, parts, seen, least)
        for s, counts in zip(shards, found, strict=True):
            assert counts.tolist() == [n[tuple(name[i] for i in key if i != ngramlm.ALONE)] for key in s.wanted().T.tolist()]
    groups = {g for s in shards for d in [s.dealt(50, seen, 20.0)] for g, b in zip(d.gram_part.tolist(), d.behind.tolist(), strict=True) if d.wanted[:2, b].tolist() == [0, 1]}
    assert len(groups) > 5


def test_asking_takes_few_bytes():
    """Less than two thirds of what the 64-bit hashes of all n-grams took, which do not compress."""
    dice = random.Random(8)
    ranks = {f"v{n}".encode(): n for n in range(20_000)} | {ngramlm.END: 20_000}
    texts = [" ".join(f"v{int(20_000 ** dice.random())}" if dice.random() < 0.85 else f"rare{dice.random()}" for _ in range(500)).encode() for _ in range(200)]
    shard = ngramlm.Shard(texts, ranks)
    _, rows = _asked([shard], 8, np.full(20_001, 1.0), 1e9)
    assert sum(len(r["asked"]) for r in rows) < 5 * shard.wanted().shape[1]


def test_words_are_split_as_in_one_text():
    texts = [None, b"", b"  A\tb\x0bC ", "\u00c4\u00a0x\u2003Y \x1c \x85".encode(), b"\xff\xfe B\n\r\f", b"z" * 1000]
    words, sizes = ngramlm.split(pa.array(texts, pa.binary()))
    assert [w for t in texts for w in ngramlm.tokens_of(t)[:-1]] == words.to_pylist()
    assert sizes.tolist() == [len(ngramlm.tokens_of(t)) - 1 for t in texts]


def test_texts_are_packed_and_shuffled_once(spark, tables):
    scored = ngramlm.score_texts(spark.read.parquet(f"{tables}/documents.parquet"), "doc_id % 3 = 0")
    scored.collect()
    final = scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1 and final.count("Scan parquet") == 1


def test_rare_words_stay_out_of_the_windows(spark):
    """Windows hold no word below the least count of its language, but all words are counted."""
    rows = [("en", f"new york r{n} new york. the rare{n} city") for n in range(12)] + [("de", "york r1 the"), (None, "new York\tnew, york"), ("de", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    held = collocations.windows(docs).collect()
    assert {w for r in held for w in (r["first"].split(" ", 1)[0], r["w2"], *r["followers"].split(" ")) if w} == {"new", "york", "the", "city"}
    assert not any(r["w2"] for r in held if not r["first"].endswith(" en"))
    total = Counter()
    for r in held:
        total[r["first"].split(" ", 1)[1]] += r["c"] * len(r["followers"].split(" "))
    assert total == {"en": 96, "de": 3, "und": 4}
    grams, totals = collocations.gram_counts(docs)
    assert {tuple(r) for r in totals.collect()} == {("en", 96), ("de", 3), ("und", 4)}
    assert {(r.w1, r.w2, r.f) for r in grams.collect()} == {("new", None, 24), ("york", None, 24), ("the", None, 12), ("city", None, 12), ("new", "york", 24)}

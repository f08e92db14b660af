"""Phrase mining against plain Python with whole numbers of any size."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagemill.llm import collocations as cl

LOWER = {c: c + 32 for c in range(65, 91)}


def wanted(rows, least, top, covered):
    counts, out = {}, []
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, rank, p.decode(), -a, left, right, n, -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def odd_rows():
    dice = random.Random(5)
    words = ["New", "york", "city", "of", "the", "a", "Ünder", " ", "l'eau", "$$", "\x1f", "x y", "Is", "İ"]
    rows = []
    for i in range(500):
        text = ""
        for _ in range(dice.randint(0, 25)):
            text += dice.choice(["new york city", "of the", dice.choice(words), dice.choice(words)]) + dice.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", ";", "\x0b", " ! "])
        rows.append((dice.choice(["en", "en", "en", "de", "", None]), text))
    rows += [("en", None), (None, None), ("fr", ""), ("es", "one two three " * 4000), ("es", "  \t ")] + rows[:20]
    return rows


def test_as_plain_python(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, w1 string, rank int, a int").repartition(4)
    for least, top, covered in [(10, 2000, 50), (2, 7, 50), (3, 40, 100), (2, 2000, 20)]:
        got = sorted(tuple(r) for r in cl.mine_phrases(df, least=least, top=top, covered=covered).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == [w for w in wanted(rows, least, top, covered)], (least, top, covered)


def test_products_beyond_64_bits(spark):
    a, left, right = 3 * 10**12, 5 * 10**12 + 7, 4 * 10**12 + 1
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(cl._score("a", F.col("l"), F.col("r")).alias("s")).first().s == 1_000_000 * a * a // (left * right)


def test_empty_table(spark):
    assert cl.mine_phrases(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_windows_are_shuffled_once(spark, tables, monkeypatch):
    """The counted windows are one exchange, which the longest phrases and the rollup both read."""
    plans = []
    monkeypatch.setattr(cl, "saved", lambda df, name: plans.append(df) or df)
    cl.gram_counts(spark.read.parquet(f"{tables}/documents.parquet"))
    plans[0].collect()
    final = plans[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2 and final.count("MapInArrow") == 1


def test_windows_over_several_flushes(spark, monkeypatch):
    rows = odd_rows()
    for held, words in [(1, 10**6), (10**6, 3), (200, 40)]:
        got = cl.WindowCounts()
        total = Counter()
        for lang, text in rows:
            got.add(lang, text)
            if got.held >= held or len(got.words) >= words:
                for b in got.flush():
                    for r in b.to_pylist():
                        total[r["lang"], r["w1"], r["w2"], r["w3"]] += r["c"]
        for b in got.flush():
            for r in b.to_pylist():
                total[r["lang"], r["w1"], r["w2"], r["w3"]] += r["c"]
        want = Counter()
        for lang, text in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
                w = re.findall(r"[^\x20\x09]+", piece)
                want.update(("und" if lang is None else lang, a, *w[i + 1 : i + 3], *[None] * (2 - len(w[i + 1 : i + 3]))) for i, a in enumerate(w))
        assert total == want

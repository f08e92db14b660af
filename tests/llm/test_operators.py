"""Every operator on a table with nulls, empty, very long, equal and repeated rows and clashing columns, and on an empty
table, held against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

import corpus_pipeline
from pagemill.llm import bpe, decontaminate, embeddings, langid, linededup, ngramlm, queries, simhash, substrings, suffixdedup, urlfilter

LAST = (1 << 63) - 1
WORDS = [f"{a}{b}{c}" for a in "abdeg" for b in "iou" for c in ("n", "rst", "l")]


def odd_documents(seed=4, n=70):
    dice = random.Random(seed)
    some = [" ".join(dice.choice(WORDS) for _ in range(dice.randint(0, 60))) for _ in range(20)]
    rows = []
    for i in range(n):
        words = dice.choice(some).split()
        if dice.random() < 0.6:
            for _ in range(dice.randint(1, 3)):
                if words:
                    words[dice.randrange(len(words))] = dice.choice(WORDS)
        text = " ".join(words)
        if dice.random() < 0.5:
            text = text.replace(" ", "\n", 3) + "\n" + dice.choice(some)[:90]
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (None, some[0] + " tail"), (None, some[0] + " tail"), (None, None), (3, some[1]), (3, some[2]), (5, "Ünïcode  Ä\u00a0ß\n" * 40), (n + 2, "ab" * 500),
             (n + 3, " ".join(dice.choice(WORDS) for _ in range(6000))), (n + 4, " \n\t ")]
    rows += rows[:3]
    dice.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns named like the helpers inside the operators."""
    names = ["rank", "key", "text_key", "spans", "score", "lang_pred", "__text", "__doc", "doc", "gone", "h1", "fp"]
    full = [(*r, "en" if (r[0] or 0) % 2 else None, *([None] * len(names))) for r in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, " + ", ".join(f"`{c}` string" for c in names)).repartition(5)


@pytest.fixture(scope="module")
def keys(docs):
    return {r.text or "": r.k for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS k").collect()}


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rank(i):
    return LAST if i is None else i


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_substrings(docs, rows):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for at in range(len(words) - 12):
            w = tuple(words[at : at + 13])
            first[w] = min(first.get(w, LAST), rank(i))
    want = []
    for i, text in rows:
        words, gone = (text or "").encode().split(), set()
        for at in range(len(words) - 12):
            if first[tuple(words[at : at + 13])] < rank(i):
                gone |= set(range(at, at + 13))
        want.append((i, len(words), len(gone), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert sum(w[2] for w in want) > 100
    assert got(substrings.dedup_substrings(docs, with_text=False)) == sorted(want, key=str)
    kept = substrings.dedup_substrings(docs).collect()
    assert all(sha((r.kept or "").encode()) == r.kept_sha256 for r in kept)


@pytest.mark.parametrize("shard", [256, 6, 1])
def test_suffixes(docs, rows, keys, shard, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SHARD", shard)
    first = {}
    order = lambda i, text: (rank(i), keys[text or ""])
    for i, text in rows:
        data = (text or "").encode()
        for at in range(len(data) - 99):
            o = (*order(i, text), at)
            first[data[at : at + 100]] = min(first.get(data[at : at + 100], o), o)
    want = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            if first[data[at : at + 100]] < (*order(i, text), at):
                gone[at : at + 100] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(data), int(gone.sum()), runs, sha(np.frombuffer(data, np.uint8)[~gone].tobytes())))
    assert sum(w[2] for w in want) > 500
    assert got(suffixdedup.dedup_suffixes(docs, with_text=False)) == sorted(want, key=str)
    for r in suffixdedup.dedup_suffixes(docs).collect():
        assert sha(bytes(r.kept)) == r.kept_sha256 and sum(s.end - s.start for s in r.removed) == r.n_removed and len(r.removed) == r.n_spans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_lines(spark):
    dice = random.Random(8)
    base = ["".join(dice.choice("abcé ") for _ in range(dice.randint(5, 14))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(dice.randint(0, 5)):
            line = list(dice.choice(base))
            for _ in range(dice.randint(0, 3)):
                at = dice.randrange(len(line))
                line[at : at + dice.randint(0, 1)] = dice.choice(["", "x", "é"])
            lines.append("".join(line))
        rows.append((i if i % 9 else None, "\n".join(lines)))
    rows += [(70, None), (71, ""), rows[5], (72, "a" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    keys = {r.text: r.k for r in df.selectExpr("text", "pmod(xxhash64(text), 1000000000) AS k").collect()}
    first = {}
    for i, text in rows:
        for n, line in enumerate((text if text is not None else "").split("\n")):
            if len(line) >= 6:
                o = (rank(i), keys[text], n)
                first[line] = min(first.get(line, o), o)
    near = {a for a in first for b in first if first[b] < first[a] and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    want = []
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        gone = [n for n, line in enumerate(lines) if len(line) >= 6 and (line in near or first[line] < (rank(i), keys[text], n))]
        want.append((i, len(lines), gone))
    assert near and got(linededup.dedup_lines(df, threshold=2, min_chars=6)) == sorted(want, key=str)
    kept = linededup.without_lines(df, threshold=2, min_chars=6)
    texts = []
    for (i, text), (_, _, gone) in zip(rows, want, strict=True):
        left = text if not gone else "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone)
        if not gone or left.strip():
            texts.append((i, left))
    assert got(kept) == sorted(texts, key=str)


def test_short_lines_that_repeat_go_at_the_default_floor(spark):
    long = "a line of more than twenty characters"
    rows = [(1, f"Home\n{long}\n\n  \n你好。"), (2, f"Home\nHomes\n{long}!\n\n  \n你好。"), (3, "Homes\nx\nHome\nx"), (4, "Home"), (5, None), (6, "\n" + " " * 30), (7, " " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = [(1, 5, []), (2, 6, [0, 2, 5]), (3, 4, [0, 2, 3]), (4, 1, [0]), (5, 0, []), (6, 2, []), (7, 1, [0])]
    assert got(linededup.dedup_lines(df)) == sorted(want, key=str)
    assert {r.doc_id: r.text for r in linededup.without_lines(df).collect()} == {1: rows[0][1], 2: "Homes\n\n  ", 3: "x", 5: None, 6: rows[5][1]}


def test_bands_equal_edit_distance(spark):
    dice = random.Random(2)
    pairs = [sorted(("".join(dice.choice("ab") for _ in range(dice.randint(1, 9))) for _ in range(2)), key=len) for _ in range(400)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        assert df.where(linededup.within(F.col("a"), F.col("b"), t) != (F.levenshtein("a", "b") <= t)).count() == 0


def test_bpe(docs, rows):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got(bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=False)) == sorted(want, key=str)
    for r in bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect():
        assert len(r.ids) == r.n_tokens and sha(bytes(r.decoded)) == r.decoded_sha256 and sha(" ".join(map(str, r.ids)).encode()) == r.ids_sha256


def groups_of(fps):
    """Smallest reachable key of every fingerprint, by links of three bits."""
    every = sorted(fps)
    root = {f: f for f in every}
    changed = True
    while changed:
        changed = False
        for a in every:
            for b in every:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash(docs, rows):
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = groups_of(set(fps))
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)]
    assert got(simhash.near_duplicates(docs)) == sorted(want, key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(root.values())) and sorted(i for i in ids if i is not None) == sorted(least.values())


def test_near_duplicates_of_the_pipeline(spark, docs, rows, tmp_path):
    """One document of each group of fingerprints within three bits, the one with the smallest id."""
    root = groups_of({simhash.fingerprint((t or "").encode()) for _, t in rows})
    least = {}
    for i, t in rows:
        own = root[simhash.fingerprint((t or "").encode())]
        least[own] = min(least.get(own, LAST), rank(i))
    kept = [rank(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == sorted(least.values())


def test_decontamination(spark, docs, rows):
    items = [("b1", " ".join((rows[0][1] or "x y").split()[:15])), ("b2", "ünïcode ä ß"), ("a3", None), (None, "a b"), ("c4", "  "), ("c5", "zz"), ("c5", "zz"), ("d6", rows[5][1])]
    items += [(None, " ".join((rows[7][1] or "x y").split()[:4]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    usable = [(n, (t or "").encode()) for n, t in items]
    words = decontaminate.words_of
    owners = {}
    for n, t in usable:
        w = words(t)
        for at in range(max(1, len(w) - 9) if w else 0):
            owners.setdefault(tuple(w[at : at + 10]), set()).add(n)
    want = []
    for i, text in rows:
        w, hit, names = words((text or "").encode()), set(), set()
        for phrase, who in owners.items():
            for at in range(len(w) - len(phrase) + 1):
                if tuple(w[at : at + len(phrase)]) == phrase:
                    hit |= set(range(at, at + len(phrase)))
                    names |= who
        want.append((i, len(w), len(hit), sorted(names, key=lambda n: (n is None, n or ""))))
    assert any(None in w[3] for w in want)  # an item without id hits words
    for block in (1 << 20, 40):  # one block, and many
        found = decontaminate.find_contamination(docs, bench, block_bytes=block)
        assert sorted(((r.doc_id, r.n_words, sum(s.end - s.first for s in r.spans), r["items"]) for r in found.collect()), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 20
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    again = decontaminate.find_contamination(clean, bench)
    assert again.where("size(spans) > 0").count() <= 1  # joining the rests may bring a short item together anew
    untouched = sorted((t for (i, t), w in zip(rows, want, strict=True) if not w[2]), key=str)
    texts = [r.text for r in clean.collect()]
    assert Counter(untouched) - Counter(texts) == Counter()
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("size(spans) > 0 OR size(items) > 0").count() == 0


def predicted(rows, labelled, settings):
    """Word first, then ever shorter n-grams, in plain Python over the labelled (lang, text)."""
    langs = sorted({lang for lang, _ in labelled})
    counts = {lang: [Counter() for _ in range(settings.longest + 1)] for lang in langs}
    padded = lambda w, k: [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]
    words = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    for lang, text in labelled:
        for w in words(text):
            counts[lang][0][w] += 1
            for k in range(1, settings.longest + 1):
                counts[lang][k].update(padded(w, k))
    known = [set().union(*(counts[lang][k] for lang in langs)) for k in range(settings.longest + 1)]

    def log(lang, k, item):
        n = counts[lang][k][item]
        return max(math.log(n / counts[lang][k].total()), settings.low) if n else settings.low

    out = []
    for text in rows:
        found = words(text)
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        total = dict.fromkeys(langs, 0.0)
        for w in found:
            k, items = 0, [w]
            if w not in known[0]:
                k = next((k for k in range(settings.longest, 0, -1) if not known[k].isdisjoint(padded(w, k))), 1)
                items = padded(w, k)
            for lang in langs:
                total[lang] += sum(log(lang, k, x) for x in items) / len(items) / len(found)
        most = max(total.values())
        odds = [math.exp((total[lang] - most) * settings.sharpness) for lang in langs]
        out.append((langs[odds.index(max(odds))], max(odds) / sum(odds)))
    return out


def test_language_id(spark):
    dice = random.Random(2)
    make = {lang: [a + b for a in letters for b in letters] for lang, letters in {"de": "abcdü", "en": "abefg", "fr": "acgéh", "es": "añ"}.items()}
    rows = [(i, lang, " ".join(dice.choice(make[lang]) + dice.choice(["", "", "x", "ung"]) for _ in range(dice.randint(1, 12)))) for i in range(120) for lang in [dice.choice(list(make))]]
    rows += [(200, None, "abc"), (201, "en", None), (202, "en", ""), (203, None, "42 ²"), (204, None, "zzz qqq"), (None, None, "ab ab"), (205, "de", "Ab, aB\ncd " * 3000)] + rows[:3]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, lang string, text string, part string, n double").repartition(4)
    for settings in (langid.Settings(), langid.Settings(longest=2)):
        for fitted in ([r for r in rows if r[1] and r[0] % 3], rows[:40], []):
            model = langid.fit(spark.createDataFrame(fitted, "doc_id bigint, lang string, text string"), settings)
            want = predicted([t for _, _, t in rows], [(lang, t) for _, lang, t in fitted if lang and t is not None], settings)
            got_ = sorted(((r.doc_id, r.text, r.lang_pred, round(r.score, 4)) for r in langid.predict(df, model, ["doc_id", "text"]).collect()), key=str)
            assert got_ == sorted(((i, t, lang, round(p, 4)) for (i, _, t), (lang, p) in zip(rows, want, strict=True)), key=str)
    kept = langid.keep_identified(df, model := langid.fit(df))
    want = predicted([t for _, _, t in rows], [(lang, t) for _, lang, t in rows if lang and t is not None], langid.Settings())
    assert kept.columns == df.columns and kept.count() == sum(lang != "und" and p >= 0.5 for lang, p in want)
    assert langid.predict(df.limit(0), model, ["doc_id"]).count() == 0


def test_language_sample_holds_the_smallest_hashes(spark):
    rows = [(i, "en", f"w{i:04d}".translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3)
    model = langid.fit(df, langid.Settings(sample_docs=50))
    first = [r.text for r in df.selectExpr("text", "xxhash64(doc_id) AS h").orderBy("h").limit(50).collect()]
    assert len(model["tables"][0].first) == 50 and (model["tables"][0].find(first) >= 0).all()


def test_language_id_on_held_out(spark, tables):
    out = queries.QUERIES["op8_language_id"](spark, tables.replace("sf0.001", "sf0.01"))
    truth = spark.read.parquet(f"{tables.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang")
    row = out.join(truth, "doc_id").where("held_out").selectExpr("count(*) AS n", "avg(CAST(lang = lang_pred AS INT)) AS right").first()
    assert row.n > 100 and row.right > 0.97


def test_lm(docs, rows):
    learn = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    split = lambda t: [*(t or "").encode().lower().split(), b" "]
    counts = Counter(w for (_, t), own in zip(rows, learn, strict=True) if own for w in split(t))
    total, floor = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    for settings in (ngramlm.Settings(), ngramlm.Settings(word_share=0.01, shard_bytes=2000)):
        out = ngramlm.score_texts(docs, "crc32(cast(doc_id AS string)) % 5 <> 1", settings).collect()
        want = sorted(((i, own, len(split(t)), sum(counts[w] > 0 for w in split(t)), total, round(sum(math.log10((counts[w] + 0.5) / floor) for w in split(t)), 6)) for (i, t), own in zip(rows, learn, strict=True)), key=str)
        assert sorted(((r.doc_id, r.learnt, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    empty = ngramlm.score_texts(docs, "false").collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in empty)


def test_lm_against_counts_of_all_training_texts(docs, rows):
    """Every probability straight from dictionaries of all n-grams, without states, arcs or shards."""
    split = lambda t: [*(t or "").encode().lower().split(), b" "]
    learn = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    texts = [split(t) for (_, t), own in zip(rows, learn, strict=True) if own]
    n = Counter(tuple(t[i : i + k]) for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1))
    total = sum(c for g, c in n.items() if len(g) == 1)
    floor = total + 0.5 * (sum(len(g) == 1 for g in n) + 1)
    priors = ngramlm.Settings().priors

    def p(c, before):
        if not before:
            return (n[c,] + 0.5) / floor
        prior = priors[len(before) - 1]
        return (n[*before, c] + prior * p(c, before[1:])) / (n[before] + prior)

    score = lambda t: sum(math.log10(p(w, tuple(t[max(0, i - 2) : i]))) for i, w in enumerate(t))
    want = sorted(((i, own, round(score(split(t)), 5)) for (i, t), own in zip(rows, learn, strict=True)), key=str)
    assert any(c == 1 for c in n.values()) and sum(not own for own in learn) > 5
    for settings in (ngramlm.Settings(), ngramlm.Settings(word_share=0.01, shard_bytes=3000, group_bytes=500), ngramlm.Settings(word_share=0.5)):
        out = ngramlm.score_texts(docs, "crc32(cast(doc_id AS string)) % 5 <> 1", settings).collect()
        assert sorted(((r.doc_id, r.learnt, round(r.score, 5)) for r in out), key=str) == want


def test_lm_beats_word_frequencies_on_held_out(spark, tables):
    row = queries.QUERIES["op6_lm_scoring"](spark, tables).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert row.s > row.b


def test_embeddings(spark):
    dice = np.random.default_rng(11)
    centre = dice.standard_normal((600, 24))
    near = [c + dice.standard_normal(24) * scale * np.linalg.norm(c) / 24**0.5 for c in centre for scale in (0.05, 0.2, 0.3, 0.34, 0.36)]
    vectors = [*centre.tolist(), *(v.tolist() for v in near)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(10000, vectors[0]), (10001, [2 * x for x in vectors[0]]), (10002, None), (10003, []), (10004, [0.0] * 24), (10005, [float("nan")] * 24), (10006, [None] * 24),
                                                       (10007, [float("inf")] + [0.0] * 23), (10008, [1.0, 0.0]), (10009, [1.0, 0.01]), (None, vectors[7])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("vec_id", "embedding", "'x' AS node", "1 AS weight", "2 AS v").repartition(4)
    out = embeddings.link_embeddings(df).collect()
    usable = [(i, np.array(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = Counter()
    for size in (2, 24):
        own = [(i, v) for i, v in usable if len(v) == size]
        unit = np.stack([v / np.linalg.norm(v) for _, v in own])
        links.update(dict(zip([i for i, _ in own], ((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist(), strict=True)))
    found = {r.vec_id: r.n_links for r in out}
    assert len(out) == len(rows) and all(found[i] <= links[i] for i in found)
    assert sum(found.values()) >= 0.95 * sum(links.values()) > 0
    assert all(found[i] == 0 for i in range(10002, 10008)) and found[10008] == found[10009] == 1
    by_id = {r.vec_id: r for r in out}
    assert by_id[10000].component_id == by_id[10001].component_id == 0 and not by_id[10000].kept and by_id[10004].kept
    hot = spark.createDataFrame([(i, [1.0 + i * 1e-5, 1.0, 0.5]) for i in range(2500)], "vec_id bigint, embedding array<double>")
    assert embeddings.link_embeddings(hot).where("n_links <> 2499 OR component_id <> 0").count() == 0


def test_urls(spark):
    hosts = ["Example.com", "www.example.com", "a.www.example.com", "example.com.", "notexample.com", "x.net", "net", "", "user@example.com:80"]
    tails = ["", "/", "/en/", "/en/x?q#f", "/en", "?/en/", "#", "/fr/é", "/es/a://b"]
    urls = [f"http://{h}{t}" for h in hosts for t in tails] + [None, "", "example.com/en/", "//example.com/en/", "a\n://net/fr/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[20], "h")], "page_id bigint, url string, host string").repartition(3)
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block"), ("", "", "block"), ("x.net", None, "allow"), ("example.com", "/en/", "allow")], "host string, path string, verdict string")
    got_ = urlfilter.judge_urls(pages, rules).collect()
    want = {}
    for u in urls:
        head, sep, rest = (u or "").partition("://")
        host = path = ""
        if sep:
            at = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
            host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
            path = tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]
        fits = [(len(h) + len(p), h + p, v) for h, p, v in [*queries.RULES, ("x.net", "", "allow")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want[u] = (host, path, best[1], best[2])
    assert len(got_) == len(urls) + 2
    assert all((r.host, r.path, r.rule, r.verdict) == want[urls[r.page_id] if r.page_id is not None else urls[20]] for r in got_)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bench = spark.createDataFrame([], "item_id string, text string")
    for df in (substrings.dedup_substrings(none), suffixdedup.dedup_suffixes(none), linededup.dedup_lines(none), linededup.without_lines(none), simhash.near_duplicates(none), simhash.one_of_each(none),
               bpe.encode_documents(none, ranks, public_tokenizers.PATTERN), decontaminate.decontaminate(none, bench), ngramlm.score_texts(none, "true"),
               embeddings.link_embeddings(spark.createDataFrame([], "vec_id bigint, embedding array<float>")),
               urlfilter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame([], "host string, path string, verdict string"))):
        assert df.count() == 0


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    """Each stage held against what its operator promises, on a table with every oddity; columns stay the same."""
    full = docs.selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", "score", "__doc")
    full.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, WORDS[0] * 3)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns and out.count() <= now.count()
        now = out
    tokens = corpus_pipeline.run(spark, str(tmp_path))
    want = now.selectExpr("doc_id", "sha2(text, 256) AS s").collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in tokens.collect()) == Counter((r.doc_id, r.s) for r in want)

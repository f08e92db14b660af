"""The parts that need no Spark, held against brute force, other implementations and round trips."""

import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import bpe, decontaminate, embeddings, langid, ngramlm, repeats, simhash, substrings, suffixdedup, urlfilter


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_finds_exactly_its_keys(coder):
    keys = list(coder.ranks)
    slots = coder.table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    strangers = [b"\x00" + k + b"\x00\xff" for k in keys[:3000]]
    assert (coder.table.slots([s for s in strangers if s not in coder.ranks]) == -1).all()
    assert bpe.PerfectHash([]).slots([b"a"]).tolist() == [-1]
    assert bpe.PerfectHash([b"a"]).slots([b"a", b"b"]).tolist() == [0, -1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t'aàbst1²߀😀\x1c\x85\xa0S.-漢|<>"), max_size=60))
def test_ids_are_those_of_the_library(coder, library, text):
    ids = coder.encode([text])[0]
    assert list(map(int, ids.split())) == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 3000 + " " * 2000, "<|endoftext|>", "", "\n\n  x"])
def test_long_and_odd_texts(coder, library, text):
    assert list(map(int, coder.encode([text])[0].split())) == library.encode_ordinary(text)


def test_rank_file_needs_all_bytes(tmp_path):
    file = tmp_path / "few"
    file.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(200)))
    with pytest.raises(ValueError):
        bpe.Coder(bpe.read_ranks(str(file)), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_order_by_grouping(symbols):
    symbols = [*symbols, 0]
    assert suffixdedup.suffix_order(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=80))
def test_suffix_array_of_an_index(values):
    text = np.array([*values, 0])
    assert suffix_list(text) == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def suffix_list(text):
    return decontaminate.suffix_array(text).tolist()


def test_classes_of_windows():
    which, offset, kind = suffixdedup.classes([b"abcdeabcde", b"xxabcdeyy", b"ab"], 5)
    by_kind = {}
    for w, o, k in zip(which.tolist(), offset.tolist(), kind.tolist(), strict=True):
        by_kind.setdefault(k, set()).add((w, o))
    assert {(0, 0), (0, 5), (1, 2)} in by_kind.values()
    assert sum(len(v) for v in by_kind.values()) == 6 + 5


def phrases_in(docs, items, window):
    owners = {}
    for name, text in items:
        words = decontaminate.words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(tuple(words[i : i + window]), set()).add(name)
    out = []
    for text in docs:
        words, hit, names = decontaminate.words_of(text), set(), set()
        for phrase, who in owners.items():
            for i in range(len(words) - len(phrase) + 1):
                if tuple(words[i : i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    names |= who
        out.append((len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_index_finds_every_phrase(seed):
    dice = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh"
    text = lambda n: " ".join(dice.choice(letters) for _ in range(n)).encode()
    items = [(str(k), text(dice.choice([0, 1, 3, 6, 9]))) for k in range(6)]
    docs = [text(dice.choice([0, 2, 8, 40, 120])) for _ in range(12)] + [None]
    phrases = decontaminate.Phrases(items, 4)
    starts, sizes, found = phrases.find([decontaminate.words_of(d) for d in docs])
    edges = np.cumsum([0, *(len(decontaminate.words_of(d)) for d in docs)])
    row = np.searchsorted(edges, starts, side="right") - 1
    got = []
    for r in range(len(docs)):
        own = row == r
        spans = decontaminate._merged(starts[own].tolist(), (starts[own] + sizes[own]).tolist())
        got.append((sum(s["end"] - s["first"] for s in spans), sorted({phrases.names[i] for i in found[own].tolist()})))
    assert got == phrases_in(docs, items, 4)


def test_words_and_cut_text():
    assert decontaminate.words_of("Ab-c  É9_x\u00a0y".encode()) == [b"ab", b"c", "É9".encode(), "x\u00a0y".encode()]
    assert decontaminate.removed_text("One, two three! four", [{"first": 1, "end": 3}]) == "One, ! four".replace(", !", ", !")


def plain_fingerprint(text, size=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "   ", "One", "one TWO", "a b c", "a b c d e\nÉ f g " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("shards", [1, 4, 9])
def test_trees_find_all_groups(shards):
    dice = np.random.default_rng(shards)
    base = dice.integers(0, 2**64, 300, dtype=np.uint64)
    fps = base[dice.integers(0, len(base), 900)]
    for _ in range(5):
        fps = fps ^ (np.uint64(1) << dice.integers(0, 64, 900, dtype=np.uint64)) * (dice.random(900) < 0.4).astype(np.uint64)
    fps = np.unique(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = np.arange(len(fps))
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    tree = simhash.Tree(fps[:400], shards)
    rows, shard, home = tree.deal(fps, 3)
    assert (np.bincount(rows[home], minlength=len(fps)) == 1).all()
    links = []
    for k in range(tree.shards):
        own, other = rows[(shard == k) & home], rows[(shard == k) & ~home]
        every = np.concatenate([own, other])
        links += [(int(every[i]), int(every[r])) for i, r in enumerate(simhash.local_groups(fps[own], fps[other], 3))]
    got = np.arange(len(fps))
    while True:
        before = got.copy()
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
        if (before == got).all():
            break
    assert (got == want).all()


def test_urls_and_sweep():
    assert urlfilter.split_url("HTTP://WWW.Ex.com?x=1#y") == ("www.ex.com", "")
    assert urlfilter.split_url("x://a/b://c?d") == ("a", "/b://c")
    assert urlfilter.split_url(None) == urlfilter.split_url("no scheme") == ("", "")
    key = urlfilter.host_key
    events = [(key("com"), True, "com", "/", "allow"), (key("a-b.com"), True, "a-b.com", "/x", "block"), (key("a.com"), True, "a.com", "/x", "block"), (key("a.com"), True, "a.com", "/x", "allow"),
              (key("w.a.com") + "\0", False, "w.a.com", "/xy", None), (key("a-b.com") + "\0", False, "a-b.com", "/", None), (key("com") + "\0", False, "com", "", None), (key("aa.com") + "\0", False, "aa.com", "/x", None)]
    got = urlfilter.sweep(*map(list, zip(*events, strict=True)))
    assert got[4:] == [("a.com/x", "block"), ("com/", "allow"), (None, None), ("com/", "allow")]


def test_rotation_is_orthogonal_and_balanced():
    sample = np.random.default_rng(1).standard_normal((500, 16))
    mean, projection = embeddings.learn_rotation(sample, 16, 3)
    assert np.allclose(projection.T @ projection, np.eye(16), atol=1e-8)
    ones = ((sample - mean) @ projection >= 0).mean(axis=0)
    assert ((ones > 0.3) & (ones < 0.7)).all()


def test_automaton_is_a_distribution():
    """After each context the chances of all words, one unknown one among them, add up to one."""
    texts = [b"a b a a b", b"a a b c", b"b c a", None]
    own = [ngramlm.tokens_of(t) for t in texts]
    n = Counter(tuple(t[i : i + k]) for t in own for k in (1, 2, 3) for i in range(len(t) - k + 1))
    vocabulary = sorted({w for t in own for w in t})
    floor = sum(map(len, own)) + 0.5 * (len(vocabulary) + 1)
    for before in ([], [b"a"], [b"c"], [b"a", b"b"], [b"a", b"a"], [b"c", b"c"], [b"zz"], [b"a", b"zz"]):
        total = 0.0
        for last in [*vocabulary, b"unknown"]:
            words = [*before, last]
            shard = ngramlm.Shard([b" ".join(w for w in words if w != ngramlm.END)] if last != ngramlm.END else [b" ".join(before)], {})
            number = {-1 - (xxhash.xxh64_intdigest(w, 42) >> 1): w for w in [*words, ngramlm.END]}
            counts = np.array([n[tuple(number[i] for i in key if i != ngramlm.ALONE)] for key in shard.wanted().T.tolist()], float)
            automaton = ngramlm.Automaton(shard, *np.split(counts, np.cumsum([len(shard.names), len(shard.pairs)])), floor, (2.0, 3.0))
            lists = shard.tokens.tolist(), shard.pair_of.tolist(), shard.gram_of.tolist()
            total += 10 ** (automaton.score(lists[0][: len(words)], *lists[1:]) - automaton.score(lists[0][: len(before)], *lists[1:]))
        assert total == pytest.approx(1, abs=1e-9)


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1 << 40)), min_size=1, max_size=40))
def test_sums_of_equal_grams(rows):
    key, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    want = Counter()
    for k, m in rows:
        want[k] += m
    assert (ngramlm.unblock(ngramlm.block(n), len(n)) == n).all()
    assert ngramlm.summed(key, n).tolist() == [want[k] for k, _ in rows]


def test_word_first_then_shorter_grams():
    low, none = langid.Settings().low, langid.Items([], np.zeros((0, 2), np.float32))
    tables = [langid.Items(["the"], np.array([[-1.0, low]], np.float32)), none, langid.Items(["<x"], np.array([[-3.0, -2.0]], np.float32)), none, none, none]
    scorer = langid.Scorer({"langs": ["en", "fr"], "tables": tables, "settings": langid.Settings()})
    the, x, y = scorer.words(["the", "x", "y"]).tolist()
    assert the == [-1.0, low] and y == [low, low]
    assert x == [(-3 + low) / 2, (-2 + low) / 2]  # by its one known pair of two
    assert scorer.predict([None, "", "12 ²", "the"])[0] == ["und", "und", "und", "en"]
    assert langid.Scorer({"langs": [], "tables": [none] * 6, "settings": langid.Settings()}).predict(["a"]) == (["und"], [0.0])


def test_every_window_has_one_anchor_of_its_own_content():
    dice = np.random.default_rng(5)
    units = repeats.mix(dice.integers(1, 50, 3000).astype(np.uint64))
    sizes = np.array([0, 5, 1500, 13, 12, 1470])
    found = repeats.anchors(units, sizes, repeats.Shape(13, 4, False))
    begin = np.cumsum(sizes) - sizes
    seen = {}
    owned = 0
    for doc, pos, start, end, context in zip(*(found[c].tolist() for c in ("doc", "pos", "start", "end", "context")), strict=True):
        owned += end - start - 12
        assert 0 <= start <= pos and pos + 4 <= end <= sizes[doc]
        text = units[begin[doc] + start : begin[doc] + end].tobytes()
        assert seen.setdefault(context, (text, pos - start)) == (text, pos - start)
    assert owned == sum(max(0, n - 12) for n in sizes.tolist())


def test_levels_double_up_to_the_window():
    assert substrings._levels(4, 13) == [8, 13] and substrings._levels(4, 8) == [8] and substrings._levels(3, 100) == [6, 12, 24, 48, 96, 100]

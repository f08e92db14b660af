"""Conversation repair against exhaustive search, and the whole operator against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pagemill.llm import conversations as cv

BLANK, GOOD = "\t\n\x0b\f\r ", re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """[(initial, fault)] -> (cost, audit): Dijkstra over (place, last initial) with whole audits as ties."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(turns) and last in ("", "a"):
            return cost, audit
        steps = [("I", 5, at, x) for x in "ua"]
        if at < len(turns):
            initial, fault = turns[at]
            steps.append(("D", 2, at + 1, last))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                steps += [("K", extra, at + 1, initial)] + [("R", 1 + extra, at + 1, x) for x in "ua"]
        for edit, price, to, x in steps:
            moved = edit != "D"
            if not moved or (x == "s" and last == "") or (x == "u" and last in ("", "s", "a")) or (x == "a" and last == "u"):
                heapq.heappush(heap, (cost + price, audit + edit, to, x if moved else last))
    raise AssertionError


def wanted(rows):
    """Contract of the query in plain Python; conversations in the order given below."""
    table, ids = {}, {}
    for conv, turn, role, text in rows:
        ids[conv] = None
        which = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
        role = "user" if which == 4 else role
        table.setdefault(conv, []).extend([(turn, role, text)] * (0 if which == 0 else 2 if which == 3 else 1))
    out = {}
    for conv in ids:
        held = sorted(table.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], keyed(r[2])))
        seen, faults, turns = set(), [], {r[0] for r in held if r[0] is not None}
        for _, role, text in held:
            core = text.strip(BLANK)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] or "?" for r in held]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        at, left, last = 0, [], ""
        for edit in audit:
            follows = "a" if last == "u" else "u"
            if edit == "I":
                left.append((follows, ""))
                last = follows
                continue
            (_, role, text), at = held[at], at + 1
            if edit == "K":
                left.append((role, text))
                last = role[0]
            elif edit == "R":
                left.append((follows, text))
                last = follows
        names = {"u": "user", "a": "assistant"}
        lines = "\n".join(f"{names.get(r, r)}:{t}" for r, t in left)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(lines.encode()).hexdigest(),
        )
    return out


HASHES = {}


def keyed(text):
    return HASHES[text]


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_cheapest_and_least_audit(seed):
    dice = random.Random(seed)
    for _ in range(250):
        kinds = dice.choice(["ua", "sua", "sua?", "suuaa", "s", "u"])
        turns = [(dice.choice(kinds), dice.choice(["", "", "", "blank", "truncated", "duplicate"])) for _ in range(dice.randint(0, 14))]
        codes = bytes(3 * "sua?".index(i) + {"": 0, "truncated": 2}.get(f, 1) for i, f in turns)
        want = cheapest(turns)
        assert cv.search(codes, cv.START, cv.TRAILING)[:2] == want
        was, cv.BLOCK = cv.BLOCK, dice.randint(1, 5)
        try:
            assert cv.search_long(codes, cv.START, cv.TRAILING)[:2] == want
        finally:
            cv.BLOCK = was


def test_search_of_a_long_conversation_stays_linear():
    dice = random.Random(1)
    codes = bytes(3 * dice.randrange(4) + dice.randrange(3) for _ in range(60_000))
    cost, audit, _ = cv.search_long(codes, cv.START, cv.TRAILING)
    assert cost == cv.suffix_bounds(codes, cv.TRAILING)[0][cv.START]
    assert sum({"D": 2, "I": 5}.get(e, 0) for e in audit) <= cost and len(audit.replace("I", "")) == len(codes)


def odd_turns():
    dice = random.Random(9)
    texts = ["Yes.", "No!", "What? ", "cut", "", " \n", "long words " * 3000 + ".", "a.b", "Ünï.", " ", "x!y?"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown", "Assistant"]
    rows = []
    for conv in [*range(40), None, 99]:
        n = 700 if conv == 99 else dice.randint(1, 9)
        for t in range(n):
            turn = t if dice.random() < 0.9 else dice.choice([None, t + 3, t - 1])
            rows.append((conv, turn, ("user", "assistant")[t % 2] if dice.random() < 0.7 else dice.choice(roles), None if dice.random() < 0.03 else f"{t}." if dice.random() < 0.5 else dice.choice(texts)))
    rows += rows[5:9] + [(1000, k, "user", "Gone.") for k in range(3) if zlib.crc32(f"1000:{k}".encode()) % 20 == 0]
    dropped = next(i for i in range(2000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Nothing is left of this one."))
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [3, 8])
def test_whole_operator(spark, parts):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, part int").repartition(4)
    damaged = cv.damage(df)
    HASHES.update({r.text: (r.h1, r.h2) for r in damaged.selectExpr("text", "xxhash64(text) AS h1", "xxhash64(1, text) AS h2").collect()})
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.conv_id: tuple(r)[1:] for r in cv.repair_conversations(damaged, all_ids=df).collect()}
        edits = cv.find_edits(damaged)
        left = cv.repaired_turns(damaged, edits).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = wanted(rows)
    assert got == want
    by_conv = {}
    for r in sorted(left, key=lambda r: r.number):
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv, held in by_conv.items():
        assert GOOD.fullmatch("".join(r.role[0] for r in held))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in held).encode()).hexdigest() == want[conv][-1]
        assert [r.number for r in held] == list(range(1, len(held) + 1))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cv.repair_conversations(cv.damage(none), all_ids=none).collect() == []

"""Repair of the structure of conversations: the cheapest edits that leave an optional system turn and then user and
assistant turns in alternation, found by a depth-first branch and bound.

Only narrow rows are ordered: a turn is its place, two hashes of its text and a code of one byte (initial of its role,
first fault). Runs of codes come out of one range-partitioned sort, so a conversation of any length is spread over as
many tasks as it fills. A run that touches an end of its partition is *open*: its costs from every state to every state
(16 numbers, at most two runs per partition) are chained on the driver, which gives every run the exact cost of what
follows; then all runs are searched on their own. Texts move once, to be replayed against the edits in one pass that
holds a turn at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import parts_for, saved

BLANKS = "\t\n\x0b\f\r "
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs; CUT_OFF is added for a truncated turn that stays
WHOLE, MUST_GO, TRUNCATED = 0, 1, 2  # what the search has to know of a turn's fault
START, SYSTEM, USER, ASSISTANT = range(4)  # what was written last; a turn of initial class c leads to state c + 1
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the one state that a user or assistant turn can lead to
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
TRAILING = (0, 2 * INSERT, INSERT, 0)  # least cost after the last turn
NEVER = 1 << 40
BLOCK = 4_096  # turns searched at once; beyond, the search goes on from the state the block before ended in


def _moves(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """Edits that use up a turn of this code: (initial, cost, next state), in order of the initials."""
    kind, fault = divmod(code, 3)
    out = [("D", DELETE, state)]
    if fault != MUST_GO:
        extra = CUT_OFF if fault == TRUNCATED else 0
        if (kind == 0 and state == START) or (kind in (1, 2) and FOLLOWS[state] == kind + 1):
            out.append(("K", KEEP + extra, kind + 1))
        if kind + 1 != FOLLOWS[state]:
            out.append(("R", REROLE + extra, FOLLOWS[state]))
    return tuple(out)


MOVES = [[_moves(code, state) for state in range(4)] for code in range(12)]


def suffix_bounds(codes: bytes, ends: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Per place and state a lower bound of what the rest costs, audits left out of account; ``ends`` is the bound after
    the last turn, what is put in there included."""
    bounds, after = [ends], ends
    for code in reversed(codes):
        start, system, user, assistant = (min(cost + after[to] for _, cost, to in moves) for moves in MOVES[code])
        user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
        after = (min(start, INSERT + user), min(system, INSERT + user), user, assistant)
        bounds.append(after)
    bounds.reverse()
    return bounds


class Prefix:
    """Edits up to a node, as a link to the shorter prefix: a search over long conversations copies no audits."""

    __slots__ = ("before", "cost", "edit", "length")

    def __init__(self, cost: int, length: int, edit: str, before: Prefix | None):
        self.cost, self.length, self.edit, self.before = cost, length, edit, before

    def audit(self) -> str:
        out, at = [], self
        while at.before is not None:
            out.append(at.edit)
            at = at.before
        return "".join(reversed(out))


def earlier(a: Prefix, b: Prefix) -> bool:
    """Whether the audit of ``a`` comes before that of ``b``: compared where the two part."""
    first, second = a, b
    while first.length > second.length:
        first = first.before
    while second.length > first.length:
        second = second.before
    if first is second:
        return a.length < b.length
    while first.before is not second.before:
        first, second = first.before, second.before
    return first.edit < second.edit if first.edit != second.edit else a.length < b.length


def search(codes: bytes, entry: int, ends: tuple[int, ...], last: bool = True) -> tuple[int, str, int]:
    """Cheapest (cost, audit) of ``codes`` entered in state ``entry``, ties to the ASCII-least audit, and the state it
    ends in. Depth first with an explicit stack: a node is a place and a state; a prefix goes on only if its cost and the
    suffix bound don't exceed the incumbent and no cheaper or equal and earlier prefix has reached the same node."""
    n, bounds = len(codes), suffix_bounds(codes, ends)
    root = Prefix(0, 0, "", None)
    best, incumbent, found, end = {entry: root}, NEVER, None, entry
    stack = [(root, 0, entry)]
    while stack:
        prefix, at, state = stack.pop()
        cost = prefix.cost
        if cost + bounds[at][state] > incumbent or best[4 * at + state] is not prefix:
            continue
        if at == n:
            total = cost if last else cost + ends[state]
            if (not last or state in (START, ASSISTANT)) and (found is None or total < incumbent or (total == incumbent and earlier(prefix, found))):
                incumbent, found, end = total, prefix, state
            steps = [("I", INSERT, FOLLOWS[state])] if last and state in (SYSTEM, USER) else []
        else:
            steps = [*MOVES[codes[at]][state], ("I", INSERT, FOLLOWS[state])]
        open_nodes = []
        for edit, price, to in steps:
            place = at if edit == "I" else at + 1
            promise = cost + price + bounds[place][to]
            if promise > incumbent:
                continue
            key, held = 4 * place + to, Prefix(cost + price, prefix.length + 1, edit, prefix)
            known = best.get(key)
            if known is None or held.cost < known.cost or (held.cost == known.cost and earlier(held, known)):
                best[key] = held
                open_nodes.append((promise, edit, held, place, to))
        open_nodes.sort(key=lambda node: node[:2], reverse=True)  # the most promising, earliest edit is looked at first
        stack.extend(node[2:] for node in open_nodes)
    return found.cost, found.audit(), end


def search_long(codes: bytes, entry: int, ends: tuple[int, ...], last: bool = True) -> tuple[int, str, int]:
    """:func:`search` block by block: the bound after a block is exact, so its best prefix is the best of the whole."""
    cuts, after = list(range(0, len(codes), BLOCK)) or [0], [ends]
    for at in reversed(cuts[1:]):
        after.append(suffix_bounds(codes[at : at + BLOCK], after[-1])[0])
    cost, audits, state = 0, [], entry
    for at in cuts:
        final = at == cuts[-1]
        price, audit, state = search(codes[at : at + BLOCK], state, after.pop(), last and final)
        cost += price
        audits.append(audit)
    return cost, "".join(audits), state


@lru_cache(maxsize=200_000)
def search_short(codes: bytes) -> tuple[int, str, int]:
    return search(codes, START, TRAILING)


def span_costs(codes: bytes) -> list[int]:
    """Least cost from every state (rows) to every state (columns), the turns put in after the last one left out."""
    columns = []
    for to in range(4):
        after = tuple(0 if s == to else NEVER for s in range(4))
        for at in reversed(range(0, len(codes), BLOCK)):
            after = suffix_bounds(codes[at : at + BLOCK], after)[0]
        columns.append(after)
    return [min(columns[to][s], NEVER) for s in range(4) for to in range(4)]


def _turn_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    own = rows.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    return own.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _code(role: Column, text: Column) -> Column:
    """3 x class of the role's initial + fault; blanks count as MUST_GO, duplicates are told by their place."""
    held = F.rtrim(text, F.lit(BLANKS))
    kind = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring(role, 1, 1)), F.lit(0)), F.lit(4)) - 1
    kind = F.when(role == "", 3).otherwise(kind)
    fault = F.when(held == "", MUST_GO).when(F.substring(held, -1, 1).isin(".", "!", "?"), WHOLE).otherwise(TRUNCATED)
    return (3 * kind + fault).cast("int")


PLACE = ["conv", "turn", "role", "h1", "h2"]
RUN = (
    "part int, run int, conv bigint, turn bigint, role string, h1 bigint, h2 bigint, open boolean, least bigint, most bigint, turns bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first int, last int, costs array<bigint>, codes binary, cost bigint, audit string"
)
RUN_ARROW = pa.schema(
    [(n, t) for n, t in zip(
        [c.split()[0] for c in RUN.split(", ")],
        [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
         pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.string()],
        strict=True,
    )]
)
LEGAL = {(0, 1), (1, 2), (2, 1)}


class Run:
    """What is gathered of one conversation's turns in one partition; a byte per turn."""

    def __init__(self, place: tuple):
        self.place, self.codes, self.turn = place, bytearray(), None
        self.least, self.turns, self.faults, self.illegal, self.first, self.last = None, 0, [0, 0, 0], 0, None, None

    def add(self, turn: int | None, code: int, duplicate: bool) -> None:
        kind, fault = divmod(code, 3)
        if turn is not None and (self.least is None or turn != self.turn):
            self.least = turn if self.least is None else self.least
            self.turns += 1
        self.turn = turn
        if fault == MUST_GO:
            self.faults[0] += 1
        elif duplicate:
            self.faults[1] += 1
            code = 3 * kind + MUST_GO
        elif fault == TRUNCATED:
            self.faults[2] += 1
        if self.last is not None and (self.last, kind) not in LEGAL:
            self.illegal += 1
        if self.first is None:
            self.first = kind
        self.last = kind
        self.codes.append(code)

    def row(self, part: int, run: int, is_open: bool) -> tuple:
        codes = bytes(self.codes)
        if is_open:
            end = (span_costs(codes), codes, None, None)
        else:
            cost, audit, _ = search_short(codes) if len(codes) <= 64 else search_long(codes, START, TRAILING)
            end = (None, None, cost, audit)
        return (part, run, *self.place, is_open, self.least, self.turn, self.turns, *self.faults, self.illegal, self.first, self.last, *end)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted marks and turns of a partition to its runs. A mark comes right before the first turn of its text."""
    part, done, rows, now, marked = TaskContext.get().partitionId(), 0, [], None, None
    for batch in batches:
        for conv, turn, role, h1, h2, is_turn, code, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not is_turn:
                marked = (conv, turn, role, h1, h2)
                continue
            if now is None or now.place[0] != conv:
                if now is not None:
                    rows.append(now.row(part, done, done == 0))
                    done += 1
                now = Run((conv, turn, role, h1, h2))
            new = marked == (conv, turn, role, h1, h2)
            for copy in range(copies):
                now.add(turn, code, copy > 0 or not new)
            marked = None
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN_ARROW.types, strict=True)], schema=RUN_ARROW)
            rows = []
    if now is not None:
        rows.append(now.row(part, done, True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN_ARROW.types, strict=True)], schema=RUN_ARROW)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs, each searched from every state it may be entered in."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            for entry in row["entries"]:
                cost, audit, end = search_long(row["codes"], entry, tuple(row["ends"]), row["final"])
                out.append((row["part"], row["run"], entry, end, cost, audit))
        names, kinds = ["part", "run", "entry", "exit", "cost", "audit"], [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def find_edits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of every conversation, as runs of turns: conv, the place of the run's first turn (turn, role,
    h1, h2), entry (state before it), audit (edits' initials K, R, D, I in order), cost, and what the report sums up.

    Turns are in order of turn (nulls first), then role, then the hashes of the text (only turns of equal number). Null
    role and text are one blank, null ids are one conversation. Repeated rows are duplicates, a role without an initial
    has none of the legal ones, texts are whole at any length, other columns are not looked at, an empty table gives an
    empty one."""
    spark, parts = rows.sparkSession, parts_for(rows.sparkSession)
    turns = _turn_rows(rows, conv_col, turn_col, role_col, text_col)
    distinct = turns.withColumn("code", _code(F.col("role"), F.col("text"))).groupBy(*PLACE, "code").agg(F.count(F.lit(1)).alias("copies"))
    marks = distinct.groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("first")).select("conv", "first.turn", "role", "h1", "h2")
    listed = distinct.select(*PLACE, F.lit(True).alias("is_turn"), "code", "copies")
    listed = listed.unionByName(marks.select(*PLACE, F.lit(False).alias("is_turn"), F.lit(0).alias("code"), F.lit(0).cast("bigint").alias("copies")))
    runs = saved(listed.repartitionByRange(parts, *PLACE).sortWithinPartitions(*PLACE, "is_turn").mapInArrow(_runs, RUN), "runs")

    # at most two open runs per partition: numbers only
    chains: dict[int | None, list] = {}
    for r in sorted(runs.where("open").select("part", "run", "conv", "least", "most", "first", "last", "costs").collect(), key=lambda r: (r.part, r.run)):
        chains.setdefault(r.conv, []).append(r)
    plan, joints = [], []
    for chain in chains.values():
        ends = TRAILING
        for at in reversed(range(len(chain))):
            r, before = chain[at], chain[at - 1] if at else None
            plan.append((r.part, r.run, [START] if not at else [0, 1, 2, 3], list(ends), at == len(chain) - 1))
            costs = [min(r.costs[4 * s + to] + ends[to] for to in range(4)) for s in range(4)]
            ends = tuple(min(NEVER, c) for c in costs)
            if before is not None:
                joints.append((r.part, r.run, int((before.last, r.first) not in LEGAL), int(before.most is not None and before.most == r.least)))
    plan_rows = spark.createDataFrame(plan, "part int, run int, entries array<int>, ends array<bigint>, final boolean")
    entered = runs.where("open").select("part", "run", "codes").join(F.broadcast(plan_rows), ["part", "run"])
    entered = saved(entered.mapInArrow(_entered, "part int, run int, entry int, exit int, cost bigint, audit string"), "entered")
    ways = {(r.part, r.run, r.entry): r.exit for r in entered.select("part", "run", "entry", "exit").collect()}
    chosen = []
    for chain in chains.values():
        state = START
        for r in chain:
            chosen.append((r.part, r.run, state))
            state = ways[r.part, r.run, state]
    settled = entered.join(F.broadcast(spark.createDataFrame(chosen, "part int, run int, entry int")), ["part", "run", "entry"]).select("part", "run", "entry", "cost", "audit")
    joined = spark.createDataFrame(joints, "part int, run int, bent int, shared int")
    told = runs.drop("costs", "codes", "first", "last")
    opened = told.where("open").drop("cost", "audit").join(F.broadcast(settled), ["part", "run"]).join(F.broadcast(joined), ["part", "run"], "left")
    opened = opened.withColumns({"illegal": F.col("illegal") + F.coalesce("bent", F.lit(0)), "turns": F.col("turns") - F.coalesce("shared", F.lit(0))}).drop("bent", "shared")
    closed = told.where("NOT open").withColumn("entry", F.lit(START))
    return closed.unionByName(opened).drop("open", "run")


def report(rows: DataFrame, edits: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation of ``rows``: gaps, blank, duplicate, truncated, illegal, cost and audit; zeros and an empty audit
    for those without edits (no turns)."""
    ids = rows.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv")).distinct()
    numbers = ["least", "most", "turns", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = ids.select("conv", *(F.lit(None).cast("bigint").alias(c) for c in numbers), F.lit(None).cast("int").alias("part"), F.lit(None).cast("string").alias("audit"))
    both = edits.select("conv", *numbers, "part", "audit").unionByName(empty)
    pieces = F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit"))))
    sums = both.groupBy("conv").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).cast("bigint").alias("gaps"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(pieces, lambda p: p.audit), "").alias("audit"),
    )
    return sums.withColumnRenamed("conv", "conv_id")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, new conversation?, number, edit, turn, role, text) of the turns that a repaired conversation consists of."""
    nothing = object()
    now, audit, at, state, number = nothing, "", 0, START, 0

    def inserted(turn: int | None) -> Iterator[tuple]:
        nonlocal at, state, number
        while at < len(audit) and audit[at] == "I":
            state, at, number = FOLLOWS[state], at + 1, number + 1
            yield now, number, "I", turn, ROLES[state], ""

    for batch in batches:
        for conv, turn, role, text, edits, entry in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "audit", "entry")), strict=True):
            if edits is not None:
                yield from inserted(None)
                if now is nothing or now != conv:
                    now, number = conv, 0
                audit, at, state = edits, 0, entry
                continue
            yield from inserted(turn)
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            number += 1
            if edit == "K":
                state = INITIALS.index(role[0]) + 1
            else:
                state = FOLLOWS[state]
                role = ROLES[state]
            yield conv, number, edit, turn, role, text
    yield from inserted(None)


def _in_order(rows: DataFrame, edits: DataFrame, *columns: str) -> DataFrame:
    texts = _turn_rows(rows, *columns).select(*PLACE, F.lit(1).alias("kind"), "text", F.lit(None).cast("string").alias("audit"), F.lit(0).alias("entry"))
    heads = edits.select(*PLACE, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "audit", "entry")
    return texts.unionByName(heads).repartition("conv").sortWithinPartitions(*PLACE, "kind")


def repaired_turns(rows: DataFrame, edits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, number (from 1), edit (K, R or I), turn (of the turn itself, or of the one an
    inserted turn stands before; null at the end), role, text."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        kinds, names = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], ["conv_id", "number", "edit", "turn", "role", "text"]
        for row in _replayed(batches):
            held.append(row)
            size += len(row[-1])
            if len(held) == 1000 or size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return _in_order(rows, edits, conv_col, turn_col, role_col, text_col).mapInArrow(turns, "conv_id bigint, number bigint, edit string, turn bigint, role string, text string")


def repaired_digests(rows: DataFrame, edits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and the SHA-256 of its repaired ``role:text`` lines; no row where no turn is left."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums, now = [], [], None
        for conv, number, _, _, role, text in _replayed(batches):
            if number == 1:
                if now is not None:
                    sums.append(now.hexdigest())
                ids.append(conv)
                now = hashlib.sha256()
            else:
                now.update(b"\n")
            now.update(f"{role}:{text}".encode())
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([*sums, now.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return _in_order(rows, edits, conv_col, turn_col, role_col, text_col).mapInArrow(digests, "conv_id bigint, repaired_sha256 string")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", all_ids: DataFrame | None = None) -> DataFrame:
    """:func:`report` with the digest of every repaired conversation. ``all_ids`` holds conversations that are to be
    reported even if ``rows`` has no turn of theirs."""
    edits = saved(find_edits(rows, conv_col, turn_col, role_col, text_col), "edits")
    told = report(rows if all_ids is None else all_ids, edits, conv_col)
    sums = repaired_digests(rows, edits, conv_col, turn_col, role_col, text_col).withColumnRenamed("conv_id", "own")
    joined = told.join(sums, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults put into conversations by the CRC of ``conversation:turn`` modulo 20: 0 drops the turn, 1 empties it, 2 takes
    its stops away, 3 repeats it, 4 makes it the user's. Nulls of ids are one blank in that text; so are roles and texts."""
    conv, turn = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")
    which = F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    damaged = {
        conv_col: conv, turn_col: turn, role_col: F.when(which == 4, F.lit("user")).otherwise(role),
        text_col: F.when(which == 1, F.lit("")).when(which == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text),
    }
    copies = F.when(which == 0, F.array()).when(which == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(F.explode(copies.cast("array<int>")), *(c.alias(n) for n, c in damaged.items())).select(*(f"`{n}`" for n in damaged))


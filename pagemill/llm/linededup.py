"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line of ``n`` characters is cut into threshold + 1 even segments. Two lines within the threshold share a segment of the
shorter one, shifted by no more than the edits left for either side; so the longer one probes, for each length the
shorter may have, the few substrings that can line up (chosen by their distance to the segment from the left and from
the right). Shared keys make candidates, and a banded bit-parallel edit distance decides.

Every line is judged on the input: a line goes if the same line, or one within the threshold, starts earlier (smaller
id, or same document and smaller line number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import rank_of, saved, whole_row

THRESHOLD = 2
NEAR_CHARS = 20  # lines under it are compared for equality only: two edits would make many short lines alike
LETTERS = "abcdefghijklmnopqrstuvwxyz"  # counted to rule pairs out; right with any choice of up to 60
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS  # of line hashes, each with 64 classes in a word of bits; bound of the one table that is broadcast


PIECE = 28  # bits for a place in a line, and for a length


def _piece(length: Column, segment: int, threshold: int, shift: int = 0) -> Column:
    """A segment of a line of ``length`` characters, moved by ``shift``, as one number: segment, first character (from 1),
    number of characters. The last segments have one character more where the division leaves a rest."""
    n = threshold + 1
    short = (length / n).cast("bigint")
    longer = n - (length - short * n)  # segments from this number on have one character more
    start = short * segment + F.greatest(F.lit(0), F.lit(segment) - longer) + (1 + shift)
    size = short + F.when(F.lit(segment) >= longer, 1).otherwise(0)
    return start * (1 << PIECE) + size + (segment << 2 * PIECE)


def index_pieces(length: Column, threshold: int) -> Column:
    return F.array(*(_piece(length, i, threshold) for i in range(threshold + 1)))


def probe_pieces(length: Column, threshold: int) -> Column:
    """The substrings that may equal a segment of a line shorter by 0..threshold characters.

    A segment moved by ``s`` has at least |s| edits on its left and |s - d| on its right (``d``: difference in length);
    with the earlier and the later segments differing at least once each, s lies within segment number and segments
    left of the threshold on both counts."""
    pieces = [
        _piece(length - d, i, threshold, s)
        for i in range(threshold + 1) for d in range(threshold + 1) for s in range(-threshold, threshold + 1)
        if abs(s) <= i and abs(s - d) <= threshold - i
    ]
    return F.array_distinct(F.array(*pieces))


def piece_key(line: Column, piece: Column) -> Column:
    """Hash of the segment's number, its length (which tells the line's length but for the rest of the division) and its
    characters."""
    mask = (1 << PIECE) - 1
    size = piece.bitwiseAND(mask).cast("int")
    start = F.shiftright(piece, PIECE).bitwiseAND(mask).cast("int")
    return F.xxhash64(F.shiftright(piece, 2 * PIECE), size, F.substring(line, start, size))


def within(shorter: Column, longer: Column, threshold: int) -> Column:
    """Whether the edit distance is at most ``threshold``: the band of 2 * threshold + 1 rows around the diagonal is one
    word of vertical differences, worked off column by column with bit operations.

    Bit k of a word stands for row j - threshold + k of column j. ``equal`` marks the rows whose character is the
    column's; ``same`` the cells equal to their diagonal neighbour. The distance is followed along the diagonal that
    ends in the last cell, where a cell that is not ``same`` adds one. State: up | down << width | distance << 2 width."""
    width = 2 * threshold + 1
    full = (1 << width) - 1
    big = lambda x: F.lit(x).cast("bigint")
    rows = F.concat(F.array_repeat(F.lit(""), threshold), F.split(shorter, ""), F.array_repeat(F.lit(""), 2 * threshold))
    columns = F.split(longer, "")

    def column(state: Column, x: Column) -> Column:
        """x: struct of the column's number from 0, its character, the rows and the gap between the lengths."""
        up, down, cost = state.bitwiseAND(full), F.shiftrightunsigned(state, width).bitwiseAND(full), F.shiftrightunsigned(state, 2 * width)
        equal = sum((F.when(F.get(x.rows, x.j + k) == x.c, big(1 << k)).otherwise(big(0)) for k in range(width)), big(0))

        def step(equal: Column) -> Column:
            same = (equal.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(equal).bitwiseOR(down).bitwiseAND(full)

            def finish(same: Column) -> Column:
                plus = down.bitwiseOR(same.bitwiseOR(up).bitwiseXOR(full))
                minus = same.bitwiseAND(up)
                moved = F.shiftrightunsigned(same, 1)
                up2 = minus.bitwiseOR(moved.bitwiseOR(plus).bitwiseXOR(full))
                down2 = moved.bitwiseAND(plus)
                add = F.when(x.j >= x.gap, big(1) - _bit(same, threshold, x.gap)).otherwise(big(0))
                return up2 + down2 * (1 << width) + (cost + add) * (1 << 2 * width)

            return _let(same, finish)

        return F.when(cost > threshold, state).otherwise(_let(equal, step))

    start = ((1 << (threshold + 1)) - 1) << threshold
    gap = F.char_length(longer) - F.char_length(shorter)
    return _let(F.struct(rows.alias("rows"), columns.alias("columns"), gap.alias("gap")), lambda p: F.when(p.gap > threshold, False).otherwise(
        F.shiftrightunsigned(F.aggregate(F.sequence(F.lit(0), F.size(p.columns) - 1), big(start) + p.gap.cast("bigint") * (1 << 2 * width), lambda s, j: column(s, _Args(p, j))), 2 * width) <= threshold))


class _Args:
    """What a column of the band reads."""

    def __init__(self, p: Column, j: Column):
        self.rows, self.gap, self.j, self.c = p.rows, p.gap, j, F.get(p.columns, j)


def _bit(word: Column, threshold: int, gap: Column) -> Column:
    """Bit of the diagonal that ends in the last cell: threshold - gap."""
    return F.getbit(word, F.lit(threshold) - gap).cast("bigint")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rank, text_key, line_no from 0, line) of every line."""
    own = docs.select(rank_of(id_col).alias("rank"), F.xxhash64(F.col(text_col)).alias("text_key"), F.split(F.col(text_col), "\n").alias("lines"))
    # the outer generator: for the inner one the optimizer adds a filter that would split every text once more
    return own.select("rank", "text_key", F.posexplode_outer("lines").alias("line_no", "line")).where("line IS NOT NULL")


#: A line is known by 128 bits of hashes of its text, its place among all lines by one number: rank, nine digits of the
#: text's hash, nine digits of the line number.

def _ids(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _place() -> Column:
    return F.expr("CAST(rank AS DECIMAL(19, 0)) * 1000000000000000000BD + CAST(pmod(text_key, 1000000000) * 1000000000 + line_no AS DECIMAL(19, 0))").cast("decimal(38,0)")


def with_odd_letters(lines: DataFrame, *keep: str) -> DataFrame:
    """``line`` and the columns ``keep`` of ``lines`` with ``letters``: a bit per letter that occurs an odd number of times. An edit changes two of the bits
    at most.

    A few letters at a time: each step is a generator of its own, so the compiled code of a step stays small."""
    lines = lines.select("line", *keep, F.lit(0).cast("bigint").alias("letters"))
    for at in range(0, len(LETTERS), 5):
        bits = F.col("letters")
        for k, c in enumerate(LETTERS[at : at + 5], at):
            count = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(c), F.lit("")))
            bits = bits + F.shiftleft(count.cast("bigint").bitwiseAND(1), k)
        lines = lines.select(F.inline_outer(F.array(F.struct("line", *keep, bits.alias("letters")))))
    return lines


def _marked_keys(lines: DataFrame, threshold: int, *keep: str) -> DataFrame:
    """(key, mark) and the columns ``keep`` of all probes of every line; ``mark`` is the hash of the line with its last bit set where the probe is
    one of the line's own segments. Those are among its probes (nothing moved), so one cut serves both sides."""
    length = F.char_length("line")
    cut = lines.select("line", *keep, index_pieces(length, threshold).alias("own"), probe_pieces(length, threshold).alias("probes"))
    cut = cut.select("line", *keep, F.explode_outer(F.transform("probes", lambda p: F.struct(p.alias("piece"), F.array_contains("own", p).cast("bigint").alias("own")))).alias("x"))
    h = F.xxhash64("line")
    return cut.select(piece_key(F.col("line"), F.col("x.piece")).alias("key"), (h - h.bitwiseAND(1) + F.col("x.own")).alias("mark"), *keep)


def _sharing(lines: DataFrame, threshold: int) -> DataFrame:
    """(mark): 47 bits of the hash of each line that shares a key with a different line, one of the two with a segment of its
    own. The rows of a key are met once, by a window: an aggregate joined back would shuffle them twice."""
    short = F.col("mark").bitwiseAND((1 << 48) - 1)
    dealt = _marked_keys(lines, threshold).select(F.col("key").bitwiseAND(-1 << 24).alias("key"), short.alias("mark"))
    dealt = dealt.repartition("key")  # two numbers: what the window computes from them comes after the shuffle
    of, same = F.shiftright("mark", 1), Window.partitionBy("key")
    met = dealt.select(of.alias("mark"), F.min(of).over(same).alias("one"), F.max(of).over(same).alias("other"), F.max(F.col("mark").bitwiseAND(1)).over(same).alias("indexed"))
    return met.where("indexed = 1 AND one <> other").select("mark")


def _in_classes(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``texts`` (h1: hash of the line) whose line is in a hash class of one of the ``marks``: a word of 64 classes per
    bucket."""
    bits = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright("mark", BUCKET_BITS).bitwiseAND(63).cast("int"))
    words = marks.select(F.col("mark").bitwiseAND(BUCKETS - 1).alias("bucket"), bits.alias("bits")).groupBy("bucket").agg(F.bit_or("bits").alias("bits"))
    mark = F.shiftright("h1", 1)
    asked = texts.withColumn("bucket", mark.bitwiseAND(BUCKETS - 1)).withColumn("class", F.shiftright(mark, BUCKET_BITS).bitwiseAND(63).cast("int"))
    return asked.join(F.broadcast(words), "bucket").where(F.getbit("bits", F.col("class")) == 1).drop("bucket", "class", "bits")


def near_lines(lines: DataFrame, threshold: int) -> DataFrame:
    """(h1, h2) of lines within the threshold of a line that starts earlier, from ``lines`` (rank, text_key, line_no,
    line).

    First, without texts and without pairs, the lines that share a key with another line: one shuffle of two numbers per
    probe, whose rows are looked at key by key for two different lines of which one is there with a segment of its own. The
    numbers are cut to 40 bits of the key (keys taken for one only make candidates) and 47 of the line. The texts of these
    lines are fetched (a filter on hash classes of bounded size keeps most others out of the shuffle). A line goes for one earlier witness, so every line is first compared with the earliest line that has its
    key as a segment; only what that leaves is compared with all earlier lines of its keys. Lines whose odd letters
    differ in too many places never become a pair. So many variants of one line don't make all their pairs."""
    texts = lines.select(*_ids("line"), "line", _place().alias("place"))
    texts = _in_classes(texts, _sharing(lines, threshold))
    texts = saved(texts.groupBy("h1", "h2", "line").agg(F.min("place").alias("first")), "lines")
    lettered = with_odd_letters(texts.select("line", "h1", "h2", "first"), "h1", "h2", "first")
    members = saved(_marked_keys(lettered, threshold, "h1", "h2", "first", "letters").withColumn("own", F.col("mark").bitwiseAND(1) == 1).drop("mark"), "members")
    one = F.struct("first", "h1", "h2", "letters")
    centers = members.where("own").groupBy("key").agg(F.min(one).alias("y"))
    alike = F.bit_count(F.col("x.letters").bitwiseXOR(F.col("y.letters"))) <= 2 * threshold
    star = members.select("key", one.alias("x")).join(centers, "key").where((F.col("x.first") != F.col("y.first")) & alike)
    settled = saved(_later_of_near(star, texts, threshold), "settled")
    left = members.join(settled, ["h1", "h2"], "left_anti").select("key", one.alias("x"), F.col("own").alias("x_own"))
    earlier = members.select("key", one.alias("y"), F.col("own").alias("y_own"))
    rest = left.join(earlier, "key").where(alike & (F.col("y.first") < F.col("x.first")) & (F.col("x_own") | F.col("y_own")))
    return settled.unionByName(_later_of_near(rest, texts, threshold)).distinct()


def _later_of_near(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(h1, h2) of the later line of each of the ``pairs`` (x, y) that is within the threshold; ``texts`` (h1, h2, line)."""
    in_order = F.expr("x.first > y.first")
    later, before = F.when(in_order, F.col("x")).otherwise(F.col("y")), F.when(in_order, F.col("y")).otherwise(F.col("x"))
    single = pairs.select(later.alias("l"), before.alias("b")).select(F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2"), F.col("b.h1").alias("b1"), F.col("b.h2").alias("b2")).distinct()
    both = single.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("other")), ["b1", "b2"])
    shorter = F.char_length("line") <= F.char_length("other")
    p = F.when(shorter, F.struct(F.col("line").alias("s"), F.col("other").alias("l"))).otherwise(F.struct(F.col("other").alias("s"), F.col("line").alias("l")))
    ordered = both.select("h1", "h2", p.alias("p"))
    return ordered.where(within(F.col("p.s"), F.col("p.l"), threshold)).select("h1", "h2").distinct()


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rank, text_key, line_no) of every line to remove; see :func:`dedup_lines` for the rules."""
    near_chars = max(NEAR_CHARS if min_chars is None else min_chars, threshold + 1)
    long = F.char_length("line") >= near_chars
    every = _lines(docs, id_col, text_col)
    lines = every.where(F.col("line").rlike("\\S") | long if min_chars is None else long)
    placed = lines.select(*_ids("line"), "rank", "text_key", "line_no", _place().alias("place"))
    known = placed.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    near = near_lines(every.where(long), threshold).withColumn("near", F.lit(True))
    known = known.join(near, ["h1", "h2"], "left").where("n > 1 OR near").select("h1", "h2", "first", "near")
    gone = placed.join(known, ["h1", "h2"]).where("near OR place > first")
    return gone.select("rank", "text_key", "line_no").distinct()


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, ``removed_lines`` (sorted line numbers from 0).

    Lines are what newlines separate. Equal lines of any length are repeats, but for blank ones under ``NEAR_CHARS``
    characters; lines from ``NEAR_CHARS`` on are also compared within the threshold. With ``min_chars`` that is the floor of
    both instead: lines under it are neither removed nor compared. A null text
    has 0 lines, an empty one has 1. Documents are ordered by id; rows without id come last, ordered by a hash of their
    text, as do rows that share an id; a row repeated with id and text is one document. Other columns are not looked at.
    An empty table gives an empty one."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), rank_of(id_col).alias("rank"), F.xxhash64(F.col(text_col)).alias("text_key"), F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(F.col(text_col), "\n"))).cast("bigint").alias("n_lines"))
    lists = repeated_lines(docs, threshold, min_chars, id_col, text_col).groupBy("rank", "text_key").agg(F.array_sort(F.collect_list("line_no")).alias("removed_lines"))
    return base.join(lists, ["rank", "text_key"], "left").select("doc_id", "n_lines", F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))


def without_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; all columns stay. Rows that lose lines and keep none with
    more than blanks go."""
    lists = repeated_lines(docs, threshold, min_chars, id_col, text_col).groupBy("rank", "text_key").agg(F.collect_list("line_no").alias("gone"))
    keyed = docs.select(whole_row(docs).alias("doc"), rank_of(id_col).alias("rank"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    joined = keyed.join(lists, ["rank", "text_key"], "left").withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    joined = joined.where(F.col("kept").isNull() | F.col("kept").rlike("\\S"))
    return joined.select(F.when(F.col("kept").isNull(), F.col("doc")).otherwise(F.col("doc").withField(f"`{text_col}`", F.col("kept"))).alias("doc")).select("doc.*")

"""Expressions over a page tree (see ``operators.dom``). All run inside one row: nothing here shuffles.

Text of an element is a slice of the page's string array, so it costs no copy per ancestor. Removing subtrees blanks
their slots in both arrays (positions stay valid), which is linear in the page however many subtrees go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions.lets import let

NODE = "struct<pre:int,parent:int,last:int,tag:string,attrs:map<string,string>,s0:int,s1:int>"
STRING = "struct<pos:int,node:int,kind:string,text:string>"
SPAN = "struct<pre:int,last:int,s0:int,s1:int>"


def empty(type_: str) -> Column:
    return F.array().cast(f"array<{type_}>")


def readable(dom: Column) -> Column:
    """The tree plus ``txt``: each string's collapsed text, NULL for blanks, comments and scripts."""
    return F.struct(
        dom["nodes"].alias("nodes"),
        dom["strings"].alias("strings"),
        F.transform(
            dom["strings"], lambda s: F.when(s["kind"] == "t", F.nullif(tx.clean(s["text"]), F.lit("")))
        ).alias("txt"),
    )


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def has_token(value: Column, token: str) -> Column:
    return F.coalesce(value.rlike(rf"(?:^|\s){token}(?:\s|$)"), F.lit(False))


def classes(node: Column) -> Column:
    names = F.split(F.coalesce(attr(node, "class"), F.lit("")), r"(?U)\s+")
    return F.filter(names, lambda c: c != "")


def span(node: Column) -> Column:
    return F.struct(*[node[f].alias(f) for f in ("pre", "last", "s0", "s1")])


def _outermost(spans: Column) -> Column:
    """Spans in document order without those inside an earlier one."""
    return F.aggregate(
        spans,
        empty(SPAN),
        lambda acc, s: F.when(
            F.coalesce(F.try_element_at(acc, F.lit(-1))["last"] >= s["pre"], F.lit(False)), acc
        ).otherwise(F.concat(acc, F.array(s))),
    )


def _blank(values: Column, spans: Column, lo: Callable, hi: Callable, type_: str) -> Column:
    """``values`` with the slots of each span set to NULL; spans are disjoint and ordered."""

    def piece(k: Column) -> Column:
        start = F.coalesce(hi(F.get(spans, k - 1)), F.lit(0))
        end = F.coalesce(lo(F.get(spans, k)), F.size(values))
        gone = F.coalesce(hi(F.get(spans, k)) - lo(F.get(spans, k)), F.lit(0))
        return F.concat(
            F.slice(values, start + 1, end - start), F.array_repeat(F.lit(None).cast(type_), gone)
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), piece))


def without_spans(tree: Column, spans: Column) -> Column:
    """The (bound) tree with all given subtrees removed."""

    def cut(outer: Column) -> Column:
        string_slots = dict(lo=lambda s: s["s0"], hi=lambda s: s["s1"])
        return F.struct(
            _blank(tree["nodes"], outer, lambda s: s["pre"], lambda s: s["last"] + 1, NODE).alias("nodes"),
            _blank(tree["strings"], outer, type_=STRING, **string_slots).alias("strings"),
            _blank(tree["txt"], outer, type_="string", **string_slots).alias("txt"),
        )

    return let(spans, lambda hits: F.when(F.size(hits) == 0, tree).otherwise(let(_outermost(hits), cut)))


def without(tree: Column, rule: Callable[[Column], Column]) -> Column:
    """The tree with every element that matches ``rule`` (and all below it) removed."""
    return let(tree, lambda t: without_spans(t, F.transform(F.filter(t["nodes"], rule), span)))


def node_at(tree: Column, pre: Column) -> Column:
    return F.get(tree["nodes"], pre)


def below(tree: Column, node: Column) -> Column:
    """All remaining descendants of a node, in document order."""
    part = F.slice(tree["nodes"], node["pre"] + 2, node["last"] - node["pre"])
    return F.filter(part, lambda x: x.isNotNull())


def children(tree: Column, node: Column) -> Column:
    return F.filter(below(tree, node), lambda x: x["parent"] == node["pre"])


def ancestors(tree: Column, node: Column) -> Column:
    """Root to parent."""
    return F.filter(F.slice(tree["nodes"], F.lit(1), node["pre"]), lambda a: a["last"] >= node["pre"])


def text_of(tree: Column, node: Column, separator: str = " ") -> Column:
    """Collapsed text below a node; empty string when there is none."""
    return F.coalesce(F.array_join(F.slice(tree["txt"], node["s0"] + 1, node["s1"] - node["s0"]), separator), F.lit(""))


def strings_of(tree: Column, node: Column) -> Column:
    """The remaining text strings below a node, as written."""
    part = F.slice(tree["strings"], node["s0"] + 1, node["s1"] - node["s0"])
    return F.transform(F.filter(part, lambda s: s["kind"] == "t"), lambda s: s["text"])


def stripped_text(strings: Column) -> Column:
    """Strings stripped at their ends, blanks skipped, joined by one space; inner whitespace stays."""
    return F.array_join(F.filter(F.transform(strings, tx.strip), lambda s: s != ""), " ")


def page_strings(tree: Column) -> Column:
    return F.transform(F.filter(tree["strings"], lambda s: s["kind"] == "t"), lambda s: s["text"])


def first_node(tree: Column, rule: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(tree["nodes"], rule), F.lit(0))


def own_text(tree: Column, node: Column) -> Column:
    """Text directly in the node (comments count as such, as in the reference's notion of own strings)."""
    part = F.slice(tree["strings"], node["s0"] + 1, node["s1"] - node["s0"])
    mine = F.filter(part, lambda s: s["node"] == node["pre"])
    return tx.clean(F.array_join(F.transform(mine, lambda s: s["text"]), " "))


def innermost(tree: Column, node: Column) -> Column:
    """The element a wrapper chain stands for: the one that still branches or holds text of its own.

    That is the lowest common ancestor of the node's text, unless a wrapper above it holds a comment."""
    part = F.slice(tree["strings"], node["s0"] + 1, node["s1"] - node["s0"])
    written = F.filter(part, lambda s: tx.clean(s["text"]) != "")

    def line(string: Column) -> Column:
        """Indexes from ``node`` down to the string's element."""
        owner = node_at(tree, string["node"])
        between = F.slice(tree["nodes"], node["pre"] + 1, owner["pre"] - node["pre"] + 1)
        on_path = F.filter(between, lambda a: a["last"] >= owner["pre"])
        return F.transform(on_path, lambda a: a["pre"])

    def pick(w: Column) -> Column:
        texts = F.filter(w, lambda s: s["kind"] == "t")

        def deepest(t: Column) -> Column:
            common = F.array_intersect(line(F.get(t, F.lit(0))), line(F.try_element_at(t, F.lit(-1))))
            remarks = F.transform(F.filter(w, lambda s: s["kind"] == "c"), lambda s: s["node"])

            def stop(path: Column) -> Column:
                at_comment = F.get(F.array_intersect(path, remarks), F.lit(0))
                return node_at(tree, F.coalesce(at_comment, F.try_element_at(path, F.lit(-1))))

            return let(common, stop)

        return let(texts, lambda t: F.when(F.size(t) == 0, node).otherwise(deepest(t)))

    return let(written, pick)


LABEL_TAGS = ("strong", "b", "dt", "th", "label")  # fixed value


def label_of(tree: Column, node: Column) -> Column:
    """What a key-value layout puts next to a value: the row's ``th`` for a cell, else a label-like sibling before."""
    row = F.try_element_at(F.filter(ancestors(tree, node), lambda a: a["tag"] == "tr"), F.lit(-1))
    heading = let(row, lambda r: F.get(F.filter(below(tree, r), lambda x: x["tag"] == "th"), F.lit(0)))
    start = node["parent"] + 2
    siblings = F.filter(
        F.slice(tree["nodes"], start, node["pre"] - node["parent"] - 1), lambda x: x["parent"] == node["parent"]
    )
    previous = F.try_element_at(siblings, F.lit(-1))

    def sibling_label(p: Column) -> Column:
        label = text_of(tree, p)
        wanted = p["tag"].isin(*LABEL_TAGS) | (F.length(label).between(1, 30) & label.endswith(":"))
        return F.when(p.isNotNull() & wanted, F.substring(label, 1, 50)).otherwise(F.lit(""))

    def by_sibling() -> Column:
        return F.when(node["parent"] < 0, F.lit("")).otherwise(let(previous, sibling_label))

    return F.when(
        node["tag"] == "td",
        let(heading, lambda h: F.when(h.isNotNull(), F.substring(text_of(tree, h), 1, 50)).otherwise(by_sibling())),
    ).otherwise(by_sibling())


def facts_of(tree: Column, block: Column) -> Column:
    """"Label: value" pairs of one block: each label child's value is everything up to the next label child.

    Between two labels lies one slice of the page's strings, so a pair is two array reads."""
    labels = F.filter(
        children(tree, block),
        lambda c: c["tag"].isin(*LABEL_TAGS) & F.length(text_of(tree, c)).between(1, 40),
    )

    def pairs(marks: Column) -> Column:
        def pair(mark: Column, i: Column) -> Column:
            until = F.coalesce(F.get(marks, i + 1)["s0"], block["s1"])
            between = F.slice(tree["strings"], mark["s1"] + 1, until - mark["s1"])
            kept = F.filter(
                between,
                lambda s: (s["kind"] == "t") | ((s["kind"] == "c") & (s["node"] == block["pre"])),
            )
            value = tx.clean(F.array_join(F.transform(kept, lambda s: s["text"]), " "))
            return F.struct(
                F.regexp_replace(text_of(tree, mark), "[: ]+$", "").alias("label"),
                F.regexp_replace(value, "^[:– -]+", "").alias("value"),
                (value != "").alias("filled"),
            )

        return F.filter(F.transform(marks, pair), lambda p: p["filled"] & (p["label"] != ""))

    return F.transform(
        let(labels, pairs), lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"))
    )


def css_path(tree: Column, node: Column, stop: Column) -> Column:
    """Stable path of an element: child steps below the content root, starting at the nearest usable id."""

    def step(x: Column) -> Column:
        named = tx.is_stable_name(attr(x, "id"))
        marks = F.transform(tx.stable_classes(classes(x)), lambda c: F.concat(F.lit("."), c))
        return F.struct(
            named.alias("named"),
            F.when(named, F.concat(x["tag"], F.lit("#"), attr(x, "id")))
            .otherwise(F.concat(x["tag"], F.array_join(marks, "")))
            .alias("css"),
            (x["tag"].isin("body", "html", "[document]") | (x["pre"] == stop["pre"])).alias("edge"),
        )

    def joined(steps: Column) -> Column:
        def from_last(flag: str, inclusive: int) -> Column:
            hits = F.filter(F.transform(steps, lambda s, i: F.when(s[flag], i + inclusive)), lambda i: i.isNotNull())
            return F.coalesce(F.array_max(hits), F.lit(0))

        start = F.greatest(from_last("edge", 1), from_last("named", 0))
        return F.array_join(F.transform(F.slice(steps, start + 1, F.size(steps)), lambda s: s["css"]), " > ")

    return let(F.transform(F.concat(ancestors(tree, node), F.array(node)), step), joined)

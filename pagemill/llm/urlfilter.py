"""URL filters as a sort-merge range join.

Hosts become reversed keys (``com.example.www.``), so a rule's host and its subdomains are one interval of the key
order. Range boundaries come from a bounded sample; a url goes to one range, a rule to every range its interval meets.
Each range is swept in key order with a stack of the nested rule hosts that are open; the rules of an open host are
looked up by the lengths their paths have. A key ends in a hash of the row, so one hot host is cut into many ranges."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import LOWER, parts_for, received, ship

URL = re.compile(r"://([^/?#]*)([^?#]*)")
SAMPLE_PER_RANGE = 64
MOST_RANGES = 20_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    found = URL.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def sort_key(url: str | None, row: str) -> str:
    return f"{host_key(split_url(url)[0])}\0{xxhash.xxh3_64_hexdigest(row)}"


def sweep(keys: list[str], rule: list[bool], hosts: list[str], paths: list[str], verdicts: list[str]) -> list[tuple[str | None, str | None]]:
    """Walk the events in key order; for each url the longest rule that fits, as text, and its verdict."""
    stack: list[tuple[str, dict[str, str], list[int]]] = []  # key, verdict by path, path lengths
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(keys)
    for at in sorted(range(len(keys)), key=lambda i: (keys[i], not rule[i])):
        key = keys[at]
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if rule[at]:
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            _, own, lengths = stack[-1]
            if own.get(paths[at]) != "block":  # of equal rules the blocking one holds
                own[paths[at]] = verdicts[at]
            if len(paths[at]) not in lengths:
                lengths.append(len(paths[at]))
            continue
        best = -1
        for prefix, own, lengths in stack:
            for n in lengths:
                path = paths[at][:n]
                if path in own and len(path) == n and len(prefix) + n >= best:
                    best = len(prefix) + n
                    out[at] = (".".join(reversed(prefix[:-1].split("."))) + path, own[path])
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict.

    ``rules``: host, path, verdict (allow or block); a rule fits its host and all subdomains where the url's path starts
    with its path. Rules with a null or an empty host are left out, a null path is empty; of equal rules the blocking
    one holds, of rules of equal length the one with the longer host. A url that is null or lacks ``://`` has an empty
    host and path and gets ``default``, as does one that no rule fits. Repeated rows are judged each; other columns are
    not looked at; empty tables are fine."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    ranges = min(parts_for(spark), MOST_RANGES)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array([sort_key(u, f"{i} {u}") for i, u in rows], pa.string())})

    picked = own.mapInArrow(keyed, "key string").orderBy(F.xxhash64("key")).limit(ranges * SAMPLE_PER_RANGE)
    sample = sorted(r.key for r in picked.collect())
    edges = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    held = ship(spark, edges)
    schema = "part int, rule boolean, page_id bigint, key string, host string, path string, verdict string"

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = received(held)
        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            split = [split_url(u) for u in urls]
            keys = [sort_key(u, f"{i} {u}") for i, u in zip(ids, urls, strict=True)]
            yield _batch([bisect_right(bounds, k) for k in keys], [False] * len(ids), ids, keys, [s[0] for s in split], [s[1] for s in split], [None] * len(ids))

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = received(held)
        for batch in batches:
            out = []
            for host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True):
                host = host.translate(LOWER)
                key = host_key(host)
                last = bisect_right(bounds, key + "\U0010ffff")
                out += [(p, True, None, key, host, path, verdict) for p in range(bisect_right(bounds, key), last + 1)]
            yield _batch(*(list(c) for c in zip(*out, strict=True))) if out else _batch([], [], [], [], [], [], [])

    def judge(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_pylist() for c in ("key", "rule", "host", "path", "verdict")}
        found = sweep(*columns.values())
        url = ~np.array(columns["rule"], bool)
        mine = np.flatnonzero(url).tolist()
        kept = group.filter(pa.array(url))
        return pa.table({
            "page_id": kept.column("page_id"), "host": kept.column("host"), "path": kept.column("path"),
            "rule": pa.array([found[i][0] for i in mine], pa.string()), "verdict": pa.array([found[i][1] or default for i in mine], pa.string())})

    usable = rules.select(F.col("host").cast("string").alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict")).where("host <> '' AND verdict IN ('allow', 'block')")
    events = own.mapInArrow(deal_urls, schema).union(usable.mapInArrow(deal_rules, schema))
    return events.groupBy("part").applyInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string")


def _batch(part: list, rule: list, ids: list, keys: list, hosts: list, paths: list, verdicts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": pa.array(part, pa.int32()), "rule": pa.array(rule, pa.bool_()), "page_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.string()),
        "host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "verdict": pa.array(verdicts, pa.string())})

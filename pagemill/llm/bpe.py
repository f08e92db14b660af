"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a vocabulary entry is resolved by a minimal perfect hash over the vocabulary; any other is merged
from its bytes with a heap of candidate pairs over a doubly linked list. Encoding and decoding are one narrow pass over
the texts: no shuffle. The compiled vocabulary (a fixed public file, 50k entries) is the only thing broadcast; its size
is checked."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import received, ship, slices

BUCKET = 4  # mean number of keys per displacement
MOST_ENTRIES = 2_000_000  # vocabularies beyond this are refused rather than broadcast
CACHE = 300_000  # pre-tokens a task remembers before it starts anew


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a blank and the rank per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > MOST_ENTRIES:
        raise ValueError(f"{len(ranks)} entries; at most {MOST_ENTRIES} are broadcast")
    return ranks


def _slot(hashes: np.ndarray, displacement: np.ndarray, size: int) -> np.ndarray:
    mixed = (hashes ^ (displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash (hash and displace): n keys, n slots, one displacement per bucket of about four keys.

    Buckets are placed from the largest to the smallest with the first displacement that hits free slots only; a bucket
    of one key simply takes a free slot, written as a negative displacement."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // BUCKET)
        hashes = self.hashes(keys)
        bucket = (hashes >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        self.displacement = np.zeros(self.buckets, np.int64)
        taken, self.keys = np.zeros(n, bool), [b""] * n
        for group in sorted(groups, key=len, reverse=True):
            own = hashes[group]
            if len(group) == 1:
                break
            at, many, fits = 0, 32, None
            while fits is None:
                spots = _slot(own[None, :], np.arange(at, at + many)[:, None], n)
                fits = next((i for i in np.flatnonzero(~taken[spots].any(axis=1)).tolist() if len(set(spots[i].tolist())) == len(group)), None)
                if fits is None:
                    at, many = at + many, min(2 * many, 4096)
            self.displacement[int(bucket[group[0]])] = at + fits
            taken[spots[fits]] = True
            for key, spot in zip(group.tolist(), spots[fits].tolist(), strict=True):
                self.keys[spot] = keys[key]
        free = iter(np.flatnonzero(~taken).tolist())
        for group in groups:
            if len(group) == 1:
                spot = next(free)
                self.displacement[int(bucket[group[0]])] = -spot - 1
                self.keys[spot] = keys[int(group[0])]

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        keys = list(keys)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """Slot of each key, or -1 where the slot holds another key."""
        if not keys or not self.size:
            return np.full(len(keys), -1, np.int64)
        hashes = self.hashes(keys)
        displacement = self.displacement[((hashes >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)]
        spots = np.where(displacement < 0, -displacement - 1, _slot(hashes, np.maximum(displacement, 0), self.size))
        held = self.keys
        return np.fromiter((s if held[s] == k else -1 for s, k in zip(spots.tolist(), keys, strict=True)), np.int64, len(keys))


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until no pair is in the vocabulary: a heap over linked bytes.

    An entry of the heap is out of date when the part it starts with was merged away or ends elsewhere by now."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part at i: piece[i:end[i]]; before[i]: start of the part left of it
    heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if middle == 0 or middle >= stop or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (rank, i, end[stop]))
        if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
            heappush(heap, (rank, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Coder:
    """Compiled vocabulary; what a task needs to encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without rank: {missing[:5]}")
        self.ranks, self.pattern = ranks, pattern
        self.table = PerfectHash(list(ranks))
        self.rank_of_slot = [ranks[k] for k in self.table.keys]
        self.known: dict[str, str] = {}
        self.bytes_of = {str(r): k for k, r in ranks.items()}

    def learn(self, pieces: set[str]) -> None:
        """Ids of pre-tokens not met before, as text: first tier for all at once, second tier for the misses."""
        new = list(pieces)
        encoded = [p.encode("utf-8") for p in new]
        for text, raw, slot in zip(new, encoded, self.table.slots(encoded).tolist(), strict=True):
            self.known[text] = str(self.rank_of_slot[slot]) if slot >= 0 else " ".join(map(str, merge_bytes(raw, self.ranks)))

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, as decimal numbers joined by blanks."""
        find = regex.compile(self.pattern).findall
        split = [find(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        seen = set()
        for pieces in split:
            seen.update(pieces)
        if new := seen.difference(self.known):
            self.learn(new)
        get = self.known.__getitem__
        return [" ".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ``ids``
    (array<int>) and ``decoded`` (binary, decoded from the ids).

    A null or empty text has no tokens. Repeated rows are encoded each; other columns of ``docs`` are not looked at, so
    clashing names don't matter; an empty table gives an empty one. Texts of any length are taken whole."""
    spark = docs.sparkSession
    coder = ship(spark, Coder(ranks, pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = received(coder)
        for batch in slices(batches):
            ids = code.encode([t or "" for t in batch.column("text").to_pylist()])
            decoded = [code.decode(i) for i in ids]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            }
            if with_ids:
                out["ids"] = pa.array([np.fromstring(i, np.int32, sep=" ") for i in ids], pa.list_(pa.int32()))
                out["decoded"] = pa.array(decoded, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return own.mapInArrow(encode, schema + (", ids array<int>, decoded binary" if with_ids else ""))

"""SentencePiece BPE encoding and decoding with byte spans of the original text.

A text is normalised by the longest prefixes that the model's compiled character map knows; every byte of the result
remembers the byte of the text it comes from. The result is cut where no merge can cross, every cut part is merged by a
heap over linked symbols (and remembered), and each piece is projected through the alignment onto the bytes of the
original text. One narrow pass: no shuffle. The compiled model, a fixed public file, is the only thing broadcast; its
size is checked."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import received, ship, slices

SPACE = "▁"  # stands for a blank inside pieces
MOST_BYTES = 64 << 20  # models beyond this are refused rather than broadcast
CACHE = 300_000  # parts a task remembers before it starts anew
SHORT = 32  # parts up to this length are merged over a list; longer ones with a heap
LOW = float("-inf")
REPLACEMENT = "�".encode()
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
BPE = 2  # kind of model


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over UTF-8 whose leaves point at replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest known prefix of ``text[at:]``."""
        units = self.units
        if not units:
            return None
        node = self._offset(units[0])
        found = None
        for n, byte in enumerate(text[at : at + 256], 1):
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, n
        if found is None:
            return None
        start, n = found
        return self.texts[start : self.texts.index(b"\0", start)], n

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


def _width(byte: int) -> int:
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class Normaliser:
    """Text to normalised text, with the original byte offset of every normalised byte (and the end)."""

    def __init__(self, charmap: bytes, dummy_prefix: bool, strip_blanks: bool, escape_blanks: bool):
        self.map = CharacterMap(charmap)
        self.dummy_prefix, self.strip_blanks = dummy_prefix, strip_blanks
        self.blank = SPACE.encode() if escape_blanks else b" "
        self.plain = not charmap and not strip_blanks

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        raw = text.encode("utf-8")
        return self._plain(raw) if self.plain else self._mapped(raw)

    def _plain(self, raw: bytes) -> tuple[str, np.ndarray]:
        """Blanks alone change: the alignment is a repetition."""
        if not raw:
            return "", np.zeros(1, np.int64)
        own = raw.replace(b" ", self.blank)
        widths = np.where(np.frombuffer(raw, np.uint8) == 32, len(self.blank), 1)
        # every byte of a blank's stand-in points at the blank; bytes of one character all point at its start
        at = np.arange(len(raw))
        inside = np.frombuffer(raw, np.uint8) & 0xC0 == 0x80
        starts = np.maximum.accumulate(np.where(inside, 0, at))
        align = np.repeat(starts, widths)
        lead = self.blank if self.dummy_prefix else b""
        return (lead + own).decode("utf-8"), np.concatenate([np.zeros(len(lead), np.int64), align, [len(raw)]])

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        n, at = len(raw), 0
        blank, out, align = self.blank, bytearray(), []
        if self.strip_blanks:
            while at < n:
                piece, used = self._prefix(raw, at)
                if piece != b" ":
                    break
                at += used
        if at == n:
            return "", np.array([n], np.int64)
        if self.dummy_prefix:
            out += blank
            align += [at] * len(blank)
        after_blank = self.strip_blanks
        while at < n:
            piece, used = self._prefix(raw, at)
            if after_blank:
                piece = piece.lstrip(b" ")
            if piece:
                own = piece.replace(b" ", blank)
                out += own
                align += [at] * len(own)
                after_blank = piece.endswith(b" ")
            at += used
            if not self.strip_blanks:
                after_blank = False
        end = n
        if self.strip_blanks:
            while out.endswith(blank):
                end = align[len(out) - len(blank)]
                del out[-len(blank) :], align[-len(blank) :]
        return out.decode("utf-8"), np.array([*align, end], np.int64)

    def _prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(raw, at)
        if found is not None:
            return found
        used = _width(raw[at])
        return raw[at : at + used], used


class PieceModel:
    """A compiled BPE model: ids, scores and surfaces of its pieces, its normaliser, and where its merges can't cross."""

    def __init__(self, data: bytes):
        if len(data) > MOST_BYTES:
            raise ValueError(f"a model of {len(data)} bytes; at most {MOST_BYTES} are broadcast")
        self.ids: dict[str, str] = {}
        self.scores: dict[str, float] = {}
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                piece, kind = own[1].decode("utf-8"), own.get(3, NORMAL)
                if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                    raise ValueError(f"pieces of kind {kind} are not supported")
                if kind == NORMAL:
                    self.ids[piece], self.scores[piece] = str(len(self.pieces)), struct.unpack("<f", own.get(2, bytes(4)))[0]
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                trainer.update(_fields(value))
            elif number == 3:
                norm.update(_fields(value))
        if trainer.get(3, 1) != BPE:
            raise ValueError("not a BPE model")
        if trainer.get(24, 0):
            raise ValueError("blanks as suffixes are not supported")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = trainer.get(40, 0)
        self.end = trainer.get(42, 2)
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.dummy_prefix, self.strip_blanks = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.normaliser = Normaliser(norm.get(2, b""), self.dummy_prefix, self.strip_blanks, bool(norm.get(5, 1)))
        pairs = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.pairs = frozenset(pairs)
        # blanks start a part if no piece has one after another character
        self.part = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not any(p[1] == SPACE != p[0] for p in pairs) else "(?s:.+)")
        self.surfaces = [self._surface(i) for i in range(len(self.pieces))]
        self.known: dict[str, tuple[str, bytes]] = {}

    def _surface(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return self.unknown_text if kind == UNKNOWN else piece.replace(SPACE, " ").encode("utf-8")

    def merge(self, part: str) -> list[str]:
        """Merge the neighbours of highest score, leftmost first, while they make a piece."""
        if len(part) > SHORT:
            return self._merge_linked(part)
        get, symbols = self.scores.get, list(part)
        scores = [get(pair, LOW) for pair in map(add, part, part[1:])]
        while scores and (best := max(scores)) != LOW:
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(symbols[i] + symbols[i + 1], LOW)
            if i:
                scores[i - 1] = get(symbols[i - 1] + symbols[i], LOW)
        return symbols

    def _merge_linked(self, part: str) -> list[str]:
        n, scores = len(part), self.scores
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # symbol at i: part[i:end[i]]
        heap = [(-scores[p], i, i + 2) for i in range(n - 1) if (p := part[i : i + 2]) in scores]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if middle == 0 or middle >= stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (score := scores.get(part[i : end[stop]])) is not None:
                    heappush(heap, (-score, i, end[stop]))
            if (left := before[i]) >= 0 and (score := scores.get(part[left:stop])) is not None:
                heappush(heap, (-score, left, stop))
        out, i = [], 0
        while i < n:
            out.append(part[i : end[i]])
            i = end[i]
        return out

    def _part(self, part: str) -> tuple[str, bytes]:
        """Ids (decimal, blank-joined) and normalised byte lengths (one byte each) of a part."""
        pairs, known = self.pairs, self.known
        if not pairs.issuperset(map(add, part, part[1:])):
            cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in pairs]
            ids, sizes = [], []
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                sub = part[a:b]
                if (held := known.get(sub)) is None:
                    held = known[sub] = self._merged(sub)
                ids.append(held[0])
                sizes.append(held[1])
            return " ".join(ids), b"".join(sizes)
        return self._merged(part)

    def _merged(self, part: str) -> tuple[str, bytes]:
        merged, ids_of = self.merge(part), self.ids
        try:
            return " ".join([ids_of[p] for p in merged]), bytes([len(p.encode()) for p in merged])
        except KeyError:
            pass
        ids, sizes = [], bytearray()
        for piece in merged:
            raw = piece.encode("utf-8")
            if piece not in ids_of and self.byte_fallback:  # the last byte stands for the whole character, as its span
                ids += [str(self.byte_ids[b]) for b in raw]
                sizes += bytes(len(raw) - 1) + bytes([len(raw)])
            else:
                ids.append(ids_of.get(piece, str(self.unknown)))
                sizes.append(len(raw))
        return " ".join(ids), bytes(sizes)

    def encode(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Ids as decimal numbers joined by blanks (the end id included), start and end of each one's bytes in ``text``."""
        own, align = self.normaliser.normalise(text)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        parts = self.part.findall(own)
        for part in set(parts).difference(known):
            known[part] = self._part(part)
        held = list(map(known.__getitem__, parts))
        ids = " ".join([h[0] for h in held])
        sizes = np.frombuffer(b"".join([h[1] for h in held]), np.uint8)
        if not self.byte_fallback and held:
            ids, sizes = self._joined_unknown(ids, sizes)
        stops = np.cumsum(sizes, dtype=np.int64)
        end = len(text.encode("utf-8")) if not text.isascii() else len(text)
        starts = np.append(align[stops - sizes], end)
        return (f"{ids} {self.end}" if ids else str(self.end)), starts, np.append(align[stops], end)

    def _joined_unknown(self, ids: str, sizes: np.ndarray) -> tuple[str, np.ndarray]:
        """Unknown pieces in a row are one."""
        numbers = np.array(ids.split(), np.int64)
        first = np.flatnonzero((numbers != self.unknown) | np.append(True, numbers[:-1] != self.unknown))
        return " ".join(map(str, numbers[first])), np.add.reduceat(sizes.astype(np.int64), first)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids: control ids are nothing, bytes that are no UTF-8 become replacement characters."""
        surfaces, kinds = self.surfaces, self.kinds
        first = next((i for i, own in enumerate(ids) if kinds[own] != CONTROL), len(ids))
        out = [surfaces[own] for own in ids]
        if self.dummy_prefix or self.strip_blanks:  # the blank in front was put there
            while first < len(ids) and kinds[ids[first]] == NORMAL and out[first].startswith(b" "):
                out[first] = out[first][1:]
                if out[first] or not self.strip_blanks:
                    break
                first += 1
        joined = b"".join(out)
        try:
            joined.decode("utf-8")
            return joined
        except UnicodeDecodeError:
            return b"".join(self._mended(out, ids))

    def _mended(self, out: list[bytes], ids: list[int]) -> Iterator[bytes]:
        run = bytearray()
        for text, own in zip([*out, b""], [*ids, None], strict=True):
            if own is not None and self.kinds[own] == BYTE:
                run += text
                continue
            at = 0
            while at < len(run):
                width = _width(run[at])
                try:
                    yield run[at : at + width].decode("utf-8").encode()
                    at += width
                except UnicodeDecodeError:
                    yield REPLACEMENT
                    at += 1
            run.clear()
            yield text


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as data:
        return PieceModel(data.read())


def encode_pieces(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens (the end id included), ids_sha256, decoded_sha256, n_covered (bytes of the
    text in the spans of its ids), and with ``with_ids`` also ``ids``, ``starts``, ``ends`` (array<int>: the span
    of each id in the UTF-8 bytes of the original text) and ``decoded`` (from the ids).

    A null or empty text has the end id alone. Repeated rows are encoded each; other columns are not looked at; an empty
    table gives an empty one. Texts of any length are taken whole."""
    held = ship(docs.sparkSession, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = received(held)
        for batch in slices(batches):
            coded = [code.encode(t or "") for t in batch.column("text").to_pylist()]
            numbers = [np.fromstring(ids, np.int32, sep=" ") for ids, _, _ in coded]
            decoded = [code.decode(n.tolist()) for n in numbers]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(map(len, numbers), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _, _ in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                "n_covered": pa.array([int((ends - starts).sum()) for _, starts, ends in coded], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array(numbers, pa.list_(pa.int32()))
                out["starts"] = pa.array([s.astype(np.int32) for _, s, _ in coded], pa.list_(pa.int32()))
                out["ends"] = pa.array([e.astype(np.int32) for _, _, e in coded], pa.list_(pa.int32()))
                out["decoded"] = pa.array([d.decode("utf-8") for d in decoded], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_covered bigint"
    return own.mapInArrow(encode, schema + (", ids array<int>, starts array<int>, ends array<int>, decoded string" if with_ids else ""))

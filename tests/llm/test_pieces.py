"""SentencePiece encoding, decoding and spans against the library, with the model's own map and with a compiled one."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from pagemill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def field(number, data):
    """A length-delimited protocol-buffer field."""
    size, out = len(data), bytes([number << 3 | 2])
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + data


def model_with(charmap, dummy_prefix, strip_blanks):
    """The model with another normaliser: later fields of a message take the place of earlier ones."""
    own = field(2, charmap) + bytes([3 << 3, dummy_prefix, 4 << 3, strip_blanks])
    with open(PATH, "rb") as data:
        return data.read() + field(3, own)


def compiled_map():
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return dict(pieces._fields(dict(pieces._fields(proto))[3]))[2]


def texts(n=400):
    dice = random.Random(3)
    some = ["hello", "World", "don't", "  ", " ", "\n", "\t", "é", "é", "ﬁ", "Ａ", "①", "①②", "½", "한국어", "漢字かな", "カﾞ", "​", " ", "▁", "▁▁", "😀", "👩‍👩‍👧", "1234", "...", "?!", "ß", "İ", "ǅ", "\x00", "﻿", "　", "aaaaaaaaaaaaaaaa", "                 ", "the", "ing", "▁the", "ﷺ", "ال"]
    out = ["", " ", "   ", "\n", "a", " a", "a ", "▁", "x" * 5000, "ab " * 3000, "漢" * 700, " " * 333, "​", "​ ​"]
    for _ in range(n):
        out.append("".join(dice.choice(some) + dice.choice(["", " ", " "]) for _ in range(dice.randint(1, 25))))
    for _ in range(n // 4):
        out.append("".join(chr(dice.choice([dice.randrange(1, 0x250), dice.randrange(0x2000, 0x2100), dice.randrange(0x3000, 0xD000), dice.randrange(0x1F300, 0x1F700)])) for _ in range(dice.randint(1, 30))))
    return out


@pytest.mark.parametrize(("charmap", "dummy", "strip"), [(False, 1, 0), (False, 1, 1), (False, 0, 0), (True, 1, 1), (True, 1, 0), (True, 0, 1)])
def test_as_the_library(charmap, dummy, strip):
    proto = model_with(compiled_map() if charmap else b"", dummy, strip)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.PieceModel(proto)
    for text in texts():
        ids, starts, ends = own.encode(text)
        ids = [int(i) for i in ids.split()]
        assert ids == library.encode(text, add_eos=True), text
        assert own.decode(ids).decode() == library.decode(ids), text
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True))[:-1] == spans, text


def test_normalised_text_as_the_library():
    proto = model_with(compiled_map(), 1, 1)
    own, library = pieces.PieceModel(proto).normaliser, sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    for text in texts():
        assert own.normalise(text)[0] == library.normalize(text)


def test_decoding_any_ids():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.read_model(PATH)
    dice = random.Random(8)
    for _ in range(500):
        ids = [dice.choice([0, 1, 2, dice.randrange(3, 259), dice.randrange(3, 259), dice.randrange(259, 32000), 28705, 259]) for _ in range(dice.randint(0, 12))]
        assert own.decode(ids).decode() == library.decode(ids), ids


def test_unknown_pieces_without_bytes():
    """A model without byte fallback joins unknown characters into one piece."""
    with open(PATH, "rb") as data:
        held = [(n, v) for n, v in pieces._fields(data.read()) if n != 1 or dict(pieces._fields(v)).get(3) != pieces.BYTE]
    proto = b"".join(field(n, v) for n, v in held) + field(2, bytes([3 << 3, 2, *(0x80 | 35 << 3 & 0x7F, 35 << 3 >> 7), 0]))
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.PieceModel(proto)
    for text in texts(150):
        ids, starts, ends = own.encode(text)
        assert [int(i) for i in ids.split()] == library.encode(text, add_eos=True), text


def test_whole_table(spark):
    rows = [(i, t) for i, t in enumerate(texts(60)) if "\x00" not in t] + [(None, None), (7, None), (7, "again"), (7, "again"), (8, "word " * 40_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, ids string, n_tokens int").repartition(3)
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.read_model(PATH)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((text or "").encode())))
    got = [tuple(r) for r in pieces.encode_pieces(df, model, with_ids=False).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in pieces.encode_pieces(df, model).collect():
        assert r.decoded == library.decode(r.ids) and len(r.ids) == len(r.starts) == len(r.ends) == r.n_tokens
    assert pieces.encode_pieces(df.limit(0), model).collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(field(1, field(1, b"a") + bytes([3 << 3, 4])) + field(2, bytes([3 << 3, 2])))
    with pytest.raises(ValueError):
        pieces.PieceModel(field(1, field(1, b"a")))

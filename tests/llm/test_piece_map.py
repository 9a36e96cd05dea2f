"""Encoding with a compiled character map: a small map is put into the default model, and the library is the judge."""

import struct

import numpy as np
import pytest
import sentencepiece

from tessel.llm import piece_encoding
from tessel.llm.piece_encoding import CharacterMap, Codec, _fields, _varint

#: What the map replaces; some entries are prefixes of others, one is longer than its replacement, one shorter.
ENTRIES = {"ﬁ": "fi", "①": "1", "①②": "twelve", "é": "e", "　": " ", "\t": " ", "Ａ": "A", "Å": "A", "…": "...", "ab": "c", "\r": ""}


def compile_map(entries: dict[str, str]) -> bytes:
    """A double-array trie over the entries' bytes, as the library reads it, and the replacements behind it."""
    texts, starts = b"", {}
    for key, value in entries.items():
        starts[key.encode()] = len(texts)
        texts += value.encode() + b"\0"
    units, used = {0: 0}, {0}

    def children(prefix):
        return sorted({k[len(prefix)] if len(k) > len(prefix) else 0 for k in starts if k.startswith(prefix)})

    def lay(node, prefix, label):
        below = children(prefix)
        base = next(b for b in range(1, 1 << 20) if (node ^ b) not in used and all((node ^ b ^ c) not in used for c in below))
        target = node ^ base
        used.update(target ^ c for c in below)
        units[node] = base << 10 | (1 << 8 if 0 in below else 0) | label
        for c in below:
            if c == 0:
                units[target] = starts[prefix] | 1 << 31
            else:
                lay(target ^ c, prefix + bytes([c]), c)

    lay(0, b"", 0)
    size = (max(units) + 256) // 256 * 256
    # A unit without an entry looks like a value, which no byte matches.
    body = b"".join(struct.pack("<I", units.get(i, 1 << 31)) for i in range(size))
    return struct.pack("<I", len(body)) + body + texts


def model(dummy: bool, squeeze: bool, entries=None) -> bytes:
    with open(piece_encoding.default_model(), "rb") as f:
        blob = f.read()
    spec = (b"\x12" + _varint(len(m := compile_map(entries))) + m if entries else b"") + bytes([3 << 3, dummy, 4 << 3, squeeze, 5 << 3, 1])
    out = b"".join(_varint(k << 3 | 2) + _varint(len(v)) + v for k, v in _fields(blob) if k != 3)
    return out + b"\x1a" + _varint(len(spec)) + spec


TEXTS = ["", " ", "plain words", "  two   spaces  and\tone tab ", "ﬁne ①② and ① … café", "ab abab a b", "　Ａ…\r\nÅ\r", "line\nline\n\n end", "日本語 ab ①", "x" * 300 + " ab" * 50, "\U0001f600 ab\x00c", "①", "\r", " ▁ ab▁▁", "<s> ab </s> <unk>"]


def test_the_map_finds_the_longest_entry():
    found = CharacterMap(compile_map(ENTRIES))
    for key, value in ENTRIES.items():
        longer = [k for k in ENTRIES if k.startswith(key) and k != key]
        assert found.longest(b"--" + key.encode() + b"z", 2) == (len(key.encode()), value.encode()), (key, longer)
    assert found.longest("①②".encode(), 0) == (6, b"twelve") and found.longest("①③".encode(), 0) == (3, b"1")
    assert found.longest(b"zab", 0) is None and found.longest(b"a", 0) is None and CharacterMap(b"").longest(b"a", 0) is None


@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("mapped", [False, True])
def test_ids_and_spans_equal_the_library(dummy, squeeze, mapped):
    blob = model(dummy, squeeze, ENTRIES if mapped else None)
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=blob), Codec(blob=blob)
    for text, (ids, spans) in zip(TEXTS, own.encode_all(TEXTS), strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == sp.encode(text, add_bos=True, add_eos=True), text
        spans = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(int)
        assert len(spans) == len(ids) and (spans[:, 0] <= spans[:, 1]).all() and spans[-1].tolist() == [len(text.encode())] * 2
        inner = spans[1:-1]
        assert (inner[1:, 0] >= inner[:-1, 0]).all() and (inner <= len(text.encode())).all()
        assert own.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)


def test_spans_name_what_the_map_replaced():
    own = Codec(blob=model(True, False, ENTRIES))
    text = "so ①② ﬁ"
    normal, back = own.normalise(text)
    assert normal == "▁so▁twelve▁fi"
    at = normal.encode().index(b"twelve")
    assert set(back[at : at + 6].tolist()) == {3} and back[at + 6] == 9 and back[-1] == len(text.encode())
    ids, spans = own.encode(text)
    spans = np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
    pieces = [own.sp.id_to_piece(i) for i in np.frombuffer(ids, "<u4").tolist()]
    assert spans[0] == [0, 0] and [s for p, s in zip(pieces, spans, strict=True) if "so" in p] == [[0, 2]]


def test_text_left_alone_by_a_model_without_normaliser():
    raw = sentencepiece.SentencePieceProcessor(model_proto=piece_encoding.without_normaliser(model(True, True, ENTRIES)))
    for text in ("▁so▁ ab", "  ab ", "①"):
        assert "".join(raw.encode(text, out_type=str)).replace("<0x", "") and raw.encode(text) != [] and "".join(p for p in raw.encode("▁so", out_type=str)) == "▁so"

"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised here, by longest-prefix matches in the model's compiled character map (a
double-array trie); every normalised byte remembers the original byte it came from. What is encoded
is that normalised text: the library gets the model without its own normalisation. A model whose map
is empty (the default one's is) keeps all characters but spaces, which become marks. The normalised
text is cut before each run of word-start marks and around line ends: where no piece of the vocabulary
holds a mark behind another character, or a line end beside one, no merge crosses such a cut, so the
parts are encoded alone and remembered. Piece lengths then project, through the alignment, to byte
spans of the original text.

Results for odd input: null counts as the empty text, which encodes to the begin and end ids alone;
begin, end and dummy-prefix pieces have empty spans; repeated rows give one row each, doc_id may be
null, an empty table gives an empty result, other columns of `docs` are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import lean, small_batches, table

MARK = "▁"
#: Parts longer than this are encoded without being remembered; the most that are remembered.
KEEP_CHARS, KEEP_PARTS = 48, 1 << 19


def _fields(blob: bytes):
    """(number, value) of the fields of one protocol-buffer message; nested messages stay bytes."""
    at, end = 0, len(blob)

    def varint(at):
        value = shift = 0
        while True:
            b = blob[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    while at < end:
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = blob[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = blob[at : at + n], at + n
        yield key >> 3, value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def without_normaliser(blob: bytes) -> bytes:
    """The model with a normaliser that leaves every text as it is: no map, no mark put before it, no space dropped or replaced."""
    spec = b"".join(_varint(k << 3) + b"\0" for k in (3, 4, 5))
    out = b""
    for k, v in _fields(blob):
        if k != 3:
            # The other fields of a model are messages.
            out += _varint(k << 3 | 2) + _varint(len(v)) + v
    return out + _varint(3 << 3 | 2) + _varint(len(spec)) + spec


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes, and the replacements it points to."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.texts = blob[4 + n :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that `data` has at `at`."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Codec:
    """Normaliser, encoder and decoder of one model file."""

    def __init__(self, path: str | None = None, blob: bytes | None = None):
        import sentencepiece

        if blob is None:
            with open(path, "rb") as f:
                blob = f.read()
        #: Decodes; encodes what is normalised already.
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=without_normaliser(blob))
        spec = next((v for k, v in _fields(blob) if k == 3), b"")
        spec = dict(_fields(spec))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.bos, self.eos = (struct.pack("<I", i) if i >= 0 else b"" for i in (self.sp.bos_id(), self.sp.eos_id()))
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        #: Bytes of the normalised text that a piece covers: byte pieces stand for one byte each.
        self.width = np.array([1 if self.sp.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.uint32)
        self.by_parts = self.escape and any(self.sp.is_byte(i) for i in range(n)) and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.known: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the original byte offset."""
        data, mark = text.encode(), MARK.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            reps = np.ones(len(raw), np.int64)
            if self.escape:
                reps[raw == 32] = 3
            lead = np.zeros(len(mark) if self.dummy and text else 0, np.uint32)
            return (MARK if len(lead) and self.escape else " " if len(lead) else "") + (text.replace(" ", MARK) if self.escape else text), np.concatenate([lead, np.repeat(np.arange(len(raw), dtype=np.uint32), reps), [len(raw)]]).astype(np.uint32)
        out, back, at = bytearray(), [], 0

        def put(piece: bytes, start: int):
            out.extend(piece)
            back.extend([start] * len(piece))

        units = []
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                n, piece = hit
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                piece = data[at : at + n]
            units.append((piece, at))
            at += n
        end = len(data)
        if self.squeeze:
            first = next((i for i, u in enumerate(units) if u[0] != b" "), len(units))
            units = units[first:]
            while units and units[-1][0] == b" ":
                end = units.pop()[1]
        if units and self.dummy:
            put(mark, units[0][1])
        space = self.squeeze
        for piece, start in units:
            if self.squeeze and space:
                piece = piece.lstrip(b" ")
            if not piece:
                continue
            for i in range(len(piece)):
                put(mark if piece[i : i + 1] == b" " else piece[i : i + 1], start)
            space = piece.endswith(b" ") if self.squeeze else False
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = back[-len(mark)]
                del back[-len(mark) :]
        return out.decode(), np.array([*back, end], np.uint32)

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of normalised texts."""
        return [np.array(got, "<u4").tobytes() for got in self.raw.encode(parts, num_threads=1)] if parts else []

    def learn(self, normals: list[str]) -> list[list[str]]:
        """Cut normalised texts into parts, and remember the ids of the short ones."""
        cut = [_PARTS.findall(t) for t in normals]
        if len(self.known) > KEEP_PARTS:
            self.known.clear()
        fresh = [p for p in set().union(*cut) - self.known.keys() if len(p) <= KEEP_CHARS]
        self.known.update(zip(fresh, self._parts(fresh), strict=True))
        return cut

    def pieces(self, parts: list[str]) -> bytes:
        """Ids of a normalised text's parts, as little-endian unsigned 32-bit integers."""
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            long = [p for p in set(parts) if p not in known]
            own = dict(zip(long, self._parts(long), strict=True))
            return b"".join([known[p] if p in known else own[p] for p in parts])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, and for each a (begin, end) span of bytes; both as unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        normal = [self.normalise(t) for t in texts]
        parts = self.learn([n for n, _ in normal]) if self.by_parts else [[]] * len(texts)
        return [self._encode(t, n, back, cut) for t, (n, back), cut in zip(texts, normal, parts, strict=True)]

    def _encode(self, text: str, normal: str, back: np.ndarray, parts: list[str]) -> tuple[bytes, bytes]:
        body = self.pieces(parts) if self.by_parts else np.array(self.raw.encode(normal), "<u4").tobytes()
        ends = np.cumsum(self.width[np.frombuffer(body, "<u4")], dtype=np.int64)
        if len(ends) == 0 or ends[-1] != len(back) - 1:
            ends = self._by_surface(normal)
        edge = back[np.concatenate([[0], ends]).astype(np.int64)] if len(back) > 1 else back[:1]
        spans = np.empty((len(ends), 2), "<u4")
        spans[:, 0], spans[:, 1] = edge[:-1], edge[1:]
        first, last = (b"\0" * 8 if self.bos else b"", struct.pack("<II", *[len(text.encode())] * 2) if self.eos else b"")
        return self.bos + body + self.eos, first + spans.tobytes() + last

    def _by_surface(self, normal: str) -> np.ndarray:
        """Piece ends in the normalised text where ids don't tell them (unknown characters)."""
        surfaces = self.raw.encode(normal, out_type=str)
        return np.cumsum([1 if self.raw.is_byte(self.raw.piece_to_id(p)) else len(p.encode()) for p in surfaces], dtype=np.int64)

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


_PARTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, carry: tuple[str, ...] = (), ids_column: str = "ids", spans_column: str = "spans", decoded_column: str = "decoded") -> DataFrame:
    """`doc_id` and the columns in `carry`, with the encoded text.

    ids: all ids with begin and end, little-endian unsigned 32-bit integers in one binary value;
    spans: as many (begin, end) pairs of byte offsets in the UTF-8 text, packed likewise;
    decoded: the text that decoding the ids gives.
    """
    small_batches(docs.sparkSession)
    path = model_path or default_model()
    keep = ["doc_id", *[c for c in carry if c != "doc_id"]]
    schema = docs.select(*keep).schema

    def encode(batches):
        model = codec(path)
        try:
            for batch in batches:
                ids, spans, texts = [], [], []
                raw = [t or "" for t in batch.column(len(keep)).to_pylist()]
                for at in range(0, len(raw), 64):
                    for a, b in model.encode_all(raw[at : at + 64]):
                        ids.append(a)
                        spans.append(b)
                        texts.append(model.decode(a))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(ids, pa.binary()), pa.array(spans, pa.binary()), pa.array(texts, pa.string())], [*keep, ids_column, spans_column, decoded_column])
        finally:
            model.known.clear()  # parts recur little from task to task, and the worker lives on

    for name, kind in ((ids_column, "binary"), (spans_column, "binary"), (decoded_column, "string")):
        schema = schema.add(name, kind)
    return docs.select(*keep, F.col("text").alias("_text of carry")).mapInArrow(lean(encode), schema)


def digest(ids: bytes) -> str:
    """Lower-case hex SHA-256 of packed ids; what op4 gives per document."""
    return hashlib.sha256(ids).hexdigest()


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans", 256).alias("spans_sha256"),
    )

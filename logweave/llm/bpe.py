"""Byte-level BPE by a sentencepiece model built from a rank vocabulary (operator 10).

The model is serialised directly from the vocabulary, nothing is trained: each
token's bytes are written as printable letters (one per byte), scored by minus its
rank, with identity normalisation and no dummy prefix.  sentencepiece then merges
the pair whose union has the lowest rank first, leftmost on ties, which is the
rule of the rank files; a pre-token that is itself in the vocabulary is its own id.
The id of a piece is its rank.  Decoding maps ids back to pieces and letters back
to bytes.

Defined cases: null and empty texts have no ids and decode to no bytes; null ids,
equal ids and equal rows are kept row by row; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import id_type, ship_package
from logweave.llm.tokens import TextEncoder, as_bytes, byte_letters

# Fixed values of the sentencepiece model format (protocol buffer field numbers and enum values).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
UNKNOWN = 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n)


def block(field: int, data: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(data)) + data


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks (which run from 0 without gaps)."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += block(PIECES, block(PIECE, piece) + varint(SCORE << 3 | 5) + struct.pack("<f", -rank))
    out += block(PIECES, block(PIECE, b"<unk>") + number(TYPE, UNKNOWN))
    out += block(TRAINER, number(MODEL_TYPE, BPE) + number(VOCAB_SIZE, len(tokens) + 1) + number(UNK_ID, len(tokens))
                 + number(BOS_ID, -1) + number(EOS_ID, -1) + number(PAD_ID, -1))
    out += block(NORMALIZER, block(NAME, b"identity") + number(ADD_DUMMY_PREFIX, 0)
                 + number(REMOVE_EXTRA_WHITESPACES, 0) + number(ESCAPE_WHITESPACES, 0))
    return bytes(out)


class Codec:
    """Encodes texts to id bytes (little-endian unsigned 32-bit) and decodes them."""

    def __init__(self, vocab_path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(vocab_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.split = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        to_byte = {c: b for b, c in self.letters.items()}
        self.pieces = [bytes(to_byte[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.single = {t: as_bytes([r]) for t, r in self.ranks.items()}
        self.encode = TextEncoder(self.pre_tokens, self.pre_tokens, keeps_blanks=True)

    def pre_tokens(self, text: str) -> bytes:
        return b"".join(map(self.pre_token, self.split(text)))

    def pre_token(self, piece: str) -> bytes:
        data = piece.encode()
        ids = self.single.get(data)
        if ids is None:
            ids = as_bytes(self.model.encode(data.decode("latin-1").translate(self.letters)))
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocab_path: str, pattern: str) -> Codec:
    """The codec of a vocabulary, built once per worker process."""
    if (vocab_path, pattern) not in _codecs:
        _codecs[vocab_path, pattern] = Codec(vocab_path, pattern)
    return _codecs[vocab_path, pattern]


def _mapped(df: DataFrame, id_col: str, value_col: str, kind: str, fields: list[T.StructField], rows) -> DataFrame:
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(value_col).cast(kind).alias("value"))
    schema = T.StructType([T.StructField("id", id_type(df, id_col)), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [rows(v.as_py()) for v in b.column(1)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], schema.names)

    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() for f in fields]
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode_texts(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit bytes."""
    def rows(text):
        ids = codec(vocab_path, pattern).encode(text)
        return len(ids) // 4, ids

    return _mapped(df, id_col, text_col, "string", [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], rows)


def decode_ids(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of the ids; null ids: no bytes."""
    return _mapped(df, id_col, ids_col, "binary", [T.StructField("decoded", T.BinaryType())],
                   lambda ids: (codec(vocab_path, pattern).decode(ids or b""),))


def bpe_round_trip(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): every text encoded, and its ids decoded again."""
    def rows(text):
        c = codec(vocab_path, pattern)
        ids = c.encode(text)
        return len(ids) // 4, ids, c.decode(ids)

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return _mapped(df, id_col, text_col, "string", fields, rows)

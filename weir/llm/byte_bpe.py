"""Byte-level BPE through a sentencepiece model written from a rank file."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from weir.llm.common import per_text
from weir.llm.words import BYTE_LETTERS, Memo, near_pattern

# Field numbers and enum values of the published sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND, KIND_UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, TYPE_BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NORM_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

UNKNOWN = "<unk>"
_LETTER_BYTES = {ord(c): b for b, c in BYTE_LETTERS.items()}
_LOADED: dict[tuple[str, str], "ByteBpe"] = {}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value) -> bytes:
    """One field of a serialised message: whole number, real number or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranked) - 1}")
    return [token for _, token in ranked]


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: byte-mapped pieces, score minus the rank, text taken as it is."""
    written = [t.decode("latin-1").translate(BYTE_LETTERS).encode("utf-8") for t in tokens]
    pieces = [_field(PIECES, _field(PIECE_TEXT, p) + _field(PIECE_SCORE, -float(rank))) for rank, p in enumerate(written)]
    unknown = _field(PIECES, _field(PIECE_TEXT, UNKNOWN.encode()) + _field(PIECE_SCORE, 0.0)
                     + _field(PIECE_KIND, KIND_UNKNOWN))
    trainer = b"".join([
        _field(MODEL_TYPE, TYPE_BPE), _field(VOCAB_SIZE, len(tokens) + 1), _field(UNK_ID, len(tokens)),
        _field(BOS_ID, -1), _field(EOS_ID, -1), _field(PAD_ID, -1)])
    plain = b"".join([
        _field(NORM_NAME, b"identity"), _field(ADD_DUMMY_PREFIX, 0), _field(REMOVE_EXTRA_SPACES, 0),
        _field(ESCAPE_SPACES, 0)])
    return b"".join(pieces) + unknown + _field(TRAINER, trainer) + _field(NORMALIZER, plain)


def load(path: str, pattern: str) -> "ByteBpe":
    """One instance per Python worker, file and pattern."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


class ByteBpe:
    """Encoding and decoding under one rank file, with a bounded cache of pieces."""

    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        #: a regex engine's \\s holds four separators that the Unicode property leaves out
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                                   .replace(r"\S", r"\P{White_Space}")).findall
        self.near, self.far = near_pattern(pattern).findall, re.compile("[̀-\U0010ffff]").search
        self.piece_ids = Memo(self._encode, 400_000)
        #: each id's piece with its stand-ins mapped back to bytes; the unknown piece is never met
        self.id_bytes = [p.translate(_LETTER_BYTES).encode("latin-1")
                         for p in self.model.id_to_piece(list(range(len(tokens))))]

    def _encode(self, piece: str) -> tuple[int, ...]:
        mapped = piece.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
        return tuple(self.model.encode(mapped))

    def encode(self, text: str) -> list[int]:
        split = self.split if not text.isascii() and self.far(text) else self.near
        return list(chain.from_iterable(map(self.piece_ids.__getitem__, split(text))))

    def decode(self, ids: list[int]) -> bytes:
        """The inverse mapping: stand-ins back to bytes."""
        return b"".join(map(self.id_bytes.__getitem__, ids))


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 digests: bool = False) -> DataFrame:
    """Per document: ``n_tokens`` and its ``ids`` under the rank file; each match of ``pattern`` is
    encoded by itself.  With ``digests``, in place of the ids their SHA-256 (decimal, joined by single
    spaces) and that of the bytes decoded from them.

    NULL and empty texts have no ids.  Repeated rows are encoded each.  Other columns are left out, so
    names cannot clash.  Row-local: no shuffle; a task keeps one text and a bounded cache.
    """

    def make():
        bpe = load(ranks, pattern)

        def work(text: str):
            ids = bpe.encode(text)
            if not digests:
                return len(ids), ids
            return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(bpe.decode(ids)).hexdigest())

        return work

    schema = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return per_text(docs, [id_col], text_col, schema, make)


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of each row's ids; NULL ids decode to no bytes."""

    def run(batches):
        bpe = load(ranks, pattern)
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")

"""Byte-level BPE encoding and decoding by way of a sentencepiece model.

The rank file's vocabulary is written out as a serialised sentencepiece BPE model:
each token's bytes are mapped to printable characters, one a byte, and score minus
their rank, so that sentencepiece always merges the pair of lowest rank, leftmost
first. Normalisation is the identity. Texts are split by the vocabulary's pattern and
each pre-token is encoded by itself; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pieces

#: Pre-tokens whose ids a task remembers at most, and their characters; beyond either the memory starts anew.
MEMORY, MEMORY_CHARS = 100_000, 8_000_000
#: Pre-tokens given to sentencepiece at once.
BLOCK = 65_536


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto with an unknown piece at 0 and token i at i + 1."""
    shown = byte_characters()
    unknown, bpe = 2, 2
    out = [_bytes(1, _bytes(1, b"<unk>") + _number(3, unknown))]
    for rank, token in enumerate(tokens):
        text = "".join(map(shown.__getitem__, token)).encode()
        out.append(_bytes(1, _bytes(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    trainer = _number(3, bpe) + _number(4, len(tokens) + 1)
    # no dummy prefix, no removal of extra white space, no escaping of white space
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _bytes(2, trainer), _bytes(3, normaliser)])


def read_tokens(path: str) -> tuple[list[bytes], list[int]]:
    """Tokens of a rank file in order of rank, and their ranks, which are the ids."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    return tokens, [ranks[t] for t in tokens]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        tokens, ids = read_tokens(path)
        self.split = regex.compile(pattern).findall
        self.shown = dict(enumerate(byte_characters()))
        self.pieces = sentencepiece.SentencePieceProcessor()
        self.pieces.LoadFromSerializedProto(serialised_model(tokens))
        self.packed = [b"", *(struct.pack("<I", i) for i in ids)]
        self.bytes_of = dict(zip(ids, tokens))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        parts, out = self.split(text), []
        for at in range(0, len(parts), BLOCK):
            block = parts[at : at + BLOCK]
            if new := [p for p in dict.fromkeys(block) if p not in self.known]:
                if len(self.known) + len(new) > MEMORY or self.held > MEMORY_CHARS:
                    self.known, self.held = {}, 0
                    new = list(dict.fromkeys(block))
                self.held += sum(map(len, new))
                mapped = [p.encode().decode("latin-1").translate(self.shown) for p in new]
                for part, ids in zip(new, self.pieces.encode(mapped, num_threads=1)):
                    self.known[part] = b"".join(map(self.packed.__getitem__, ids))
            out.append(b"".join(map(self.known.__getitem__, block)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the packed ids; raises KeyError for an id that the vocabulary lacks."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k byte-level vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _codec(vocabulary: tuple[str, str] | None) -> Callable[[], Codec]:
    return lambda: Codec(*(vocabulary or default_vocabulary()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids): token ids of each whole text, packed as little-endian unsigned 32-bit integers.

    ``vocabulary`` is (path of a rank file that every executor has, pattern); none: the
    public 50k one as installed there. No special tokens are made; their strings are
    ordinary text. Null and empty texts have no ids; repeated rows each return
    their row; an empty table gives an empty result; other columns are ignored."""
    made = _codec(vocabulary)
    return map_texts(docs, id_col, text_col, "ids binary", lambda: _each(made().encode), encoded=False)


def _each(work: Callable) -> Callable:
    return lambda text: (work(text),)


def decode(encoded: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, decoded): the bytes that the packed ``ids`` stand for; null ids decode to no bytes."""
    made = _codec(vocabulary)
    schema = encoded.select("doc_id", F.lit(b"").alias("decoded")).schema

    def run(batches):
        codec = made()
        for batch in batches:
            for part in pieces(batch):
                texts = pa.array([codec.decode(x.as_py() or b"") for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` in one pass, with the same results and cases."""
    made = _codec(vocabulary)

    def per_text() -> Callable[[str], tuple[bytes, bytes]]:
        codec = made()

        def both(text: str) -> tuple[bytes, bytes]:
            ids = codec.encode(text)
            return ids, codec.decode(ids)

        return both

    return map_texts(docs, id_col, text_col, "ids binary, decoded binary", per_text, encoded=False)

"""Byte-level BPE through a sentencepiece model that is made from the vocabulary.

The ranks of a byte-level vocabulary become a sentencepiece BPE model: each
token's bytes are written as one character per byte, its score is its negative
rank, so the merge of lowest rank comes first, and the normaliser is the
identity. The model is serialised here, field by field, and never trained.
Text is split into pre-tokens by the vocabulary's pattern; each is encoded by
itself; decoding maps the pieces' characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm.common import spread

#: Characters that stand for the bytes: one block of 256 letters, all of two bytes in UTF-8.
FIRST = 0x100
_TO_CHARS = {b: chr(FIRST + b) for b in range(256)}
#: Pre-tokens that a worker keeps at most, and the longest that it keeps.
KEPT, KEPT_CHARS = 400_000, 64
_AT_ONCE = 1 << 16


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank on each line) in order of rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"the ranks of {path} have gaps")
    return [found[k] for k in range(len(found))]


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: a piece for each token, its id the rank, and the unknown piece last.

    Fixed numbers of the format: ModelProto has pieces 1, trainer_spec 2 and
    normalizer_spec 3; a piece has text 1, score 2 and type 3 (unknown is 2);
    the trainer has model_type 3 (BPE is 2), vocab_size 4, unk_id 40, bos_id
    41, eos_id 42 and pad_id 43; the normaliser has name 1, add_dummy_prefix 3,
    remove_extra_whitespaces 4 and escape_whitespaces 5.
    """
    out = [_block(1, _block(1, as_chars(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))) for rank, t in enumerate(tokens)]
    out.append(_block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    n = len(tokens)
    out.append(_block(2, _number(3, 2) + _number(4, n + 1) + _number(40, n) + _number(41, -1) + _number(42, -1) + _number(43, -1)))
    out.append(_block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.tokens = ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.tokens))
        self.pattern = regex.compile(pattern)
        chars = [self.model.id_to_piece(k) for k in range(len(self.tokens))]
        self.bytes_of = [bytes(ord(c) - FIRST for c in piece) for piece in chars]  # the inverse of as_chars
        self.cache = _Cache(self.model)

    def _in_parts(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a long text, in lists of bounded length."""
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, _AT_ONCE)]:
            yield part

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        self.cache.fill({t for x in lists for t in x})
        return [b"".join(map(self.cache.__getitem__, x)) for x in lists]

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; empty for null."""
        held: list[list[str]] = []
        room = 0
        for text in texts:
            text = text or ""
            if len(text) > 8 * _AT_ONCE:
                yield from self._ids(held)
                held, room = [], 0
                yield b"".join(self._ids([part])[0] for part in self._in_parts(text))
                continue
            held.append(self.pattern.findall(text))
            room += len(text)
            if room > 4 * _AT_ONCE:
                yield from self._ids(held)
                held, room = [], 0
        yield from self._ids(held)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Cache(dict):
    """Ids of pre-tokens, filled for many at a time and emptied when full."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        super().__init__()
        self.model = model

    def fill(self, pre_tokens: set[str]) -> None:
        if len(self) >= KEPT:
            self.clear()
        new = [t for t in pre_tokens if t not in self and len(t) <= KEPT_CHARS]
        if new:
            found = self.model.encode([as_chars(t.encode("utf-8", "surrogatepass")) for t in new], num_threads=1)
            self.update((t, struct.pack(f"<{len(ids)}I", *ids)) for t, ids in zip(new, found))

    def __missing__(self, pre_token: str) -> bytes:
        """Of a long pre-token, which isn't kept."""
        ids = self.model.encode(as_chars(pre_token.encode("utf-8", "surrogatepass")))
        return np.array(ids, "<u4").tobytes()


@lru_cache(2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs(doc_id, text, ...), and ids with keep_ids.

    ids: little-endian unsigned 32-bit numbers; decoded_sha256 is taken from
    the bytes that decoding the ids gives. Null and empty texts have no ids
    and the hash of no bytes; repeated rows stay repeated; an empty table gives
    an empty result; further columns are ignored. The vocabulary's path must
    hold on the executors.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, of_ids, of_text, kept = [], [], [], []
                for ids in bpe.encode_many(text.as_py() for text in part.column("text")):
                    n.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    kept.append(ids if keep_ids else None)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(slim).mapInArrow(run, schema)

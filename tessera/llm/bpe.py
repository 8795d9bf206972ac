"""Byte-level BPE through sentencepiece, its model serialised straight from a rank file.

Every byte string of the vocabulary becomes a piece of printable characters, one a byte, scored by its negative rank;
the normaliser is the identity. sentencepiece then joins the pair of lowest rank first, as byte-level BPE does, in
n log n even for a pre-token of a million bytes. Decoding takes the pieces of the ids and maps their characters back to
bytes. A pre-token that is a token by itself but that merging by rank does not lead to would come out in parts; the codec
finds such tokens by encoding the whole vocabulary once and keeps their ids apart.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table

#: Pre-tokens up to this many characters are remembered, and so many of them before the memory starts anew.
REMEMBER_CHARS, REMEMBER = 40, 200_000
UNKNOWN = "▁unknown"


def byte_chars() -> list[str]:
    """A printable character for each byte: its own where Latin-1 has one, else one from U+0100 on."""
    out, nxt = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b) if plain else chr(nxt))
        nxt += not plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: the unknown piece as id 0, then the vocabulary in the order of its ranks."""
    chars = byte_chars()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(45, UNKNOWN.encode())
    for special in (41, 42, 43):  # no beginning, end or padding piece
        trainer += _varint(special << 3) + b"\xff" * 9 + b"\x01"
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids and ids to bytes; ids are those of the rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.order = [""] + [str(r) for r in sorted(ranks.values())]
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.to_chars = dict(enumerate(byte_chars()))
        self.memory: dict[str, str] = {}
        back = {c: b for b, c in self.to_chars.items()}
        self.to_bytes = {order: bytes(back[c] for c in self.model.id_to_piece(i)) for i, order in enumerate(self.order) if i}
        # tokens that merging by rank does not lead to; those that are not a text can be no pre-token
        texts = {}
        for token, rank in ranks.items():
            try:
                texts[token.decode()] = str(rank)
            except UnicodeDecodeError:
                pass
        made = self.model.encode([self.mapped(t) for t in texts], num_threads=1)
        self.whole = {t: rank for (t, rank), ids in zip(texts.items(), made) if [self.order[i] for i in ids] != [rank]}

    def mapped(self, part: str) -> str:
        return part.encode().decode("latin-1").translate(self.to_chars)

    def encoded(self, parts: list[str]) -> list[str]:
        """For each pre-token its ids, joined by one space."""
        order = self.order
        todo = [p for p in parts if p not in self.whole]
        ids = self.model.encode([self.mapped(p) for p in todo], num_threads=1) if todo else []
        done = {p: " ".join([order[i] for i in x]) for p, x in zip(todo, ids)}
        return [self.whole[p] if p in self.whole else done[p] for p in parts]

    def encode(self, text: str) -> str:
        """Ids of a text, joined by one space."""
        parts = self.split(text)
        memory = self.memory
        new = {p for p in parts if p not in memory}
        extra = {}
        if new:
            new = list(new)
            if len(memory) > REMEMBER:
                memory.clear()
                new = list(set(parts))
            for p, ids in zip(new, self.encoded(new)):
                (memory if len(p) <= REMEMBER_CHARS else extra)[p] = ids
        if extra:
            return " ".join([memory[p] if p in memory else extra[p] for p in parts])
        return " ".join(map(memory.__getitem__, parts))

    def decode(self, ids: str) -> bytes:
        """The bytes of the pieces of ids joined by one space."""
        return b"".join(map(self.to_bytes.__getitem__, ids.split(" "))) if ids else b""


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): one row a row of ``docs``; with ``ids`` also the array itself.

    Null text: empty, no tokens. Each match of the pattern is encoded by itself, without special tokens. Rows are
    independent, so repeated rows give repeated results and an empty table none; other columns are dropped.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    name = shipped(docs.sparkSession, path)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import SparkFiles

        c = codec(SparkFiles.get(name), pattern)
        for batch in batches:
            rows = ([], [], [], [])
            for text in batch.column(1):
                s = c.encode(text.as_py() or "")
                rows[0].append(s.count(" ") + 1 if s else 0)
                rows[1].append(hashlib.sha256(s.encode()).hexdigest())
                rows[2].append(hashlib.sha256(c.decode(s)).hexdigest())
                if ids:
                    rows[3].append(np.array(s.split(" "), np.int32) if s else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(rows[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


_shipped: set[tuple[str, str]] = set()


def shipped(spark, path: str) -> str:
    """The name under which workers find the rank file, which is on the driver's disk only."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _shipped:
        sc.addFile(path)
        _shipped.add((sc.applicationId, path))
    return os.path.basename(path)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), *public_vocabulary())

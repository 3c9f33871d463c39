"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary, through a sentencepiece model.

The sentencepiece model is serialised straight from the vocabulary: every
token becomes a piece of byte-mapped characters whose score is its negative
rank, so the highest-scoring merge is the lowest rank; normalisation is the
identity.  Texts are cut into pre-tokens, mapped, encoded, and decoded by the
inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Cutting rule of the byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MOST_KEPT = 100_000
_LONGEST_KEPT = 64


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(vocabulary: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model with the vocabulary's ids; the id after the last is the unknown piece."""
    chars = byte_characters()
    order = sorted(vocabulary, key=vocabulary.get)
    if [vocabulary[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0 .. n-1")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(order)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(order))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encodes and decodes texts with one serialised model."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PATTERN).findall
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        self.to_bytes = {c: b for b, c in enumerate(chars)}
        self.plain = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        self.known: dict[str, list[int]] = {}

    def _mapped(self, token: str) -> str:
        # bytes as Latin-1 characters, then each to its printable stand-in
        return token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.plain)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give the empty list, a blank one is encoded as it is."""
        cut = [self.cut(t) if t else [] for t in texts]
        new = list({p for ps in cut for p in ps if p not in self.known})
        if len(self.known) + len(new) > _MOST_KEPT:
            self.known.clear()
            new = list({p for ps in cut for p in ps})
        fresh = dict(zip(new, self.sp.encode([self._mapped(p) for p in new], num_threads=1))) if new else {}
        self.known |= {p: ids for p, ids in fresh.items() if len(p) <= _LONGEST_KEPT}
        get = self.known
        out = []
        for ps in cut:
            ids: list[int] = []
            for p in ps:
                ids += get[p] if p in get else fresh[p]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        text = "".join(self.sp.id_to_piece(i) for i in ids)
        return bytes(self.to_bytes[c] for c in text).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The encoder of a model, built once a worker."""
    k = hash(model)
    if k not in _ENCODERS:
        _ENCODERS[k] = Encoder(model)
    return _ENCODERS[k]


def model_of(tokenizer: str, folder: str = TOKENIZERS) -> bytes:
    return sentencepiece_model(ranks(f"{folder}/{tokenizer}.tiktoken"))


def encoded(spark: SparkSession, df: DataFrame, tokenizer: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """`key` and `ids` of every row, without special tokens; their strings are ordinary text.

    Null and empty texts give the empty list; repeated rows come out as often as
    they stand in the table; other columns are not read.  The model (about 1 MB,
    fixed by the vocabulary) is broadcast; the pass is one narrow stage.
    """
    shared = spark.sparkContext.broadcast(model_of(tokenizer, folder))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    return df.select(F.col(key).alias("k"), F.col(text)).mapInArrow(run, f"k {kind.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def lengths(spark: SparkSession, df: DataFrame, tokenizers: list[str], key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """`key`, `tokenizer`, `tokens`: the number of tokens of every row under each tokenizer, in one pass over the texts."""
    shared = spark.sparkContext.broadcast({t: model_of(t, folder) for t in tokenizers})
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {t: encoder(m) for t, m in shared.value.items()}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                for t, enc in encoders.items():
                    n = [len(x) for x in enc.encode(texts)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t] * len(n)), pa.array(n, pa.int32())], ["k", "tokenizer", "tokens"])

    return df.select(F.col(key).alias("k"), F.col(text)).mapInArrow(run, f"k {kind.simpleString()}, tokenizer string, tokens int").withColumnRenamed("k", key)

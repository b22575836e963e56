"""Token files: a concatenated id array with Elias-Fano coded document boundaries.

File format: a table of segments in Parquet, in the order (part, segment). A segment holds
the ids of consecutive documents as one little-endian array of `width` bytes an id, the
position after each document (ends) and the doc_ids, both as Elias-Fano sequences.
`first` is the number of ids before the segment within its part.

An Elias-Fano sequence of n values below u keeps the low floor(log2(u / n)) bits of each
value in a packed array and the high parts as unary gaps in a bit vector: about
2 + log2(u / n) bits a value. select(i) finds the i-th one from a sample every 64 ones.

The plan: documents are range-partitioned by doc_id and sorted (one shuffle of the texts),
tokenised in that order and written; token totals of the parts give each part's start.

Defined results: null text is empty and gets the end id alone; rows without a doc_id come
first; rows with equal doc_id are ordered by a hash of their text; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, input_bytes, materialize, slices, table

END_ID = 2
#: Ids of one segment (a longer document has its own).
SEGMENT_IDS = 1 << 20
SAMPLE = 64
#: Distinct pieces that a worker remembers; the memory starts anew beyond them.
MEMORY = 800_000

FIELDS = "n_docs long, n_ids long, first long, width int, ids binary, no_id long, base_id long, "
FIELDS += ", ".join(f"{k}_{f}" for k in ("ends", "docs") for f in ("n long", "low_bits int", "low binary", "high binary", "samples binary"))
SCHEMA = f"part int, segment int, {FIELDS}"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


class EliasFano:
    """A sequence of non-decreasing, non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if int(v[-1]) >= n else 0
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value: one sample, then at most a few bytes of the bit vector."""
        at = int(np.frombuffer(self.samples, "<u4", 1, i // SAMPLE * 4)[0])
        left, byte = i % SAMPLE, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = (byte << 3) + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        chunk = int.from_bytes(self.low[a >> 3 : (a + self.low_bits + 7) >> 3], "little")
        return chunk >> (a & 7) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((ones - np.arange(self.n)) << self.low_bits) | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def fields(self) -> tuple:
        return self.n, self.low_bits, self.low, self.high, self.samples


# A run of white space gives its last space to the next word, as the tokenizer's own pattern
# does. Latin letters before plain punctuation or white space end a pre-token, so that words
# are remembered without their punctuation.
_ONCE = "+" if sys.version_info >= (3, 11) else ""  # no backtracking into a word
_PIECE = re.compile(rf" ?[A-Za-zÀ-ÖØ-öø-ÿ]+{_ONCE}(?=[\s.,;:!?]|\Z)| ?\S+|\s+(?!\S)|\s")
#: Characters on which Python and the tokenizer differ about white space.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


class Encoder:
    """A byte-level BPE tokenizer with a memory of the pieces between blanks. A border between
    such pieces is a border of the tokenizer's pre-tokens, so they encode independently;
    texts with special tokens or odd white space go to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = (*_ODD, *special)
        self.memory = _Memory(self)
        # a word of Latin letters is one pre-token: the model takes it without the pipeline,
        # in the byte-level alphabet
        self.word = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
        pipeline = type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and not self.tok.pre_tokenizer.add_prefix_space and self.tok.normalizer is None
        self.model = self.tok.model if pipeline else None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.letters = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in (32, *range(0xC0, 0x100))}

    def piece(self, piece: str) -> bytes:
        if self.model and self.word.fullmatch(piece):
            return array(self.code, [t.id for t in self.model.tokenize(piece.translate(self.letters))]).tobytes()
        return self.text(piece)

    def text(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        get, out = self.memory.__getitem__, []
        for t in texts:
            if t and any(w in t for w in self.whole):
                out.append(self.text(t))
            else:
                out.append(b"".join(map(get, _PIECE.findall(t))) if t else b"")
        if len(self.memory) > MEMORY:
            self.memory.clear()
        return out


class _Memory(dict):
    """Pieces and their ids; what is missing is encoded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        self[piece] = got = self.encoder.piece(piece)
        return got


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _segment(part: int, segment: int, first: int, ids: list, blobs: list[bytes], width: int) -> tuple:
    sizes = np.array([len(b) // width for b in blobs])
    known = [i for i in ids if i is not None]
    base = known[0] if known else 0
    ends, docs = EliasFano.encode(np.cumsum(sizes)), EliasFano.encode(np.array([i - base for i in known], np.uint64))
    return (part, segment, len(ids), int(sizes.sum()), first, width, b"".join(blobs), len(ids) - len(known), base, *ends.fields(), *docs.fields())


def write(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the token file; returns its segments, read from it."""
    configure(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    size = input_bytes(docs)
    n = max(1, -(-size // max(4 << 20, size // 20_000)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"), "text")

    def encode(batches):
        import pyarrow.compute  # noqa: F401

        enc, part = _encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.kind).tobytes()
        segment = first = held = 0
        ids, blobs = [], []

        def flush():
            row = _segment(part, segment, first, ids, blobs, enc.width)
            return pa.RecordBatch.from_pylist([dict(zip(NAMES, row))], schema=arrow)

        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                for i, b in zip(piece.column("id").to_pylist(), enc.encode(piece.column("text").to_pylist())):
                    b += end
                    if ids and held + len(b) > SEGMENT_IDS * enc.width:
                        yield flush()
                        segment, first, held, ids, blobs = segment + 1, first + held // enc.width, 0, [], []
                    ids.append(i)
                    blobs.append(b)
                    held += len(b)
        if ids:
            yield flush()

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(SCHEMA))
    return materialize(rows.mapInArrow(encode, SCHEMA), "op7-tokens")


def read(segments: DataFrame) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids_crc32."""
    totals = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    parts = np.array(sorted(totals), np.int64)
    before = np.append(0, np.cumsum([totals[p] for p in sorted(totals)]))

    def rows(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                s = batch.slice(r, 1).to_pylist()[0]
                ef = lambda k: EliasFano(*(s[f"{k}_{f}"] for f in ("n", "low_bits", "low", "high", "samples")))  # noqa: E731,B023
                ends = ef("ends")
                ends = np.array([ends.select(i) for i in range(ends.n)], np.int64)
                starts = np.append(0, ends[:-1])
                ids = np.frombuffer(s["ids"], f"<u{s['width']}").astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                doc = [None] * s["no_id"] + (ef("docs").values() + s["base_id"]).tolist()
                shift = int(before[np.searchsorted(parts, s["part"])]) + s["first"]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(starts + shift), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))

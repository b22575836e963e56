"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Method: words of equal length advance together. At each end position every substring length
is probed at once: a polynomial substring hash is looked up among the sorted piece keys, and
the maximum over admissible lengths is stored as the backpointer.

The model is a BPE model, whose segmentation is the one that merging by score gives, not the
one with the best sum of scores. The recurrence therefore admits a piece after a prefix when
the two tokens can stand side by side, i.e. no merge across their border would have come
before the merges inside them; exactly one piece qualifies per position, so the maximum
finds it. The result equals the library's ids. Only words with two or more adjacent space
marks (whose pieces share one score) are merged pair by pair from a heap, n log n in their length.

Defined results: null or empty text has no tokens and decodes to ""; characters without a
piece become byte pieces; decoding drops the one leading space that encoding adds. A literal
U+2581 reads as a space, as in the library, so it does not survive a round trip.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, mix, slices, table, without

MARK = "▁"
#: Distinct words that a worker remembers; the memory starts anew beyond them.
MEMORY = 500_000
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BITS = 1 << 22
#: Makes a quantifier keep what it took (Python 3.11 and later; only faster).
ONCE = "+" if sys.version_info >= (3, 11) else ""


def _keys(codes: np.ndarray) -> np.ndarray:
    """Prefix sums (rows, length + 1) of mixed characters times powers of the base."""
    scale = np.cumprod(np.full(codes.shape[1], _B, np.uint64))
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * scale, axis=1, out=sums[:, 1:])
    return sums


class Model:
    """Pieces, scores and merge order of a BPE sentencepiece model. `place` numbers single
    characters first and merged pieces by falling score."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.kinds = pieces, kinds
        self.score = {p: s for p, s, k in zip(pieces, scores, kinds) if k == "normal"}
        self.id_of = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        self.raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"" for p, k in zip(pieces, kinds)]
        self._build()

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], [kind(i) for i in ids])

    def merge(self, word: str) -> list[str]:
        """Pieces by merging: the adjacent pair whose union scores best, leftmost first."""
        return self._merge(word)[0]

    def _merge(self, word: str) -> tuple[list[str], tuple[str, str]]:
        """The pieces, and the two that were merged last. The pairs wait in a heap; a pair that a
        merge has changed meanwhile is passed over."""
        n, parts, last = len(word), list(word), ("", "")
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (s := self.score.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[after[i]]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            last = (a, b)
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [p for p in parts if p], last

    def _build(self) -> None:
        plain = [p for p in self.id_of if not (len(p) > 1 and set(p) == {MARK})]
        ones = sorted((p for p in plain if len(p) == 1), key=self.id_of.get)
        more = sorted((p for p in plain if len(p) > 1), key=lambda p: (-self.score[p], self.id_of[p]))
        halves = {p: self._merge(p) for p in more}
        more = [p for p in more if len(halves[p][0]) == 1]  # others are never reached by merging
        order = ones + more
        place = {p: i for i, p in enumerate(order)}
        n = self.n = len(order)
        self.id_at = np.array([self.id_of[p] for p in order] + [-1], np.int64)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        pairs, whole = [], []
        for p in more:
            a, b = (place[x] for x in halves[p][1])
            self.left[place[p]], self.right[place[p]] = a, b
            pairs.append(a * (n + 1) + b)
            whole.append(place[p])
        by = np.argsort(pairs)
        self.pairs, self.whole = np.array(pairs, np.int64)[by], np.array(whole, np.int64)[by]
        self.pair_bits = np.zeros(_BITS, bool)
        self.pair_bits[self._pair_slot(self.pairs)] = True
        self.longest = max(map(len, order), default=1)
        keys = np.zeros(n, np.uint64)
        for size in {len(p) for p in order}:
            at = [i for i, p in enumerate(order) if len(p) == size]
            codes = np.frombuffer("".join(order[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, size)
            keys[at] = _keys(codes)[:, -1]
        by = np.argsort(keys)
        self.keys, self.place = keys[by], by
        self.bits = np.zeros(_BITS, bool)
        self.bits[(keys & np.uint64(_BITS - 1)).astype(np.int64)] = True
        # where no piece holds a letter before a punctuation mark, no merge crosses that border
        after_letter = {b for p in self.id_of for a, b in zip(p, p[1:]) if a.isalpha()}
        ends = "".join(c for c in ".,;:!?" if c not in after_letter)
        word = rf"{MARK}*[^\W\d_]+{ONCE}(?=[{re.escape(ends)}])|" if ends else ""
        self.word = re.compile(rf"{word}{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    @staticmethod
    def _pair_slot(code: np.ndarray) -> np.ndarray:
        return (code * 0x9E3779B1 >> 10) & (_BITS - 1)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the piece that merges a and b, or a number above all."""
        code = a * (self.n + 1) + b
        out = np.full(len(code), self.n + 1)
        maybe = np.flatnonzero(self.pair_bits[self._pair_slot(code)])
        if len(maybe):
            code = code[maybe]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = self.pairs[at] == code
            out[maybe[hit]] = self.whole[at[hit]]
        return out

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b (places) can stay neighbours. Both are taken apart, the one
        merged later first; at no time may a merge across the border come before the merge
        that was undone last."""
        out = np.zeros(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), self.n + 1)
        while len(live):
            ok = self._joined(a, b) >= limit
            live, a, b, limit = live[ok], a[ok], b[ok], limit[ok]
            leaf_a, leaf_b = self.right[a] == a, self.left[b] == b
            take_a = ((a > b) & ~leaf_a) | (leaf_b & ~leaf_a)
            done = leaf_a & leaf_b
            out[live[done]] = True
            limit = np.where(take_a, a, b + 1)
            a, b = np.where(take_a, self.right[a], a), np.where(take_a, b, self.left[b])
            live, a, b, limit = live[~done], a[~done], b[~done], limit[~done]
        return out

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length."""
        size, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, size)
        sums = _keys(codes)
        back = np.append(np.uint64(1), np.cumprod(np.full(size, _BINV, np.uint64)))
        length = np.zeros((m, size + 1), np.int64)
        token = np.full((m, size + 1), self.n)  # n: a character without a piece
        for end in range(1, size + 1):
            best, found = np.zeros(m, np.int64), np.full(m, self.n)
            for step in range(1, min(end, self.longest) + 1):
                begin = end - step
                key = (sums[:, end] - sums[:, begin]) * back[begin]
                row = np.flatnonzero(self.bits[(key & np.uint64(_BITS - 1)).astype(np.int64)])
                if not len(row):
                    continue
                at = np.minimum(np.searchsorted(self.keys, key[row]), self.n - 1)
                hit = self.keys[at] == key[row]
                row, piece = row[hit], self.place[at[hit]]
                if begin:
                    prior = token[row, begin]
                    fits = prior == self.n
                    fits[~fits] = self.side_by_side(prior[~fits], piece[~fits])
                    row, piece = row[fits], piece[fits]
                best[row], found[row] = np.maximum(best[row], step), piece
            length[:, end] = np.maximum(best, 1)
            token[:, end] = found
        return self._trace(words, token, length)

    def _trace(self, words, token, length) -> list[bytes]:
        """Follow the backpointers of all words at once."""
        m, size = len(words), len(words[0])
        ids = np.full((m, size), -2, np.int32)
        at, rows = np.full(m, size), np.arange(m)
        unknown = []
        while len(rows):
            found = self.id_at[token[rows, at[rows]]]
            ids[rows, at[rows] - 1] = found
            if (found < 0).any():
                unknown.append(rows[found < 0])
            at[rows] -= length[rows, at[rows]]
            rows = rows[at[rows] > 0]
        keep = ids != -2
        flat, cut = ids[keep].astype("<i4").tobytes(), np.append(0, np.cumsum(keep.sum(axis=1)) * 4).tolist()
        out = [flat[a:b] for a, b in zip(cut, cut[1:])]
        for r in set(np.concatenate(unknown).tolist()) if unknown else ():
            got = []
            for e, i in enumerate(ids[r].tolist()):
                got.extend(() if i == -2 else (i,) if i >= 0 else self._bytes(words[r][e]))
            out[r] = np.array(got, "<i4").tobytes()
        return out

    def _bytes(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "replace")
        return [self.byte_id[b] for b in raw] if self.byte_id else [self.unknown]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out, by_size = {}, {}
        for w in words:
            if MARK * 2 in w:
                out[w] = np.array([i for p in self.merge(w) for i in ([self.id_of[p]] if p in self.id_of else self._bytes(p))], "<i4").tobytes()
            else:
                by_size.setdefault(len(w), []).append(w)
        for size, same in by_size.items():
            most = max(1, (1 << 20) // size)
            for i in range(0, len(same), most):
                out |= zip(same[i : i + most], self._viterbi(same[i : i + most]))
        return out

    def encode(self, texts: list[str | None], memory: dict | None = None) -> list[np.ndarray]:
        memory = {} if memory is None else memory
        cut = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        missing = list(set().union(*cut).difference(memory)) if cut else []
        if len(memory) + len(missing) > MEMORY:
            memory.clear()
            missing = list(set().union(*cut))
        memory |= self.encode_words(missing)
        get = memory.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in cut]

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[Model, dict]:
    """One model and word memory for each worker process."""
    return Model.load(path), {}


def encode_decode(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with ids array<int>, decoded string (of those ids), n_tokens and ids_crc32 (which
    replace columns of these names)."""
    configure(docs.sparkSession)
    docs = without(docs, ["ids", "decoded", "n_tokens", "ids_crc32"])
    path, names = model_path or default_model(), docs.columns

    def run(batches):
        model, memory = _model(path)
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                ids = model.encode(part.column(text_col).to_pylist(), memory)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                arr = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, arr, pa.array([model.decode(x.tolist()) for x in ids], pa.string()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                    [*names, "ids", "decoded", "n_tokens", "ids_crc32"],
                )

    more = "ids array<int>, decoded string, n_tokens long, ids_crc32 long"
    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(more).fields]))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids, and whether they decode to the text."""
    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "ids_crc32", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their ids; whether these decode to the text."""
    docs = without(docs, ["ids", "decoded", "n_tokens", "ids_crc32", "round_trip"])
    out = encode_decode(docs)
    return out.select(*docs.columns, "ids", "n_tokens", "ids_crc32", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))

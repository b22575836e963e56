"""Line dedup by overlapping three-line windows.

Method: a text is cut into lines; every three consecutive lines form a window, hashed over
the lines' words. A window that occurs anywhere earlier (smaller doc_id, or further up in
the same document) is repeated; the lines it covers are removed, overlapping windows
merging their cover. The first occurrence stays.

Lines: prose often holds whole paragraphs between line feeds, so a line ends at a line feed
or a sentence end. A piece of fewer than four words does not close a line; it belongs to
the next (a rule that looks at the piece alone, so that equal passages are cut alike
wherever they stand). Inside a sentence, lines also end by content: places are taken by
ascending hash of the two words around them, each at least four words from every end taken
before, until no place is left. So a line has four to seven words (only a text's last may
have fewer), and where a line ends depends on few words around it: a passage of over 50
words holds a window although it begins and ends inside sentences (all of 4,000 random
passages of 51 words did). A window holds twelve words or more, and chance repeats of stock
phrases stay. Words are compared without regard to case and white space.

The plan: (window, doc_id) rows, once per document, are counted with a combine before the
shuffle; windows of more than one document are written with their first doc_id and joined
back (a hot window is one row there, so AQE can split its other side); each text then
gets the list of its own windows to remove, no longer than itself.

Defined results: null text stays null; texts of fewer than three lines are kept; rows with
equal doc_id count as one document (both keep what the document keeps); rows without a
doc_id come after all others. Columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configure, discard, materialize, mix, powers, slices, table, without

WINDOW = 3
LEAST_WORDS = 4
#: Text bytes whose lines are found at once; their arrays fit the caches.
PART_BYTES = 1 << 18

#: Characters that end a sentence, and those that may follow them in the same word.
_STOP, _CLOSER = (np.isin(np.arange(1 << 16), [ord(c) for c in some]) for some in (".!?。！？।؟", "\"'”’)]"))
_SPACE = np.array([chr(c).isspace() for c in range(1 << 16)])
_CODE = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
_NEVER = np.uint64(2**64 - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and which code points belong to words."""
    on = ~_SPACE[np.minimum(codes, 0xFFFF)]
    head = on.copy()
    head[1:] &= ~on[:-1]
    return np.flatnonzero(head), on


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin, their hashes, and the words before which a line feed or a sentence ends."""
    begin, on = _starts(codes)
    if not len(begin):
        return begin, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(on)
    k = np.searchsorted(at, begin)
    size = np.diff(np.append(k, len(at)))
    pos = at - np.repeat(begin, size)
    c = codes[at]
    value = _CODE[np.minimum(c, 0xFFFF)]
    if (wide := c > 0xFFFF).any():
        value[wide] = mix(c[wide].astype(np.uint64) + np.uint64(1))
    h = mix(np.add.reduceat(value * powers(int(pos.max()) + 1)[pos], k))
    last = begin + size - 1
    look = np.minimum(codes[last], 0xFFFF)
    while len(back := np.flatnonzero(_CLOSER[look] & (last > begin))):
        last[back] -= 1
        look[back] = np.minimum(codes[last[back]], 0xFFFF)
    ends = [np.flatnonzero(_STOP[look]) + 1, np.searchsorted(begin, np.flatnonzero(codes == 10))]
    return begin, h, np.unique(np.concatenate(ends))


def _inner(rank: np.ndarray, fixed: np.ndarray, least: int) -> np.ndarray:
    """Words before which a line ends inside a sentence: by ascending rank (then position), every
    place at least `least` words from the fixed ends and from those taken before."""
    pad = least - 1
    near = [d for d in range(-pad, pad + 1) if d]
    left = np.full(len(rank) + 2 * pad + 1, _NEVER)
    left[pad : pad + len(rank)] = np.minimum(rank, _NEVER - np.uint64(1))
    for d in [0, *near]:
        left[fixed + pad + d] = _NEVER
    open_, out = np.flatnonzero(left != _NEVER), []
    for _ in range(24):  # every place that is least among its neighbours, at once
        if not len(open_):
            break
        own, ok = left[open_], np.ones(len(open_), bool)
        for d in near:
            ok &= left[open_ + d] > own if d < 0 else left[open_ + d] >= own
        got = open_[ok]
        out.append(got)
        for d in [0, *near]:
            left[got + d] = _NEVER
        open_ = open_[left[open_] != _NEVER]
    more = []
    for i in open_[np.argsort(left[open_], kind="stable")].tolist():  # long chains, e.g. one word again and again
        if left[i] != _NEVER:
            more.append(i)
            left[i - pad : i + pad + 1] = _NEVER
    return np.sort(np.concatenate([*out, np.array(more, np.int64)]).astype(np.int64)) - pad


def layout(texts: list[str], least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of all texts: where each begins in its text, a hash of its words, and n + 1
    offsets of the texts into the lines."""
    joined = "\n".join([*texts, ""])
    size = np.array([len(t) for t in texts], np.int64)
    off = np.append(0, np.cumsum(size + 1))
    low = joined.lower()
    begin, h, ends = _words(_codes(low))
    if len(low) != len(joined):  # one letter has a longer lower case; its words are the same
        begin = _starts(_codes(joined))[0]
    word = np.searchsorted(begin, off)
    ends = np.union1d(ends, word)
    hard = np.setdiff1d(ends[1:][np.diff(ends) >= least], word)
    rank = h.copy()
    rank[1:] = mix(h[:-1] * powers(1)[0] + h[1:])
    cuts = np.append(hard, _inner(rank, np.union1d(hard, word), least))
    at = np.sort(np.concatenate([off[:-1][size > 0], begin[cuts]]))
    first = np.searchsorted(at, off)
    head = np.searchsorted(begin, at)
    n = np.diff(np.append(head, len(h)))
    out = np.zeros(len(at), np.uint64)
    if (some := n > 0).any():
        pos = np.arange(len(h)) - np.repeat(head[some], n[some])
        out[some] = mix(np.add.reduceat(h * powers(int(pos.max()) + 1)[pos], head[some]) + n[some].astype(np.uint64))
    return at - np.repeat(off[:-1], np.diff(first)), out, first


def lines(text: str, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Spans of the lines; they partition the text."""
    at = layout([text], least)[0].tolist()
    return list(zip(at, [*at[1:], len(text)]))


def windows(h: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A signed 64-bit hash for the window that begins at each line, from the lines' hashes."""
    if len(h) < size:
        return np.zeros(0, np.int64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _window_rows(batches):
    """(window, id, h, twice) once per text; twice: it comes more than once in this text."""
    for batch in batches:
        for part in slices(batch, "text", PART_BYTES):
            _, h, first = layout([t or "" for t in part.column("text").to_pylist()])
            win, of = windows(h), np.repeat(np.arange(part.num_rows), np.diff(first))
            own = of[: len(win)] == of[WINDOW - 1 :]
            win, of = win[own], of[: len(win)][own]
            if not len(win):
                continue
            order = np.lexsort((win, of))
            win, of = win[order], of[order]
            head = np.flatnonzero(np.append(True, (win[1:] != win[:-1]) | (of[1:] != of[:-1])))
            more = np.diff(np.append(head, len(win))) > 1
            yield pa.RecordBatch.from_arrays([pa.array(win[head]), part.column("id").take(pa.array(of[head])), part.column("h").take(pa.array(of[head])), pa.array(more)], ["win", "id", "h", "twice"])


def kept(text: str | None, again: list[int] | None, laid: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[str | None, int]:
    """The text without repeated windows, and the number of lines removed. again: windows
    that an earlier document holds; None: no window of the text is repeated anywhere. laid: where
    its lines begin, and their hashes."""
    if not text or again is None:
        return text, 0
    begin, h = laid or layout([text])[:2]
    w = windows(h)
    if not len(w):
        return text, 0
    _, first = np.unique(w, return_index=True)
    hit = np.ones(len(w), bool)
    hit[first] = False
    if again:
        hit |= np.isin(w, np.array(again, np.int64))
    if not hit.any():
        return text, 0
    cover = np.zeros(len(begin), bool)
    for i in range(WINDOW):
        cover[i : i + len(hit)] |= hit
    spans = zip(begin.tolist(), [*begin[1:].tolist(), len(text)])
    return "".join(text[a:b] for (a, b), c in zip(spans, cover) if not c).rstrip(), int(cover.sum())


def _kept_all(texts: list[str | None], again: list[list[int] | None]) -> list[tuple[str | None, int]]:
    held = [i for i, (t, a) in enumerate(zip(texts, again)) if t and a is not None]
    begin, h, first = layout([texts[i] for i in held])
    out = [(t, 0) for t in texts]
    for i, a, b in zip(held, first, first[1:]):
        out[i] = kept(texts[i], again[i], (begin[a:b], h[a:b]))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: str = "n_removed") -> DataFrame:
    """docs with the text after removal, and the number of lines removed in column `count`
    (which replaces one of that name)."""
    configure(docs.sparkSession)
    docs = without(docs, [count])
    own_id, own_h = F.col(id_col).cast("long"), F.xxhash64(text_col)
    rows = docs.select(own_id.alias("id"), own_h.alias("h"), F.col(text_col).alias("text"))
    wins = materialize(rows.mapInArrow(_window_rows, "win long, id long, h long, twice boolean"), "op9-windows")
    first = wins.groupBy("win").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max("twice").alias("any")).where("n > 1 or any").select("win", "first")
    first = materialize(first, "op9-repeated")
    # a text's windows are looked up under its id and hash: texts without an id are apart
    earlier = ~F.col("id").eqNullSafe(F.col("first"))
    again = wins.join(first, "win").where(earlier | F.col("twice"))
    key = lambda i, h: [F.coalesce(i, F.lit(0).cast("long")), F.when(i.isNull(), F.xxhash64(h)).otherwise(h)]
    again = again.groupBy(*[k.alias(n) for k, n in zip(key(F.col("id"), F.col("h")), ("_dl_id", "_dl_h"))])
    again = again.agg(F.sort_array(F.collect_set(F.when(earlier, F.col("win")))).alias("_dl_again"))
    again = materialize(again, "op9-again")
    discard(wins, first)

    keyed = docs.select("*", *[k.alias(n) for k, n in zip(key(own_id, own_h), ("_dl_id", "_dl_h"))])
    whole = keyed.join(again, ["_dl_id", "_dl_h"], "left")
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())])
    names = docs.columns

    def remove(batches):
        for batch in batches:
            for part in slices(batch, text_col, PART_BYTES):
                done = _kept_all(part.column(text_col).to_pylist(), part.column("_dl_again").to_pylist())
                cols = [pa.array([d[0] for d in done], pa.string()) if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([d[1] for d in done], pa.int64())], [*names, count])

    return whole.select(*names, "_dl_again").mapInArrow(remove, schema)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_removed", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated windows; a document with words of which none
    remains (a later exact copy) goes, one that had none to begin with stays."""
    out = dedup(docs, count="_dl_removed")
    gone = (F.col("_dl_removed") > 0) & (F.length(F.trim("text")) == 0)
    out = out.where(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_dl_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

"""Shared parts of the corpus operators: tables, written intermediates, vectorised words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch that goes to a Python worker; texts may be long.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is
    unset the checkpoint folder of the context, the warehouse on a cluster, and a
    temporary folder for a single local JVM (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            found = tempfile.mkdtemp(prefix="docloom-")
            spark.conf.set("spark.checkpoint.dir", found)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/docloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost
    executors, and gives later joins plain scans whose exchanges AQE can split."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_docloom_path", None):
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def broadcasts_up_to(spark: SparkSession, most: int):
    """While it lasts, Spark by itself broadcasts no side of a join above `most` bytes (a lower
    threshold of the session stays): the driver holds a broadcast table, with its hash index and
    its serialised pieces, at several times the bytes that the threshold counts."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    spark.conf.set(names[0], str(min(most, int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))))
    spark.conf.unset(names[1])  # then it is as the first
    try:
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def without(df: DataFrame, names) -> DataFrame:
    """df without columns that an operator's own would clash with (these replace them)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (the files' bytes for a scan). Frames of unknown size
    (rows from the driver or an RDD) count as 4 MB for each shuffle partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 22


def tasks_for(df: DataFrame, bytes_per_task: int, least: int = 1) -> int:
    return max(least, -(-input_bytes(df) // bytes_per_task))


# --- vectorised words -------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_SEED = np.random.default_rng(20240607)
_LUT = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_LUT_FOLD = _LUT.copy()
_LUT_FOLD[65:91] = _LUT[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_pow = np.cumprod(np.full(4096, _BASE, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def powers(n: int) -> np.ndarray:
    global _pow
    if n > len(_pow):
        _pow = np.cumprod(np.full(max(n, 2 * len(_pow)), _BASE, np.uint64))
    return _pow


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, and n + 1 offsets (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, fold: bool = True, is_word: np.ndarray = _IS_WORD):
    """Words of concatenated texts: (hash, first byte, end byte) of each, and n + 1 offsets
    of the texts into the words. fold lower-cases A-Z. Whole words are hashed to 64 bits."""
    on = is_word[data]
    at = np.flatnonzero(on)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(off), np.int64)
    starts = on.copy()
    starts[1:] &= ~on[:-1]
    first = off[:-1][(off[:-1] < len(data))]
    starts[first] = on[first]
    head = starts[at]
    k = np.flatnonzero(head)
    begin = at[k]
    end = np.append(at[np.append(k[1:], len(at)) - 1], 0)[: len(k)] + 1
    pos = at - np.repeat(begin, np.diff(np.append(k, len(at))))
    values = (_LUT_FOLD if fold else _LUT)[data[at]] * powers(int(pos.max()) + 1)[pos]
    h = mix(np.add.reduceat(values, k))
    return h, begin, end, np.searchsorted(begin, off)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _BASE + h[i : i + m]
    return mix(out + np.uint64(n))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch of about `most` text bytes (a single longer text is its own part)."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
    trim()


@lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def trim() -> None:
    """Give freed memory back: a worker lives on between stages, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)

"""Files: whole documents, concatenated objects, lines. Only Spark's own readers and writers
touch storage, so any file system that Spark reaches works."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode
from ..limits import INVALID_ARGUMENT, IO_ERROR, JsonError, Limits
from ..operators import array_items, candidates, object_stream


#: Partitions of small files that one task may read, and the mean of bytes up to which they are small.
TOGETHER, SMALL = 8, 64 << 20


def read_documents(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """path, content (bytes as they are) of each file. Spark counts any file as 4 MB, so that 32 small ones
    are a task of their own; up to 8 such tasks are made one, while each core has some."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    now = files.rdd.getNumPartitions()
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return files.coalesce(max(-(-now // TOGETHER), -(-size // SMALL), min(now, 4 * spark.sparkContext.defaultParallelism), 1))


def _documents(spark: SparkSession, source) -> DataFrame:
    """Of a path, or of documents that read_documents gave, so that several readers share a listing."""
    return source if isinstance(source, DataFrame) else read_documents(spark, source)


def read_objects(spark: SparkSession, path, schema, limits: Limits | None = None) -> DataFrame:
    """path, seq, stream_offset, record, error of files of concatenated objects. Here and below, path may also
    be what read_documents gave."""
    return object_stream(_documents(spark, path), "content", schema, ["path"], limits)


def read_items(spark: SparkSession, path, selector: str = "", schema=None, limits: Limits | None = None) -> DataFrame:
    """path, index, value or record, error of the items of one array in each file."""
    return array_items(_documents(spark, path), "content", selector, ["path"], schema, limits)


def read_candidates(spark: SparkSession, path, framing: str = "auto", limits: Limits | None = None) -> DataFrame:
    return candidates(_documents(spark, path), "content", ["path"], framing, limits)


def read_jsonl(spark: SparkSession, path) -> DataFrame:
    """doc: the lines of newline-delimited files, split across tasks by Spark; blank ones go."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("doc"))


def write_text(df: DataFrame, text: str, path: str, **options) -> None:
    """One text per line in files below a path."""
    df.select(F.col(text).alias("value")).write.text(path, **options)


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share; where that is
    unset, below the warehouse, or in a temporary folder of a single local JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        found = tempfile.mkdtemp(prefix="docloom-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/docloom-files/{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, record, schema, path: str, limits: Limits | None = None, max_records: int | None = None, pretty: bool = False) -> None:
    """Records as lines (pretty: indented, a line feed after each). Fails on the first record that
    can't be encoded."""
    text = encode(record, schema, limits, pretty)
    checked = df.select(text.alias("r")).select(F.when(F.col("r.error.code") == "ok", F.col("r.text")).otherwise(F.raise_error(F.concat_ws(": ", F.col("r.error.code"), F.col("r.error.message")))).alias("value"))
    writer = checked.write.option("maxRecordsPerFile", max_records) if max_records else checked.write
    writer.text(path)


def write_files(df: DataFrame, name: str, content: str | Column, path: str) -> None:
    """One file for each row, with this name below a path and exactly these bytes, by the file
    system that Spark's own configuration gives for the path (in the tasks, through Arrow)."""
    target = path.rstrip("/")

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # a task that is run again writes the same bytes over
                with store.open_output_stream(f"{base}/{n}") as out:
                    out.write(c or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = df.select(F.col(name).alias("name"), (F.col(content) if isinstance(content, str) else content).alias("content"))
    rows.mapInArrow(put, "n long").agg(F.sum("n")).collect()


def _done(r: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit(IO_ERROR + ": "), r["error"]["code"], F.lit(": "), r["error"]["message"]))
    return F.when(r["error"]["code"] == "ok", r["text"]).otherwise(bad)


def _apart(source: str, target: str) -> None:
    if source.rstrip("/") == target.rstrip("/"):
        raise JsonError(INVALID_ARGUMENT, "source and target must differ")


def rewrite_files(spark: SparkSession, source: str, target: str, rewrite) -> None:
    """Apply rewrite(column) -> struct<text, error> to each file; the results stand below target under
    the same names, without a byte added."""
    _apart(source, target)
    out = read_documents(spark, source).select(F.element_at(F.split("path", "/"), -1).alias("name"), rewrite(F.col("content")).alias("r"))
    write_files(out.select("name", F.encode(_done(F.col("r")), "UTF-8").alias("content")), "name", "content", target)


def rewrite_lines(spark: SparkSession, source: str, target: str, rewrite) -> None:
    """The same for each line of files of lines, split across tasks by Spark."""
    _apart(source, target)
    write_text(read_jsonl(spark, source).select(rewrite(F.col("doc")).alias("r")).select(_done(F.col("r")).alias("t")), "t", target)

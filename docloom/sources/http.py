"""HTTP bodies as documents, and records as uploads; each task has its own connections."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch(df: DataFrame, url: str, timeout_s: float = 30.0, max_bytes: int = 64 << 20) -> DataFrame:
    """url, status, content_type, content, failure for each distinct row; one request a row. The
    rows feed decode, array_items, sse_events and the like."""

    def run(batches):
        from urllib.error import HTTPError
        from urllib.request import urlopen

        for batch in batches:
            out = []
            for u in batch.column(0).to_pylist():
                row = {"url": u, "status": None, "content_type": None, "content": None, "failure": None}
                try:
                    with urlopen(u, timeout=timeout_s) as r:  # noqa: S310
                        body = r.read(max_bytes + 1)
                        row |= {"status": r.status, "content_type": r.headers.get("Content-Type"), "content": body}
                        if len(body) > max_bytes:
                            row |= {"content": None, "failure": "overflow: body is larger than allowed"}
                except HTTPError as e:
                    row |= {"status": e.code, "failure": f"io_error: {e.reason}"}
                except (OSError, ValueError) as e:
                    row["failure"] = f"io_error: {e}"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    kind = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("content", pa.binary()), ("failure", pa.string())])
    return df.select(F.col(url).alias("url")).mapInArrow(run, "url string, status int, content_type string, content binary, failure string")


def _parsed(df: DataFrame, url: str, make, value, timeout_s: float, chunk_bytes: int) -> DataFrame:
    """url, seq, value, error_code, error_message: bodies go through a push parser while they arrive;
    a body is never held, only its unfinished value."""

    def run(batches):
        from urllib.request import urlopen

        from ..limits import IO_ERROR, JsonError

        def rows(u: str):
            seq, splitter = 0, make()
            try:
                with urlopen(u, timeout=timeout_s) as r:  # noqa: S310
                    while chunk := r.read(chunk_bytes):
                        for got in splitter.feed(chunk):
                            yield u, seq, value(got), None, None
                            seq += 1
                splitter.finish()
            except JsonError as e:
                yield u, seq, None, e.code, e.message
            except (OSError, ValueError) as e:  # HTTPError is one of the first
                yield u, seq, None, IO_ERROR, str(e)

        for batch in batches:
            for u in batch.column(0).to_pylist():
                held = []
                for row in rows(u):
                    held.append(row)
                    if len(held) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["url", "seq", "value", "error_code", "error_message"]
    return df.select(F.col(url).alias("url")).mapInArrow(run, "url string, seq long, value string, error_code string, error_message string")


def fetch_items(df: DataFrame, url: str, selector: str = "", mode: str = "text", schema=None, timeout_s: float = 30.0, chunk_bytes: int = 64 << 10, max_residual: int = 10 << 20) -> DataFrame:
    """url, seq, value, error of the items of one array in each body, parsed as it arrives: their
    text, decoded strings (mode "strings"), or the text of records decoded by a schema."""
    from ..streaming.push import ItemSplitter, item_check

    check = item_check(mode, schema)
    return _parsed(df, url, lambda: ItemSplitter(selector, max_residual, check), lambda v: v, timeout_s, chunk_bytes)


def fetch_objects(df: DataFrame, url: str, schema, timeout_s: float = 30.0, chunk_bytes: int = 64 << 10, max_residual: int = 10 << 20) -> DataFrame:
    """url, seq, value (text of the decoded record), error of concatenated objects in each body."""
    from ..streaming.push import ObjectSplitter, object_check

    check = object_check(schema)
    return _parsed(df, url, lambda: ObjectSplitter(max_residual), check, timeout_s, chunk_bytes)


def upload(df: DataFrame, text: str, url: str, method: str = "POST", content_type: str = "application/json", timeout_s: float = 30.0) -> DataFrame:
    """Send each text; status, failure per row. Sending happens when the result is read, once
    per attempt of a task: the receiver has to accept repeats."""

    def run(batches):
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                row = {"status": None, "failure": None}
                try:
                    with urlopen(Request(url, (t or "").encode(), {"Content-Type": content_type}, method=method), timeout=timeout_s) as r:  # noqa: S310
                        row["status"] = r.status
                except HTTPError as e:
                    row |= {"status": e.code, "failure": f"io_error: {e.reason}"}
                except (OSError, ValueError) as e:
                    row["failure"] = f"io_error: {e}"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("status", pa.int32()), ("failure", pa.string())]))

    return df.select(F.col(text).alias("t")).mapInArrow(run, "status int, failure string")

"""Table operators over a document column, and the same as SQL table functions.

Each DataFrame operator keeps the chosen columns and adds the rows' fields. The generator runs
in mapInArrow, so rows leave in bounded batches and no cell ever holds all rows of a
document; sources stay narrow (no shuffle). A document is never split across tasks."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import PythonEvalType

from .. import batch as many
from .. import framing
from ..functions.columns import ERROR, arrow_type, strings, struct_type
from ..limits import INVALID_ARGUMENT, JsonError, Limits, ok_row
from ..records import Decoder
from ..schema import Schema
from ..strict import as_bytes

#: Rows of one output batch.
BATCH = 4096

CANDIDATE = struct_type(index="bigint", stream_offset="bigint", byte_size="bigint", payload="string", error=ERROR)
EVENT = struct_type(seq="bigint", event="string", depth="int", text="string", path="array<string>", error=ERROR)
LEAF = struct_type(seq="bigint", path="array<string>", type="string", text="string", error=ERROR)
SSE = struct_type(seq="bigint", event="string", id="string", data="string", data_len="bigint", retry_ms="decimal(20,0)", has_retry="boolean", has_data="boolean", late_event="boolean", error=ERROR)
PART = struct_type(seq="bigint", name="string", content_type="string", content_length="bigint", headers=T.ArrayType(struct_type(name="string", value="string")), body="binary", error=ERROR)
CHUNK = struct_type(chunk_no="bigint", bytes="binary", eof="boolean")
ITEM = struct_type(index="bigint", value="string", error=ERROR)


def expand(df: DataFrame, doc: str, keep: list[str], result: T.StructType, rows: Callable[..., Iterator[dict]], extra: tuple[str, ...] = (), at_once: Callable | None = None) -> DataFrame:
    """keep columns + the fields of each row that rows(document bytes, *extra values) yields;
    null documents give no rows. at_once: a function of many documents (accepted ones, row of the
    document of each result, columns but the error); the ones that it does not accept follow."""
    clash = set(keep) & set(result.fieldNames())
    if clash:
        raise JsonError(INVALID_ARGUMENT, f"columns {sorted(clash)} clash with the operator's; rename them first")
    kinds = [(f.name, arrow_type(f.dataType)) for f in result.fields]
    width, n = len(keep), len(extra)

    def together(batch):
        """The batches of the accepted documents, then the rows that are left."""
        docs = many.binary(batch.column(width))
        left = []
        for first, end in many.parts(many.lengths_of(docs)):
            ok, at, columns = at_once(docs.slice(first, end - first))
            left += [first + i for i in range(end - first) if not ok[i]] if not ok.all() else []
            columns = [c if c.type == t else c.cast(t) for c, (_, t) in zip(columns, kinds)]
            for a in range(0, len(at), 16 * BATCH):
                rows_ = pa.array(at[a : a + 16 * BATCH] + first)
                error = errors_column([ok_row()] * len(rows_), kinds[-1][1])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows_) for i in range(width)], *[c.slice(a, 16 * BATCH) for c in columns], error], [*keep, *result.fieldNames()])
        return batch.take(pa.array(left, pa.int64())) if len(left) < batch.num_rows else batch

    def run(batches):
        for batch in batches:
            if at_once:
                batch = yield from together(batch)
            docs = strings(batch.column(width))
            others = [batch.column(width + 1 + i).to_pylist() for i in range(n)]
            at, out = [], []

            def flush():
                cols = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(width)]
                body = [errors_column([r["error"] for r in out], t) if n == "error" else pa.array([r[n] for r in out], t) for n, t in kinds]
                done = pa.RecordBatch.from_arrays([*cols, *body], [*keep, *result.fieldNames()])
                at.clear()
                out.clear()
                return done

            for i, d in enumerate(docs):
                if d is None:
                    continue
                for row in rows(as_bytes(d), *[o[i] for o in others]):
                    at.append(i)
                    out.append(row)
                    if len(out) >= BATCH:
                        yield flush()
            if out:
                yield flush()

    chosen = df.select(*keep, F.col(doc).alias("_doc"), *[F.col(e).alias(f"_x{i}") for i, e in enumerate(extra)])
    return chosen.mapInArrow(run, T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], *result.fields]))


def errors_column(errors: list[dict], kind: pa.DataType) -> pa.Array:
    """An error column; rows without an error share one value."""
    n, ok = len(errors), ok_row()
    if all(e is ok for e in errors):
        return pa.repeat(pa.scalar(ok, kind), n)
    return pa.array(errors, kind)


def candidates(df: DataFrame, doc: str, keep: list[str] = (), framing_mode: str = framing.AUTO, limits: Limits | None = None, payload: bool = True, max_items: int | None = None, max_payload_bytes: int | None = None) -> DataFrame:
    """index, stream_offset, byte_size, payload, error of each JSON value of a byte stream."""
    value = (limits or Limits()).value
    return expand(df, doc, list(keep), CANDIDATE, lambda d: framing.candidates(d, framing_mode, value, payload, max_items, max_payload_bytes))


def _with_record(base: T.StructType, schema) -> tuple[T.StructType, Schema]:
    s = Schema.of(schema)
    return T.StructType([*[f for f in base.fields if f.name != "error"], T.StructField("record", s.plain()), T.StructField("error", ERROR)]), s


def object_stream(df: DataFrame, doc: str, schema, keep: list[str] = (), limits: Limits | None = None, max_items: int | None = None) -> DataFrame:
    """seq, stream_offset, record, error of concatenated root objects."""
    result, s = _with_record(struct_type(seq="bigint", stream_offset="bigint", error=ERROR), schema)
    decoder = Decoder(s, limits)
    return expand(df, doc, list(keep), result, lambda d: framing.objects(d, decoder, max_items))


def array_items(df: DataFrame, doc: str, selector: str = "", keep: list[str] = (), schema=None, limits: Limits | None = None, strings_only: bool = False, max_items: int | None = None) -> DataFrame:
    """index, value (or record, with a schema), error of the items of one array."""
    limits = limits or Limits()
    value = limits.value
    whole = not strings_only and max_items is None and not set(selector or "") & set(".[")
    if schema is None:
        pick = lambda r: {k: r[k] for k in ("index", "value", "error")}
        return expand(df, doc, list(keep), ITEM, lambda d: map(pick, framing.array_items(d, selector, None, value, max_items, strings_only)), at_once=(lambda d: many.item_rows(d, selector, None, limits)) if whole else None)
    result, s = _with_record(struct_type(index="bigint", error=ERROR), schema)
    decoder = Decoder(s, limits)
    return expand(df, doc, list(keep), result, lambda d: ({k: r[k] for k in ("index", "record", "error")} for r in framing.array_items(d, selector, decoder, value, max_items)), at_once=(lambda d: many.item_rows(d, selector, s, limits)) if whole and many.plain_schema(s.fields) else None)


def json_events(df: DataFrame, doc: str, keep: list[str] = (), with_path: bool = True, limits: Limits | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """seq, event, depth, text, path, error of each structural event."""
    value = (limits or Limits()).value
    return expand(df, doc, list(keep), EVENT, lambda d: framing.events(d, with_path, value, only), at_once=lambda d: many.event_rows(d, value, with_path, only, False))


def json_leaves(df: DataFrame, doc: str, keep: list[str] = (), limits: Limits | None = None) -> DataFrame:
    """seq, path, type, text, error of each scalar."""
    value = (limits or Limits()).value
    return expand(df, doc, list(keep), LEAF, lambda d: framing.leaves(d, value), at_once=leaf_rows(value))


def leaf_rows(value) -> Callable:
    def rows(docs):
        ok, at, (seq, kind, _, text, path) = many.event_rows(docs, value, True, framing.SCALAR_EVENTS, True)
        return ok, at, [seq, path, kind, text]

    return rows


def sse_events(df: DataFrame, doc: str, keep: list[str] = (), limits: Limits | None = None) -> DataFrame:
    """seq, event, id, data, data_len, retry_ms, has_retry, has_data, late_event (its name came
    after its data), error of each event."""
    sse = (limits or Limits()).sse
    return expand(df, doc, list(keep), SSE, lambda d: framing.sse_events(d, sse))


def sse_json(df: DataFrame, doc: str, keep: list[str] = (), schema=None, event_names: list[str] | None = None, limits: Limits | None = None) -> DataFrame:
    """Events whose data is JSON, decoded by a schema or as canonical text; metadata-only events
    are passed over. event_names: an allow-list, "" for unnamed events; under one, an event
    whose name comes after its data is an invalid argument."""
    from ..functions.columns import canonical_json, decode

    sse = sse_events(df, doc, keep, limits)
    chosen = sse.where((F.col("error.code") != "ok") | F.col("has_data"))
    if event_names is not None:
        late = F.col("error").withField("code", F.lit(INVALID_ARGUMENT)).withField("message", F.lit("an event's name came after its data"))
        chosen = chosen.withColumn("error", F.when(F.col("late_event"), late).otherwise(F.col("error")))
        chosen = chosen.where((F.col("error.code") != "ok") | F.col("event").isin(list(event_names)))
    got = decode("data", schema, limits) if schema is not None else canonical_json("data", "reescape", limits)
    value = "value" if schema is not None else "text"
    chosen = chosen.withColumn("_got", got)
    bad = F.col("error.code") != "ok"
    return chosen.select(*keep, "seq", "event", "id", F.when(~bad, F.col(f"_got.{value}")).alias("record"), F.when(bad, F.col("error")).otherwise(F.col("_got.error")).alias("error"))


def multipart_parts(df: DataFrame, body: str, content_type: str, keep: list[str] = (), limits: Limits | None = None) -> DataFrame:
    """seq, name, content_type, content_length, headers, body, error of each part."""
    lim = (limits or Limits()).multipart
    return expand(df, body, list(keep), PART, lambda d, t: framing.multipart_parts(d, t or "", lim), (content_type,))


def chunks(df: DataFrame, doc: str, size: int, keep: list[str] = ()) -> DataFrame:
    """chunk_no, bytes, eof: a text in pieces of at most `size` bytes."""
    if size <= 0:
        raise JsonError(INVALID_ARGUMENT, "chunk size must be positive")
    return expand(df, doc, list(keep), CHUNK, lambda d: framing.chunked(d, size))


def _distinct(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each distinct tuple of values, the number of each row's tuple)."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    return first, which


def row_lists(result: T.StructType, rows: Callable[..., Iterator[dict]], at_once: Callable | None = None):
    """An Arrow UDF: the list of the rows that rows(document bytes, *other arguments) yields (null
    documents: an empty one). Equal arguments are read once in a piece of a batch; lists leave a piece at a
    time. at_once(*other arguments): a function of many documents as in expand, or None."""
    kind = arrow_type(T.ArrayType(result))
    row = kind.value_type
    error_at = row.get_field_index("error")

    def piece(docs: pa.Array, others: list[pa.Array]) -> pa.Array:
        values = [o.to_pylist() for o in others]
        done, at, left = [], [], range(len(docs))
        together = at_once(*[v[0] for v in values]) if at_once and all(v.count(v[0]) == len(v) for v in values) else None
        if together:
            ok, whose, columns = together(docs)
            columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, row)]
            columns.insert(error_at, errors_column([ok_row()] * len(whose), row[error_at].type))
            done.append(pa.StructArray.from_arrays(columns, fields=list(row)))
            at.append(np.asarray(whose, np.int64))
            left = np.flatnonzero(~ok).tolist()
        out, whose = [], []
        for i in left:
            d = docs[i].as_py()
            if d is not None:
                n = len(out)
                out.extend(rows(as_bytes(d), *[v[i] for v in values]))
                whose.extend([i] * (len(out) - n))
        columns = [errors_column([r["error"] for r in out], f.type) if f.name == "error" else pa.array([r[f.name] for r in out], f.type) for f in row]
        done.append(pa.StructArray.from_arrays(columns, fields=list(row)))
        at.append(np.array(whose, np.int64))
        at = np.concatenate(at)
        offsets = np.zeros(len(docs) + 1, np.int32)
        np.cumsum(np.bincount(at, minlength=len(docs)), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(done).take(pa.array(np.argsort(at, kind="stable"))), type=kind)

    def run(batches):
        for batch in batches:
            docs, *others = batch if isinstance(batch, (tuple, list)) else (batch,)
            docs = many.binary(docs)
            for first, end in many.parts(many.lengths_of(docs)):
                columns = [c.slice(first, end - first) for c in (docs, *others)]
                one, which = _distinct(columns)
                columns = [c.take(pa.array(one)) for c in columns]
                yield piece(columns[0], columns[1:]).take(pa.array(which))

    run.__annotations__ = {}  # strings here, which the UDF's type inference can't read
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        return F.arrow_udf(run, T.ArrayType(result), PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)


def register(spark: SparkSession, limits: Limits | None = None) -> None:
    """Table functions for SQL: json_candidates(doc, framing), json_items(doc, selector),
    json_events(doc), json_leaves(doc), sse_events(doc), multipart_parts(body, content_type),
    text_chunks(doc, size); to be used with LATERAL. Each is a SQL function over an Arrow function
    docloom_<name> that gives a document's rows as a list."""
    lim = limits or Limits()

    def items(selector):
        return (lambda d: many.item_rows(d, selector, None, lim)) if selector is not None and not set(selector) & set(".[") else None

    for name, more, result, rows, at_once in (
        ("json_candidates", "framing STRING DEFAULT 'auto'", CANDIDATE, lambda d, mode: framing.candidates(d, mode, lim.value), None),
        ("json_items", "selector STRING DEFAULT ''", ITEM, lambda d, selector: framing.array_items(d, selector, None, lim.value), items),
        ("json_events", "", EVENT, lambda d: framing.events(d, True, lim.value), lambda: lambda d: many.event_rows(d, lim.value, True, None, False)),
        ("json_leaves", "", LEAF, lambda d: framing.leaves(d, lim.value), lambda: leaf_rows(lim.value)),
        ("sse_events", "", SSE, lambda d: framing.sse_events(d, lim.sse), None),
        ("multipart_parts", "content_type STRING", PART, lambda d, t: framing.multipart_parts(d, t or "", lim.multipart), None),
        ("text_chunks", "size BIGINT", CHUNK, lambda d, n: framing.chunked(d, int(n)), None),
    ):
        spark.udf.register(f"docloom_{name}", row_lists(result, rows, at_once))
        parameters = ", ".join(p for p in ("doc BINARY", more) if p)
        arguments = ", ".join(p.split()[0] for p in parameters.split(", "))
        table = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.fields)
        columns = ", ".join(f"r.`{n}`" for n in result.fieldNames())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({table}) RETURN SELECT {columns} FROM (SELECT explode(docloom_{name}({arguments})) AS r)")

"""Column functions: Catalyst expressions where these have the semantics, Arrow UDFs where not.

Results of fallible functions are structs of the value and an `error` (code "ok" on success),
so that one bad document never fails a query."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import batch as many
from ..limits import INTERNAL_ERROR, INVALID_ARGUMENT, STATUSES, JsonError, Limits, ok_row
from ..records import Decoder, Encoder
from ..records import encode_any as any_text
from ..rewriting import Raw, Rule, parse_array_selector, parse_path
from ..rewriting import array_rewrite as rewrite_array
from ..rewriting import value_rewrite as rewrite_value
from ..schema import Schema
from ..strict import as_bytes, canonical, pretty, quote, type_of, validate

_NAMED = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "decimal(20,0)": T.DecimalType(20, 0), "array<string>": T.ArrayType(T.StringType()),
}


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def struct_type(**fields) -> T.StructType:
    """A struct of named types or type objects (workers import this, so no JVM may be asked)."""
    return T.StructType([T.StructField(k, _NAMED[v] if isinstance(v, str) else v) for k, v in fields.items()])


ERROR = struct_type(code="string", line="bigint", column="bigint", offset="bigint", truncated="boolean", message="string")


def arrow_type(t: T.DataType) -> pa.DataType:
    return to_arrow_type(t)


def strings(a: pa.Array):
    """The bytes of each value of a string or binary column (None for null)."""
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
        a = a.cast(pa.binary() if pa.types.is_string(a.type) else pa.large_binary())
    return a.to_pylist()


def _bracketed(docs: pa.Array, most: int) -> np.ndarray:
    """Rows of texts with more opening brackets than that."""
    count = pc.add(pc.count_substring(docs, "["), pc.count_substring(docs, "{"))
    return np.flatnonzero(pc.fill_null(pc.greater(count, most), False).to_numpy(zero_copy_only=False))


def row_udf(result: T.DataType, one: Callable, together: Callable | None = None, most: int = 0):
    """An Arrow UDF that applies `one` to each row: bytes of the first column (never None: a
    null document gives a null result), Python values of the others. together, for a struct of a value and an
    error: a function of many documents with more than `most` opening brackets, which C readers leave to the
    tokenizer (accepted ones, values of all); `one` reads what it does not accept."""
    kind = arrow_type(result)

    def at_once(docs: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The rows that are accepted and their results."""
        docs = docs.take(pa.array(rows))
        accepted, values = [], []
        for first, end in many.parts(many.lengths_of(docs)):
            ok, column = together(docs.slice(first, end - first))
            accepted.append(ok)
            values.append((column if column.type == kind[0].type else column.cast(kind[0].type)).filter(pa.array(ok)))
        value, ok = pa.concat_arrays(values), np.concatenate(accepted)
        return rows[ok], pa.StructArray.from_arrays([value, pa.repeat(pa.scalar(ok_row(), kind[1].type), len(value))], fields=list(kind))

    def run(*columns: pa.Array) -> pa.Array:
        if together:
            raw = many.binary(columns[0])
            rows = _bracketed(raw, most)
            if len(rows):
                rows, done = at_once(raw, rows)
                others = np.delete(np.arange(len(raw)), rows)
                rest = pa.array([None if (d := raw[i].as_py()) is None else one(d) for i in others.tolist()], kind)
                return pa.concat_arrays([done, rest]).take(pa.array(np.argsort(np.concatenate([rows, others]), kind="stable")))
        docs, *rest = [strings(columns[0]), *[c.to_pylist() for c in columns[1:]]]
        return pa.array([None if d is None else one(as_bytes(d), *r) for d, *r in zip(docs, *rest)], kind)

    run.__annotations__ = {}  # strings here, which the UDF's type inference can't read
    return F.arrow_udf(run, result)


def fallible(one: Callable, value: str) -> Callable:
    """{value, error} of a function that may raise JsonError."""

    def safe(*args) -> dict:
        try:
            return {value: one(*args), "error": ok_row()}
        except JsonError as e:
            e.data = e.data or args[0]
            return {value: None, "error": e.row()}
        except RecursionError:
            return {value: None, "error": JsonError(INTERNAL_ERROR, "nesting is too deep to process").row()}

    return safe


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


# --- whole documents --------------------------------------------------------------------


def validate_json(c, limits: Limits | None = None) -> Column:
    """struct<valid, error>: exactly one value of any kind."""
    value_limits = (limits or Limits()).value

    def one(data: bytes) -> dict:
        try:
            validate(data, value_limits)
            return {"valid": True, "error": ok_row()}
        except JsonError as e:
            return {"valid": False, "error": e.row()}

    def together(docs: pa.Array):
        ok = many.Tokens(docs, value_limits).ok
        return ok, pa.array(ok)

    return row_udf(struct_type(valid="boolean", error=ERROR), one, together, value_limits.max_depth)(col_of(c))


def canonical_json(c, mode: str = "preserve_escapes", limits: Limits | None = None) -> Column:
    """struct<text, error>: compact text; mode preserve_escapes keeps string tokens, reescape
    writes them anew under the value limits."""
    if mode not in ("preserve_escapes", "reescape"):
        raise JsonError(INVALID_ARGUMENT, f"unknown mode {mode}")
    value_limits = (limits or Limits()).value
    return row_udf(struct_type(text="string", error=ERROR), fallible(lambda d: _text(canonical(d, mode, value_limits)), "text"))(col_of(c))


def pretty_json(c, reescape: bool = False) -> Column:
    """struct<text, error>: two-space indent."""
    return row_udf(struct_type(text="string", error=ERROR), fallible(lambda d: _text(pretty(d, reescape)), "text"))(col_of(c))


def json_typeof(c) -> Column:
    """object, array, string, number, bool or null; SQL NULL if it is not one JSON value."""

    def one(data: bytes):
        try:
            validate(data)
            return type_of(data)
        except JsonError:
            return None

    return row_udf(T.StringType(), one)(col_of(c))


def json_quote(c) -> Column:
    """A JSON string token of a string column: printable ASCII without escapes as it is, else Spark's
    own writer, with control characters that it writes in upper case done character by character
    (those texts only)."""
    c = col_of(c).cast("string")
    clean = c.rlike("^[ !#-\\[\\]-~]*\\z")
    whole = F.to_json(F.struct(c.alias("v")))
    easy = F.substring(whole, F.lit(6), F.char_length(whole) - 6)
    odd = F.array_join(F.transform(F.split(c, ""), _quote_char), "")
    hard = F.concat(F.lit('"'), odd, F.lit('"'))
    return F.when(c.isNull(), F.lit("null")).when(clean, F.concat(F.lit('"'), c, F.lit('"'))).when(c.rlike("[\\x0b\\x0e\\x0f\\x1a-\\x1f]"), hard).otherwise(easy)


def _quote_char(ch: Column) -> Column:
    out = F.when(ch == '"', F.lit('\\"')).when(ch == "\\", F.lit("\\\\"))
    for raw, text in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = out.when(ch == raw, F.lit(text))
    return out.when(ch.rlike("^[\\x00-\\x1f]$"), F.concat(F.lit("\\u00"), F.lpad(F.lower(F.hex(F.ascii(ch))), 2, "0"))).otherwise(ch)


def f64_text(c) -> Column:
    """17 significant digits, shortest exponent form; NULL for numbers that are not finite."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None or v != v or v in (float("inf"), float("-inf")) else f"{v:.17g}" for v in x.to_pylist()], pa.string())

    run.__annotations__ = {}
    return F.arrow_udf(run, T.StringType())(col_of(c).cast("double"))


def measure(c) -> Column:
    """Bytes of a text in UTF-8."""
    return F.octet_length(col_of(c)).cast("long")


def status_code(c) -> Column:
    """The number of a status name."""
    return F.element_at(F.create_map(*[x for i, s in enumerate(STATUSES) for x in (F.lit(s), F.lit(i))]), col_of(c))


# --- strict scalars (Catalyst only) -----------------------------------------------------


def parse_i64(c) -> Column:
    """A JSON integer token in range, else NULL."""
    c = col_of(c)
    return F.when(c.rlike(r"^-?(?:0|[1-9][0-9]*)\z"), c.try_cast("bigint"))


def parse_u64(c) -> Column:
    """An unsigned JSON integer token up to 2^64 - 1 as decimal(20,0), else NULL."""
    c = col_of(c)
    v = F.when(c.rlike(r"^(?:0|[1-9][0-9]{0,19})\z"), c.try_cast("decimal(20,0)"))
    return F.when(v <= F.lit("18446744073709551615").cast("decimal(20,0)"), v)


def parse_f64(c) -> Column:
    """A JSON number token whose double is finite, else NULL."""
    c = col_of(c)
    v = F.when(c.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"), c.try_cast("double"))
    return F.when((F.abs(v) < float("inf")), v)


def decode_base64(c) -> Column:
    """Strict base64: padded groups of four, no white space; else NULL."""
    c = col_of(c)
    return F.when(c.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"), F.try_to_binary(c, F.lit("base64")))


def truncate_bytes(c, most: int) -> Column:
    """At most so many bytes of UTF-8, cut at a character's border."""
    c = col_of(c)
    head = F.substring(F.encode(c, "UTF-8"), F.lit(1), F.lit(most))
    # drop the bytes of a character that the cut has split
    tail = [F.hex(F.substring(head, F.lit(-k), F.lit(1))) for k in (1, 2, 3)]
    is_tail = [t.rlike("^[89AB]") for t in tail]
    lead = lambda t, n: t.rlike({2: "^[CD]", 3: "^E", 4: "^F"}[n])
    cut = (
        F.when(tail[0].rlike("^[CDEF]"), 1)
        .when(is_tail[0] & (lead(tail[1], 3) | lead(tail[1], 4)), 2)
        .when(is_tail[0] & is_tail[1] & lead(tail[2], 4), 3)
        .otherwise(0)
    )
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(head, F.lit(1), (F.octet_length(head) - cut).cast("int")), "UTF-8"))


# --- record fields (Catalyst only) ------------------------------------------------------


def status_name(c) -> Column:
    """The name of a status number."""
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), col_of(c) + 1)


def _outcome(value: Column, bad: Column, cut: Column, message: str) -> Column:
    none = F.lit(None).cast("bigint")
    error = F.struct(
        F.when(bad, F.lit("overflow")).otherwise(F.lit("ok")).alias("code"), none.alias("line"), none.alias("column"), none.alias("offset"),
        F.coalesce(cut, F.lit(False)).alias("truncated"), F.when(bad, F.lit(message)).alias("message"),
    )
    return F.struct(F.when(~F.coalesce(bad, F.lit(False)), value).alias("value"), error.alias("error"))


def assign_string(c, max_bytes: int, overflow: str = "fail") -> Column:
    """struct<value, error> of a string put into a field of fixed capacity."""
    c = col_of(c)
    over = F.octet_length(c) > max_bytes
    return _outcome(truncate_bytes(c, max_bytes), over if overflow == "fail" else F.lit(False), over if overflow == "truncate" else F.lit(False), "string is longer than its capacity")


def append_item(array, value, max_items: int | None = None, overflow: str = "fail") -> Column:
    """struct<value, error> of an array (NULL: empty) with an item appended under a capacity."""
    array, value = col_of(array), col_of(value)
    grown = F.coalesce(F.array_append(array, value), F.array(value))
    if max_items is None:
        return _outcome(grown, F.lit(False), F.lit(False), "")
    over = F.size(grown) > max_items
    return _outcome(F.when(over, array).otherwise(grown), over if overflow == "fail" else F.lit(False), over if overflow == "truncate" else F.lit(False), "array is longer than its capacity")


def present_keys(c) -> Column:
    """Root keys of a valid object document: the presence mask for merge_record."""
    return F.json_object_keys(col_of(c).cast("string"))


def spilled(c, memory_limit: int = 64 << 10) -> Column:
    """Whether a text or bytes value is larger than a spool keeps in memory."""
    return F.octet_length(col_of(c)) > memory_limit


# --- records ----------------------------------------------------------------------------


def decode(c, schema, limits: Limits | None = None, fields: list[str] | None = None, into=None) -> Column:
    """struct<value, error> of a document decoded by a schema. fields prunes the schema: other
    keys are only checked for syntax. into: a struct column whose values stay where the
    document has no key (arrays that are present replace)."""
    s = Schema.of(schema)
    if fields:
        s = s.only(*fields)
    decoder = Decoder(s, limits)

    def one(data: bytes, base=None) -> dict:
        try:
            record, truncated = decoder.decode(data, base)
            return {"value": record, "error": ok_row(truncated)}
        except JsonError as e:
            return {"value": None, "error": e.row()}

    lim = limits or Limits()

    def together(docs: pa.Array):
        tokens = many.Tokens(docs, lim.value, min(lim.max_depth, lim.value.max_depth))
        roots = np.flatnonzero((tokens.depth == 0) & tokens.is_value())
        at = np.full(len(docs), -1, np.int64)
        at[tokens.doc[roots]] = np.arange(len(roots))
        records = tokens.records(roots, s, lim)
        return tokens.ok, records.take(pa.array(at, mask=at < 0))

    plain = into is None and many.plain_schema(s.fields)
    udf = row_udf(struct_type(value=s.plain(), error=ERROR), one, together if plain else None, lim.max_depth)
    return udf(col_of(c), col_of(into)) if into is not None else udf(col_of(c))


def merge_record(old, new, present, schema) -> Column:
    """Fields of `new` whose name is in the array `present`, others of `old` (Catalyst only)."""
    old, new, present = col_of(old), col_of(new), col_of(present)
    names = [f.name for f in Schema.of(schema).fields]
    return F.struct(*[F.when(F.array_contains(present, n), new[n]).otherwise(old[n]).alias(n) for n in names])


_NATIVE = frozenset("i64 u64 bool string text_stream text_source bytes_stream bytes_source i64_array u64_array bool_array string_array".split())


def _native(s: Schema) -> bool:
    """Whether Spark's own expressions encode a schema byte for byte."""
    return all(_native(Schema(f.fields)) and not f.omit if f.kind in ("object", "object_array") else f.kind in _NATIVE and not (f.omit and f.kind.endswith("_array")) for f in s.fields)


def _native_value(f, v: Column) -> Column:
    if f.kind in ("i64", "u64"):
        return F.coalesce(v.cast("string"), F.lit("0"))
    if f.kind == "bool":
        return F.coalesce(v.cast("string"), F.lit("false"))
    if f.kind in ("bytes_stream", "bytes_source"):
        b64 = F.regexp_replace(F.base64(v), "[\\r\\n]", "")
        return F.when(v.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), b64, F.lit('"')))
    if f.kind == "object":
        return F.when(v.isNull(), F.lit("null")).otherwise(_native_object(f.fields, v))
    if f.kind.endswith("_array"):
        item = f.item
        return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(v, lambda x: _native_value(item, x)), ","), F.lit("")), F.lit("]"))
    return json_quote(v)


def _native_object(fields, record: Column) -> Column:
    members = []
    for f in fields:
        v = record[f.name]
        text = F.concat(F.lit(_text(quote(f.name.encode())) + ":"), _native_value(f, v))
        gone = v.isNull() if f.presence or f.omit == "null" else (v.isNull() | (F.octet_length(v) == 0)) if f.omit == "empty" else None
        members.append(text if gone is None else F.when(~gone, text))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def encode(record, schema, limits: Limits | None = None, pretty: bool = False, native: bool | None = None) -> Column:
    """struct<text, error> of a struct column. Schemas of integers, booleans, strings and bytes
    stay inside the JVM; doubles, arbitrary values, nested omit rules and pretty output need
    the Arrow UDF."""
    s, limits = Schema.of(schema), limits or Limits()
    record = col_of(record)
    if native is None:
        native = not pretty and _native(s)
    if native:
        whole = F.when(record.isNotNull(), _native_object(s.fields, record))
        none = F.lit(None)

        def checked(text: Column) -> Column:
            big = F.octet_length(text) > limits.max_output_bytes
            error = F.struct(
                F.when(big, F.lit("overflow")).otherwise(F.lit("ok")).alias("code"), none.cast("bigint").alias("line"), none.cast("bigint").alias("column"),
                none.cast("bigint").alias("offset"), F.lit(False).alias("truncated"), F.when(big, F.lit("output is larger than allowed")).alias("message"),
            )
            return F.struct(F.when(~big, text).alias("text"), error.alias("error"))

        # in a lambda, so that the text is made once
        return F.get(F.transform(F.array(whole), checked), F.lit(0))
    encoder = Encoder(s, limits, pretty)
    kind = struct_type(text="string", error=ERROR)

    def run(records: pa.Array) -> pa.Array:
        out = []
        for r in records.to_pylist():
            if r is None:
                out.append({"text": None, "error": ok_row()})
                continue
            try:
                out.append({"text": encoder.encode(r), "error": ok_row()})
            except JsonError as e:
                out.append({"text": None, "error": e.row()})
        return pa.array(out, arrow_type(kind))

    run.__annotations__ = {}
    return F.arrow_udf(run, kind)(record)


def encode_any(c) -> Column:
    """Schema-free text of any column: sorted keys, 17-digit doubles."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([any_text(v) for v in x.to_pylist()], pa.string())

    run.__annotations__ = {}
    return F.arrow_udf(run, T.StringType())(col_of(c))


def encode_buffer(record, schema, capacity: int, overflow: str = "fail", limits: Limits | None = None) -> Column:
    """struct<value, error, needed> of encoding into `capacity` bytes: needed is the whole size;
    a text beyond the capacity fails or is cut."""
    text = encode(record, schema, limits)["text"]
    put = assign_string(text, capacity, overflow)
    return F.struct(put["value"].alias("value"), put["error"].alias("error"), F.octet_length(text).cast("long").alias("needed"))


def write_json(build: Callable, *columns) -> Column:
    """struct<text, error> of documents by writer calls: build(writer, *values) for each row."""
    from ..writer import JsonWriter

    kind = struct_type(text="string", error=ERROR)

    def one(*values) -> dict:
        writer = JsonWriter()
        try:
            build(writer, *values)
            return {"text": writer.finish(), "error": ok_row()}
        except JsonError as e:
            return {"text": None, "error": e.row()}

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([one(*v) for v in zip(*(a.to_pylist() for a in arrays))], arrow_type(kind))

    run.__annotations__ = {}
    return F.arrow_udf(run, kind)(*map(col_of, columns))


# --- rewriting --------------------------------------------------------------------------


def value_rewrite(c, path, action: str = "replace", replacement=None, limits: Limits | None = None) -> Column:
    """struct<text, error>. path: a dotted selector, or a list of raw segments. replacement: a
    string column or literal of JSON text, or a Python callable old -> new."""
    return value_rewrite_many(c, [(path, action, replacement)], limits)


def value_rewrite_many(c, steps: list[tuple], limits: Limits | None = None) -> Column:
    """Several (path, action, replacement) in one pass over the column."""
    value_limits = (limits or Limits()).value
    plan, columns = [], []
    for path, action, replacement in steps:
        segments = parse_path(path) if path is None or isinstance(path, str) else list(path)
        if action == "drop" and not segments:
            raise JsonError(INVALID_ARGUMENT, "the root can't be dropped")
        if isinstance(replacement, Column):
            plan.append((segments, action, len(columns), None))
            columns.append(replacement.cast("string"))
        else:
            plan.append((segments, action, None, replacement if callable(replacement) or replacement is None else Raw(replacement)))

    def one(data: bytes, *given) -> str:
        for segments, action, at, fixed in plan:
            new = fixed if at is None else Raw("null" if given[at] is None else given[at])
            data = rewrite_value(data, segments, action, new, value_limits)
        return _text(data)

    return row_udf(struct_type(text="string", error=ERROR), fallible(one, "text"))(col_of(c), *columns)


def array_rewrite(c, selector: str, rules: list[Rule] | Callable = (), append=None, item_schema=None, limits: Limits | None = None) -> Column:
    """struct<text, error> with the items of the selected arrays kept, dropped, replaced or
    joined by others."""
    parse_array_selector(selector)
    schema = Schema.of(item_schema) if item_schema is not None else None
    decoder = Decoder(schema, limits) if schema else None
    result = struct_type(text="string", error=ERROR)
    one = fallible(lambda d: _text(rewrite_array(d, selector, rules, append, schema, limits, decoder)), "text")
    together = many.Rewriting(parse_array_selector(selector), rules, append, schema, limits or Limits())
    if not together.fit:
        return row_udf(result, one)(col_of(c))
    kind = arrow_type(result)

    def run(column: pa.Array) -> pa.Array:
        docs = many.binary(column)
        left, at, texts = np.ones(len(docs), bool), [np.empty(0, np.int64)], [pa.array([], pa.string())]
        for first, end in many.parts(many.lengths_of(docs)):
            ok, rows, made = together.rows(docs.slice(first, end - first))
            left[first:end] = ~ok
            at.append(rows + first)
            texts.append(made)
        text = pa.concat_arrays(texts)
        done = pa.StructArray.from_arrays([text, pa.repeat(pa.scalar(ok_row(), kind.field(1).type), len(text))], fields=list(kind))
        if not left.any():
            return done
        rest = np.flatnonzero(left)
        slow = pa.array([None if d is None else one(d) for d in docs.take(pa.array(rest)).to_pylist()], kind)
        return pa.concat_arrays([done, slow]).take(pa.array(np.argsort(np.concatenate([*at, rest]), kind="stable")))

    run.__annotations__ = {}
    return F.arrow_udf(run, result)(col_of(c))


# --- compiled paths ---------------------------------------------------------------------

_STEP = re.compile(r"([^.\[\]]{1,127})(?:\[([0-9]+)\])?\Z")


def _steps(path: str, record: T.StructType) -> list[tuple[str, int]]:
    """(field, 1-based item or 0) of a path like items[2].label, checked against a type."""
    out, kind = [], record
    for part in path.split("."):
        m = _STEP.match(part)
        if not m or not isinstance(kind, T.StructType) or m[1] not in kind.fieldNames():
            raise JsonError(INVALID_ARGUMENT, f"path {path}: no field {part}")
        kind, item = kind[m[1]].dataType, int(m[2] or 0)
        if item and not isinstance(kind, T.ArrayType):
            raise JsonError(INVALID_ARGUMENT, f"path {path}: {m[1]} is not an array")
        kind = kind.elementType if item else kind
        out.append((m[1], item))
    return out


def path_get(record, path: str, schema) -> Column:
    """The value at a path; NULL out of range. Unknown fields are errors at once."""
    out = col_of(record)
    for name, item in _steps(path, Schema.of(schema).struct()):
        out = out[name]
        out = F.get(out, F.lit(item - 1)) if item else out
    return out


def path_count(record, path: str, schema) -> Column:
    """Number of items of the array at a path (0 for NULL)."""
    return F.greatest(F.size(path_get(record, path, schema)), F.lit(0)).cast("long")

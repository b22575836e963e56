"""Queries over every kind of field, capacities, presence, the writer, SQL table functions, files
and streams; registered beside those of queries.py, each with SQL for the same rows."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import functions as J
from . import operators as O
from . import plans as P
from . import schema as S
from . import sources, streaming
from .limits import Limits, SpoolClass, ValueLimits
from .queries import _LINES, _order_docs, _user_streams, query, t
from .rewriting import Rule, drop


def _doc(*members: tuple[str, object]) -> F.Column:
    """JSON text by concatenation: (key, column of JSON text or null to leave the member out)."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in members]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _n(c: str) -> F.Column:
    return F.col(c).cast("string")


def _q(c: str) -> F.Column:
    return F.concat(F.lit('"'), F.col(c), F.lit('"'))


def _every(c: str, k: int, text: F.Column, otherwise=None) -> F.Column:
    """text where c is a multiple of k, else another JSON text (default: the member is left out)."""
    return F.when(F.col(c) % k == 0, text).otherwise(otherwise if otherwise is not None else F.lit(None))


# --- fields ------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS a, o_orderstatus AS r, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS f, o_orderstatus AS fr, o_orderpriority AS s, o_orderstatus AS sr FROM orders")
def string_fields(spark, d):
    """Allocated, fixed and streamed strings, each plain and required."""
    s = S.schema(S.string("a"), S.string("r", required=True), S.string("f", max_bytes=32), S.string("fr", max_bytes=8, required=True), S.spooled_text("s"), S.spooled_text("sr", required=True))
    doc = _doc(("a", _every("o_orderkey", 2, _q("o_orderpriority"), F.lit("null"))), ("r", _q("o_orderstatus")), ("f", _every("o_orderkey", 3, _q("o_orderpriority"))), ("fr", _q("o_orderstatus")), ("s", _q("o_orderpriority")), ("sr", _q("o_orderstatus")))
    return t(spark, d, "orders").select("o_orderkey", J.decode(doc, s).value.alias("v")).select("o_orderkey", "v.*")


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'missing_required_field' WHEN 1 THEN 'type_mismatch' ELSE 'ok' END AS s, CASE o_orderkey % 4 WHEN 0 THEN 'missing_required_field' WHEN 1 THEN 'type_mismatch' ELSE 'ok' END AS i, CASE o_orderkey % 4 WHEN 0 THEN 'missing_required_field' WHEN 1 THEN 'type_mismatch' ELSE 'ok' END AS u, CASE o_orderkey % 4 WHEN 0 THEN 'missing_required_field' WHEN 1 THEN 'type_mismatch' ELSE 'ok' END AS f, CASE o_orderkey % 4 WHEN 0 THEN 'missing_required_field' WHEN 1 THEN 'type_mismatch' ELSE 'ok' END AS b, CASE o_orderkey % 4 WHEN 0 THEN 'missing_required_field' WHEN 1 THEN 'type_mismatch' ELSE 'ok' END AS o, CASE o_orderkey % 4 WHEN 0 THEN 'missing_required_field' WHEN 1 THEN 'type_mismatch' ELSE 'ok' END AS t FROM orders"
)
def required_fields(spark, d):
    """Required scalars, objects and streams: missing, of another type, and there."""
    k = F.col("o_orderkey") % 4

    def status(field: S.Field, good: str, bad: str) -> F.Column:
        doc = F.when(k == 0, F.lit("{}")).when(k == 1, F.lit('{"v":%s}' % bad)).otherwise(F.lit('{"v":%s}' % good))
        return J.decode(doc, S.schema(field)).error.code

    rules = {"required": True}
    return t(spark, d, "orders").select(
        "o_orderkey", status(S.string("v", **rules), '"x"', "1").alias("s"), status(S.i64("v", **rules), "1", '"x"').alias("i"), status(S.u64("v", **rules), "1", "-1").alias("u"),
        status(S.f64("v", **rules), "1.5", "true").alias("f"), status(S.boolean("v", **rules), "true", "0").alias("b"), status(S.obj("v", S.i64("x"), **rules), '{"x":1}', "[]").alias("o"),
        status(S.spooled_text("v", **rules), '"x"', "{}").alias("t"),
    )


@query("SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS i, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey ELSE 0 END::VARCHAR AS u, l_quantity AS f, l_tax > 0 AS b FROM lineitem")
def scalar_fields(spark, d):
    """i64, u64, f64 and bool; a missing u64 is 0."""
    s = S.schema(S.i64("i"), S.u64("u"), S.f64("f"), S.boolean("b"))
    doc = _doc(("i", _n("l_linenumber")), ("u", _every("l_partkey", 2, _n("l_suppkey"))), ("f", _n("l_quantity")), ("b", (F.col("l_tax") > 0).cast("string")))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", J.decode(doc, s).value.alias("v"))
    return rows.select("l_orderkey", "l_partkey", "v.i", F.col("v.u").cast("string").alias("u"), "v.f", "v.b")


_PRESENT = "CASE WHEN o_orderkey % 3 = 0 THEN {} END"


@query(f"SELECT o_orderkey, {_PRESENT.format('o_custkey')} AS i, {_PRESENT.format('o_custkey::VARCHAR')} AS u, {_PRESENT.format('o_custkey / 2.0')}::DOUBLE AS f, {_PRESENT.format('true')} AS b, CASE WHEN o_orderkey % 3 = 2 THEN 'type_mismatch' ELSE 'ok' END AS plain FROM orders")
def presence_fields(spark, d):
    """Fields that know whether they were there: absent and (where allowed) null both give NULL; a
    field with presence alone refuses null."""
    kinds = {"i": S.i64, "u": S.u64, "f": S.f64, "b": S.boolean}
    k = F.col("o_orderkey") % 3
    values = {"i": _n("o_custkey"), "u": _n("o_custkey"), "f": (F.col("o_custkey") / 2).cast("string"), "b": F.lit("true")}
    docs = _doc(*[(n, F.when(k == 0, v).when(k == 2, F.lit("null"))) for n, v in values.items()])
    maybe = S.schema(*[f(n, presence=True, nullable=True) for n, f in kinds.items()])
    plain = S.schema(*[f(n, presence=True) for n, f in kinds.items()])
    rows = t(spark, d, "orders").select("o_orderkey", J.decode(docs, maybe).value.alias("v"), J.decode(docs, plain).error.code.alias("plain"))
    return rows.select("o_orderkey", "v.i", F.col("v.u").cast("string").alias("u"), "v.f", "v.b", "plain")


@query("SELECT o_orderkey, '{' || CASE WHEN o_orderkey % 3 = 0 THEN '\"i\":' || o_custkey || ',\"u\":' || o_custkey || ',\"b\":true' ELSE '' END || '}' AS doc FROM orders")
def presence_encoded(spark, d):
    """A presence field is written only where it is set."""
    s = S.schema(S.i64("i", presence=True), S.u64("u", presence=True, nullable=True), S.boolean("b", presence=True))
    on = F.col("o_orderkey") % 3 == 0
    row = F.struct(F.when(on, F.col("o_custkey")).alias("i"), F.when(on, F.col("o_custkey").cast("decimal(20,0)")).alias("u"), F.when(on, F.lit(True)).alias("b"))
    return t(spark, d, "orders").select("o_orderkey", J.encode(row, s).text.alias("doc"))


_BY_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag"


def _groups(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("g"))
    return li.select("l_orderkey", F.transform("g", lambda x: x["l_returnflag"]).alias("s"), F.transform("g", lambda x: x["l_partkey"]).alias("i"), F.transform("g", lambda x: x["l_suppkey"]).alias("u"))


@query(
    f"SELECT l_orderkey, array_to_string(list(l_returnflag {_BY_ORDER}), ',') AS s, array_to_string(list(l_partkey {_BY_ORDER}), ',') AS i, array_to_string(list(l_suppkey {_BY_ORDER}), ',') AS u, sum(l_partkey / 2.0)::DOUBLE AS f, count(*) FILTER (l_suppkey > 50) AS b FROM lineitem GROUP BY 1"
)
def array_fields(spark, d):
    """Arrays of strings, integers, doubles and booleans."""
    s = S.schema(S.string_array("s"), S.i64_array("i"), S.u64_array("u"), S.f64_array("f"), S.bool_array("b"))
    arr = lambda c, f: F.concat(F.lit("["), F.array_join(F.transform(c, f), ","), F.lit("]"))
    doc = _doc(
        ("s", arr("s", lambda x: F.concat(F.lit('"'), x, F.lit('"')))), ("i", arr("i", lambda x: x.cast("string"))), ("u", arr("u", lambda x: x.cast("string"))),
        ("f", arr("i", lambda x: (x / 2).cast("string"))), ("b", arr("u", lambda x: (x > 50).cast("string"))),
    )
    v = _groups(spark, d).select("l_orderkey", J.decode(doc, s).value.alias("v"))
    return v.select(
        "l_orderkey", F.array_join("v.s", ",").alias("s"), F.array_join("v.i", ",").alias("i"), F.array_join(F.transform("v.u", lambda x: x.cast("string")), ",").alias("u"),
        F.aggregate("v.f", F.lit(0.0), lambda a, x: a + x).alias("f"), F.size(F.filter("v.b", lambda x: x)).cast("long").alias("b"),
    )


@query(
    f"SELECT l_orderkey, '{{' || CASE WHEN l_orderkey % 2 = 0 THEN '\"s\":[\"' || array_to_string(list(l_returnflag {_BY_ORDER}), '\",\"') || '\"],\"i\":[' || array_to_string(list(l_partkey {_BY_ORDER}), ',') || '],\"u\":[' || array_to_string(list(l_suppkey {_BY_ORDER}), ',') || '],\"f\":[' || array_to_string(list((l_partkey % 7) / 2 {_BY_ORDER}), ',') || '],\"b\":[' || array_to_string(list(l_suppkey > 50 {_BY_ORDER}), ',') || '],\"o\":[' || array_to_string(list('{{\"p\":' || l_partkey || '}}' {_BY_ORDER}), ',') || ']' ELSE '' END || '}}' AS doc FROM lineitem GROUP BY 1".replace(
        "(l_partkey % 7) / 2", "format('{:.17g}', (l_partkey % 7) / 2.0::DOUBLE)"
    )
)
def array_omit_empty(spark, d):
    """Arrays that are left out where they are empty."""
    e = {"omit": "empty"}
    s = S.schema(S.string_array("s", **e), S.i64_array("i", **e), S.u64_array("u", **e), S.f64_array("f", **e), S.bool_array("b", **e), S.object_array("o", S.i64("p"), **e))
    on = lambda a: F.when(F.col("l_orderkey") % 2 == 0, a).otherwise(F.slice(a, 1, 0))
    row = F.struct(
        on(F.col("s")).alias("s"), on(F.col("i")).alias("i"), on(F.transform("u", lambda x: x.cast("decimal(20,0)"))).alias("u"), on(F.transform("i", lambda x: (x % 7) / 2)).alias("f"),
        on(F.transform("u", lambda x: x > 50)).alias("b"), on(F.transform("i", lambda x: F.struct(x.alias("p")))).alias("o"),
    )
    return _groups(spark, d).select("l_orderkey", J.encode(row, s).text.alias("doc"))


@query("SELECT c_custkey, c_nationkey::BIGINT AS n, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, 'missing_required_field' AS status FROM customer")
def object_fields(spark, d):
    """Nested objects, plain and required (a required member of an object counts with it)."""
    inner = [S.i64("n", required=True), S.string("name")]
    s = S.schema(S.obj("a", S.obj("b", *inner, required=True), required=True), S.obj("c", S.string("x")))
    deep = _doc(("n", _n("c_nationkey")), ("name", _every("c_custkey", 2, _q("c_name"))))
    v = J.decode(F.concat(F.lit('{"a":{"b":'), deep, F.lit("}}")), s)
    bad = J.decode(F.concat(F.lit('{"a":{"b":{"name":'), _q("c_name"), F.lit("}}}")), s)
    return t(spark, d, "customer").select("c_custkey", v.value.a.b.n.alias("n"), v.value.a.b["name"].alias("name"), bad.error.code.alias("status"))


@query("SELECT doc_id, '{' || CASE WHEN doc_id % 2 = 0 THEN '\"s\":' || to_json(lang) || ',\"x\":\"' || to_base64(encode(source)) || '\",\"q\":' || to_json(source) || ',\"p\":\"' || to_base64(encode(lang)) || '\"' ELSE '' END || '}' AS doc FROM documents")
def stream_omit_rules(spark, d):
    """Streamed and sourced text and bytes that are left out where empty or null."""
    s = S.schema(S.spooled_text("s", omit="empty"), S.spooled_bytes("x", omit="empty"), S.text_source("q", omit="null"), S.bytes_source("p", omit="null"))
    on = F.col("doc_id") % 2 == 0
    row = F.struct(F.when(on, F.col("lang")).otherwise("").alias("s"), F.when(on, F.encode("source", "UTF-8")).otherwise(F.encode(F.lit(""), "UTF-8")).alias("x"), F.when(on, F.col("source")).alias("q"), F.when(on, F.encode("lang", "UTF-8")).alias("p"))
    return t(spark, d, "documents").select("doc_id", J.encode(row, s).text.alias("doc"))


@query("SELECT doc_id, '{\"q\":' || to_json(text) || ',\"p\":\"' || to_base64(encode(lang)) || '\",\"r\":' || to_json(source) || ',\"b\":\"' || to_base64(encode(source)) || '\"}' AS doc FROM documents")
def source_fields(spark, d):
    """Values that come from a source: text and base64, plain and required."""
    s = S.schema(S.text_source("q"), S.bytes_source("p"), S.text_source("r", required=True), S.bytes_source("b", required=True))
    row = F.struct(F.col("text").alias("q"), F.encode("lang", "UTF-8").alias("p"), F.col("source").alias("r"), F.encode("source", "UTF-8").alias("b"))
    return t(spark, d, "documents").select("doc_id", J.encode(row, s).text.alias("doc"))


@query("SELECT doc_id, text AS s, CASE WHEN strlen(text) > 2000 THEN 'overflow' ELSE 'ok' END AS limited, strlen(text) > 1000 AS spilled FROM documents")
def spool_classes(spark, d):
    """Spooled fields of the default and of a named class with a limit of its own."""
    small = Limits(spool_classes=(("small", SpoolClass(1000, 2000)),))
    doc = J.encode(F.struct("text"), S.schema(S.string("text"))).text
    v = J.decode(doc, S.schema(S.spooled_text("text"))).value.text
    limited = J.decode(doc, S.schema(S.spooled_text("text", spool="small")), small).error.code
    return t(spark, d, "documents").select("doc_id", v.alias("s"), limited.alias("limited"), J.spilled("text", 1000).alias("spilled"))


@query("SELECT event_id, replace(props, ' ', '') AS v, replace(props, ' ', '') AS r, CASE WHEN event_id % 2 = 0 THEN '{\"v\":' || replace(props, ' ', '') || ',\"o\":[1,2]}' ELSE '{\"v\":' || replace(props, ' ', '') || '}' END AS doc FROM events")
def json_value_fields(spark, d):
    """Captured values: plain, required, and left out where null; written back as they are."""
    s = S.schema(S.json_value("v"), S.json_value("r", required=True), S.json_value("o", omit="null"))
    doc = F.concat(F.lit('{"v": '), F.col("props"), F.lit(' , "r":'), F.col("props"), F.when(F.col("event_id") % 2 == 0, ', "o":[1, 2]').otherwise(""), F.lit("}"))
    rows = t(spark, d, "events").select("event_id", J.decode(doc, s).value.alias("r"))
    again = J.encode(F.struct("r.v", "r.o"), S.schema(S.json_value("v"), S.json_value("o", omit="null"))).text
    return rows.select("event_id", "r.v", "r.r", again.alias("doc"))


@query(f"SELECT l_orderkey, array_to_string(list(flag ORDER BY idx), ',') AS flags, sum(line)::BIGINT AS lines, count(*) AS n FROM ({_LINES}) GROUP BY 1")
def streamed_arrays(spark, d):
    """Arrays of strings and of objects whose items are streamed, plain and required."""
    s = S.schema(S.string_items("flags", required=True), S.object_items("items", *[S.i64("line", required=True)], required=True))
    docs = _order_docs(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit('{"flags":["'), F.array_join("typed.items.flag", '","'), F.lit('"],"items":'), F.get_json_object("doc", "$.items"), F.lit("}")).alias("doc"))
    v = docs.select("l_orderkey", J.decode("doc", s).value.alias("v"))
    return v.select("l_orderkey", F.array_join("v.flags", ",").alias("flags"), F.aggregate("v.items", F.lit(0).cast("long"), lambda a, x: a + x["line"]).alias("lines"), F.size("v.items").cast("long").alias("n"))


@query(
    "SELECT p_partkey, substr(p_name, 1, 5) AS cut, CASE WHEN strlen(p_name) > 5 THEN 'overflow' ELSE 'ok' END AS fixed, strlen('{\"p_name\":' || to_json(p_name) || '}')::BIGINT AS needed, CASE WHEN strlen('{\"p_name\":' || to_json(p_name) || '}') > 20 THEN 'overflow' ELSE 'ok' END AS buffer, '{\"p_name\":' AS head FROM part"
)
def capacities(spark, d):
    """Strings and texts put into a fixed number of bytes."""
    cut, fixed = J.assign_string("p_name", 5, "truncate"), J.assign_string("p_name", 5)
    s = S.schema(S.string("p_name"))
    whole, part = J.encode_buffer(F.struct("p_name"), s, 20), J.encode_buffer(F.struct("p_name"), s, 10, "truncate")
    return t(spark, d, "part").select("p_partkey", cut["value"].alias("cut"), fixed["error"]["code"].alias("fixed"), whole["needed"].alias("needed"), whole["error"]["code"].alias("buffer"), part["value"].alias("head"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus || ',x' END AS s, o_custkey || ',7' AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'overflow' ELSE 'ok' END AS status, o_orderkey % 2 = 0 AS cut, 'true,false' AS b, '0.5' AS f, '1' AS o FROM orders"
)
def append_items(spark, d):
    """Items appended to arrays of each kind, with and without a capacity."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("array<string>")
    names = F.when(k % 3 == 0, none).otherwise(F.array("o_orderstatus"))
    two = F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    objects = J.append_item(F.lit(None).cast("array<struct<x:int>>"), F.struct(F.lit(1).alias("x")))["value"]
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return t(spark, d, "orders").select(
        "o_orderkey", join(J.append_item(names, F.lit("x"))["value"]).alias("s"), join(J.append_item(F.array("o_custkey"), F.lit(7).cast("long"))["value"]).alias("i"),
        J.append_item(two, F.lit(3), 2)["error"]["code"].alias("status"), J.append_item(two, F.lit(3), 2, "truncate")["error"]["truncated"].alias("cut"),
        join(J.append_item(F.array(F.lit(True)), F.lit(False))["value"]).alias("b"), join(J.append_item(F.lit(None).cast("array<double>"), F.lit(0.5))["value"]).alias("f"), join(F.transform(objects, lambda o: o["x"])).alias("o"),
    )


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE -1 END::BIGINT AS a, event_id AS b, CASE WHEN event_id % 2 = 0 THEN 'b,a' ELSE 'b' END AS keys FROM events")
def merge_present(spark, d):
    """decode(into=) without Python for the merge: members that are there replace."""
    s = S.schema(S.i64("a"), S.i64("b"))
    doc = _doc(("b", _n("event_id")), ("a", _every("event_id", 2, _n("user_id"))))
    old = F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-2).cast("long").alias("b"))
    rows = t(spark, d, "events").select("event_id", J.merge_record(old, J.decode(doc, s).value, J.present_keys(doc), s).alias("v"), F.array_join(J.present_keys(doc), ",").alias("keys"))
    return rows.select("event_id", "v.a", "v.b", "keys")


# --- scalars ------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS raw, (['object','array','string','number','bool','null',NULL])[(c_custkey % 7)::INTEGER + 1] AS kind FROM customer")
def scalar_functions(spark, d):
    """Numbers, base64 and the kind of a value: NULL where the token is not exact JSON."""
    k, n = F.col("c_custkey"), _n("c_acctbal")
    number = F.when(k % 4 == 0, F.concat(n, F.lit("."))).when(k % 4 == 1, F.concat(F.lit("0"), F.abs("c_acctbal").cast("string"))).otherwise(n)
    b64 = F.base64(F.encode("c_name", "UTF-8"))
    raw = F.decode(J.decode_base64(F.when(k % 2 == 0, b64).otherwise(F.concat(b64, F.lit(" ")))), "UTF-8")
    docs = ['{"a":1}', "[1]", '"s"', "-1e3", "true", " null ", "nil"]
    kind = J.json_typeof(F.element_at(F.array(*[F.lit(x) for x in docs]), (k % 7 + 1).cast("int")))
    return t(spark, d, "customer").select("c_custkey", J.parse_f64(number).alias("v"), raw.alias("raw"), kind.alias("kind"))


@query("SELECT s_suppkey, (s_suppkey % 12)::INTEGER AS code, (['ok','invalid_argument','invalid_json','type_mismatch','missing_required_field','duplicate_field','overflow','truncated','allocation_failed','callback_failed','io_error','internal_error'])[(s_suppkey % 12)::INTEGER + 1] AS name FROM supplier")
def status_names(spark, d):
    name = J.status_name((F.col("s_suppkey") % 12).cast("int"))
    return t(spark, d, "supplier").select("s_suppkey", J.status_code(name).alias("code"), name.alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'overflow' ELSE 'ok' END AS depth, CASE WHEN event_id % 3 = 1 THEN 'overflow' ELSE 'ok' END AS string, CASE WHEN event_id % 3 = 2 THEN 'overflow' ELSE 'ok' END AS number FROM events")
def value_limits(spark, d):
    """Depth, strings and numbers beyond the limits of arbitrary values."""
    doc = F.when(F.col("event_id") % 3 == 0, F.lit('{"a":[[[1]]]}')).when(F.col("event_id") % 3 == 1, F.lit('["long text"]')).otherwise(F.lit("[123456]"))
    code = lambda **x: J.validate_json(doc, Limits(value=ValueLimits(**x))).error.code
    return t(spark, d, "events").select("event_id", code(max_depth=3).alias("depth"), code(max_string_bytes=5).alias("string"), code(max_number_bytes=4).alias("number"))


# --- writer ---------------------------------------------------------------------------------


@query(
    f"SELECT l_orderkey, '{{\"id\":' || l_orderkey || ',\"items\":[' || string_agg('{{\"n\":' || line || ',\"f\":' || to_json(flag) || '}}', ',' ORDER BY idx) || '],\"x\":[1,2,{{\"k\":true}}],\"b\":\"YWJj\",\"d\":0.5,\"u\":18446744073709551615,\"z\":null,\"ok\":false,\"t\":\"one two\",\"raw\":1.50,\"v\":{{\"a\":[1,2]}},\"r\":{{\"n\":1}}}}' AS doc FROM ({_LINES}) GROUP BY 1"
)
def writer_documents(spark, d):
    """Documents by writer calls: every kind of value, chunked strings and values, spliced arrays."""

    def build(w, key, lines, flags):
        w.begin_object().key("id").i64(key).key("items").begin_array()
        for n, f in zip(lines, flags):
            w.begin_object().key("n").i64(n).key("f").string(f).end_object()
        w.end_array().key("x").begin_array().array_items('{"q":[1, 2,{"k" :true}]}', "q").end_array()
        w.key("b").base64(b"abc").key("d").f64(0.5).key("u").u64((1 << 64) - 1).key("z").null().key("ok").boolean(False)
        w.key("t").string_begin().string_chunk("one ").string_chunk(b"two").string_end().key("raw").number_text("1.50")
        w.key("v").value_begin().value_chunk(b'{"a" :[1').value_chunk(b", 2] }").value_end()
        w.key("r").record({"n": 1}, S.schema(S.i64("n"))).end_object()

    docs = _order_docs(spark, d)
    return docs.select(F.col("o_orderkey").alias("l_orderkey"), J.write_json(build, "o_orderkey", "typed.items.line", "typed.items.flag").text.alias("doc"))


@query("SELECT r_regionkey::BIGINT AS k, (['invalid_argument','invalid_json','invalid_argument','overflow','invalid_json'])[r_regionkey + 1] AS status FROM region")
def writer_errors(spark, d):
    """Calls that the grammar of a document refuses."""

    def build(w, k):
        if k == 0:
            w.begin_object().i64(1)
        elif k == 1:
            w.begin_array().number_text("01").end_array()
        elif k == 2:
            w.begin_array()
        elif k == 3:
            w.begin_object().key("k" * 70_000)
        else:
            w.begin_array().value_begin().value_chunk("[1,").value_end()

    return t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), J.write_json(build, "r_regionkey").error.code.alias("status"))


# --- SQL table functions --------------------------------------------------------------------


@query("SELECT event_id, f, n::BIGINT AS n, value FROM (SELECT event_id, 'items' AS f, v AS n, v::VARCHAR AS value FROM events, unnest([0, 1]) AS x(v) UNION ALL SELECT event_id, 'candidates', v, '[' || v || ']' FROM events, unnest([0, 1]) AS x(v) UNION ALL SELECT event_id, 'leaves', 0, json_extract_string(props, '$.k') FROM events UNION ALL SELECT event_id, 'events', v, (['object_begin','key','number','object_end'])[v + 1] FROM events, unnest([0, 1, 2, 3]) AS x(v) UNION ALL SELECT event_id, 'sse', 0, replace(props, ' ', '') FROM events UNION ALL SELECT event_id, 'chunks', v, (['ab','c'])[v + 1] FROM events, unnest([0, 1]) AS x(v) UNION ALL SELECT event_id, 'parts', 0, 'a' FROM events)")
def table_functions(spark, d):
    """Every operator as a SQL table function."""
    O.register(spark)
    t(spark, d, "events").createOrReplaceTempView("docloom_events")
    body = "concat('--q\\r\\nContent-Disposition: form-data; name=a\\r\\n\\r\\nx\\r\\n--q--\\r\\n')"
    return spark.sql(
        f"""SELECT event_id, 'items' AS f, x.index AS n, x.value FROM docloom_events, LATERAL json_items('{{"a":[0, 1]}}', 'a') x
        UNION ALL SELECT event_id, 'candidates', x.index, x.payload FROM docloom_events, LATERAL json_candidates('[0] [1]', 'ndjson') x
        UNION ALL SELECT event_id, 'leaves', x.seq, x.text FROM docloom_events, LATERAL json_leaves(props) x
        UNION ALL SELECT event_id, 'events', x.seq, x.event FROM docloom_events, LATERAL json_events(props) x
        UNION ALL SELECT event_id, 'sse', x.seq, replace(x.data, ' ', '') FROM docloom_events, LATERAL sse_events(concat('data: ', props, '\\n\\n')) x
        UNION ALL SELECT event_id, 'chunks', x.chunk_no, decode(x.bytes, 'UTF-8') FROM docloom_events, LATERAL text_chunks('abc', 2) x
        UNION ALL SELECT event_id, 'parts', x.seq, x.name FROM docloom_events, LATERAL multipart_parts({body}, 'multipart/form-data; boundary=q') x"""
    )


# --- files ----------------------------------------------------------------------------------


def _written(df: DataFrame, text: str) -> str:
    """One document a line, in files of a new folder."""
    path = sources.scratch(df.sparkSession)
    sources.write_text(df, text, path)
    return path


@query("SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def file_objects(spark, d):
    """Files of concatenated objects."""
    s = S.schema(S.i64("c", required=True), S.i64("k"))
    path = _written(t(spark, d, "orders").select(_doc(("c", _n("o_custkey")), ("k", _n("o_orderkey"))).alias("doc")).repartition(3), "doc")
    rows = sources.read_objects(spark, path, s)
    return rows.groupBy(F.col("record.c").alias("o_custkey")).agg(F.count("*").alias("n"), F.sum("record.k").alias("keys"))


@query("SELECT event_type, count(*) AS n, sum(strlen(replace(props, ' ', '')))::BIGINT AS bytes FROM events GROUP BY 1")
def file_candidates(spark, d):
    """Files of values on lines."""
    path = _written(t(spark, d, "events").select(F.concat(F.lit('["'), "event_type", F.lit('", '), "props", F.lit("]")).alias("doc")).repartition(2), "doc")
    rows = sources.read_candidates(spark, path, "ndjson").where("error.code = 'ok'")
    return rows.groupBy(F.get_json_object("payload", "$[0]").alias("event_type")).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.get_json_object("payload", "$[1]"))).cast("long").alias("bytes"))


@query("SELECT user_id, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def file_items(spark, d):
    """One array in each of many files; each file is validated, decoded and visited whole as well."""
    user = F.coalesce(_n("user_id"), F.lit("null"))
    docs = _user_streams(spark, d, ", ", "[{}]").select(F.concat(user, F.lit(".json")).alias("name"), F.concat(F.lit('{"user":'), user, F.lit(', "rows":'), "doc", F.lit("}")).alias("doc"))
    path = sources.scratch(spark)
    sources.write_files(docs, "name", F.encode("doc", "UTF-8"), path)
    files = sources.read_documents(spark, path)
    items = sources.read_items(spark, files, "rows", S.schema(S.i64("k"))).groupBy(F.col("path").alias("file")).agg(F.sum("record.k").alias("k"))
    user_id = J.decode("content", S.schema(S.i64("user"))).value.user
    whole = files.select(F.col("path").alias("file"), J.validate_json("content").valid.alias("valid"), user_id.alias("user_id"), "content")
    leaves = O.json_leaves(whole, "content", ["file", "valid", "user_id"]).where("valid").groupBy("file", "user_id").agg((F.count("*") - 1).alias("n"))
    return items.join(leaves, "file").select("user_id", "n", "k")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def file_jsonl(spark, d):
    """Records to lines in files and back."""
    s = S.schema(S.i64("c_custkey", required=True), S.string("c_name"), S.string("c_mktsegment"))
    path = sources.scratch(spark)
    sources.write_jsonl(t(spark, d, "customer"), F.struct(*[f.name for f in s.fields]), s, path, max_records=200)
    return sources.read_jsonl(spark, path).select(J.decode("doc", s).value.alias("v")).select("v.*")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def file_jsonl_pretty(spark, d):
    """Pretty records in files: concatenated objects over several lines."""
    s = S.schema(S.i64("id", required=True), S.string("name"))
    path = sources.scratch(spark)
    rows = t(spark, d, "nation").select(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).alias("r"))
    sources.write_jsonl(rows, "r", s, path, pretty=True)
    return sources.read_objects(spark, path, s).select("record.*")


@query(f"SELECT l_orderkey, idx, line, flag FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx) - 1 AS idx, line, flag FROM ({_LINES}) WHERE flag <> 'R')")
def file_array_rewrite(spark, d):
    """Items dropped from the array of each document, file to file; files keep their names."""
    docs = _order_docs(spark, d)
    s = S.schema(S.i64("line"), S.string("flag"))
    path, out = sources.scratch(spark), sources.scratch(spark)
    docs.select(F.concat(F.lit('{"id":'), _n("o_orderkey"), F.lit(',"items":'), F.get_json_object("doc", "$.items"), F.lit("}")).alias("value")).write.text(path)
    sources.rewrite_lines(spark, path, out, lambda c: J.array_rewrite(c, "items", [Rule(drop(), {"flag": "R"})]))
    rows = sources.read_jsonl(spark, out).select(J.decode("doc", S.schema(S.i64("id", required=True), S.object_array("items", *s.fields))).value.alias("v"))
    return rows.select(F.col("v.id").alias("l_orderkey"), F.posexplode("v.items").alias("idx", "i")).select("l_orderkey", F.col("idx").cast("long").alias("idx"), "i.line", "i.flag")


@query("SELECT s_suppkey::VARCHAR AS name, '{\"k\":' || s_suppkey || ',\"n\":' || to_json(s_name) || ',\"new\":7}' AS doc FROM supplier")
def file_rewrite_named(spark, d):
    """One value of each file set, file to file: same names, bytes without anything added."""
    path, out = sources.scratch(spark), sources.scratch(spark)
    docs = t(spark, d, "supplier").select(F.concat(_n("s_suppkey"), F.lit(".json")).alias("name"), _doc(("k", _n("s_suppkey")), ("n", _q("s_name"))).alias("doc"))
    sources.write_files(docs, "name", F.encode("doc", "UTF-8"), path)
    sources.rewrite_files(spark, path, out, lambda c: J.value_rewrite(c, "new", "replace", "7"))
    rows = sources.read_documents(spark, out)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), F.decode("content", "UTF-8").alias("doc"))


# --- streams --------------------------------------------------------------------------------


def _streamed(df: DataFrame, operator) -> DataFrame:
    """A table as a stream, run once through a streaming operator to its end."""
    spark = df.sparkSession
    source, target = sources.scratch(spark), sources.scratch(spark)
    df.write.parquet(source)
    stream = operator(spark.readStream.schema(df.schema).parquet(source))
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", sources.scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _chunked(docs: DataFrame, key: str, size: int) -> DataFrame:
    """key, no, chunk, last: the documents' bytes in pieces."""
    pieces = O.chunks(docs, "doc", size, [key])
    return pieces.select(key, F.col("chunk_no").alias("no"), F.col("bytes").alias("chunk"), F.col("eof").alias("last"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS record FROM events")
def push_object_stream(spark, d):
    """Concatenated objects in chunks of 7 bytes, parsed as they arrive."""
    docs = _chunked(_user_streams(spark, d, " "), "user_id", 7)
    return _streamed(docs, lambda s: streaming.push_objects(s, "user_id", "chunk", "no", S.schema(S.i64("k")), "last")).select("user_id", "seq", "record")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, replace(props, ' ', '') AS value FROM events")
def push_array_items(spark, d):
    """The items of one array in chunks of 11 bytes."""
    docs = _chunked(_user_streams(spark, d, ", ", '{"a" : 1, "rows":[{}], "z":null}'), "user_id", 11)
    return _streamed(docs, lambda s: streaming.push_items(s, "user_id", "chunk", "no", "rows", "last")).select("user_id", "seq", "value")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS record FROM events")
def push_array_records(spark, d):
    """The items of one array in chunks, decoded by a schema."""
    docs = _chunked(_user_streams(spark, d, ", ", '{"rows":[{}]}'), "user_id", 13)
    return _streamed(docs, lambda s: streaming.push_items(s, "user_id", "chunk", "no", "rows", "last", schema=S.schema(S.i64("k", required=True)))).select("user_id", "seq", F.col("value").alias("record"))


def _types(spark, d) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit('{"t":["'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), '","'), F.lit('"]}')).alias("doc"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS value FROM events")
def push_string_items(spark, d):
    """String items of one array, decoded, each whole."""
    return _streamed(_chunked(_types(spark, d), "user_id", 5), lambda s: streaming.push_items(s, "user_id", "chunk", "no", "t", "last", mode="strings")).select("user_id", "seq", "value")


@query("SELECT user_id, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS item FROM events")
def push_string_chunks(spark, d):
    """String items of one array in pieces as they arrive, put together again."""
    rows = _streamed(_chunked(_types(spark, d), "user_id", 5), lambda s: streaming.push_string_chunks(s, "user_id", "chunk", "no", "t", "last"))
    whole = rows.groupBy("user_id", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "").alias("value"))
    return whole.select("user_id", "value", "item")


@query("SELECT user_id, event_id::VARCHAR AS id, replace(props, ' ', '') AS data FROM events")
def push_sse_stream(spark, d):
    one = F.concat(F.lit("id:"), F.col("event_id").cast("string"), F.lit("\r\ndata:"), F.replace("props", F.lit(" "), F.lit("")), F.lit("\r\n\r\n"))
    docs = t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("doc"))
    return _streamed(_chunked(docs, "user_id", 17), lambda s: streaming.push_sse(s, "user_id", "chunk", "no", "last")).select("user_id", "id", "data")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::BIGINT AS seq, turn::VARCHAR AS name, coalesce(text, '') AS body FROM conversations")
def push_multipart_stream(spark, d):
    """Multipart bodies in chunks of 50 bytes."""
    part = F.concat(F.lit("--b\r\nContent-Disposition: form-data; name="), _n("turn"), F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("\r\n\r\n"), F.coalesce("text", F.lit("")), F.lit("\r\n"))
    docs = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", part.alias("p")))).alias("g"))
    docs = docs.select("conv_id", F.concat(F.array_join(F.transform("g", lambda x: x["p"]), ""), F.lit("--b--\r\n")).alias("doc"))
    rows = _streamed(_chunked(docs, "conv_id", 50), lambda s: streaming.push_multipart(s, "conv_id", "chunk", "no", "b", "last"))
    return rows.select("conv_id", "seq", "name", F.decode("body", "UTF-8").alias("body"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Hourly windows under a watermark over decoded documents; the last ones close behind a late mark."""
    e = t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "props")
    end = e.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select("ts", F.lit("end").alias("event_type"), F.lit('{"k":0}').alias("props"))
    rows = e.unionByName(end)

    def windows(s: DataFrame) -> DataFrame:
        s = s.select("ts", "event_type", J.decode("props", S.schema(S.i64("k"))).value.k.alias("k")).withWatermark("ts", "1 hour")
        g = s.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
        return g.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "n", "k")

    return _streamed(rows, windows).where("event_type != 'end'")


# --- relational work around documents -------------------------------------------------------


@query("SELECT event_type, event_id, k FROM (SELECT event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY event_type ORDER BY CAST(json_extract_string(props, '$.k') AS BIGINT) DESC, event_id) AS r FROM events) WHERE r <= 5")
def top_values(spark, d):
    """Top five of decoded values by type (the limit is the feature)."""
    e = t(spark, d, "events").select("event_type", "event_id", J.decode("props", S.schema(S.i64("k"))).value.k.alias("k"))
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("k"), "event_id"))
    return e.withColumn("r", r).where("r <= 5").drop("r")


@query("SELECT user_id, 'both' AS side FROM (SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT user_id, 'only' FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_operations(spark, d):
    """Keys read from documents against keys of a table: intersect, except, union."""
    doc = _doc(("user", _n("user_id")))
    users = t(spark, d, "events").select(J.decode(doc, S.schema(S.i64("user"))).value.user.alias("user_id"))
    rich = t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    return users.intersect(rich).withColumn("side", F.lit("both")).union(users.subtract(rich).withColumn("side", F.lit("only")))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (strftime(o_orderdate, '%Y-%m'), o_orderstatus)")
def rollup_dates(spark, d):
    """Dates carried as text in documents, grouped by month and status with subtotals."""
    s = S.schema(S.string("at"), S.string("status"))
    doc = J.encode(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.col("o_orderstatus").alias("status")), s).text
    v = t(spark, d, "orders").select(J.decode(doc, s).value.alias("v")).select(F.date_format(F.to_date("v.at"), "yyyy-MM").alias("month"), "v.status")
    return v.rollup("month", "status").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1, 2")
def map_aggregates(spark, d):
    """Maps built from decoded members and taken apart again."""
    e = t(spark, d, "events").select("event_type", "user_id", J.decode("props", S.schema(S.i64("k"))).value.k.alias("k"))
    g = e.groupBy("event_type", "user_id").agg(F.sum("k").alias("k"))
    m = g.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("user_id", "k"))).alias("m"))
    return m.select("event_type", F.explode("m").alias("user_id", "k"))


@query("SELECT c_custkey, CASE WHEN n > 0 THEN 'semi' ELSE 'anti' END AS side, n FROM (SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1)")
def semi_anti_joins(spark, d):
    """Customers with and without documents, and how many."""
    e = t(spark, d, "events").where(J.validate_json("props").valid).select(F.col("user_id").alias("c_custkey"))
    c = t(spark, d, "customer").select("c_custkey")
    n = e.groupBy("c_custkey").agg(F.count("*").alias("n"))
    semi = c.join(e, "c_custkey", "left_semi").join(n, "c_custkey").select("c_custkey", F.lit("semi").alias("side"), "n")
    return semi.union(c.join(e, "c_custkey", "left_anti").select("c_custkey", F.lit("anti").alias("side"), F.lit(0).cast("long").alias("n")))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, '[' || n_nationkey || ',\"a\",' || (n_nationkey + 1) || ']' AS spliced, to_json(n_name || '-' || n_name)::VARCHAR AS text FROM nation")
def assemble_parts(spark, d):
    """Array texts spliced, and one string from ordered chunks."""
    n = t(spark, d, "nation")
    k = F.col("n_nationkey")
    rows = n.select("n_nationkey", P.splice(F.concat(F.lit("["), k.cast("string"), F.lit(',"a"]')), F.lit("[]"), F.concat(F.lit("["), (k + 1).cast("string"), F.lit("]"))).alias("spliced"), F.explode(F.array(F.struct(F.lit(1).alias("o"), F.col("n_name").alias("c")), F.struct(F.lit(0).alias("o"), F.concat("n_name", F.lit("-")).alias("c")))).alias("x"))
    return rows.groupBy("n_nationkey", "spliced").agg(P.concat_string("x.o", "x.c").alias("text")).select(k.cast("long").alias("n_nationkey"), "spliced", "text")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, '{\"id\":' || n_nationkey || ',\"meta\":{\"name\":' || to_json(n_name) || '}}' AS doc FROM nation")
def typed_paths(spark, d):
    """Members of typed documents set and dropped without Python."""
    row = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.struct(F.col("n_regionkey").cast("long").alias("region"), F.lit("x").alias("name")).alias("meta"))
    r = t(spark, d, "nation").select("n_nationkey", P.drop_path(P.set_path(row, "meta.name", F.col("n_name")), "meta.region").alias("r"))
    s = S.schema(S.i64("id"), S.obj("meta", S.string("name")))
    return r.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), J.encode("r", s).text.alias("doc"))


@query("SELECT s_suppkey, '{\"id\":' || s_suppkey || ',\"tags\":[1,2],\"z\":' || s_nationkey || '}' AS doc, s_nationkey::BIGINT AS z FROM supplier")
def replaced_values(spark, d):
    """Values replaced by literals, columns and functions at paths of raw segments."""
    doc = _doc(("id", _n("s_suppkey")), ("tags", F.lit("[0]")), ("z", F.lit("1")))
    new = J.value_rewrite_many(doc, [(["tags"], "replace", "[1, 2]"), ("z", "replace", _n("s_nationkey"))]).text
    return t(spark, d, "supplier").select("s_suppkey", new.alias("doc"), J.decode(new, S.schema(S.i64("z"))).value.z.alias("z"))



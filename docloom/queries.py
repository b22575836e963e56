"""The document operators as queries over the driver's tables, each with SQL that computes the
same rows relationally. JSON texts are built by the engine's own encoders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as J
from . import operators as O
from . import plans as P
from . import schema as S
from .limits import Limits
from .rewriting import Rule, drop, insert_after, replace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


PROPS = S.schema(S.i64("k", required=True))
CUSTOMER = S.schema(S.i64("c_custkey", required=True), S.string("c_name"), S.i64("c_nationkey"), S.f64("c_acctbal"), S.string("c_mktsegment"))
ITEM = S.schema(S.i64("line", required=True), S.i64("part"), S.string("flag"))
ORDER = S.schema(S.i64("id", required=True), S.string("status"), S.object_array("items", *ITEM.fields))


# --- decoding and encoding --------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY 1")
def decode_events(spark, d):
    rows = t(spark, d, "events").select("event_type", J.decode("props", PROPS).value.k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def encode_roundtrip(spark, d):
    doc = J.encode(F.struct(*[f.name for f in CUSTOMER.fields]), CUSTOMER).text
    return t(spark, d, "customer").select(J.decode(doc, CUSTOMER).value.alias("v")).select("v.*")


@query("SELECT c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":' || to_json(c_name) || ',\"c_mktsegment\":' || to_json(c_mktsegment) || '}' AS doc FROM customer")
def encode_native(spark, d):
    s = CUSTOMER.only("c_custkey", "c_name", "c_mktsegment")
    return t(spark, d, "customer").select("c_custkey", J.encode(F.struct("c_custkey", "c_name", "c_mktsegment"), s).text.alias("doc"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, '{' || chr(10) || '  \"id\": ' || n_nationkey || ',' || chr(10) || '  \"name\": ' || to_json(n_name) || chr(10) || '}' AS doc FROM nation")
def encode_pretty(spark, d):
    s = S.schema(S.i64("id"), S.string("name"))
    row = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), J.encode(row, s, pretty=True).text.alias("doc"))


@query("SELECT c_custkey, '{\"id\":' || c_custkey || ',\"name\":' || to_json(c_name) || ',\"nation\":' || c_nationkey || '}' AS doc FROM customer")
def encode_sorted_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey", J.encode_any(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))).alias("doc"))


@query("SELECT o_orderkey, '{\"id\":' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',\"note\":' || to_json(o_orderstatus) END || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',\"cust\":' || o_custkey END || '}' AS doc FROM orders")
def encode_omit_rules(spark, d):
    s = S.schema(S.i64("id", required=True), S.string("note", omit="empty"), S.i64("cust", presence=True, nullable=True), S.obj("child", S.string("x", omit="null"), omit="empty"))
    k = F.col("o_orderkey")
    row = F.struct(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("note"), F.when(k % 4 != 0, F.col("o_custkey")).alias("cust"), F.struct(F.lit(None).cast("string").alias("x")).alias("child"))
    return t(spark, d, "orders").select("o_orderkey", J.encode(row, s).text.alias("doc"))


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'invalid_json' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1")
def validate_mixed(spark, d):
    doc = F.concat("props", F.when(F.col("event_id") % 7 == 0, " x").otherwise(" \n"))
    return t(spark, d, "events").select(J.validate_json(doc).error.code.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN length(props) + 2 END::BIGINT AS at FROM events")
def validate_position(spark, d):
    doc = F.concat("props", F.when(F.col("event_id") % 7 == 0, " x").otherwise(""))
    return t(spark, d, "events").select("event_id", J.validate_json(doc).error.offset.alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing_required_field' ELSE 'ok' END AS status FROM events")
def required_missing(spark, d):
    doc = F.when(F.col("event_id") % 5 == 0, F.regexp_replace("props", '"k"', '"q"')).otherwise(F.col("props"))
    return t(spark, d, "events").select("event_id", J.decode(doc, PROPS).error.code.alias("status"))


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'duplicate_field' ELSE 'ok' END AS strict_status, CASE WHEN event_id % 3 = 0 THEN event_id ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS last_k FROM events"
)
def duplicate_policy(spark, d):
    again = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(',"k":'), F.col("event_id").cast("string"), F.lit("}"))
    doc = F.when(F.col("event_id") % 3 == 0, again).otherwise(F.col("props"))
    loose = Limits(reject_duplicate_keys=False)
    return t(spark, d, "events").select("event_id", J.decode(doc, PROPS).error.code.alias("strict_status"), J.decode(doc, PROPS, loose).value.k.alias("last_k"))


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'type_mismatch' ELSE 'ok' END AS plain_status, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"
)
def nullable_presence(spark, d):
    doc = F.when(F.col("event_id") % 4 == 0, F.lit('{"k":null}')).otherwise(F.col("props"))
    maybe = S.schema(S.i64("k", presence=True, nullable=True))
    return t(spark, d, "events").select("event_id", J.decode(doc, PROPS).error.code.alias("plain_status"), J.decode(doc, maybe).value.k.alias("k"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'type_mismatch' WHEN 2 THEN 'type_mismatch' ELSE 'ok' END AS i64_status, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 3 THEN -o_orderkey END AS v, CASE WHEN o_orderkey % 4 = 0 THEN 'ok' ELSE 'type_mismatch' END AS u64_status FROM orders"
)
def strict_integers(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    token = F.when(k % 4 == 1, F.concat(n, F.lit(".0"))).when(k % 4 == 2, F.concat(n, F.lit("e2"))).when(k % 4 == 3, F.concat(F.lit("-"), n)).otherwise(n)
    doc = F.concat(F.lit('{"v":'), token, F.lit("}"))
    signed, unsigned = J.decode(doc, S.schema(S.i64("v"))), J.decode(doc, S.schema(S.u64("v")))
    return t(spark, d, "orders").select("o_orderkey", signed.error.code.alias("i64_status"), signed.value.v.alias("v"), unsigned.error.code.alias("u64_status"))


@query(
    "SELECT s.n::BIGINT AS n, s.i AS as_i64, s.u AS as_u64 FROM (VALUES (1, 9223372036854775807, '9223372036854775807'), (2, NULL, '9223372036854775808'), (3, NULL, '18446744073709551615'), (4, NULL, NULL), (5, -9223372036854775808, NULL), (6, NULL, NULL), (7, 0, NULL), (8, NULL, NULL)) s(n, i, u)"
)
def integer_bounds(spark, d):
    tokens = ["9223372036854775807", "9223372036854775808", "18446744073709551615", "18446744073709551616", "-9223372036854775808", "01", "-0", "+1"]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(tokens)], "n long, x string")
    return df.select("n", J.parse_i64("x").alias("as_i64"), J.parse_u64("x").cast("string").alias("as_u64"))


@query("SELECT p_partkey, CASE WHEN strlen(p_name) > 7 THEN 'overflow' ELSE 'ok' END AS fail_status, substr(p_name, 1, 7) AS cut, strlen(p_name) > 7 AS truncated FROM part")
def fixed_capacity(spark, d):
    doc = J.encode(F.struct("p_name"), S.schema(S.string("p_name"))).text
    fail_, cut = (J.decode(doc, S.schema(S.string("p_name", max_bytes=7, overflow=o))) for o in ("fail", "truncate"))
    return t(spark, d, "part").select("p_partkey", fail_.error.code.alias("fail_status"), cut.value.p_name.alias("cut"), cut.error.truncated.alias("truncated"))


@query("SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 51), lambda n: strlen(substr(text, 1, n::INTEGER)) <= 50))::INTEGER) AS cut FROM documents")
def truncate_bytes(spark, d):
    return t(spark, d, "documents").select("doc_id", J.truncate_bytes("text", 50).alias("cut"))


@query("SELECT doc_id, sha256(text) AS sha, strlen(text)::BIGINT AS n_bytes FROM documents")
def base64_field(spark, d):
    s = S.schema(S.spooled_bytes("b"))
    doc = J.encode(F.struct(F.encode("text", "UTF-8").alias("b")), s).text
    v = J.decode(doc, s).value.b
    return t(spark, d, "documents").select("doc_id", F.sha2(v, 256).alias("sha"), F.octet_length(v).cast("long").alias("n_bytes"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE -1 END::BIGINT AS a, event_id AS b FROM events")
def decode_into(spark, d):
    s = S.schema(S.i64("a"), S.i64("b"))
    doc = F.concat(F.lit('{"b":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"a":'), F.col("user_id").cast("string"))).otherwise(""), F.lit("}"))
    old = F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-2).cast("long").alias("b"))
    return t(spark, d, "events").select("event_id", J.decode(doc, s, into=old).value.alias("v")).select("event_id", "v.a", "v.b")


# --- text forms -------------------------------------------------------------------------


@query("SELECT event_id, replace(props, ' ', '') AS doc FROM events")
def canonical_text(spark, d):
    doc = F.concat(F.lit(" \n"), F.regexp_replace("props", ":", " \t: "), F.lit("\r\n"))
    return t(spark, d, "events").select("event_id", J.canonical_json(doc).text.alias("doc"))


@query("SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS doc FROM events")
def pretty_text(spark, d):
    return t(spark, d, "events").select("event_id", J.pretty_json("props").text.alias("doc"))


@query("SELECT page_id, to_json(html)::VARCHAR AS quoted FROM pages")
def quote_pages(spark, d):
    return t(spark, d, "pages").select("page_id", J.json_quote("html").alias("quoted"))


@query("SELECT c_custkey, format('{:.17g}', c_acctbal) AS text FROM customer")
def f64_text(spark, d):
    return t(spark, d, "customer").select("c_custkey", J.f64_text("c_acctbal").alias("text"))


@query("SELECT c_custkey, strlen('{\"c_custkey\":' || c_custkey || ',\"c_name\":' || to_json(c_name) || ',\"c_mktsegment\":' || to_json(c_mktsegment) || '}')::BIGINT AS n_bytes FROM customer")
def measure(spark, d):
    return encode_native(spark, d).select("c_custkey", J.measure("doc").alias("n_bytes"))


@query("SELECT doc_id, (strlen(text) + 999) // 1000 AS n_chunks, strlen(text)::BIGINT AS n_bytes FROM documents WHERE strlen(text) > 0")
def text_chunks(spark, d):
    rows = O.chunks(t(spark, d, "documents"), "text", 1000, ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("bytes")).alias("n_bytes"))


# --- streams of values ------------------------------------------------------------------


def _order_docs(spark, d) -> DataFrame:
    """(o_orderkey, doc): each order with its line items."""
    li = t(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("sup")).alias("i"))
    li = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items"))
    o = t(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    items = F.transform("items", lambda i: F.struct(i["line"].alias("line"), i["part"].alias("part"), i["flag"].alias("flag")))
    row, typed = (F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), x.alias("items")) for x in (F.col("items"), items))
    return o.select("o_orderkey", J.encode(row, ORDER).text.alias("doc"), typed.alias("typed"))


_SORTED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_suppkey)"
_LINES = f"SELECT l_orderkey, {_SORTED} - 1 AS idx, l_linenumber::BIGINT AS line, l_partkey AS part, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, o_orderkey AS id, o_orderstatus AS status FROM orders")
def object_stream(spark, d):
    s = S.schema(S.i64("id", required=True), S.string("status"))
    doc = J.encode(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), s).text
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", doc.alias("one"))
    o = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "one"))), lambda x: x["one"]), "").alias("doc"))
    return O.object_stream(o, "doc", s, ["o_custkey"]).select("o_custkey", "seq", "record.id", "record.status")


def _user_streams(spark, d, sep: str, around: str = "{}") -> DataFrame:
    e = t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), sep).alias("doc"))
    a, b = around.split("{}")
    return e.select("user_id", F.concat(F.lit(a), "doc", F.lit(b)).alias("doc"))


_CANDIDATES = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, (coalesce(sum(strlen(props) + {sep}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {lead})::BIGINT AS at, strlen(props)::BIGINT AS n, replace(props, ' ', '') AS payload FROM events"


@query(_CANDIDATES.format(sep=1, lead=0))
def candidates_ndjson(spark, d):
    return O.candidates(_user_streams(spark, d, "\n"), "doc", ["user_id"], "ndjson").select("user_id", F.col("index").alias("idx"), F.col("stream_offset").alias("at"), F.col("byte_size").alias("n"), "payload")


@query(_CANDIDATES.format(sep=2, lead=2))
def candidates_array(spark, d):
    return O.candidates(_user_streams(spark, d, ", ", "[ {} ]"), "doc", ["user_id"]).select("user_id", F.col("index").alias("idx"), F.col("stream_offset").alias("at"), F.col("byte_size").alias("n"), "payload")


@query("SELECT user_id, least(count(*), 3) AS n FROM events GROUP BY 1")
def candidates_stop(spark, d):
    """The limit is the feature: the scan of each stream stops after three values."""
    return O.candidates(_user_streams(spark, d, " "), "doc", ["user_id"], max_items=3).groupBy("user_id").agg(F.count("*").alias("n"))


@query(_LINES)
def array_items(spark, d):
    return O.array_items(_order_docs(spark, d), "doc", "items", ["o_orderkey"], ITEM).select(F.col("o_orderkey").alias("l_orderkey"), F.col("index").alias("idx"), "record.*")


@query(f"SELECT l_orderkey, idx, '{{\"line\":' || line || ',\"part\":' || part || ',\"flag\":' || to_json(flag) || '}}' AS value FROM ({_LINES})")
def array_items_raw(spark, d):
    return O.array_items(_order_docs(spark, d), "doc", "items", ["o_orderkey"]).select(F.col("o_orderkey").alias("l_orderkey"), F.col("index").alias("idx"), "value")


_EVENTS = f"""WITH l AS (SELECT l_orderkey AS k, idx AS x, line::VARCHAR AS a, part::VARCHAR AS b, flag AS c FROM ({_LINES})),
n AS (SELECT k, count(*) AS n FROM l GROUP BY 1), o AS (SELECT o_orderkey AS k, o_orderstatus AS s, n FROM orders JOIN n ON k = o_orderkey)
SELECT k, seq::BIGINT AS seq, event, depth::INTEGER AS depth, text, path FROM (
SELECT k, e.seq, e.event, e.depth, e.text, e.path FROM o, unnest([
{{'seq': 0, 'event': 'object_begin', 'depth': 0, 'text': NULL, 'path': ''}}, {{'seq': 1, 'event': 'key', 'depth': 1, 'text': 'id', 'path': ''}},
{{'seq': 2, 'event': 'number', 'depth': 1, 'text': k::VARCHAR, 'path': 'id'}}, {{'seq': 3, 'event': 'key', 'depth': 1, 'text': 'status', 'path': ''}},
{{'seq': 4, 'event': 'string', 'depth': 1, 'text': s, 'path': 'status'}}, {{'seq': 5, 'event': 'key', 'depth': 1, 'text': 'items', 'path': ''}},
{{'seq': 6, 'event': 'array_begin', 'depth': 1, 'text': NULL, 'path': 'items'}}, {{'seq': 7 + 8 * n, 'event': 'array_end', 'depth': 1, 'text': NULL, 'path': 'items'}},
{{'seq': 8 + 8 * n, 'event': 'object_end', 'depth': 0, 'text': NULL, 'path': ''}}]) AS u(e)
UNION ALL SELECT k, 7 + 8 * x + e.seq, e.event, e.depth, e.text, 'items.' || x || e.path FROM l, unnest([
{{'seq': 0, 'event': 'object_begin', 'depth': 2, 'text': NULL, 'path': ''}}, {{'seq': 1, 'event': 'key', 'depth': 3, 'text': 'line', 'path': ''}},
{{'seq': 2, 'event': 'number', 'depth': 3, 'text': a, 'path': '.line'}}, {{'seq': 3, 'event': 'key', 'depth': 3, 'text': 'part', 'path': ''}},
{{'seq': 4, 'event': 'number', 'depth': 3, 'text': b, 'path': '.part'}}, {{'seq': 5, 'event': 'key', 'depth': 3, 'text': 'flag', 'path': ''}},
{{'seq': 6, 'event': 'string', 'depth': 3, 'text': c, 'path': '.flag'}}, {{'seq': 7, 'event': 'object_end', 'depth': 2, 'text': NULL, 'path': ''}}]) AS u(e))"""


@query(_EVENTS)
def json_events(spark, d):
    """Every event of every document, with depth, text and path."""
    e = O.json_events(_order_docs(spark, d), "doc", ["o_orderkey"])
    return e.select(F.col("o_orderkey").alias("k"), "seq", "event", "depth", "text", F.array_join("path", ".").alias("path"))


@query(f"SELECT l_orderkey, 'items.' || idx || '.' || f AS path, kind AS type, v AS text FROM (SELECT l_orderkey, idx, unnest(['line', 'part', 'flag']) AS f, unnest(['number', 'number', 'string']) AS kind, unnest([line::VARCHAR, part::VARCHAR, flag]) AS v FROM ({_LINES})) UNION ALL SELECT o_orderkey, unnest(['id', 'status']), unnest(['number', 'string']), unnest([o_orderkey::VARCHAR, o_orderstatus]) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def json_leaves(spark, d):
    leaves = O.json_leaves(_order_docs(spark, d), "doc", ["o_orderkey"])
    return leaves.select(F.col("o_orderkey").alias("l_orderkey"), F.array_join("path", ".").alias("path"), "type", "text")


# --- rewriting --------------------------------------------------------------------------


@query(f"SELECT l_orderkey, sum(line)::BIGINT AS lines, count(*) AS n FROM (SELECT * FROM ({_LINES}) WHERE flag <> 'R' UNION ALL SELECT o_orderkey, 0, 99, 0, 'Z' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) GROUP BY 1")
def array_rewrite_drop_append(spark, d):
    out = J.array_rewrite("doc", "items", [Rule(drop(), {"flag": "R"})], [{"line": 99, "part": 0, "flag": "Z"}], ITEM).text
    rows = O.array_items(_order_docs(spark, d).select("o_orderkey", out.alias("doc")), "doc", "items", ["o_orderkey"], ITEM)
    return rows.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.sum("record.line").alias("lines"), F.count("*").alias("n"))


_REWRITTEN = f"""SELECT l_orderkey, idx, 0 AS sub, line, CASE WHEN flag = 'N' THEN 0 ELSE part END AS part, flag FROM ({_LINES})
UNION ALL SELECT l_orderkey, idx, 1, 1000, part, 'X' FROM ({_LINES}) WHERE flag = 'A'"""


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx, sub) - 1 AS idx, line, CASE WHEN sub = 1 THEN 7 ELSE part END AS part, flag FROM ({_REWRITTEN})")
def array_rewrite_replace_insert(spark, d):
    def act(item, context):
        if item["flag"] == "N":
            return replace({**item, "part": 0})
        return insert_after({"line": 1000, "part": 7, "flag": "X"}) if item["flag"] == "A" else Rule(drop()).action if item["flag"] is None else replace(item)

    out = J.array_rewrite("doc", "items", act, None, ITEM).text
    rows = O.array_items(_order_docs(spark, d).select("o_orderkey", out.alias("doc")), "doc", "items", ["o_orderkey"], ITEM)
    return rows.select(F.col("o_orderkey").alias("l_orderkey"), F.col("index").alias("idx"), "record.*")


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx, sub) - 1 AS idx, line, CASE WHEN sub = 1 THEN 7 ELSE part END AS part, flag FROM ({_REWRITTEN})")
def array_rewrite_typed(spark, d):
    """The same on a typed document: higher-order functions only."""

    def item(i, parents):
        zero = F.struct(i["line"].alias("line"), F.lit(0).cast("long").alias("part"), i["flag"].alias("flag"))
        more = F.struct(F.lit(1000).cast("long").alias("line"), F.lit(7).cast("long").alias("part"), F.lit("X").alias("flag"))
        return F.when(i["flag"] == "N", F.array(zero)).when(i["flag"] == "A", F.array(i, more)).otherwise(F.array(i))

    docs = _order_docs(spark, d).select("o_orderkey", P.rewrite_items("typed", "items", item).alias("v"))
    rows = docs.select("o_orderkey", F.posexplode("v.items").alias("idx", "i"))
    return rows.select(F.col("o_orderkey").alias("l_orderkey"), F.col("idx").cast("long").alias("idx"), "i.*")


@query(
    "SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' AND l_returnflag = 'R' THEN NULL ELSE l_linenumber END::BIGINT AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT (o_orderstatus = 'F' AND l_returnflag = 'R')"
)
def array_rewrite_fanout(spark, d):
    """orders[].items of one document per customer; items go only where the parent's status is F."""
    docs = _order_docs(spark, d).join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    docs = docs.groupBy("o_custkey").agg(F.concat(F.lit('{"orders":'), P.array_of("o_orderkey", "doc"), F.lit("}")).alias("doc"))
    out = J.array_rewrite("doc", "orders[].items", [Rule(drop(), {"flag": "R"}, {"status": "F"})]).text
    orders = O.array_items(docs.select("o_custkey", out.alias("doc")), "doc", "orders", ["o_custkey"], ORDER)
    return orders.select("o_custkey", F.col("record.id").alias("o_orderkey"), F.explode("record.items").alias("i")).select("o_custkey", "o_orderkey", "i.line")


@query(
    "SELECT event_id, '{\"k\":' || (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) || ',\"meta\":{\"request\":{\"id\":' || user_id || '}}}' AS grown, '{}' AS dropped, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'type_mismatch' END AS drop_status FROM events"
)
def value_rewrite(spark, d):
    grown = J.value_rewrite_many("props", [("k", "replace", lambda old: old + 1), ("meta.request.id", "replace", F.col("user_id").cast("string"))])
    dropped = J.value_rewrite("props", "k", "drop")
    status = J.value_rewrite(F.concat(F.lit('{"i":['), F.when(F.col("event_id") % 2 == 0, "1,2").otherwise("1"), F.lit("]}")), "i.1", "drop")
    return t(spark, d, "events").select("event_id", grown.text.alias("grown"), dropped.text.alias("dropped"), status.error.code.alias("drop_status"))


# --- protocols --------------------------------------------------------------------------


def _sse_docs(spark, d) -> DataFrame:
    c = t(spark, d, "conversations")
    data = F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n|\r", "\ndata: ")
    one = F.concat(F.lit("event: "), "role", F.lit("\nid: "), F.col("turn").cast("string"), F.lit("\nretry: 1500\ndata: "), data, F.lit("\n\n"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", one.alias("e")))), lambda x: x["e"]), ": keep-alive\n").alias("doc"))


@query("SELECT conv_id, turn::VARCHAR AS id, role AS event, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS data, 1500::BIGINT AS retry FROM conversations")
def sse_events(spark, d):
    e = O.sse_events(_sse_docs(spark, d), "doc", ["conv_id"])
    return e.select("conv_id", "id", "event", "data", F.col("retry_ms").cast("long").alias("retry"))


@query("SELECT user_id, event_id::VARCHAR AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view')")
def sse_json(spark, d):
    one = F.concat(F.lit("event:"), "event_type", F.lit("\r\nid:"), F.col("event_id").cast("string"), F.lit("\r\ndata:"), "props", F.lit("\r\n\r\n"))
    docs = t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("doc"))
    return O.sse_json(docs, "doc", ["user_id"], PROPS, ["click", "view"]).select("user_id", "id", F.col("record.k").alias("k"))


@query("SELECT doc_id, 'meta' AS name, to_json(source)::VARCHAR AS body, -1::BIGINT AS declared FROM documents UNION ALL SELECT doc_id, 'text', text, strlen(text)::BIGINT FROM documents")
def multipart_parts(spark, d):
    head = F.concat(F.lit('--b0\r\nContent-Disposition: form-data; name="meta"\r\nContent-Type: application/json\r\n\r\n'), J.json_quote("source"), F.lit("\r\n--b0\r\nContent-Disposition: form-data; name=text\r\nContent-Length: "))
    body = F.concat(head, F.octet_length("text").cast("string"), F.lit("\r\n\r\n"), "text", F.lit("\r\n--b0--\r\n"))
    docs = t(spark, d, "documents").select("doc_id", body.alias("body"), F.lit('multipart/form-data; boundary="b0"').alias("kind"))
    parts = O.multipart_parts(docs.withColumnRenamed("body", "raw"), "raw", "kind", ["doc_id"])
    return parts.select("doc_id", "name", F.decode("body", "UTF-8").alias("body"), F.col("content_length").alias("declared"))


# --- assembling and relational work around documents ------------------------------------


@query(
    "SELECT r_regionkey::BIGINT AS r_regionkey, '{\"name\":' || to_json(r_name) || ',\"nations\":[' || string_agg('{\"id\":' || n_nationkey || ',\"name\":' || to_json(n_name) || '}', ',' ORDER BY n_nationkey) || ']}' AS doc FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"
)
def assemble_tree(spark, d):
    n = t(spark, d, "nation").select("n_regionkey", "n_nationkey", P.object_of(id=F.col("n_nationkey").cast("string"), name=J.json_quote("n_name")).alias("one"))
    n = n.groupBy("n_regionkey").agg(P.array_of("n_nationkey", "one").alias("nations"))
    r = t(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), P.object_of(name=J.json_quote("r_name"), nations="nations").alias("doc"))


@query("SELECT user_id, sum(strlen(replace(props, ' ', '')) + 1)::BIGINT AS n_bytes, count(*) AS n FROM events GROUP BY 1")
def jsonl_bytes(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", J.canonical_json("props").text.alias("doc"))
    g = e.groupBy("user_id").agg(P.jsonl("event_id", "doc").alias("lines"), F.count("*").alias("n"))
    return g.select("user_id", F.octet_length("lines").cast("long").alias("n_bytes"), "n")


@query(f"SELECT l_orderkey, count(*) AS n_items, max(CASE WHEN idx = 1 THEN part END) AS second_part FROM ({_LINES}) GROUP BY 1")
def compiled_paths(spark, d):
    v = J.decode("doc", ORDER).value
    rows = _order_docs(spark, d).select("o_orderkey", v.alias("v"))
    return rows.select(F.col("o_orderkey").alias("l_orderkey"), J.path_count("v", "items", ORDER).alias("n_items"), J.path_get("v", "items[2].part", ORDER).alias("second_part"))


@query(
    "SELECT c_mktsegment, event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k, rank() OVER (PARTITION BY c_mktsegment ORDER BY sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) DESC) AS place FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2"
)
def relational_on_documents(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", J.decode("props", PROPS).value.k.alias("k"))
    g = e.join(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("user_id") == F.col("c_custkey")).groupBy("c_mktsegment", "event_type").agg(F.sum("k").alias("sum_k"))
    return g.withColumn("place", F.rank().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("sum_k"))).cast("long"))

import http.server
import threading
from unittest import mock

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import batch, framing
from docloom import functions as J
from docloom import operators as O
from docloom import plans as P
from docloom import schema as S
from docloom import sources
from docloom.engine import Engine
from docloom.limits import JsonError, Limits, ValueLimits
from docloom.records import Decoder
from docloom.streaming import push_items, push_objects, push_sse
from docloom.strict import validate

ITEM = S.schema(S.i64("id", required=True), S.string("label"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, '{"id":1,"label":"xé","q":[1,2]}'), (2, '{"id":1.0}'), (3, None), (4, "[1,2"), (5, '{"id":1,"id":2}'), (6, "")]
    return spark.createDataFrame(rows, "k long, doc string")


def by_key(df):
    return {r.k: r for r in df.collect()}


def test_column_functions(docs):
    got = by_key(docs.select("k", J.validate_json("doc").alias("v"), J.decode("doc", ITEM).alias("d"), J.json_typeof("doc").alias("t"), J.canonical_json("doc", "reescape").text.alias("c")))
    assert [got[k].v and got[k].v.valid for k in range(1, 7)] == [True, True, None, False, True, False]
    assert got[1].d.value.label == "xé" and got[2].d.error.code == "type_mismatch" and got[5].d.error.code == "duplicate_field"
    assert [got[k].t for k in range(1, 7)] == ["object", "object", None, None, "object", None]
    assert got[5].c == '{"id":1,"id":2}' and got[3].c is None


def test_native_encoder_equals_the_udf(spark):
    s = S.schema(S.i64("id"), S.string("s"), S.string("e", omit="empty"), S.boolean("b", presence=True), S.spooled_bytes("y"), S.i64_array("a"), S.obj("o", S.string("x")))
    rows = [(1, 'a\x1f\x01"\\/é\n\x0b\x7f', "", True, b"\x00\xff" * 60, [1, 2], ("q",)), (2, None, None, None, None, None, None), (3, "", "z", False, b"", [], (None,))]
    df = spark.createDataFrame(rows, "id long, s string, e string, b boolean, y binary, a array<long>, o struct<x:string>")
    row = F.struct("id", "s", "e", "b", "y", "a", "o")
    for r in df.select(J.encode(row, s, native=True).alias("n"), J.encode(row, s, native=False).alias("p")).collect():
        assert r.n == r.p
    plan = df.select(J.encode(row, s).text)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_strict_scalars(spark):
    one = spark.range(1).select(
        J.truncate_bytes(F.lit("aé漢😀"), 2).alias("a"), J.truncate_bytes(F.lit("aé漢😀"), 5).alias("b"), J.truncate_bytes(F.lit("aé漢😀"), 9).alias("c"), J.truncate_bytes(F.lit("aé漢😀"), 10).alias("d"),
        J.parse_u64(F.lit("18446744073709551616")).alias("u"), J.parse_i64(F.lit("1\n")).alias("i"), J.parse_f64(F.lit("1e400")).alias("f"), J.decode_base64(F.lit("QU I=")).alias("x"), J.decode_base64(F.lit("QUI=")).alias("y"), J.status_code(F.lit("overflow")).alias("s"),
    ).first()
    assert tuple(one[:4]) == ("a", "aé", "aé漢", "aé漢😀") and tuple(one[4:8]) == (None,) * 4 and bytes(one.y) == b"AB" and one.s == 6


def test_record_fields(spark):
    df = spark.createDataFrame([([1, 2], "aé", '{"b":1}'), (None, "a", "{}")], "l array<long>, s string, doc string")
    rows = df.select(
        J.append_item("l", F.lit(3), 2).alias("fail"), J.append_item("l", F.lit(3), 2, "truncate").alias("cut"), J.append_item("l", F.lit(3)).value.alias("free"), J.assign_string("s", 2, "truncate").alias("s"),
        J.assign_string("s", 2).error.code.alias("sf"), J.present_keys("doc").alias("keys"), J.spilled("s", 1).alias("big"), J.status_name(F.lit(5)).alias("name"),
        J.encode_buffer(F.struct("s"), S.schema(S.string("s")), 5, "truncate").alias("buf"),
        J.merge_record(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(9).alias("b")), J.present_keys("doc"), S.schema(S.i64("a"), S.i64("b"))).alias("merged"),
    ).collect()
    a, b = rows
    assert a.fail.error.code == "overflow" and a.fail.value is None and (a.cut.value, a.cut.error.truncated) == ([1, 2], True) and a.free == [1, 2, 3]
    assert b.fail.value == b.free == [3] and (a.s.value, a.s.error.truncated, a.sf, a.keys, a.big, a.name) == ("a", True, "overflow", ["b"], True, "duplicate_field")
    assert a.buf.needed == 11 and a.buf.value == '{"s":' and a.buf.error.truncated and tuple(a.merged) == (1, 9) and tuple(b.merged) == (1, 2)


def test_table_operators(docs, spark):
    rows = O.candidates(docs, "doc", ["k"]).orderBy("k", "index").collect()
    assert [(r.k, r["index"], r.error.code) for r in rows] == [(1, 0, "ok"), (2, 0, "ok"), (4, 0, "ok"), (4, 1, "invalid_json"), (5, 0, "ok")]
    with pytest.raises(JsonError):
        O.candidates(docs.withColumnRenamed("k", "index"), "doc", ["index"])
    O.register(spark)
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("select array_join(l.path, '.') p, l.text from some_docs, lateral json_leaves(doc) l where k = 1").collect()
    assert sorted(tuple(r) for r in got) == [("id", "1"), ("label", "xé"), ("q.0", "1"), ("q.1", "2")]
    assert spark.sql("select count(*) from lateral json_candidates('1 2 3')").first()[0] == 3

def test_table_functions_many_documents_at_once(spark):
    """Equal to the row generators on odd documents, through Arrow, with rows of a piece at a time."""
    texts = ['{"a":[1,{"b":"x"}],"k":2}', '{"a":["\\\\u00e9"]}', '{"a":[1, 2', "", "[]", None, '{"a":7}', '{"a":[1],"a":[2]}', "[" * 70, '{"a":[true]} x', '{"é":null}', '{"a":[1,{"b":"x"}],"k":2}']
    docs = [(i, t, m) for i, (t, m) in enumerate((t, m) for m in ("a", "", "a.b", None) for t in texts)]
    df = spark.createDataFrame([(i, None if t is None else t.encode(), t, m) for i, t, m in docs] + [(len(docs), b'{"a":["\\xff"]}', "x", "a")], "k long, b binary, t string, m string").coalesce(1)
    df.createOrReplaceTempView("odd_docs")
    O.register(spark)
    cases = {
        "json_items(b, 'a')": lambda d, m: framing.array_items(d, "a"), "json_items(b, m)": lambda d, m: framing.array_items(d, m), "json_items(b)": lambda d, m: framing.array_items(d),
        "json_candidates(b)": lambda d, m: framing.candidates(d), "json_candidates(b, 'single')": lambda d, m: framing.candidates(d, "single"), "json_events(b)": lambda d, m: framing.events(d),
        "json_leaves(b)": lambda d, m: framing.leaves(d), "sse_events(b)": lambda d, m: framing.sse_events(d), "text_chunks(b, 5)": lambda d, m: framing.chunked(d, 5), "multipart_parts(b, m)": lambda d, m: framing.multipart_parts(d, m or ""),
    }
    given = df.collect()
    for call, rows in cases.items():
        got = spark.sql(f"select k, x.* from odd_docs, lateral {call} x")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "PythonUDTF" not in plan and "Exchange" not in plan
        want = [(r.k, *[w[n] for n in got.columns[1:]]) for r in given if r.b is not None for w in rows(bytes(r.b), r.m)]
        assert [tuple(x.asDict(True).values()) for x in got.collect()] == want, call
    assert spark.sql("select x.value from odd_docs, lateral json_items(t, 'a') x where k = 1").collect()[0][0] == '"\\\\u00e9"'
    assert spark.sql("select count(*) from odd_docs left join lateral json_leaves(b) x on true where k = 5").first()[0] == 1


def test_documents_with_many_brackets_are_read_together(spark):
    """More opening brackets than the C readers are given: the same rows as one by one, mixed with others."""
    s, lim = S.schema(S.i64("id", required=True), S.string("label"), S.object_array("sub", S.i64("n"))), Limits(max_depth=3, value=ValueLimits(max_depth=3))
    one = '{"id":%s,"label":%s,"sub":[{"n":1},{"n":2},{}],"q":%s}'
    texts = [one % (i, t, q) for i in (7, "1.5", '"x"', -0) for t in ('"a"', '"é"', "null", '"\\n"', '"\x01"', "3") for q in ("[[1]]", "[[[1]]]", "[{},{}]", "[1}", '{"a":1,"a":2}', "0")]
    texts += ["", None, "[[],[],[],[]]", "[[],[],[],[]] x", '[{},{},{},{}', '{"id":1,"id":2,"sub":[{},{},{}]}', '{"label":"b","sub":[{},{},{}]}', '{"id":1}', "[" * 9 + "]" * 9, '{"id":1,"sub":[{},{},1,{}]}'] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "k long, doc string").coalesce(1)
    decoder = Decoder(s, lim)

    def alone(f, d):
        try:
            return f(d.encode())
        except JsonError as e:
            return e.code, e.row()["offset"] if e.data else None

    for r in df.select("k", J.validate_json("doc", lim).alias("v"), J.decode("doc", s, lim).alias("d")).collect():
        d = texts[r.k]
        if d is None:
            assert r.v is None and r.d is None
            continue
        want = alone(lambda b: validate(b, lim.value), d)
        assert (r.v.valid, r.v.error.code) == ((True, "ok") if want is None else (False, want[0])), d
        want = alone(lambda b: decoder.decode(b)[0], d)
        assert (r.d.value.asDict(True) if r.d.value else r.d.error.code) == (want if isinstance(want, dict) else want[0]), d
    long = '{"id":1,"sub":[' + ",".join(['{"n":5}'] * 100) + "]}"
    with mock.patch("docloom.functions.columns.many.Tokens", side_effect=batch.Tokens) as tokens:
        assert decode_one(J.decode, long, s) and tokens.called


def decode_one(make, doc, s):
    """The Arrow function of a column function, called here: whether one document goes through it."""
    seen = []
    with mock.patch("docloom.functions.columns.F.arrow_udf", side_effect=lambda run, kind: lambda *c: seen.append(run)):
        make("doc", s)
    return seen[0](pa.array([doc, None])).to_pylist()[0]["error"]["code"] == "ok"


def test_small_files_share_tasks(spark, tmp_path):
    """1,100 small files are 35 tasks of Spark's, here 16; one listing serves two readers."""
    many = spark.range(1100).select(F.concat(F.col("id").cast("string"), F.lit(".json")).alias("name"), F.concat(F.lit('{"rows":[{"k":'), "id", F.lit("},{}]}")).alias("doc"))
    sources.write_files(many, "name", F.encode("doc", "UTF-8"), str(tmp_path / "many"))
    files = sources.read_documents(spark, str(tmp_path / "many"))
    assert files.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism == 16
    items = sources.read_items(spark, files, "rows", S.schema(S.i64("k")))
    assert items.agg(F.count("*"), F.sum("record.k"), F.count_distinct("path")).first()[:] == (2200, 1099 * 550, 1100)
    assert files.where(J.validate_json("content").valid).count() == 1100



def test_sse_json_names(spark):
    body = 'event: keep\ndata: {"id":1}\n\nevent: skip\ndata: {"id":2}\n\ndata: {"id":3}\nevent: keep\n\nretry: 5\n\ndata: {"id":4}\n\nevent: keep\ndata: {"id":"x"}\n\n'
    df = spark.createDataFrame([(1, body)], "k long, doc string")
    got = [(r.record and r.record.id, r.error.code) for r in O.sse_json(df, "doc", ["k"], ITEM, ["keep"]).orderBy("seq").collect()]
    assert got == [(1, "ok"), (None, "invalid_argument"), (None, "type_mismatch")]
    assert [r.record and r.record.id for r in O.sse_json(df, "doc", ["k"], ITEM, [""]).where("error.code = 'ok'").collect()] == [4]
    free = O.sse_json(df, "doc", ["k"]).orderBy("seq").collect()
    assert [r.record for r in free] == ['{"id":1}', '{"id":2}', '{"id":3}', '{"id":4}', '{"id":"x"}']


def test_rewrites_on_columns(docs):
    got = by_key(docs.select("k", J.value_rewrite_many("doc", [("q.0", "replace", F.lit("7")), ("label", "drop", None), ("n.m", "replace", '"z"')]).alias("r")))
    assert got[1].r.text == '{"id":1,"q":[7,2],"n":{"m":"z"}}' and got[4].r.error.code == "invalid_json"
    with pytest.raises(JsonError):
        J.value_rewrite("doc", "", "drop")
    with pytest.raises(JsonError):
        J.path_get("doc", "nope", ITEM)


def test_plans(spark):
    df = spark.createDataFrame([(1, '"a"'), (2, '"b"')], "o long, t string")
    one = df.agg(P.array_of("o", "t").alias("a"), P.jsonl("o", "t").alias("l"), P.concat_string("o", "t").alias("s")).first()
    assert one.a == '["a","b"]' and one.l == '"a"\n"b"\n' and one.s == '"\\"a\\"\\"b\\""'
    assert spark.range(1).select(P.splice(F.lit("[1]"), F.lit("[]"), F.lit("[2,3]"))).first()[0] == "[1,2,3]"


def test_engine_limits(docs, spark):
    e = Engine(spark, Limits(value=ValueLimits(max_depth=1)))
    assert by_key(docs.select("k", e.validate_json("doc").alias("v")))[1].v.error.code == "overflow"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    out = str(tmp_path / "lines")
    sources.write_jsonl(df.coalesce(1), F.struct("id", "label"), ITEM, out)
    assert sorted(r.doc for r in sources.read_jsonl(spark, out).collect()) == ['{"id":1,"label":"a"}', '{"id":2,"label":"b"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_bytes(b'{"id":1}{"id":2} {"id":3}')
    (tmp_path / "in" / "y.json").write_bytes(b'{"id":4}')
    rows = sources.read_objects(spark, str(tmp_path / "in"), ITEM).collect()
    assert sorted(r.record.id for r in rows) == [1, 2, 3, 4]
    (tmp_path / "arr").mkdir()
    (tmp_path / "arr" / "z.json").write_bytes(b'{"items":[{"id":1},{"id":2}]}')
    target = str(tmp_path / "done")
    sources.rewrite_files(spark, str(tmp_path / "arr"), target, lambda c: J.value_rewrite(c, "items.0", "drop"))
    assert spark.read.text(target).first()[0] == '{"items":[{"id":2}]}'
    with pytest.raises(JsonError):
        sources.rewrite_files(spark, target, target, None)


def test_http(spark):
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = b'[{"id":1},{"id":2}]'
            self.send_response(200 if self.path == "/ok" else 404)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}/ok",), (f"{base}/no",)], "url string")
    rows = {r.url[-2:]: r for r in sources.fetch(urls, "url").collect()}
    assert rows["ok"].status == 200 and rows["no"].status == 404 and rows["no"].failure
    items = O.array_items(sources.fetch(urls.where("url like '%ok'"), "url"), "content", "", ["url"], ITEM)
    assert sorted(r.record.id for r in items.collect()) == [1, 2]
    sent = sources.upload(spark.createDataFrame([('{"a":1}',)], "t string"), "t", base).collect()
    assert [r.status for r in sent] == [204] and got == [b'{"a":1}']
    server.shutdown()


def test_streams(spark, tmp_path):
    source, schema = str(tmp_path / "chunks"), "key string, n long, part binary, last boolean"
    batches = [
        [("o", 1, b'{"id":1,"la', False), ("i", 1, b'{"items":[1,', False), ("s", 1, b"event: x\ndata: a", False)],
        [("o", 2, b'bel":"x"}{"id":2}', True), ("i", 2, b' {"a":2}]}', True), ("s", 2, b"b\n\ndata: c", True), ("e", 1, b'{"id":"no"}', True)],
    ]
    frames = []
    for make, keys in ((lambda df: push_objects(df, "key", "part", "n", ITEM, "last"), ("o", "e")), (lambda df: push_items(df, "key", "part", "n", "items", "last"), ("i",)), (lambda df: push_sse(df, "key", "part", "n", "last"), ("s",))):
        folder = f"{source}-{keys[0]}"
        name = f"out_{keys[0]}"
        spark.createDataFrame([b for b in batches[0] if b[0] in keys], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{keys[0]}")).start()
        q.processAllAvailable()
        spark.createDataFrame([b for b in batches[1] if b[0] in keys], schema).coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
        q.stop()
        frames.append(spark.sql(f"select * from {name} order by key, seq").collect())
    objects, items, sse = frames
    assert [(r.key, r.record, r.error_code) for r in objects] == [("e", None, "type_mismatch"), ("o", '{"id":1,"label":"x"}', None), ("o", '{"id":2,"label":null}', None)]
    assert [r.value for r in items] == ["1", '{"a":2}']
    assert [(r.event, r.data) for r in sse] == [("x", "ab"), ("", "c")]


def test_an_encoded_text_is_made_once(spark):
    df = spark.createDataFrame([(1, "plain"), (2, 'q"\\ é\x7f\x0b\n'), (3, None), (4, "")], "k long, s string")
    text = J.encode(F.struct("k", "s"), S.schema(S.i64("k"), S.string("s"))).text
    out = df.select(text.alias("doc"), J.json_quote("s").alias("q"))
    assert df.select(text.alias("doc"))._jdf.queryExecution().optimizedPlan().toString().count("StructsToJson") == 2
    assert [tuple(r) for r in out.collect()] == [
        ('{"k":1,"s":"plain"}', '"plain"'), ('{"k":2,"s":"q\\"\\\\ é\x7f\\u000b\\n"}', '"q\\"\\\\ é\x7f\\u000b\\n"'), ('{"k":3,"s":null}', "null"), ('{"k":4,"s":""}', '""')
    ]


def test_written_documents_are_not_dealt_to_a_fixed_number_of_tasks(spark, monkeypatch, tmp_path):
    from docloom import queries_fields

    made = []
    monkeypatch.setattr(sources, "scratch", lambda spark: made.append(str(tmp_path / f"f{len(made)}")) or made[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        queries_fields.file_array_rewrite(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(list((tmp_path / "f0").glob("part-*"))) == 6

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom import schema as S
from docloom.framing import array_items, candidates, chunked, events, leaves, multipart_boundary, multipart_parts, objects, sse_events
from docloom.limits import JsonError, Limits, MultipartLimits, SseLimits
from docloom.records import Decoder
from docloom.streaming import ItemSplitter, ObjectSplitter, SseSplitter

ITEM = S.schema(S.i64("id", required=True), S.string("label", max_bytes=11))


def codes(rows):
    return [r["error"]["code"] for r in rows]


def test_candidates_positions():
    rows = list(candidates(b' \n1 \t {"x":2}\r\n true '))
    assert [(r["index"], r["stream_offset"], r["byte_size"], r["payload"]) for r in rows] == [(0, 2, 1, "1"), (1, 6, 7, '{"x":2}'), (2, 16, 4, "true")]


@pytest.mark.parametrize(("data", "framing"), [(b"truefalse", "auto"), (b"1true", "auto"), (b'{}"x"', "auto"), (b"1,2", "ndjson"), (b"[]{}", "ndjson")])
def test_values_need_white_space(data, framing):
    last = list(candidates(data, framing))[-1]["error"]
    assert last["code"] == "invalid_json" and "whitespace" in last["message"]


@pytest.mark.parametrize("data", [b"1 2", b"1\n2", b"1\t2", b"1\r\n2"])
def test_white_space_separates(data):
    assert codes(candidates(data)) == ["ok", "ok"]


def test_framings():
    assert codes(candidates(b'[{"a":1},2,null]')) == ["ok"] * 3
    assert list(candidates(b"")) == list(candidates(b" ", "ndjson")) == []
    assert codes(candidates(b"", "single")) == codes(candidates(b"1 2", "single")) == ["invalid_json"]
    assert codes(candidates(b"{}", "array")) == ["type_mismatch"]
    assert codes(candidates(b"[1,]")) == codes(candidates(b"[,1]")) == ["invalid_json"]
    assert codes(candidates(b"[1] 2")) == ["ok", "invalid_json"]
    assert codes(candidates(b"[1,2,3", "auto", max_items=2)) == ["ok", "ok"]
    assert codes(candidates(b"[1]", "other")) == ["invalid_argument"]
    assert codes(candidates(b'"abcdef"', max_payload_bytes=3)) == ["overflow"]


def test_objects_touch_and_end():
    rows = list(objects(b'{"id":1}{"id":2,"label":"x"} \n{"id":3}{"id"', Decoder(ITEM)))
    assert [r["record"] and r["record"]["id"] for r in rows] == [1, 2, 3, None]
    assert codes(objects(b"1", Decoder(ITEM))) == ["invalid_json"]


def test_selected_arrays():
    doc = b'{"meta":{"a":[1]},"items":[{"id":1},{"id":2}],"z":[{"q":{}}]}'
    assert [r["value"] for r in array_items(doc, "items")] == ['{"id":1}', '{"id":2}']
    assert [r["record"]["id"] for r in array_items(doc, "items", Decoder(ITEM))] == [1, 2]
    assert [codes(array_items(doc, s)) for s in ("nope", "a.b", "meta")] == [["missing_required_field"], ["invalid_argument"], ["type_mismatch"]]
    assert codes(array_items(b'{"items":["a"],"items":3}', "items")) == ["ok", "duplicate_field"]
    assert codes(array_items(b'{"x":{"a":1,"a":2},"items":[]}', "items", Decoder(ITEM))) == ["duplicate_field"]
    assert codes(array_items(b"[1,[2]] x")) == ["ok", "ok", "invalid_json"] or codes(array_items(b"[1,[2]] x")) == ["ok", "invalid_json"]
    assert codes(array_items(b'["a",1]', strings=True)) == ["ok", "type_mismatch"]


def test_events_and_leaves():
    rows = list(events(b'{"a":[1,{"b":true}],"c":null}'))
    assert [r["event"] for r in rows] == ["object_begin", "key", "array_begin", "number", "object_begin", "key", "bool", "object_end", "array_end", "key", "null", "object_end"]
    assert rows[1]["path"] == [] and rows[3]["path"] == ["a", "0"] and rows[5]["path"] == ["a", "1"]
    assert [(r["path"], r["text"]) for r in leaves(b'{"a":[1,{"b":true}],"c":"x"}')] == [(["a", "0"], "1"), (["a", "1", "b"], "true"), (["c"], "x")]
    assert codes(events(b"[1,]"))[-1] == "invalid_json"


SSE = b"id: abc\r\nevent: update\r: ignored\nretry: 1500\ndata: first\ndata: second\n\ndata: z"


def test_sse():
    got = [(r["event"], r["id"], r["data"], r["retry_ms"]) for r in sse_events(SSE)]
    assert got == [("update", "abc", "first\nsecond", 1500), ("", "", "z", None)]
    assert codes(sse_events(b"data: xxxx\n", SseLimits(max_line_bytes=5))) == ["overflow"]
    assert codes(sse_events(b"data: aa\ndata: bb\n", SseLimits(max_event_data_bytes=4))) == ["overflow"]
    assert [r["has_data"] for r in sse_events(b"event: x\n\nretry: 1x\n\n")] == [False]


def test_multipart():
    body = b'--B\r\nContent-Disposition: form-data; name="me\\"ta"\r\nContent-Type: application/json\r\n\r\n{"ok":true}\r\n--B\nContent-Length: 3\n\nabc\r\n--B--\r\n'
    rows = list(multipart_parts(body, 'multipart/mixed; charset=x; Boundary="B"'))
    assert [(r["name"], r["content_length"], r["body"]) for r in rows] == [('me"ta', -1, b'{"ok":true}'), (None, 3, b"abc")]
    assert codes(multipart_parts(b"junk\n--B--\n", "m; boundary=B")) == ["invalid_json"]
    assert codes(multipart_parts(body[:-8], "m; boundary=B"))[-1] == "invalid_json"
    assert codes(multipart_parts(b"", "m; x=1")) == ["invalid_argument"]
    assert codes(multipart_parts(b"--B\nContent-Length: 1x\n\n", "m; boundary=B")) == ["invalid_json"]
    with pytest.raises(JsonError):
        multipart_boundary("m; boundary=abc", MultipartLimits(max_boundary_bytes=2))


def test_chunked():
    assert [(c["bytes"], c["eof"]) for c in chunked(b"abcde", 2)] == [(b"ab", False), (b"cd", False), (b"e", True)]


def cuts(data, rng):
    at = 0
    while at < len(data):
        n = rng.randint(1, 5)
        yield data[at : at + n]
        at += n


def pushed(make, data, rng):
    splitter, got = make(), []
    for c in cuts(data, rng):
        got += list(splitter.feed(c))
        saved = splitter.save()
        splitter = make()
        splitter.load(*saved)
    return got + list(splitter.finish() or ())


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32))
def test_any_cut_into_chunks_gives_the_same_rows(seed):
    rng = random.Random(seed)
    assert [x.strip() for x in pushed(ObjectSplitter, b' {"a":"x}\\"y"}\n{"b":[{},"]"]}{"c":1} ', rng)] == [b'{"a":"x}\\"y"}', b'{"b":[{},"]"]}', b'{"c":1}']
    doc = b'{"m":{"items":[9]},"items":[{"id":1,"s":"],"}, 2 ,"q\\\\",[3]],"z":[1]}'
    assert pushed(lambda: ItemSplitter("items"), doc, rng) == [b'{"id":1,"s":"],"}', b"2", b'"q\\\\"', b"[3]"]
    assert pushed(ItemSplitter, b'[1,{"a":[]} ,"x"]', rng) == [b"1", b'{"a":[]}', b'"x"']
    whole = [{k: r[k] for k in ("event", "id", "data", "retry_ms")} for r in sse_events(SSE)]
    assert [{k: r[k] for k in ("event", "id", "data", "retry_ms")} for r in pushed(SseSplitter, SSE, rng)] == whole


def test_push_failures():
    for data, code in ((b"[1,]", "invalid_json"), (b"[1", "invalid_json"), (b'{"a":1}', "type_mismatch")):
        with pytest.raises(JsonError) as e:
            pushed(ItemSplitter, data, random.Random(0))
        assert e.value.code == code
    with pytest.raises(JsonError) as e:
        pushed(lambda: ObjectSplitter(4), b'{"aaaaaaaa":1}', random.Random(0))
    assert e.value.code == "overflow"


def test_limits_object():
    with pytest.raises(JsonError):
        Limits(max_depth=0).check()

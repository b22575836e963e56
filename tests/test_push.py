"""Push parsers against the pull operators, for any cut into chunks."""

import random

import pytest

from docloom import framing
from docloom import schema as S
from docloom.limits import JsonError, Limits, MultipartLimits
from docloom.streaming import ItemSplitter, MultipartSplitter, ObjectSplitter
from docloom.streaming.push import item_check
from docloom.writer import JsonWriter

DOCS = [
    b'{"a":1,"items":[1, "x,]", {"b":[1,2]} , null ],"z":{"q":[]}}', b'{"items":[]}', b'{"items":[ ]} ', b'{"a" 1 tru, "items":[1,2], nonsense}', b'{"items":[1],"items":[2]}',
    b'{"items":[1,2], nonsense}', b'{"items":[1,2]', b'{"items":[1,,2]}', b'{"items":[1 2]}', b'{"items":[1,]}', b'{"items":{"a":1}}', b'{"items":3,"b":1}', b'{"b":1}', b'[1,2]', b'', b'{"items":[1]} x',
    b'{"\\u0069tems":["\\u00e9\\n", "\\ud83d\\ude00"]}', '{"k":"é😀","items":["é😀","𝔸"]}'.encode(), b'{"a":{"items":[9]},"items":[{"k":1,"k":2}]}', b'{"items":[tru]}', b'{"items":[1}', b'{"a":[{]},"items":[1]}',
]


def cuts(data, rng):
    at = 0
    while at < len(data):
        n = rng.choice((1, 2, 3, 7, 50))
        yield data[at : at + n]
        at += n


def pushed(splitter, data, rng):
    out = []
    try:
        for c in cuts(data, rng):
            # the state survives between chunks
            out += splitter.feed(c)
            saved = splitter.save()
            splitter.load(*saved)
        out += splitter.finish() or ()
    except JsonError as e:
        return out, e.code
    return out, "ok"


@pytest.mark.parametrize("data", DOCS)
def test_items_by_push_are_those_by_pull(data):
    rng = random.Random(1)
    for strings in (False, True):
        rows = list(framing.array_items(data, "items", strings=strings))
        want = [r["value"] for r in rows if r["error"]["code"] == "ok"], next((r["error"]["code"] for r in rows if r["error"]["code"] != "ok"), "ok")
        for _ in range(6):
            got = pushed(ItemSplitter("items", check=item_check("strings" if strings else "text")), data, rng)
            assert got == want, data


@pytest.mark.parametrize("data", [d.partition(b":")[2].rpartition(b"}")[0] for d in DOCS if d.startswith(b'{"items"')])
def test_root_arrays(data):
    rows = list(framing.array_items(data))
    want = [r["value"] for r in rows if r["error"]["code"] == "ok"], next((r["error"]["code"] for r in rows if r["error"]["code"] != "ok"), "ok")
    assert pushed(ItemSplitter(check=item_check()), data, random.Random(2)) == want


def test_records_and_type_checks():
    check = item_check(schema=S.schema(S.i64("k", required=True)))
    rng = random.Random(3)
    assert pushed(ItemSplitter("a", check=check), b'{"a":[{"k":1,"z":[]}, {"k":2}]}', rng) == (['{"k":1}', '{"k":2}'], "ok")
    assert pushed(ItemSplitter("a", check=check), b'{"a":[{"k":1}, 2]}', rng) == (['{"k":1}'], "type_mismatch")
    assert pushed(ItemSplitter("a", check=check), b'{"a":[{}]}', rng) == ([], "missing_required_field")
    with pytest.raises(JsonError):
        item_check("pieces")


def test_string_pieces_join_to_the_strings():
    rng = random.Random(4)
    texts = ["", "plain", 'quo"te\\', "é😀𝔸\n" * 30, "\u0000\u001f", "x" * 500]
    import json

    for ascii_only in (True, False):
        data = json.dumps({"t": texts}, ensure_ascii=ascii_only).encode()
        for _ in range(20):
            got, end = pushed(ItemSplitter("t", check=item_check("strings"), pieces=True), data, rng)
            assert end == "ok" and [i for i, _, e in got if e] == list(range(len(texts)))
            assert ["".join(v for i, v, _ in got if i == n) for n in range(len(texts))] == texts
    assert pushed(ItemSplitter("t", check=item_check("strings"), pieces=True), b'{"t":["a", 1]}', rng)[1] == "type_mismatch"


def test_many_items_in_one_chunk_take_linear_time():
    import time

    data = b"[" + b"1," * 400_000 + b"1]"
    start = time.time()
    assert sum(1 for _ in ItemSplitter(check=item_check()).feed(data)) == 400_001 and time.time() - start < 30
    start = time.time()
    assert sum(1 for _ in ObjectSplitter().feed(b'{"a":1}' * 300_000)) == 300_000 and time.time() - start < 30


def test_multipart_by_push_is_that_by_pull():
    rng = random.Random(5)
    bodies = [
        b"--b\r\nContent-Disposition: form-data; name=x\r\n\r\none\r\n--b\r\nContent-Length: 5\r\n\r\n--b\r\n\r\n--b--\r\n", b"\r\n--b\nA: 1\n\nline\n--bc\nmore\n--b--\n", b"--b--\r\n", b"--b\r\n\r\nopen", b"--c\r\n", b"",
        b"--b\r\nbad header\r\n\r\nx\r\n--b--", b"--b\r\nContent-Length: 99\r\n\r\nshort", b"--b\r\n\r\nlast\r\n--b--", b"--b\r\nContent-Length: x\r\n\r\n\r\n--b--", b"--b\r\n\r\n\r\n--b\r\n\r\n--b--\r\n",
    ]
    for data in bodies:
        rows = list(framing.multipart_parts(data, "multipart/form-data; boundary=b"))
        want = [{k: r[k] for k in ("name", "content_type", "content_length", "headers", "body")} for r in rows if r["error"]["code"] == "ok"]
        code = next((r["error"]["code"] for r in rows if r["error"]["code"] != "ok"), "ok")
        for _ in range(10):
            assert pushed(MultipartSplitter("b"), data, rng) == (want, code), data
    small = Limits(multipart=MultipartLimits(max_part_bytes=10))
    assert pushed(MultipartSplitter("b", small), b"--b\r\n\r\n" + b"x" * 100, rng) == ([], "overflow")


def test_writer_values_in_chunks():
    w = JsonWriter()
    w.begin_array().value_begin()
    for c in (b'{"a"', b": [1,", b" 2]", b"}"):
        w.value_chunk(c)
    w.value_end().value_from([b"1", b"e3"]).array_items_from([b'{"q":[{"z": 1', b"}, 2]", b"}"], "q").end_array()
    assert w.finish() == '[{"a":[1,2]},1e3,{"z":1},2]'
    for calls in (lambda w: w.value_chunk(b"1"), lambda w: w.value_begin().string("x"), lambda w: w.value_begin().value_chunk(b"1 2").value_end(), lambda w: w.value_begin().finish(), lambda w: w.begin_array().array_items_from([b"[1,"])):
        w = JsonWriter()
        with pytest.raises(JsonError):
            calls(w)
        with pytest.raises(JsonError):
            w.null()

"""The tokenizer of many documents accepts only what the row tokenizer accepts, with the same rows."""

import random

import pyarrow as pa
import pytest

from docloom import batch, framing
from docloom import schema as S
from docloom.limits import JsonError, Limits, ValueLimits
from docloom.operators.tables import leaf_rows
from docloom.records import Decoder
from docloom.rewriting import Context, Rule, array_rewrite, drop, insert_after, insert_before, parse_array_selector, replace, replace_and_insert_after

ITEM = S.schema(S.i64("id", required=True), S.string("label"), S.object_array("sub", S.i64("n"), S.string("t")))
PIECES = ["{", "}", "[", "]", ",", ":", " ", "\n", '"a"', '"items"', '"id"', '"label"', '"é"', "1", "-7", "1.5e3", "01", "true", "null", "nul", '"', "\\", '"\\n"', "\x01", '{"id":1}', '{"items":[{"id":2}]}', '"sub":[{"n":1},{}]']
VALID = [
    '{"items":[{"id":1,"label":"x"},{"id":2 , "sub":[ {"n":3,"t":null} , {} ]}],"z":[]}', '{"items":[]}', "[]", "[1, 2 ,[3],{\"a\":[{}]}]", '"s"', "-0", " 7\n", '{"a":{"b":[null,true,{"c":"d e"}]}}',
    '{"items":[{"id":-0},{"id":999999999999999999}]}', '{"items":[{"id":9223372036854775807}]}', '{"items":[{"id":1.0}]}', '{"items":[{"label":"q"}]}', '{"items":[null]}', '{"items":{}}', '{"items":[1],"items":[2]}',
    '{"items":[{"id":1,"id":2}]}', '{"é":"ü","items":["ö"]}', '{"items":[{"id":1,"label":null,"q":{"r":[1]}}]}', '{"other":{"items":[1]}}', '[{"items":[{"id":1}]}]', "", " ", '{"items":[{"id":1}]} x', "[1]]", "[" * 70 + "]" * 70, '"' + "y" * 300 + '"', "1" * 300,
]


def texts() -> list[bytes | None]:
    r = random.Random(3)
    out = [v.encode() for v in VALID] + [None, b'["\xff"]', b'"\xc3', b'\xa9"', b'{"items":["\xe9"]}']
    out += ["".join(r.choices(PIECES, k=r.randrange(1, 9))).encode() for _ in range(20_000)]
    for _ in range(20_000):  # one byte changed, taken out or doubled
        v = bytearray(r.choice(VALID).encode()) or bytearray(b"1")
        i = r.randrange(len(v))
        v[i : i + 1] = r.choice([b"", v[i : i + 1] * 2, r.choice(PIECES).encode()])
        out.append(bytes(v))
    r.shuffle(out)
    return out


def compare(at_once, one, least: int):
    docs, accepted = texts(), 0
    for start in range(0, len(docs), 1000):
        part = docs[start : start + 1000]
        ok, at, columns = at_once(pa.array(part, pa.large_binary()))
        got = {}
        for i, *row in zip(at.tolist(), *(c.to_pylist() for c in columns)):
            assert ok[i]
            got.setdefault(i, []).append(row)
        for i, d in enumerate(part):
            if ok[i]:
                accepted += 1
                assert got.get(i, []) == one(d), d
    assert accepted > least


@pytest.mark.parametrize("limits", [Limits(), Limits(max_depth=3, value=ValueLimits(max_depth=3, max_string_bytes=4, max_key_bytes=4, max_number_bytes=2)), Limits(max_dynamic_string_bytes=2)])
def test_same_rows(limits):
    def rows(names, made):
        made = list(made)
        assert all(r["error"]["code"] == "ok" for r in made)
        return [[r[n] for n in names] for r in made]

    v, decoder = limits.value, Decoder(ITEM, limits)
    for selector in ("items", "", "é"):
        compare(lambda d: batch.item_rows(d, selector, None, limits), lambda d: rows(("index", "value"), framing.array_items(d, selector, None, v)), 300 if selector != "é" else 0)
        compare(lambda d: batch.item_rows(d, selector, ITEM, limits), lambda d: rows(("index", "record"), framing.array_items(d, selector, decoder, v)), 300 if selector != "é" else 0)
    compare(lambda d: batch.event_rows(d, v, True, None, False), lambda d: rows(("seq", "event", "depth", "text", "path"), framing.events(d, True, v)), 3000)
    compare(leaf_rows(v), lambda d: rows(("seq", "path", "type", "text"), framing.leaves(d, v)), 3000)


def test_common_documents_are_accepted():
    docs = [f'{{"id": {i}, "items": [{{"id":{i},"label":"l{i}","sub":[]}}, {{"id":0}}]}}'.encode() for i in range(500)]
    assert batch.item_rows(pa.array(docs, pa.large_binary()), "items", ITEM, Limits())[0].all()
    assert batch.event_rows(pa.array(docs, pa.large_binary()), ValueLimits(), True, None, False)[0].all()


def by_item(item, context: Context):
    if isinstance(item, dict) and item.get("id") == 2:
        return replace({"id": context.index, "label": 'q"é'})
    return drop() if item == 1 else insert_before({"id": 5}) if context.index == 1 else replace_and_insert_after({"id": 3}, {"id": 4}, {"id": 6})


@pytest.mark.parametrize("schema", [None, ITEM])
@pytest.mark.parametrize("selector", ["items", "", "a.items", "items[].sub", "a[].items"])
def test_rewriting_is_the_same(selector, schema):
    first = {"id": 9, "label": "new"}
    rules = [Rule(drop(), {"id": 1}), Rule(insert_after(first, {"id": 8}), {"label": None}, {}), Rule(replace(first), {"id": 2.0}, {"label": "x"}), Rule(drop(), {}, {"id": 1})]
    more = ['{"a":{"x":1,"items":[{"id":1},{"id":7}]}}', '{"a":[{"id":1,"items":[ {"id":4,"label":"x"} ]},{"items":[]},7,{"label":"x","items":[{"id":2,"label":"y"}],"id":1}]}', '{"items":[{"id":1,"label":"x","sub":[{"id":2,"label":"z"},{"id":3}]},{"sub":[{"id":1}],"id":1}]}', "[]", '[{"id":2,"label":"x"},1]']
    docs = texts() + [m.encode() for m in more * 3]
    limits, accepted = Limits(), 0
    for given, append in ((rules, None), (rules[1:], [first]), (by_item, [first, {"id": 0}])):
        whole = batch.Rewriting(parse_array_selector(selector), given, append, schema, limits)
        assert whole.fit == (given is rules or given != by_item or len(selector.split(".")) < 2)
        for start in range(0, len(docs) * whole.fit, 1000):
            part = docs[start : start + 1000]
            ok, rows, made = whole.rows(pa.array(part, pa.large_binary()))
            assert rows.tolist() == [i for i in range(len(part)) if ok[i]]
            accepted += len(rows)
            for i, text in zip(rows.tolist(), made.to_pylist()):
                assert text == array_rewrite(part[i], selector, given, append, schema, limits).decode(), part[i]
    assert accepted > 5


def test_common_documents_are_rewritten_together():
    docs = pa.array([f'{{"id": {i}, "items": [{{"id":{i % 3},"label":"l{i}","sub":[]}}, {{"id":0}}]}}'.encode() for i in range(500)], pa.large_binary())
    for schema in (None, ITEM):
        for rules in ([Rule(drop(), {"id": 1})], by_item):
            assert batch.Rewriting([("items", False)], rules, [{"id": 1}], schema, Limits()).rows(docs)[0].all()


def test_a_failing_call_leaves_its_document_to_the_row_path():
    def refuse(item, context):
        if item["id"] == 1:
            raise JsonError("invalid_argument", "no")
        return replace(item)

    ok, rows, made = batch.Rewriting([("items", False)], refuse, None, ITEM, Limits()).rows(pa.array([b'{"items":[{"id":1}]}', b'{"items":[{"id":2,"label":"a"}]}'], pa.large_binary()))
    assert ok.tolist() == [False, True] and rows.tolist() == [1] and made.to_pylist() == ['{"items":[{"id":2,"label":"a","sub":[]}]}']


def test_flat_items_are_read_by_the_scanner_with_the_same_rows():
    many = ['{"n":"%s","items":[{"id":%s,"label":%s}%s]}' % (n, i, t, m) for n in ("a", ":", "[", "é") for i in ("1", "-0", "-5", "1.0", "1e2", "true", "123456789012345678901", '"3"') for t in ("null", '"x"', '"a:b"', '"},{"', "7", '"\\\\n"') for m in ("", ', {"id" : 2 ,"label":"y"}', ',{"id":2,"id":3,"label":"y"}', ',{"id":2}', ',{}', ",[[]]", ',{"id":4,"label":"z","q":[]}', ',{"id":4,"label":"z","q":1234567890123456789}')]
    docs = pa.array([m.encode() for m in many] + [b'{"items":[]}', b'\xef\xbb\xbf{"items":[]}', b'{"items":[{"id":1,"label":"\xff"}]}', b'{"items":[{}]}', b'{"items":[NaN]}', None], pa.large_binary())
    flat = S.schema(S.i64("id", required=True), S.string("label"))
    for schema, least in ((flat, 10), (None, 10)):
        for limits in (Limits(), Limits(max_depth=2, value=ValueLimits(max_depth=2)), Limits(value=ValueLimits(max_number_bytes=1))):
            rows = batch.Flat("items", schema, limits)
            assert not rows.fit or len(rows.read(docs)[1]) > least
            (ok, at, columns), (want, there, others) = (f(docs, "items", schema, limits) for f in (batch.item_rows, batch._item_rows))
            assert (ok >= want).all() and (ok == want).all()
            assert sorted(zip(at.tolist(), *(c.to_pylist() for c in columns)), key=lambda r: r[:2]) == sorted(zip(there.tolist(), *(c.to_pylist() for c in others)), key=lambda r: r[:2])

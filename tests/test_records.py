import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom import schema as S
from docloom.limits import JsonError, Limits, SpoolClass
from docloom.records import Decoder, Encoder

PERSON = S.schema(
    S.string("name", required=True), S.string("nickname", max_bytes=7, overflow="truncate"), S.i64("age"), S.f64("score"), S.boolean("active"),
    S.obj("address", S.string("city", required=True, max_bytes=15), S.i64("zip"), required=True), S.i64_array("lucky_numbers"), S.string_array("tags"),
    S.object_array("items", S.i64("id", required=True), S.string("label", max_bytes=11)),
)
DOC = b'{"name":"A\\u00e9","nickname":"abcdefghij","age":3,"score":1.5,"active":true,"address":{"city":"X","zip":9,"q":[1,{"z":1}]},"lucky_numbers":[1,2],"tags":["a"],"items":[{"id":1,"label":"l"}],"zzz":{}}'


def status(schema, data, limits=None):
    try:
        Decoder(schema, limits).decode(data)
        return "ok"
    except JsonError as e:
        return e.code


def test_decode_person():
    record, truncated = Decoder(PERSON).decode(DOC)
    assert truncated and record["name"] == "Aé" and record["nickname"] == "abcdefg"
    assert record["address"] == {"city": "X", "zip": 9} and record["items"] == [{"id": 1, "label": "l"}]
    assert Decoder(PERSON).decode_at(DOC, 0)[0] == record


@pytest.mark.parametrize(
    ("data", "code", "at"),
    [
        (b"[]", "type_mismatch", 1), (b'{"name":1}', "type_mismatch", 9), (b'{"name":"a"}', "missing_required_field", 12), (b'{"name":"a","name":"b"}', "duplicate_field", 13),
        (b'{"age":1.0}', "type_mismatch", 8), (b'{"age":1e2}', "type_mismatch", 8), (b'{"age":null}', "type_mismatch", 8), (b'{"lucky_numbers":[null]}', "type_mismatch", 19),
        (b'{"lucky_numbers":[[1]]}', "type_mismatch", 19), (b'{"name":"x","age":"s" ...', "type_mismatch", 19), (b'{"name":"x\\u0000"}', "type_mismatch", 9),
        (b'{"age":9223372036854775808}', "type_mismatch", 8), (b'{"score":1e999}', "type_mismatch", 10), (b'{"name":"x","zzz":[1,}', "invalid_json", 22), (b'{"name":"x"', "invalid_json", 12),
        (b'{"address":{"city":"0123456789abcdefg"}}', "overflow", 20),
    ],
)
def test_first_failure(data, code, at):
    with pytest.raises(JsonError) as e:
        Decoder(PERSON).decode(data)
    assert (e.value.code, e.value.row()["offset"]) == (code, at)


def test_missing_keys_are_zero():
    s = S.schema(S.string("s"), S.string("f", max_bytes=3), S.i64("i"), S.i64("p", presence=True), S.f64("d"), S.boolean("b"), S.u64("u"), S.i64_array("a"), S.obj("o", S.i64("x")), S.json_value("j"), S.spooled_text("t"))
    assert Decoder(s).decode(b"{}")[0] == {"s": None, "f": "", "i": 0, "p": None, "d": 0.0, "b": False, "u": Decimal(0), "a": [], "o": {"x": 0}, "j": None, "t": ""}


def test_null_rules():
    assert status(S.schema(S.i64("x", presence=True)), b'{"x":null}') == "type_mismatch"
    assert status(S.schema(S.i64("x", presence=True, nullable=True)), b'{"x":null}') == "ok"
    assert Decoder(S.schema(S.i64_array("x"))).decode(b'{"x":null}')[0] == {"x": []}


def test_u64_and_json_value():
    s = S.schema(S.u64("u"), S.json_value("j"))
    record = Decoder(s).decode(b'{"u":18446744073709551615,"j": {"b": 1.50, "a": [ "\\u0041" ]}}')[0]
    assert record == {"u": Decimal(18446744073709551615), "j": '{"b":1.50,"a":["A"]}'}
    assert status(s, b'{"u":18446744073709551616}') == status(s, b'{"u":-1}') == "type_mismatch"


def test_limits_and_policies():
    assert status(S.schema(S.string("s")), b'{"s":"abc"}', Limits(max_dynamic_string_bytes=2)) == "overflow"
    assert status(S.schema(S.spooled_text("s")), b'{"s":"abc"}', Limits(spool=SpoolClass(1, 2))) == "overflow"
    assert status(S.schema(S.i64("a")), b'{"a":1,"a":2}', Limits(reject_duplicate_keys=False)) == "ok"
    assert status(S.schema(S.obj("a", S.i64("b"))), b'{"a":{"b":[[1]]}}', Limits(max_depth=2)) in ("overflow", "type_mismatch")
    assert status(S.schema(S.i64("a")), b'{"q":' + b"[" * 64 + b"]" * 64 + b"}") == "overflow"
    cut = S.schema(S.i64_array("a", max_items=2, overflow="truncate"))
    assert Decoder(cut).decode(b'{"a":[1,2,3]}') == ({"a": [1, 2]}, True)
    quiet = S.schema(S.i64_array("a", max_items=2, overflow="truncate_silent"))
    assert Decoder(quiet).decode(b'{"a":[1,2,3]}') == ({"a": [1, 2]}, False)
    assert status(S.schema(S.i64_array("a", max_items=2)), b'{"a":[1,2,3]}') == "overflow"


def test_base64_is_strict():
    s = S.schema(S.spooled_bytes("b"))
    assert Decoder(s).decode(b'{"b":"QUI="}')[0] == {"b": b"AB"}
    for bad in (b"QU I=", b"QUI", b"QU==I", b"QUI=\\n"):
        assert status(s, b'{"b":"' + bad + b'"}') == "invalid_json"


def test_decode_into():
    s = S.schema(S.i64("a"), S.i64_array("l"), S.obj("o", S.i64("x"), S.i64("y")))
    base = {"a": 1, "l": [1], "o": {"x": 1, "y": 2}}
    assert Decoder(s).decode(b'{"l":[5],"o":{"y":9}}', base)[0] == {"a": 1, "l": [5], "o": {"x": 1, "y": 9}}


@pytest.mark.parametrize(
    "field",
    [
        lambda: S.string("x", required=True, omit="null"), lambda: S.i64("x", required=True, presence=True), lambda: S.string("x", presence=True), lambda: S.i64("x", nullable=True),
        lambda: S.obj("x", S.i64("y"), presence=True), lambda: S.i64("x", max_bytes=3), lambda: S.string("x", overflow="no"), lambda: S.Field("x", "object"),
    ],
)
def test_bad_layouts(field):
    with pytest.raises(JsonError) as e:
        S.schema(field())
    assert e.value.code == "invalid_argument"


def test_encode_and_omit_rules():
    s = S.schema(
        S.string("model", required=True), S.string("instructions", omit="null"), S.i64("max", presence=True), S.obj("reasoning", S.string("effort", omit="null"), omit="empty"), S.string_array("tags", omit="empty"), S.json_value("meta", omit="null"),
    )
    empty = {"model": "m", "instructions": None, "max": None, "reasoning": {"effort": None}, "tags": [], "meta": None}
    assert Encoder(s).encode(empty) == '{"model":"m"}'
    full = {"model": "m", "instructions": "", "max": 0, "reasoning": {"effort": "x"}, "tags": ["t"], "meta": '{"a": 1.50}'}
    assert Encoder(s).encode(full) == '{"model":"m","instructions":"","max":0,"reasoning":{"effort":"x"},"tags":["t"],"meta":{"a":1.50}}'


def test_numbers_and_pretty():
    s = S.schema(S.f64("d"), S.u64("u"), S.i64_array("a"), S.obj("o", S.i64("x")))
    row = {"d": 0.1, "u": Decimal(18446744073709551615), "a": [], "o": {"x": 1}}
    assert Encoder(s).encode(row) == '{"d":0.10000000000000001,"u":18446744073709551615,"a":[],"o":{"x":1}}'
    assert Encoder(s, pretty=True).encode(row) == '{\n  "d": 0.10000000000000001,\n  "u": 18446744073709551615,\n  "a": [],\n  "o": {\n    "x": 1\n  }\n}'
    with pytest.raises(JsonError):
        Encoder(s).encode({**row, "d": float("nan")})
    with pytest.raises(JsonError) as e:
        Encoder(s, Limits(max_output_bytes=10)).encode(row)
    assert e.value.code == "overflow"


def test_schema_survives_its_struct():
    assert S.Schema.of(PERSON.struct()) == PERSON
    assert S.Schema.of(PERSON).only("age").struct().fieldNames() == ["age"]


ROW = st.fixed_dictionaries({"s": st.text(st.characters(blacklist_characters="\0", blacklist_categories=("Cs",)), max_size=20), "i": st.integers(-(2**63), 2**63 - 1), "d": st.floats(allow_nan=False, allow_infinity=False, allow_subnormal=False), "b": st.booleans(), "l": st.lists(st.integers(-9, 9), max_size=4)})


@settings(max_examples=150, deadline=None)
@given(ROW)
def test_round_trip(row):
    s = S.schema(S.string("s"), S.i64("i"), S.f64("d"), S.boolean("b"), S.i64_array("l"))
    text = Encoder(s).encode(row)
    assert json.loads(text) == row
    assert Decoder(s).decode(text.encode())[0] == row == Decoder(s).decode_at(text.encode(), 0)[0]

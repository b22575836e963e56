import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.limits import JsonError, ValueLimits
from docloom.records import encode_any
from docloom.strict import canonical, compact, end_of, only_space_after, pretty, quote, type_of, unescape, validate, walk

GOOD = [b"{}", b' [1, 2.50 ,"a\\u00e9\\ud83d\\ude00"] ', b"1", b'"x"', b"null", b'{"a":{"b":[]}}', b'{"a":1,"a":2}', b'"\xff\x80"', b"-0", b"1e400", b"[" * 64 + b"]" * 64]
BAD = [
    b"", b" ", b"01", b"[1,]", b'{"a"}', b'{"a":}', b'{"a":1,}', b'"\\ud800"', b'"\\udc00\\ud800"', b'"\\x"', b'"a\nb"', b"nul", b"1 2", b"[1}", b"NaN", b"\xef\xbb\xbf1", b"+1", b"1.",
    b"1e", b".5", b'"abc', b"{a:1}", b"\xc2\xa01", b"{'a':1}", b"truex", b"-", b"[1 2]", b'"\\u12"', b'{"a":1 "b":2}', b"[", b'{"a"', b'{"a":', b"[,1]", b"Infinity", b'["a" "b"]',
]


def rejects(data, **limits):
    with pytest.raises(JsonError) as e:
        validate(data, ValueLimits(**limits) if limits else None)
    return e.value


@pytest.mark.parametrize("data", GOOD)
def test_accepts(data):
    validate(data)


@pytest.mark.parametrize("data", BAD)
def test_rejects(data):
    assert rejects(data).code == "invalid_json"


@pytest.mark.parametrize("data", GOOD + BAD)
def test_fast_path_agrees_with_the_tokenizer(data):
    def slow():
        only_space_after(data, end_of(data, 0, ValueLimits()))

    try:
        validate(data)
    except JsonError:
        with pytest.raises(JsonError):
            slow()
    else:
        slow()


def test_positions_are_one_based_bytes():
    e = rejects('{"é":1,\n  x}'.encode())
    row = e.row()
    assert (row["line"], row["column"], row["offset"]) == (2, 3, 12)


def test_limits():
    assert rejects(b"[" * 65 + b"]" * 65).code == "overflow"
    assert rejects(b'"abcd"', max_string_bytes=3).code == "overflow"
    assert rejects(b'{"abcd":1}', max_key_bytes=3).code == "overflow"
    assert rejects(b"12345", max_number_bytes=4).code == "overflow"
    validate(b'"\\u00e9"', ValueLimits(max_string_bytes=2))


def test_canonical_modes():
    doc = b' { "b" : 1.50 , "a\\/\\u0041" : [ ] } '
    assert canonical(doc) == b'{"b":1.50,"a\\/\\u0041":[]}'
    assert canonical(doc, "reescape") == b'{"b":1.50,"a/A":[]}'
    # the transcoder does not pair surrogates and has no depth limit
    assert canonical(b'"\\ud800"') == b'"\\ud800"'
    assert canonical(b"[" * 100 + b"]" * 100) == b"[" * 100 + b"]" * 100
    with pytest.raises(JsonError):
        canonical(b'"\\ud800"', "reescape")


def test_pretty():
    assert pretty(b'{"a":1,"b":[],"c":{},"d":[1,{"x":null}]}').decode() == '{\n  "a": 1,\n  "b": [],\n  "c": {},\n  "d": [\n    1,\n    {\n      "x": null\n    }\n  ]\n}'


def test_duplicates_are_found_on_request():
    with pytest.raises(JsonError) as e:
        list(walk(b'{"a":1,"\\u0061":2}', 0, None, True))
    assert e.value.code == "duplicate_field"


def test_types():
    assert [type_of(x) for x in (b"{}", b"[]", b'"s"', b"1", b"true", b"null")] == ["object", "array", "string", "number", "bool", "null"]


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text() | st.floats(allow_nan=False, allow_infinity=False), lambda v: st.lists(v) | st.dictionaries(st.text(), v), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_spaces_never_matter(value):
    text = encode_any(value).encode("utf-8", "surrogatepass")
    spaced = pretty(text)
    validate(spaced)
    assert compact(spaced) == text
    assert compact(spaced, True) == text


@settings(max_examples=150, deadline=None)
@given(st.binary())
def test_quote_and_unescape(raw):
    token = quote(raw)
    assert unescape(token, 0, len(token)) == raw

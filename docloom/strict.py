"""Strict JSON over bytes: one tokenizer for every operator.

walk() yields the structural events of one value with byte positions; everything else
(validation, canonical text, items, candidates, rewriting) is a fold over these events.
Bytes of 0x80 and above are taken as they are inside strings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from .limits import DUPLICATE_FIELD, INVALID_JSON, OVERFLOW, JsonError, ValueLimits

_SPACE = re.compile(rb"[ \t\r\n]*")
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]+|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_NUMBER_CHARS = re.compile(rb"[-+0-9.eE]*")
_ESCAPE = re.compile(rb"\\(?:u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.S)
_SURROGATE = re.compile(rb"\\u[dD][89a-fA-F]")
_SIMPLE = {b'"': b'"', b"\\": b"\\", b"/": b"/", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t"}
_QUOTED = re.compile(rb'["\\\x00-\x1f]')
#: Escapes of canonical output; other control bytes are written as \u00xx in lower case.
_OUT = {0x22: b'\\"', 0x5C: b"\\\\", 8: b"\\b", 12: b"\\f", 10: b"\\n", 13: b"\\r", 9: b"\\t"}

OBJECT_BEGIN, OBJECT_END, ARRAY_BEGIN, ARRAY_END, KEY, STRING, NUMBER, BOOL, NULL = (
    "object_begin", "object_end", "array_begin", "array_end", "key", "string", "number", "bool", "null",
)


class Event(NamedTuple):
    kind: str
    begin: int
    end: int
    depth: int


def fail(message: str, at: int, data: bytes, code: str = INVALID_JSON) -> JsonError:
    return JsonError(code, message, at, data)


def as_bytes(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass") if isinstance(value, str) else bytes(value)


def skip_space(data: bytes, at: int) -> int:
    return _SPACE.match(data, at).end()


def _string_end(data: bytes, at: int) -> int:
    m = _STRING.match(data, at)
    if not m:
        _explain_string(data, at)
    if _SURROGATE.search(data, at, m.end()):
        unescape(data, at, m.end())
    return m.end()


def _explain_string(data: bytes, at: int) -> None:
    i = at + 1
    while i < len(data):
        c = data[i]
        if c == 0x22:
            break
        if c < 0x20:
            raise fail("unescaped control character in string", i, data)
        if c == 0x5C:
            if i + 1 >= len(data):
                break
            if data[i + 1] == 0x75:
                if not re.match(rb"[0-9a-fA-F]{4}", data[i + 2 : i + 6]):
                    raise fail("invalid unicode escape", i, data)
                i += 6
                continue
            if data[i + 1 : i + 2] not in _SIMPLE:
                raise fail("invalid escape sequence", i, data)
            i += 1
        i += 1
    raise fail("unterminated string", len(data), data)


def unescape(data: bytes, begin: int, end: int) -> bytes:
    """The bytes of a string token (with its quotes). Surrogate escapes have to pair."""
    raw = data[begin + 1 : end - 1]
    if b"\\" not in raw:
        return raw

    def one(m: re.Match) -> bytes:
        if m[1]:
            return chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00).encode()
        if m[3]:
            code = int(m[3], 16)
            if 0xD800 <= code < 0xE000:
                raise fail("unpaired surrogate escape", begin + 1 + m.start(), data)
            return chr(code).encode()
        return _SIMPLE[m[4]]

    return _ESCAPE.sub(one, raw)


def quote(raw: bytes) -> bytes:
    """A canonical string token for arbitrary bytes."""
    if not _QUOTED.search(raw):
        return b'"' + raw + b'"'
    return b'"' + _QUOTED.sub(lambda m: _OUT.get(m[0][0]) or b"\\u%04x" % m[0][0], raw) + b'"'


def _number_end(data: bytes, at: int) -> int:
    m = _NUMBER.match(data, at)
    if not m or _NUMBER_CHARS.match(data, m.end()).end() != m.end():
        raise fail("invalid number", at, data)
    return m.end()


_LITERALS = {0x74: (b"true", BOOL), 0x66: (b"false", BOOL), 0x6E: (b"null", NULL)}


def walk(data: bytes, at: int = 0, limits: ValueLimits | None = None, unique_keys: bool = False) -> Iterator[Event]:
    """Events of one value at a position; KEY and STRING cover the token with its quotes. The
    last event ends the value. depth is that of the containers around the event."""
    most = limits.max_depth if limits else 1 << 30
    stack: list[list] = []  # [is object, keys seen or None]
    start = at
    at = skip_space(data, at)
    n = len(data)
    state = "value"
    while True:
        if limits and limits.max_total_bytes and at - start > limits.max_total_bytes:
            raise fail("value is larger than allowed", at, data, OVERFLOW)
        if at >= n:
            raise fail("unexpected end of input", n, data)
        c = data[at]
        if state in ("key", "key_or_end"):
            if c == 0x7D and state == "key_or_end":
                stack.pop()
                at += 1
                yield Event(OBJECT_END, at - 1, at, len(stack))
            elif c != 0x22:
                raise fail("expected object key", at, data)
            else:
                end = _string_end(data, at)
                if limits and end - at - 2 > limits.max_key_bytes and len(unescape(data, at, end)) > limits.max_key_bytes:
                    raise fail("key is longer than allowed", at, data, OVERFLOW)
                if unique_keys:
                    name = unescape(data, at, end)
                    if name in stack[-1][1]:
                        raise fail("duplicate object key", at, data, DUPLICATE_FIELD)
                    stack[-1][1].add(name)
                yield Event(KEY, at, end, len(stack))
                at = skip_space(data, end)
                if at >= n or data[at] != 0x3A:
                    raise fail("expected ':' after object key", at, data) if at < n else fail("unexpected end of input", n, data)
                at = skip_space(data, at + 1)
                state = "value"
                continue
        elif c == 0x5D and state == "value_or_end":
            stack.pop()
            at += 1
            yield Event(ARRAY_END, at - 1, at, len(stack))
        elif c in (0x7B, 0x5B):
            if len(stack) >= most:
                raise fail("nesting is deeper than allowed", at, data, OVERFLOW)
            is_object = c == 0x7B
            yield Event(OBJECT_BEGIN if is_object else ARRAY_BEGIN, at, at + 1, len(stack))
            stack.append([is_object, set() if unique_keys and is_object else None])
            at = skip_space(data, at + 1)
            state = "key_or_end" if is_object else "value_or_end"
            continue
        elif c == 0x22:
            end = _string_end(data, at)
            if limits and end - at - 2 > limits.max_string_bytes and len(unescape(data, at, end)) > limits.max_string_bytes:
                raise fail("string is longer than allowed", at, data, OVERFLOW)
            yield Event(STRING, at, end, len(stack))
            at = end
        elif c == 0x2D or 0x30 <= c <= 0x39:
            end = _number_end(data, at)
            if limits and end - at > limits.max_number_bytes:
                raise fail("number is longer than allowed", at, data, OVERFLOW)
            yield Event(NUMBER, at, end, len(stack))
            at = end
        elif c in _LITERALS and data.startswith(_LITERALS[c][0], at):
            word, kind = _LITERALS[c]
            yield Event(kind, at, at + len(word), len(stack))
            at += len(word)
        else:
            raise fail("expected a value", at, data)
        # after a complete value
        if not stack:
            return
        at = skip_space(data, at)
        if at >= n:
            raise fail("unexpected end of input", n, data)
        is_object = stack[-1][0]
        if data[at] == 0x2C:
            at = skip_space(data, at + 1)
            state = "key" if is_object else "value"
        elif data[at] == (0x7D if is_object else 0x5D):
            state = "key_or_end" if is_object else "value_or_end"
        else:
            raise fail(f"expected ',' or '{'}' if is_object else ']'}'", at, data)


def end_of(data: bytes, at: int, limits: ValueLimits | None = None, unique_keys: bool = False) -> int:
    """The end of the value at a position."""
    end = at
    for e in walk(data, at, limits, unique_keys):
        end = e.end
    return end


def only_space_after(data: bytes, at: int) -> None:
    if (at := skip_space(data, at)) < len(data):
        raise fail("trailing data after the value", at, data)


# --- whole documents --------------------------------------------------------------------


class _Fast(Exception):
    """The fast path cannot tell; the tokenizer decides."""


def _reject(_):
    raise _Fast


_decoder = json.JSONDecoder(parse_int=lambda s: None, parse_float=lambda s: None, parse_constant=_reject)


def _plainly_valid(data: bytes, limits: ValueLimits) -> bool:
    """Whether the C scanner accepts a text on which none of the limits can bear. False: unknown."""
    if len(data) > min(limits.max_key_bytes, limits.max_string_bytes) or data.count(b"[") + data.count(b"{") > limits.max_depth or _SURROGATE.search(data):
        return False
    if limits.max_total_bytes or len(data) > limits.max_number_bytes and re.search(rb"[-+0-9.eE]{%d}" % (limits.max_number_bytes + 1), data):
        return False
    try:
        text = data.decode()
        value_end = _decoder.raw_decode(text, _SPACE.match(data).end())[1] if text.isascii() else None
        if value_end is None:
            _decoder.decode(text)
            return True
        return skip_space(data, value_end) == len(data)
    except (ValueError, _Fast, RecursionError):
        return False


def validate(data: bytes, limits: ValueLimits | None = None) -> None:
    """Exactly one value and white space around it."""
    limits = limits or ValueLimits()
    if not _plainly_valid(data, limits):
        only_space_after(data, end_of(data, 0, limits))


_PIECES = re.compile(rb'("(?:[^"\\]|\\.)*")|[ \t\r\n]+', re.S)


def _reescape(token: bytes) -> bytes:
    return quote(unescape(token, 0, len(token))) if b"\\" in token else token


def compact(data: bytes, reescape: bool = False) -> bytes:
    """A valid text without white space: tokens are kept, or strings written anew."""
    if reescape:
        return _PIECES.sub(lambda m: _reescape(m[1]) if m[1] else b"", data)
    return _PIECES.sub(rb"\1", data) if re.search(rb"[ \t\r\n]", data) else data


_LOOSE_ESCAPE = re.compile(rb"\\u[dD][89a-fA-F][0-9a-fA-F]{2}")


def canonical(data: bytes, mode: str = "preserve_escapes", limits: ValueLimits | None = None) -> bytes:
    """Compact form of exactly one value. preserve_escapes keeps string tokens, does not ask
    surrogate escapes to pair and has no depth limit; reescape decodes and quotes strings
    anew under the limits."""
    if mode == "reescape":
        validate(data, limits)
        return compact(data, True)
    checked = _LOOSE_ESCAPE.sub(rb"\\u0000", data) if _LOOSE_ESCAPE.search(data) else data
    free = ValueLimits(max_depth=1 << 30, max_string_bytes=1 << 62, max_number_bytes=1 << 62, max_key_bytes=1 << 62)
    if not _plainly_valid(checked, ValueLimits()):
        only_space_after(checked, end_of(checked, 0, free))
    return compact(data)


def pretty(data: bytes, reescape: bool = False, limits: ValueLimits | None = None) -> bytes:
    """Two-space indent, one space after a key's colon, empty containers closed at once."""
    out, first, after_key = [], True, False
    last_end, empty = 0, False
    free = limits or ValueLimits(max_depth=1 << 30, max_string_bytes=1 << 62, max_number_bytes=1 << 62, max_key_bytes=1 << 62)
    for e in walk(data, 0, free):
        closing = e.kind in (OBJECT_END, ARRAY_END)
        if closing:
            if not empty:
                out.append(b"\n" + b"  " * e.depth)
        elif after_key:
            after_key = False
        elif e.depth:
            out.append((b"" if first else b",") + b"\n" + b"  " * e.depth)
        token = data[e.begin : e.end]
        out.append(_reescape(token) if reescape and e.kind in (KEY, STRING) else token)
        if e.kind == KEY:
            out.append(b": ")
            after_key = True
        first = empty = e.kind in (OBJECT_BEGIN, ARRAY_BEGIN)
        last_end = e.end
    only_space_after(data, last_end)
    return b"".join(out)


def type_of(data: bytes) -> str:
    kind = next(walk(data)).kind
    return {OBJECT_BEGIN: "object", ARRAY_BEGIN: "array"}.get(kind, kind)

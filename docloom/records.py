"""Decoding bytes to records of a schema, and encoding records to canonical JSON.

Records are plain dicts in the shape of the schema's StructType. Decoding has two paths with
one outcome: the C scanner of the standard library for texts it accepts, and the tokenizer,
which finds the first failure in byte order."""

from __future__ import annotations

import base64
import json
import re
from decimal import Decimal

from .limits import (
    DUPLICATE_FIELD, INVALID_ARGUMENT, INVALID_JSON, MISSING_REQUIRED_FIELD, OVERFLOW, TYPE_MISMATCH,
    JsonError, Limits, ValueLimits,
)
from .schema import DECODE_ONLY, ENCODE_ONLY, Field, Schema
from .strict import (
    ARRAY_BEGIN, ARRAY_END, BOOL, KEY, NULL, NUMBER, OBJECT_BEGIN, OBJECT_END, STRING,
    _SURROGATE, _Fast, _reject, compact, fail, only_space_after, quote, skip_space, unescape, validate, walk,
)

_QUOTED_TEXT = re.compile('["\\\\\x00-\x1f\ud800-\udfff]')
_INTEGER = re.compile(r"-?(?:0|[1-9][0-9]*)\Z")
_BASE64 = re.compile(rb"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\Z")
#: Limits of the mapped path: its own depth and string rules apply instead.
_FREE = ValueLimits(max_string_bytes=1 << 62, max_number_bytes=1 << 62, max_key_bytes=1 << 62)


class _Number(str):
    pass


class _Object(list):
    pass


_tree = json.JSONDecoder(object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_reject)


def zero(f: Field):
    """What a field holds when its key is missing or null."""
    if f.kind == "object":
        return {m.name: zero(m) for m in f.fields}
    if f.kind.endswith(("_array", "_items")):
        return []
    if f.presence or f.kind == "json_value" or (f.kind == "string" and f.max_bytes is None) or f.kind in ENCODE_ONLY:
        return None
    return {"string": "", "text_stream": "", "bytes_stream": b"", "i64": 0, "u64": Decimal(0), "f64": 0.0, "bool": False}[f.kind]


class Decoder:
    def __init__(self, schema: Schema, limits: Limits | None = None):
        self.schema, self.limits = schema, limits or Limits()
        self.walk_limits = ValueLimits(self.limits.max_depth, 1 << 62, 1 << 62, 1 << 62)
        self._maps: dict[int, dict] = {}
        self._read = self._compile(schema.fields)

    def decode(self, data: bytes, base: dict | None = None) -> tuple[dict, bool]:
        """(record, truncated). base: a record whose values stay where the text has no key."""
        if data.count(b"[") + data.count(b"{") <= self.limits.max_depth and not _SURROGATE.search(data):
            self.truncated = False
            try:
                node = _tree.decode(data.decode())
                if type(node) is _Object:
                    return self._read(node, base), self.truncated
            except (ValueError, JsonError, RecursionError, _Fast):
                pass  # again, for the position
        record, end, truncated = self.decode_at(data, 0, base)
        only_space_after(data, end)
        return record, truncated

    def read(self, node, to_bytes) -> dict:
        """The record of an object that is already a tree (of a document that is UTF-8 and within the
        depth limit); to_bytes gives the text of a node, which is read again for its failure."""
        self.truncated = False
        if type(node) is _Object:
            try:
                return self._read(node)
            except (JsonError, ValueError, RecursionError):
                pass
        return self.decode(to_bytes(node))[0]

    def decode_at(self, data: bytes, at: int, base: dict | None = None) -> tuple[dict, int, bool]:
        """The object at a position and its end."""
        self.truncated, self.data = False, data
        at = skip_space(data, at)
        if at < len(data) and data[at] != 0x7B:
            first = next(walk(data, at, self.walk_limits))  # a syntax error comes first
            raise fail("expected an object", first.begin, data, TYPE_MISMATCH)
        events = walk(data, at, self.walk_limits)
        next(events)
        record, end = self._object(events, self.schema.fields, base)
        return record, end, self.truncated

    def _map(self, fields: tuple[Field, ...]) -> dict[str, Field]:
        got = self._maps.get(id(fields))
        if got is None:
            got = self._maps[id(fields)] = {f.name: f for f in fields}
        return got

    def _start(self, fields, base):
        if base is None:
            return {f.name: zero(f) for f in fields}
        return {f.name: base.get(f.name, zero(f)) for f in fields}

    # tree path: one reader for each object type, built once

    def _compile(self, fields: tuple[Field, ...]):
        """A function (pairs, base) -> record for an object of these fields."""
        readers = {f.name: self._reader(f) for f in fields}
        zeros = [(f.name, zero(f)) for f in fields]
        plain = {n: z for n, z in zeros if not isinstance(z, (dict, list))}
        fresh = [f for f in fields if f.name not in plain]
        required = [f for f in fields if f.required]
        strict = self.limits.reject_duplicate_keys

        def read(pairs, base=None):
            out = dict(plain)
            for f in fresh:
                out[f.name] = zero(f)
            if base is not None:
                out.update((k, v) for k, v in base.items() if k in out)
            seen = set()
            for name, node in pairs:
                one = readers.get(name)
                if one is None:
                    continue
                if strict and name in seen:
                    raise JsonError(DUPLICATE_FIELD, f"duplicate field {name}")
                seen.add(name)
                out[name] = one(node, base and base.get(name))
            for f in required:
                if f.name not in seen:
                    raise JsonError(MISSING_REQUIRED_FIELD, f"missing required field {f.name}")
            return {f.name: out[f.name] for f in fields}

        return read

    def _reader(self, f: Field):
        """A function (node, base) -> value for one field."""
        kind = f.kind
        if kind == "json_value":
            return lambda node, base=None: _value_text(node, self.limits)
        if kind == "object":
            read = self._compile(f.fields)

            def one(node, base=None):
                if type(node) is _Object:
                    return read(node, base)
                if node is None:
                    return zero(f)
                raise self._mismatch(f, None)

            return one
        if kind.endswith(("_array", "_items")):
            item = self._reader(f.item)

            def many(node, base=None):
                if node is None:
                    return []
                if type(node) is not list:
                    raise self._mismatch(f, None)
                out = []
                for x in node:
                    if x is None or type(x) is list:
                        raise self._mismatch(f, None)
                    v = item(x)
                    if self._room(f, out, None):
                        out.append(v)
                return out

            return many
        if kind == "string" and f.max_bytes is None:
            most = self.limits.max_dynamic_string_bytes

            def string(node, base=None):
                if type(node) is str and "\0" not in node and len(node) * 4 <= most:
                    return node
                return self._any(f, node)

            return string
        if kind == "i64":

            def integer(node, base=None):
                if type(node) is _Number and len(node) < 19 and (node.isdigit() or _INTEGER.match(node)):
                    return int(node)
                return self._any(f, node)

            return integer
        return lambda node, base=None: self._any(f, node)

    def _any(self, f: Field, node):
        if node is None:
            return self._scalar(f, NULL, None, None)
        if type(node) is _Number:
            return self._scalar(f, NUMBER, node, None)
        if type(node) is str:
            return self._scalar(f, STRING, node.encode("utf-8", "surrogatepass"), None)
        if type(node) is bool:
            return self._scalar(f, BOOL, node, None)
        raise self._mismatch(f, None)

    # event path

    def _object(self, events, fields: tuple[Field, ...], base: dict | None) -> tuple[dict, int]:
        out, by_name, seen = self._start(fields, base), self._map(fields), set()
        for e in events:
            if e.kind == OBJECT_END:
                self._required(fields, seen, e.begin)
                return out, e.end
            name = unescape(self.data, e.begin, e.end).decode("utf-8", "replace")
            f = by_name.get(name)
            if f is None:
                self._skip(events, next(events))
                continue
            if name in seen and self.limits.reject_duplicate_keys:
                raise fail(f"duplicate field {name}", e.begin, self.data, DUPLICATE_FIELD)
            seen.add(name)
            out[name] = self._value(f, next(events), events, base and base.get(name))
        raise fail("unexpected end of input", len(self.data), self.data)

    @staticmethod
    def _skip(events, first) -> int:
        if first.kind not in (OBJECT_BEGIN, ARRAY_BEGIN):
            return first.end
        for e in events:
            if e.kind in (OBJECT_END, ARRAY_END) and e.depth == first.depth:
                return e.end
        return first.end

    def _value(self, f: Field, e, events, base=None):
        kind = f.kind
        if kind == "json_value":
            end = self._skip(events, e)
            text = self.data[e.begin : end]
            validate(text, self.limits.value)
            return compact(text, True).decode("utf-8", "replace")
        if e.kind == NULL:
            return self._scalar(f, NULL, None, e.begin)
        if kind == "object":
            if e.kind != OBJECT_BEGIN:
                raise self._mismatch(f, e.begin)
            return self._object(events, f.fields, base)[0]
        if kind.endswith(("_array", "_items")):
            if e.kind != ARRAY_BEGIN:
                raise self._mismatch(f, e.begin)
            item, out = f.item, []
            for x in events:
                if x.kind == ARRAY_END:
                    return out
                if x.kind in (NULL, ARRAY_BEGIN):
                    raise self._mismatch(f, x.begin)
                v = self._value(item, x, events)
                if self._room(f, out, x.begin):
                    out.append(v)
        if e.kind in (OBJECT_BEGIN, ARRAY_BEGIN):
            raise self._mismatch(f, e.begin)
        if e.kind == STRING:
            return self._scalar(f, STRING, unescape(self.data, e.begin, e.end), e.begin)
        token = self.data[e.begin : e.end].decode("ascii")
        return self._scalar(f, e.kind, token == "true" if e.kind == BOOL else token, e.begin)

    # rules of both

    def _mismatch(self, f: Field, at, why: str = "") -> JsonError:
        return JsonError(TYPE_MISMATCH, f"field {f.name} is not of kind {f.kind}{why}", at, getattr(self, "data", b"") if at is not None else b"")

    def _room(self, f: Field, out: list, at) -> bool:
        if f.max_items is None or len(out) < f.max_items:
            return True
        if f.overflow == "fail":
            raise JsonError(OVERFLOW, f"array {f.name} is longer than its capacity", at, self.data if at is not None else b"")
        self.truncated |= f.overflow == "truncate"
        return False

    def _required(self, fields, seen, at) -> None:
        for f in fields:
            if f.required and f.name not in seen:
                raise JsonError(MISSING_REQUIRED_FIELD, f"missing required field {f.name}", at, self.data if at is not None else b"")

    def _scalar(self, f: Field, kind: str, value, at):
        want = f.kind
        if kind == NULL:
            if want in ("i64", "u64", "f64", "bool") and not f.nullable or want in ENCODE_ONLY:
                raise self._mismatch(f, at)
            return zero(f)
        if want == "string" or want == "text_stream":
            if kind != STRING:
                raise self._mismatch(f, at)
            return self._text(f, value, at)
        if want == "bytes_stream":
            if kind != STRING:
                raise self._mismatch(f, at)
            if not _BASE64.match(value):
                raise JsonError(INVALID_JSON, f"field {f.name} is not base64", at, self.data if at is not None else b"")
            raw = base64.b64decode(value)
            self._spool(f, len(raw), at)
            return raw
        if want == "bool" and kind == BOOL:
            return value
        if kind == NUMBER and want in ("i64", "u64"):
            if not _INTEGER.match(value) or (want == "u64" and value[0] == "-") or len(value) > 21:
                raise self._mismatch(f, at)
            v = int(value)
            if not (0 <= v < 1 << 64 if want == "u64" else -(1 << 63) <= v < 1 << 63):
                raise self._mismatch(f, at, ": out of range")
            return Decimal(v) if want == "u64" else v
        if kind == NUMBER and want == "f64":
            v = float(value)
            digits = re.split("[eE]", value)[0]
            if v in (float("inf"), float("-inf")) or (abs(v) < 2.2250738585072014e-308 and re.search("[1-9]", digits)):
                raise self._mismatch(f, at, ": out of range")
            return v
        raise self._mismatch(f, at)

    def _spool(self, f: Field, size: int, at) -> None:
        spool = dict(self.limits.spool_classes).get(f.spool, self.limits.spool)
        if spool.max_bytes and size > spool.max_bytes:
            raise JsonError(OVERFLOW, f"field {f.name} is larger than its spool allows", at, self.data if at is not None else b"")

    def _text(self, f: Field, raw: bytes, at) -> str:
        if f.kind == "text_stream":
            self._spool(f, len(raw), at)
            return raw.decode("utf-8", "replace")
        if b"\0" in raw:
            raise self._mismatch(f, at, ": embedded NUL")
        if f.max_bytes is None:
            if len(raw) > self.limits.max_dynamic_string_bytes:
                raise JsonError(OVERFLOW, f"field {f.name} is longer than allowed", at, self.data if at is not None else b"")
        elif len(raw) > f.max_bytes:
            if f.overflow == "fail":
                raise JsonError(OVERFLOW, f"field {f.name} is longer than its capacity", at, self.data if at is not None else b"")
            self.truncated |= f.overflow == "truncate"
            # a cut inside a character would not be a string: it moves to the border before
            return raw[: f.max_bytes].decode("utf-8", "ignore")
        return raw.decode("utf-8", "replace")


def _value_text(node, limits: Limits) -> str:
    text = _dump(node)
    validate(text.encode("utf-8", "surrogatepass"), limits.value)
    return text


def _dump(node) -> str | None:
    """Canonical text of a tree, numbers as they stood."""
    if type(node) is _Number:
        return str(node)
    if type(node) is str:
        return quote(node.encode("utf-8", "surrogatepass")).decode()
    if type(node) is _Object:
        return "{" + ",".join(f"{_dump(k)}:{_dump(v)}" for k, v in node) + "}"
    if type(node) is list:
        return "[" + ",".join(map(_dump, node)) + "]"
    return {None: "null", True: "true", False: "false"}[node]


# --- encoding ---------------------------------------------------------------------------


def f64_text(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        raise JsonError(TYPE_MISMATCH, "a number is not finite")
    return f"{x:.17g}"


class Encoder:
    """Canonical text of records: schema order, omit rules, no white space (or pretty)."""

    def __init__(self, schema: Schema, limits: Limits | None = None, pretty: bool = False):
        for f in schema.fields:
            if f.kind in DECODE_ONLY:
                raise JsonError(INVALID_ARGUMENT, f"field {f.name} can only be decoded")
        self.schema, self.limits, self.pretty = schema, limits or Limits(), pretty

    def encode(self, record: dict) -> str:
        text = self._object(self.schema.fields, record, 0)
        if len(text) * 4 > self.limits.max_output_bytes and len(text.encode()) > self.limits.max_output_bytes:
            raise JsonError(OVERFLOW, "output is larger than allowed")
        return text

    def _wrap(self, parts: list[str], ends: str, depth: int) -> str:
        if not self.pretty or not parts:
            return ends[0] + ",".join(parts) + ends[1]
        pad = "\n" + "  " * (depth + 1)
        return ends[0] + pad + ("," + pad).join(parts) + "\n" + "  " * depth + ends[1]

    def _object(self, fields, record, depth: int) -> str:
        colon = ": " if self.pretty else ":"
        parts = []
        for f in fields:
            v = record.get(f.name)
            if v is None and f.presence or f.omit and not f.required and self.empty(f, v):
                continue
            parts.append(f.label + colon + self._value(f, v, depth + 1))
        return self._wrap(parts, "{}", depth)

    def empty(self, f: Field, v) -> bool:
        """Whether the field's omit rule applies."""
        if v is None:
            return True
        if f.omit != "empty":
            return False
        if f.kind == "object":
            return all((v.get(m.name) is None and m.presence) or (bool(m.omit) and not m.required and self.empty(m, v.get(m.name))) for m in f.fields)
        return not v if f.kind not in ("i64", "u64", "f64", "bool") else False

    def _value(self, f: Field, v, depth: int) -> str:
        kind = f.kind
        if kind == "object":
            return "null" if v is None else self._object(f.fields, v, depth)
        if kind.endswith("_array"):
            item = f.item
            return self._wrap([self._value(item, x, depth + 1) for x in v or ()], "[]", depth)
        if v is None:
            return {"i64": "0", "u64": "0", "f64": "0", "bool": "false"}.get(kind, "null")
        if kind in ("string", "text_stream", "text_source"):
            if not _QUOTED_TEXT.search(v):
                return f'"{v}"'
            return quote(v.encode("utf-8", "surrogatepass")).decode("utf-8", "replace")
        if kind in ("bytes_stream", "bytes_source"):
            return '"' + base64.b64encode(bytes(v)).decode() + '"'
        if kind == "bool":
            return "true" if v else "false"
        if kind == "f64":
            return f64_text(float(v))
        if kind == "json_value":
            return self._json(v, depth)
        return str(int(v))

    def _json(self, v: str, depth: int) -> str:
        from .strict import canonical, pretty

        raw = v.encode("utf-8", "surrogatepass")
        if not self.pretty:
            return canonical(raw).decode("utf-8", "replace")
        return pretty(raw).decode("utf-8", "replace").replace("\n", "\n" + "  " * depth)


def encode_any(value) -> str:
    """Schema-free: keys sorted, integers as they are, floats by 17 digits."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, Decimal)) and value == int(value):
        return str(int(value))
    if isinstance(value, (float, Decimal)):
        return f64_text(float(value))
    if isinstance(value, (bytes, bytearray)):
        return quote(bytes(value)).decode("utf-8", "replace")
    if isinstance(value, str):
        return quote(value.encode("utf-8", "surrogatepass")).decode("utf-8", "replace")
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode_any(str(k))}:{encode_any(value[k])}" for k in sorted(value, key=str)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(encode_any, value)) + "]"
    raise JsonError(TYPE_MISMATCH, f"no JSON for {type(value).__name__}")


__all__ = ["Decoder", "Encoder", "encode_any", "f64_text", "zero", "KEY"]

"""An event writer for use inside UDFs: checks the grammar, keeps number tokens, splices values."""

from __future__ import annotations

import base64
from collections.abc import Iterable

from .limits import INVALID_ARGUMENT, INVALID_JSON, JsonError, ValueLimits
from .records import Encoder, f64_text
from .schema import Schema
from .strict import _NUMBER, canonical, quote


class JsonWriter:
    """One root value; a key before each member; strings closed before anything else. After a
    failure every call fails. Duplicate keys are written as given."""

    def __init__(self, limits: ValueLimits | None = None):
        self.limits = limits or ValueLimits()
        self._out: list[bytes] = []
        self._stack: list[list] = []  # [kind "{" or "[", members so far, key pending]
        self._string: list[bytes] | None = None
        self._value: list[bytes] | None = None
        self._root = self._failed = False

    def _fail(self, message: str, code: str = INVALID_ARGUMENT):
        self._failed = True
        raise JsonError(code, message)

    def _before(self) -> None:
        if self._failed:
            raise JsonError(INVALID_ARGUMENT, "writer has failed before")
        if self._string is not None or self._value is not None:
            self._fail("a string or value is open")
        if not self._stack:
            if self._root:
                self._fail("a root value is already written")
            self._root = True
            return
        top = self._stack[-1]
        if top[0] == "{":
            if not top[2]:
                self._fail("a value needs a key")
            top[2] = False
        else:
            if top[1]:
                self._out.append(b",")
            top[1] += 1

    def _put(self, raw: bytes) -> JsonWriter:
        self._before()
        self._out.append(raw)
        return self

    def _open(self, kind: str) -> JsonWriter:
        if len(self._stack) >= self.limits.max_depth:
            self._fail("nesting is deeper than allowed")
        self._put(kind.encode())
        self._stack.append([kind, 0, False])
        return self

    def _close(self, kind: str, mark: bytes) -> JsonWriter:
        if self._failed or self._string is not None or self._value is not None or not self._stack or self._stack[-1][0] != kind or self._stack[-1][2]:
            self._fail("nothing of this kind can be closed here")
        self._stack.pop()
        self._out.append(mark)
        return self

    def begin_object(self) -> JsonWriter:
        return self._open("{")

    def end_object(self) -> JsonWriter:
        return self._close("{", b"}")

    def begin_array(self) -> JsonWriter:
        return self._open("[")

    def end_array(self) -> JsonWriter:
        return self._close("[", b"]")

    def key(self, name: str | bytes) -> JsonWriter:
        top = self._stack[-1] if self._stack else None
        if self._failed or self._string is not None or self._value is not None or not top or top[0] != "{" or top[2]:
            self._fail("a key can't stand here")
        raw = name.encode("utf-8", "surrogatepass") if isinstance(name, str) else name
        if len(raw) > self.limits.max_key_bytes:
            self._fail("key is longer than allowed", "overflow")
        self._out.append((b"," if top[1] else b"") + quote(raw) + b":")
        top[1] += 1
        top[2] = True
        return self

    def string(self, value: str | bytes) -> JsonWriter:
        return self._put(quote(value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value))

    def string_begin(self) -> JsonWriter:
        self._before()
        self._string = []
        return self

    def string_chunk(self, value: str | bytes) -> JsonWriter:
        if self._failed or self._string is None:
            self._fail("no string is open")
        self._string.append(value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value)
        return self

    def string_end(self) -> JsonWriter:
        if self._failed or self._string is None:
            self._fail("no string is open")
        self._out.append(quote(b"".join(self._string)))
        self._string = None
        return self

    def string_from(self, chunks: Iterable[bytes]) -> JsonWriter:
        self.string_begin()
        for c in chunks:
            self.string_chunk(c)
        return self.string_end()

    def base64(self, value: bytes) -> JsonWriter:
        return self._put(b'"' + base64.b64encode(value) + b'"')

    def number_text(self, token: str | bytes) -> JsonWriter:
        raw = token.encode() if isinstance(token, str) else token
        if not _NUMBER.fullmatch(raw):
            self._fail("not a JSON number", INVALID_JSON)
        return self._put(raw)

    def i64(self, value: int) -> JsonWriter:
        if not -(1 << 63) <= value < 1 << 63:
            self._fail("number is out of range")
        return self._put(b"%d" % value)

    def u64(self, value: int) -> JsonWriter:
        if not 0 <= value < 1 << 64:
            self._fail("number is out of range")
        return self._put(b"%d" % value)

    def f64(self, value: float) -> JsonWriter:
        try:
            text = f64_text(value)
        except JsonError:
            self._failed = True
            raise
        return self._put(text.encode())

    def boolean(self, value: bool) -> JsonWriter:
        return self._put(b"true" if value else b"false")

    def null(self) -> JsonWriter:
        return self._put(b"null")

    def json_value(self, text: str | bytes) -> JsonWriter:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        try:
            done = canonical(raw)
        except JsonError:
            self._failed = True
            raise
        return self._put(done)

    def value_begin(self) -> JsonWriter:
        """Open a value whose JSON text comes in chunks."""
        self._before()
        self._value = []
        return self

    def value_chunk(self, chunk: str | bytes) -> JsonWriter:
        if self._failed or self._value is None:
            self._fail("no value is open")
        self._value.append(chunk.encode("utf-8", "surrogatepass") if isinstance(chunk, str) else chunk)
        return self

    def value_end(self) -> JsonWriter:
        """Close it: the chunks have to be exactly one value."""
        if self._failed or self._value is None:
            self._fail("no value is open")
        raw, self._value = b"".join(self._value), None
        try:
            self._out.append(canonical(raw))
        except JsonError:
            self._failed = True
            raise
        return self

    def value_from(self, chunks: Iterable[bytes]) -> JsonWriter:
        """A value from a reader, a file or a spool."""
        self.value_begin()
        for c in chunks:
            self.value_chunk(c)
        return self.value_end()

    def array_items_from(self, chunks: Iterable[bytes], selector: str = "") -> JsonWriter:
        """The items of the array in a document that comes in chunks, each as soon as it is whole."""
        from .streaming import ItemSplitter

        if self._failed or not self._stack or self._stack[-1][0] != "[":
            self._fail("no array is open")
        splitter = ItemSplitter(selector)
        try:
            for c in chunks:
                for item in splitter.feed(c):
                    self._put(item)
            splitter.finish()
        except JsonError:
            self._failed = True
            raise
        return self

    def array_items(self, text: str | bytes, selector: str = "") -> JsonWriter:
        """Append the items of a document's array to the open array."""
        from .framing import array_items

        if not self._stack or self._stack[-1][0] != "[":
            self._fail("no array is open")
        for row in array_items(text.encode() if isinstance(text, str) else text, selector):
            if row["error"]["code"] != "ok":
                self._fail(row["error"]["message"], row["error"]["code"])
            self._put(row["value"].encode("utf-8", "surrogatepass"))
        return self

    def record(self, value: dict, schema: Schema) -> JsonWriter:
        return self._put(Encoder(schema).encode(value).encode("utf-8", "surrogatepass"))

    def finish(self) -> str:
        if self._failed or not self._root or self._stack or self._string is not None or self._value is not None:
            self._fail("the document is not complete")
        return b"".join(self._out).decode("utf-8", "replace")

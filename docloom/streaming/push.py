"""Push parsers: chunks of a byte stream per key arrive over micro-batches; complete values leave,
the rest waits as residual bytes in the state, bounded by max_residual.

A splitter's state is a JSON text and the residual, so it survives restarts. Any cut of the
stream into chunks gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..framing import SseState, array_items, read_header
from ..limits import INVALID_ARGUMENT, INVALID_JSON, OVERFLOW, TYPE_MISMATCH, JsonError, Limits, ValueLimits
from ..records import Decoder, Encoder
from ..schema import Schema
from ..strict import compact, end_of, only_space_after, skip_space, unescape, walk

_NEXT = re.compile(rb'["{}\[\],:]')
_IN_STRING = re.compile(rb'["\\]')
_SPACE = b" \t\r\n"


class _Scanner:
    """Scans bytes once; `depth` and string state carry over from chunk to chunk."""

    def __init__(self, max_residual: int):
        self.held, self.at, self.depth, self.quoted = b"", 0, 0, False
        self.start = 0  # what is before it has been taken
        self.max_residual = max_residual

    def add(self, chunk: bytes) -> None:
        self.settle()
        self.held += chunk
        if len(self.held) > self.max_residual:
            raise JsonError(OVERFLOW, "residual bytes are more than allowed")

    def settle(self) -> None:
        """Let go of the bytes that were taken: once a chunk, not once a value."""
        if self.start:
            self.held, self.at, self.start = self.held[self.start :], self.at - self.start, 0

    @property
    def lead(self) -> bytes:
        """The first byte that is neither taken nor white space."""
        at = skip_space(self.held, self.start)
        return self.held[at : at + 1]

    def marks(self) -> Iterator[tuple[int, int]]:
        """(byte, position) of structural bytes outside strings; quotes are reported when a
        string ends."""
        while True:
            if self.quoted:
                m = _IN_STRING.search(self.held, self.at)
                if not m:
                    self.at = len(self.held)
                    return
                if m[0] == b"\\":
                    if m.end() >= len(self.held):
                        self.at = m.start()
                        return
                    self.at = m.end() + 1
                    continue
                self.at, self.quoted = m.end(), False
                yield 0x22, m.start()
                continue
            m = _NEXT.search(self.held, self.at)
            if not m:
                self.at = len(self.held)
                return
            self.at = m.end()
            if m[0] == b'"':
                self.quoted = True
                continue
            yield m[0][0], m.start()

    def cut(self, at: int) -> bytes:
        """Take the bytes before a position out of the residual."""
        out, self.start = self.held[self.start : at], at
        return out

    def save(self) -> list:
        self.settle()
        return [self.at, self.depth, self.quoted]

    def load(self, saved: list, held: bytes) -> None:
        (self.at, self.depth, self.quoted), self.held, self.start = saved, held, 0


class ObjectSplitter:
    """Concatenated root objects."""

    def __init__(self, max_residual: int = 10 << 20):
        self.scan = _Scanner(max_residual)

    def _check_lead(self) -> None:
        if self.scan.lead not in (b"", b"{"):
            raise JsonError(INVALID_JSON, "expected top-level object")

    def feed(self, chunk: bytes) -> Iterator[bytes]:
        s = self.scan
        s.add(chunk)
        if not s.depth:
            self._check_lead()
        for c, at in s.marks():
            if c in b"{[":
                s.depth += 1
            elif c in b"}]":
                s.depth -= 1
                if s.depth <= 0:
                    yield s.cut(at + 1)
                    self._check_lead()

    def finish(self) -> None:
        if self.scan.lead:
            raise JsonError(INVALID_JSON, "unexpected end of input")

    def save(self) -> tuple[str, bytes]:
        return json.dumps(self.scan.save()), self.scan.held

    def load(self, text: str, held: bytes) -> None:
        self.scan.load(json.loads(text), held)


#: The longest part of a string token's inside that ends between characters and escapes.
_WHOLE = re.compile(rb'(?:[^"\\\x00-\x1f\x80-\xff]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|\\["\\/bfnrt]|\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})*')


class ItemSplitter:
    """Items of the root array or of the array under one root key. What stands outside the array is
    kept (an "outline" of the document with the array empty) and judged by the pull operator
    when the array begins and at the end, so any cut into chunks gives its rows and errors.

    check(raw) judges an item and gives its row's value. As in the pull operator an item leaves when
    the next one has begun or the array ends. pieces: string items leave in parts as they arrive,
    as (item, text, whether it ends)."""

    def __init__(self, selector: str = "", max_residual: int = 10 << 20, check=None, pieces: bool = False):
        self.selector, self.scan = selector, _Scanner(max_residual)
        self.check, self.pieces, self.outline = check or _raw_item, pieces, b""
        self.unique = getattr(self.check, "unique", True)
        self.state = "seek"  # seek, items, after
        self.key, self.base, self.comma, self.item = "", 0, False, 0
        self.waiting: bytes | None = None

    def _outside(self, raw: bytes) -> bytes:
        self.outline += raw
        if len(self.outline) > self.scan.max_residual:
            raise JsonError(OVERFLOW, "bytes outside the array are more than allowed")
        return raw

    def _judge(self, closing: bytes = b"") -> None:
        """Raise what the pull operator reports for the outline."""
        for row in array_items(self.outline + closing, self.selector):
            if row["error"]["code"] != "ok":
                raise JsonError(row["error"]["code"], row["error"]["message"])

    def feed(self, chunk: bytes) -> Iterator:
        s = self.scan
        s.add(chunk)
        for c, at in s.marks():
            if self.state == "items":
                if c in b"{[":
                    if s.depth == self.base and not s.held[s.start : at].strip(_SPACE):
                        yield from self._release()
                    s.depth += 1
                elif c == 0x2C and s.depth == self.base:
                    yield from self._item(s.cut(at + 1)[:-1], True)
                elif c in b"}]":
                    s.depth -= 1
                    if s.depth < self.base:
                        last = s.cut(at + 1)[:-1]
                        if c != 0x5D:
                            raise JsonError(INVALID_JSON, "expected ',' or ']'")
                        if last.strip(_SPACE) or self.comma:
                            yield from self._item(last, False)
                        yield from self._release()
                        self.state = "after"
                        self._outside(b"]")
                continue
            if c in b"{[":
                wanted = self.state == "seek" and c == 0x5B and (s.depth == 0 if not self.selector else s.depth == 1 and self.key == self.selector)
                s.depth += 1
                self._outside(s.cut(at + 1))
                if wanted:
                    self._judge(b"]}" if self.selector else b"]")
                    self.state, self.base = "items", s.depth
                elif self.state == "seek" and s.depth == 2 and self.selector and self.key == self.selector:
                    raise JsonError(TYPE_MISMATCH, "selected value is not an array")
            elif c in b"}]":
                s.depth -= 1
                self._outside(s.cut(at + 1))
            elif c == 0x3A and s.depth == 1:
                token = self._outside(s.cut(at + 1))[:-1].strip(_SPACE)
                try:
                    self.key = unescape(token, 0, len(token)).decode("utf-8", "replace")
                except (JsonError, KeyError):
                    self.key = ""  # the outline's judge will say
            elif c == 0x2C:
                self._outside(s.cut(at + 1))
        if self.pieces and self.state == "items" and s.quoted and s.depth == self.base:
            yield from self._piece()

    def _piece(self) -> Iterator:
        """What has arrived of an open string item; the rest stays as a string that begins anew."""
        s = self.scan
        begin = skip_space(s.held, s.start)
        if s.held[begin : begin + 1] != b'"':
            return
        end = _WHOLE.match(s.held, begin + 1).end()
        if end > begin + 1:
            text = unescape(b'"' + s.held[begin + 1 : end] + b'"', 0, end - begin + 1)
            at = s.at - end + 1
            s.held, s.start, s.at = b'"' + s.held[end:], 0, at
            yield self.item, text.decode("utf-8", "replace"), False

    def _item(self, raw: bytes, comma: bool) -> Iterator:
        self.comma = comma
        if self.pieces:
            yield self.item, self.check(raw), True
            self.item += 1
            return
        events = walk(raw, 0, ValueLimits(), self.unique)
        end = next(events).end
        yield from self._release()
        for e in events:
            end = e.end
        only_space_after(raw, end)
        self.waiting = raw

    def _release(self) -> Iterator:
        raw, self.waiting = self.waiting, None
        if raw is not None:
            yield self.check(raw)

    def finish(self) -> None:
        if self.state == "items":
            raise JsonError(INVALID_JSON, "unexpected end of input")
        self._outside(self.scan.cut(len(self.scan.held)))
        self._judge()

    def save(self) -> tuple[str, bytes]:
        state = [self.scan.save(), self.state, self.key, self.base, self.comma, self.item, len(self.outline), None if self.waiting is None else len(self.waiting)]
        return json.dumps(state), self.outline + (self.waiting or b"") + self.scan.held

    def load(self, text: str, held: bytes) -> None:
        scan, self.state, self.key, self.base, self.comma, self.item, n, more = json.loads(text)
        self.outline, self.waiting = held[:n], None if more is None else held[n : n + more]
        self.scan.load(scan, held[n + (more or 0) :])


def _raw_item(raw: bytes) -> bytes:
    return compact(raw.strip(_SPACE))


def _string_item(raw: bytes) -> str:
    raw = raw.strip(_SPACE)
    end = end_of(raw, 0, ValueLimits())
    if raw[:1] != b'"':
        raise JsonError(TYPE_MISMATCH, "selected array item is not a string")
    only_space_after(raw, end)
    return unescape(raw, 0, len(raw)).decode("utf-8", "replace")


class MultipartSplitter:
    """Parts of a multipart body, each whole. A part without a Content-Length waits for its
    boundary, within max_part_bytes."""

    def __init__(self, boundary: str, limits: Limits | None = None):
        self.limits, self.mark = (limits or Limits()).multipart, b"--" + boundary.encode()
        if not boundary or len(boundary.encode()) > self.limits.max_boundary_bytes:
            raise JsonError(OVERFLOW if boundary else INVALID_ARGUMENT, "multipart boundary is empty or longer than allowed")
        self.border = re.compile(rb"(?:\A|(?<=\n))" + re.escape(self.mark) + rb"(--)?\r?\n")
        self.held, self.state, self.part, self.end = b"", "border", None, False

    def _line(self, at: int, end: bool) -> tuple[bytes, int] | None:
        m = re.compile(rb"([^\r\n]*)(\r\n|\n|\r(?!\Z))" if not end else rb"([^\r\n]*)(\r\n|\r|\n|\Z)").match(self.held, at)
        size = len(m[1]) if m else len(self.held) - at
        if size > self.limits.max_header_line_bytes:
            raise JsonError(OVERFLOW, "multipart line is longer than allowed")
        return (m[1], m.end()) if m and at < len(self.held) else None

    def feed(self, chunk: bytes) -> Iterator[dict]:
        self.held += chunk
        yield from self._run(False)

    def _run(self, end: bool) -> Iterator[dict]:
        at = 0
        try:
            while self.state != "done":
                if self.state in ("border", "head"):
                    if not (got := self._line(at, end)):
                        return
                    line, at = got
                    if self.state == "border":
                        if line == self.mark + b"--":
                            self.state = "done"
                        elif line == self.mark:
                            self.part, self.state = {"name": None, "content_type": None, "content_length": -1, "headers": []}, "head"
                        elif line:
                            raise JsonError(INVALID_JSON, "unexpected multipart boundary line")
                    elif not line:
                        self.state = "body"
                    else:
                        if len(self.part["headers"]) >= self.limits.max_headers:
                            raise JsonError(OVERFLOW, "multipart part has more headers than allowed")
                        read_header(line, self.part)
                    continue
                size = self.part["content_length"]
                if size >= 0:
                    if len(self.held) < at + size:
                        return
                    body, at, self.state = self.held[at : at + size], at + size, "border"
                else:
                    rest = self.held[at:]
                    m = (re.compile(self.border.pattern.replace(rb"\r?\n", rb"\r?(?:\n|\Z)")) if end else self.border).search(rest)
                    if not m:
                        if len(rest) > self.limits.max_part_bytes + len(self.mark) + 8:
                            raise JsonError(OVERFLOW, "multipart part is larger than is held")
                        return
                    body, at = re.sub(rb"\r?\n\Z", b"", rest[: m.start()]), at + m.end()
                    self.state, next_part = ("done" if m[1] else "head"), {"name": None, "content_type": None, "content_length": -1, "headers": []}
                    done, self.part = self.part, next_part
                    yield {**done, "body": body}
                    continue
                yield {**self.part, "body": body}
        finally:
            self.held = self.held[at:]

    def finish(self) -> Iterator[dict]:
        yield from self._run(True)
        if self.state != "done":
            raise JsonError(INVALID_JSON, "multipart body ends before the closing boundary")

    def save(self) -> tuple[str, bytes]:
        return json.dumps([self.state, self.part]), self.held

    def load(self, text: str, held: bytes) -> None:
        (self.state, self.part), self.held = json.loads(text), held


class SseSplitter:
    """Server-sent events; a carriage return at a chunk's end waits for a line feed."""

    def __init__(self, limits: Limits | None = None):
        self.limits, self.state, self.held = (limits or Limits()).sse, SseState(), b""

    def feed(self, chunk: bytes) -> Iterator[dict]:
        data, at = self.held + chunk, 0
        for m in re.finditer(rb"([^\r\n]*)(\r\n|\n|\r(?!\Z))", data):
            if len(m[1]) > self.limits.max_line_bytes:
                raise JsonError(OVERFLOW, "SSE line is longer than allowed")
            at = m.end()
            if got := self.state.line(m[1], self.limits):
                yield got
        self.held = data[at:]
        if len(self.held) > self.limits.max_line_bytes + 1:
            raise JsonError(OVERFLOW, "SSE line is longer than allowed")

    def finish(self) -> Iterator[dict]:
        line, self.held = self.held.removesuffix(b"\r"), b""
        for got in (self.state.line(line, self.limits) if line else None, self.state.flush()):
            if got:
                yield got

    def save(self) -> tuple[str, bytes]:
        s = self.state
        text = [s.event.decode("latin-1"), s.id.decode("latin-1"), None if s.data is None else s.data.decode("latin-1"), s.retry, s.pending, s.late]
        return json.dumps(text), self.held

    def load(self, text: str, held: bytes) -> None:
        s, (event, id_, data, retry, pending, late) = self.state, json.loads(text)
        s.event, s.id, s.data = event.encode("latin-1"), id_.encode("latin-1"), None if data is None else data.encode("latin-1")
        s.retry, s.pending, s.late, self.held = retry, pending, late, held


def _push(df: DataFrame, key: str, chunk: str, order: str, make, row, fields: str, last: str | None) -> DataFrame:
    """Stateful operator: per key, chunks in `order` go through a splitter. `last` names a Boolean
    column that ends the key's stream. A failure ends it with an error row."""
    import pandas as pd

    names = [f.split()[0] for f in fields.split(", ")]

    def run(group, frames, state: GroupState):
        splitter, seq, over = make(), 0, False
        if state.exists:
            saved, held, seq, over = state.get
            splitter.load(saved, held)
        chunks = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        try:
            for r in chunks.itertuples(index=False):
                if over:
                    break
                for v in splitter.feed(bytes(getattr(r, chunk) or b"")):
                    out.append((group[0], seq, *row(v), None, None))
                    seq += 1
                if last and getattr(r, last):
                    over = True
                    for v in splitter.finish() or ():
                        out.append((group[0], seq, *row(v), None, None))
                        seq += 1
        except JsonError as e:
            over = True
            out.append((group[0], seq, *[None] * (len(names)), e.code, e.message))
        saved, held = splitter.save() if not over else ("", b"")
        state.update((saved, held, seq, over))
        yield pd.DataFrame(out, columns=[key, "seq", *names, "error_code", "error_message"])

    kind = df.schema[key].dataType.simpleString()
    chosen = df.select(key, chunk, order, *([last] if last else []))
    return chosen.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long, {fields}, error_code string, error_message string", "saved string, held binary, seq long, over boolean", "append", GroupStateTimeout.NoTimeout)


def object_check(schema, limits: Limits | None = None):
    """Bytes of an object -> canonical text of its record."""
    s = Schema.of(schema)
    decoder, encoder = Decoder(s, limits), Encoder(s)
    return lambda raw: encoder.encode(decoder.decode(raw)[0])


def item_check(mode: str = "text", schema=None, limits: Limits | None = None):
    """What ItemSplitter makes of an item."""
    if mode not in ("text", "strings") or (schema is not None and mode != "text"):
        raise JsonError(INVALID_ARGUMENT, f"unknown mode {mode}")
    if schema is None:
        return _string_item if mode == "strings" else lambda raw: _raw_item(raw).decode("utf-8", "replace")
    decode = object_check(schema, limits)

    def check(raw: bytes) -> str:
        raw = raw.strip(_SPACE)
        if raw[:1] != b"{":
            raise JsonError(TYPE_MISMATCH, "selected array item is not an object")
        return decode(raw)

    check.unique = False  # repeated keys are the decoder's matter
    return check


def push_objects(df: DataFrame, key: str, chunk: str, order: str, schema, last: str | None = None, limits: Limits | None = None, max_residual: int = 10 << 20) -> DataFrame:
    """key, seq, record (canonical text of the decoded record), error of object streams."""
    check = object_check(schema, limits)
    return _push(df, key, chunk, order, lambda: ObjectSplitter(max_residual), lambda raw: (check(raw),), "record string", last)


def push_items(df: DataFrame, key: str, chunk: str, order: str, selector: str = "", last: str | None = None, max_residual: int = 10 << 20, mode: str = "text", schema=None, limits: Limits | None = None) -> DataFrame:
    """key, seq, value, error of the items of one array of a chunked document. mode "text": the item's
    text; "strings": decoded string items. With a schema: canonical text of the decoded record."""
    check = item_check(mode, schema, limits)
    return _push(df, key, chunk, order, lambda: ItemSplitter(selector, max_residual, check), lambda v: (v,), "value string", last)


def push_string_chunks(df: DataFrame, key: str, chunk: str, order: str, selector: str = "", last: str | None = None, max_residual: int = 10 << 20) -> DataFrame:
    """key, seq, item, value, ends, error: the string items of one array in parts, as they arrive; the
    values of one item in the order of seq are its text, the last one has ends = true."""
    return _push(df, key, chunk, order, lambda: ItemSplitter(selector, max_residual, _string_item, True), lambda v: v, "item long, value string, ends boolean", last)


def push_multipart(df: DataFrame, key: str, chunk: str, order: str, boundary: str, last: str | None = None, limits: Limits | None = None) -> DataFrame:
    """key, seq, name, content_type, body, error of chunked multipart bodies with one boundary."""
    return _push(df, key, chunk, order, lambda: MultipartSplitter(boundary, limits), lambda p: (p["name"], p["content_type"], p["body"]), "name string, content_type string, body binary", last)


def push_sse(df: DataFrame, key: str, chunk: str, order: str, last: str | None = None, limits: Limits | None = None) -> DataFrame:
    """key, seq, event, id, data, retry_ms, error of chunked event streams."""
    return _push(df, key, chunk, order, lambda: SseSplitter(limits), lambda e: (e["event"], e["id"], e["data"], e["retry_ms"]), "event string, id string, data string, retry_ms double", last)

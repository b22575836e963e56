"""Byte streams to rows: candidates, objects, selected items, events, SSE, multipart, chunks.

Every function is a generator of dicts over one byte string. A failure ends the rows with a
last one that has only an error, after the rows delivered so far."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .limits import (
    INVALID_ARGUMENT, INVALID_JSON, MISSING_REQUIRED_FIELD, OVERFLOW, TYPE_MISMATCH,
    JsonError, Limits, MultipartLimits, SseLimits, ValueLimits, ok_row,
)
from .records import Decoder
from .strict import (
    ARRAY_BEGIN, ARRAY_END, BOOL, KEY, NUMBER, OBJECT_BEGIN, OBJECT_END, STRING,
    compact, end_of, fail, only_space_after, skip_space, unescape, walk,
)

AUTO, SINGLE, NDJSON, ARRAY_ITEMS = "auto", "single", "ndjson", "array"


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def candidates(data: bytes, framing: str = AUTO, limits: ValueLimits | None = None, payload: bool = True, max_items: int | None = None, max_payload_bytes: int | None = None) -> Iterator[dict]:
    """Values of a stream: index, stream_offset, byte_size (source bytes), payload (compact)."""
    limits = limits or ValueLimits()
    index = 0

    def row(at: int, end: int) -> dict:
        body = compact(data[at:end], True) if payload else None
        if body is not None and max_payload_bytes is not None and len(body) > max_payload_bytes:
            raise fail("payload is larger than allowed", at, data, OVERFLOW)
        return {"index": index, "stream_offset": at, "byte_size": end - at, "payload": _text(body) if body is not None else None, "error": ok_row()}

    try:
        if framing not in (AUTO, SINGLE, NDJSON, ARRAY_ITEMS):
            raise JsonError(INVALID_ARGUMENT, f"unknown framing {framing}")
        if max_items == 0:
            return
        at = skip_space(data, 0)
        if framing == AUTO:
            framing = ARRAY_ITEMS if data[at : at + 1] == b"[" else NDJSON
        if framing == ARRAY_ITEMS:
            for begin, end in _items(data, at, limits, False):
                yield row(begin, end)
                index += 1
                if index == max_items:
                    return
            return
        if framing == SINGLE:
            end = end_of(data, at, limits)
            only_space_after(data, end)
            yield row(at, end)
            return
        while at < len(data) and index != max_items:
            end = end_of(data, at, limits)
            after = skip_space(data, end)
            if after == end and end < len(data):
                raise fail("values must be separated by whitespace", end, data)
            yield row(at, end)
            index += 1
            at = after
    except JsonError as e:
        e.data = e.data or data
        yield {"index": index, "stream_offset": None, "byte_size": None, "payload": None, "error": e.row()}


def _items(data: bytes, at: int, limits: ValueLimits | None, unique: bool) -> Iterator[tuple[int, int]]:
    """Spans of a root array's items; each is yielded once the delimiter after it was read, and
    the end only after the array is known to be all there is."""
    events = walk(data, at, limits, unique)
    first = next(events)
    if first.kind != ARRAY_BEGIN:
        raise fail("expected an array", first.begin, data, TYPE_MISMATCH)
    begin = None
    for e in events:
        if begin is not None and e.depth == 1 and e.kind not in (OBJECT_END, ARRAY_END):
            yield begin, end
        if e.depth == 0:
            if begin is not None:
                yield begin, end
            only_space_after(data, e.end)
            return
        if e.depth == 1:
            if e.kind not in (OBJECT_END, ARRAY_END):
                begin = e.begin
            end = e.end


def objects(data: bytes, decoder: Decoder, max_items: int | None = None) -> Iterator[dict]:
    """Records of concatenated root objects; white space between them is optional."""
    seq, at = 0, skip_space(data, 0)
    try:
        while at < len(data) and (max_items is None or seq < max_items):
            if data[at] != 0x7B:
                raise fail("expected top-level object", at, data)
            begin = at
            record, at, truncated = decoder.decode_at(data, at)
            yield {"seq": seq, "stream_offset": begin, "record": record, "error": ok_row(truncated)}
            seq += 1
            at = skip_space(data, at)
    except JsonError as e:
        e.data = e.data or data
        yield {"seq": seq, "stream_offset": None, "record": None, "error": e.row()}


def array_items(data: bytes, selector: str | None = "", decoder: Decoder | None = None, limits: ValueLimits | None = None, max_items: int | None = None, strings: bool = False) -> Iterator[dict]:
    """Items of the root array ("") or of the array under one root key. With a decoder items
    are records; otherwise raw text (string tokens kept); strings: decoded string items."""
    limits = limits or ValueLimits()
    index = 0

    def row(begin: int, end: int) -> dict:
        out = {"index": index, "value": None, "record": None, "error": ok_row()}
        if decoder:
            if data[begin : begin + 1] != b"{":
                raise fail("selected array item is not an object", begin, data, TYPE_MISMATCH)
            out["record"], _, truncated = decoder.decode_at(data, begin)
            out["error"] = ok_row(truncated)
        elif strings:
            if data[begin : begin + 1] != b'"':
                raise fail("selected array item is not a string", begin, data, TYPE_MISMATCH)
            out["value"] = _text(unescape(data, begin, end))
        else:
            out["value"] = _text(compact(data[begin:end]))
        return out

    try:
        if max_items == 0:
            return
        for span in _selected(data, selector or "", limits, decoder is None):
            yield row(*span)
            index += 1
            if index == max_items:
                return
    except JsonError as e:
        e.data = e.data or data
        yield {"index": index, "value": None, "record": None, "error": e.row()}


def _selected(data: bytes, selector: str, limits: ValueLimits, unique: bool) -> Iterator[tuple[int, int]]:
    if not selector:
        yield from _items(data, 0, limits, unique)
        return
    if "." in selector or "[" in selector:
        raise JsonError(INVALID_ARGUMENT, "selector must be one root key")
    want, keys, found, inside = selector.encode(), set(), False, False
    begin = end = last = None
    for e in walk(data, 0, limits, unique):
        if last is None and e.kind != OBJECT_BEGIN:
            raise fail("expected an object", e.begin, data, TYPE_MISMATCH)
        last = e.end
        if inside:
            opens = e.kind not in (OBJECT_END, ARRAY_END)
            if e.depth == 2 and begin is not None and opens:
                yield begin, end
            if e.depth == 1:  # the selected array closes
                if begin is not None:
                    yield begin, end
                inside = False
            elif e.depth == 2:
                begin, end = (e.begin if opens else begin), e.end
            continue
        if e.depth == 1 and e.kind == KEY:
            name = unescape(data, e.begin, e.end)
            if name in keys:
                raise fail("duplicate object key", e.begin, data, "duplicate_field")
            keys.add(name)
            waiting = name == want
            at_key = e.begin
        elif e.depth == 1 and keys and waiting:
            waiting = False
            if e.kind != ARRAY_BEGIN:
                raise fail("selected value is not an array", e.begin, data, TYPE_MISMATCH)
            found = inside = True
        elif e.depth == 1 and not unique and e.kind in (OBJECT_END, ARRAY_END):
            end_of(data, skip_space(data, data.index(b":", at_key + len(name)) + 1), limits, True)  # members passed over
    only_space_after(data, last)
    if not found:
        raise JsonError(MISSING_REQUIRED_FIELD, f"no key {selector}")


def events(data: bytes, with_path: bool = True, limits: ValueLimits | None = None, only: tuple[str, ...] | None = None) -> Iterator[dict]:
    """Structural events in order. Keys have their parent's path, values their own."""
    limits = limits or ValueLimits()
    path: list = []  # decoded keys and item numbers
    kinds: list[bool] = []  # is array
    seq, last = 0, 0
    try:
        for e in walk(data, 0, limits):
            closing = e.kind in (OBJECT_END, ARRAY_END)
            if closing:
                kinds.pop()
                path.pop()
            elif kinds and kinds[-1] and e.kind != KEY:
                path[-1] += 1
            text = None
            if e.kind in (KEY, STRING):
                text = _text(unescape(data, e.begin, e.end))
            elif e.kind in (NUMBER, BOOL):
                text = _text(data[e.begin : e.end])
            own = path[:-1] if e.kind == KEY else path
            if only is None or e.kind in only:
                yield {"seq": seq, "event": e.kind, "depth": e.depth, "text": text, "path": [str(p) for p in own] if with_path else None, "error": ok_row()}
            seq += 1
            if e.kind == KEY:
                path[-1] = text
            elif e.kind in (OBJECT_BEGIN, ARRAY_BEGIN):
                kinds.append(e.kind == ARRAY_BEGIN)
                path.append(-1 if e.kind == ARRAY_BEGIN else "")
            last = e.end
        only_space_after(data, last)
    except JsonError as e:
        e.data = e.data or data
        yield {"seq": seq, "event": None, "depth": None, "text": None, "path": None, "error": e.row()}


SCALAR_EVENTS = (STRING, NUMBER, BOOL, "null")


def leaves(data: bytes, limits: ValueLimits | None = None) -> Iterator[dict]:
    """Scalars with their paths."""
    for n, e in enumerate(events(data, True, limits, SCALAR_EVENTS)):
        yield {"seq": n, "path": e["path"], "type": e["event"], "text": e["text"], "error": e["error"]}


# --- server-sent events and multipart ---------------------------------------------------

_LINE = re.compile(rb"([^\r\n]*)(\r\n|\r|\n|\Z)")


class SseState:
    """The event being built; it does not outlive a blank line."""

    def __init__(self):
        self.event, self.id, self.data, self.retry, self.pending, self.late = b"", b"", None, None, False, False

    def line(self, line: bytes, limits: SseLimits) -> dict | None:
        """Take one line; the event that it completes, if any."""
        if not line:
            return self.flush()
        if line[:1] == b":":
            return None
        name, _, value = line.partition(b":")
        value = value.removeprefix(b" ")
        if name == b"data":
            size = (len(self.data) + 1 if self.data is not None else 0) + len(value)
            if size > limits.max_event_data_bytes:
                raise JsonError(OVERFLOW, "SSE event data is larger than allowed")
            self.data = value if self.data is None else self.data + b"\n" + value
            self.pending = True
        elif name == b"event":
            self.event, self.pending, self.late = value, True, self.late or self.data is not None
        elif name == b"id" and b"\0" not in value:
            self.id, self.pending = value, True
        elif name == b"retry" and value.isdigit() and int(value) < 1 << 64:
            self.retry, self.pending = int(value), True
        return None

    def flush(self) -> dict | None:
        if not self.pending:
            return None
        data = self.data or b""
        out = {"event": _text(self.event), "id": _text(self.id), "data": _text(data), "data_len": len(data), "retry_ms": self.retry, "has_retry": self.retry is not None, "has_data": self.data is not None, "late_event": self.late}
        self.__init__()
        return out


_NO_SSE = {"event": None, "id": None, "data": None, "data_len": None, "retry_ms": None, "has_retry": None, "has_data": None, "late_event": None}


def sse_events(data: bytes, limits: SseLimits | None = None) -> Iterator[dict]:
    """Events of a text/event-stream body; a pending event also ends at the end of input."""
    limits, state, seq, at = limits or SseLimits(), SseState(), 0, 0
    try:
        while at < len(data):
            m = _LINE.match(data, at)
            if len(m[1]) > limits.max_line_bytes:
                raise JsonError(OVERFLOW, "SSE line is longer than allowed")
            at = m.end()
            if got := state.line(m[1], limits):
                yield {"seq": seq, **got, "error": ok_row()}
                seq += 1
        if got := state.flush():
            yield {"seq": seq, **got, "error": ok_row()}
    except JsonError as e:
        yield {"seq": seq, **_NO_SSE, "error": e.row()}


_PARAMETER = re.compile(r'[ \t]*([^=;]*?)[ \t]*(?:=[ \t]*(?:"((?:[^"\\]|\\.)*)"|("[^"]*$)|([^; \t]*))[^;]*)?(?:;|$)')


def _parameters(text: str) -> Iterator[tuple[str, str | None, bool]]:
    """(name, value, quoted) of a header's parameters; value None: an open quote."""
    for m in _PARAMETER.finditer(text):
        if m[3] is not None:
            yield m[1].lower(), None, True
        elif m[2] is not None:
            yield m[1].lower(), m[2], True
        elif m[4] is not None:
            yield m[1].lower(), m[4], False


def multipart_boundary(content_type: str, limits: MultipartLimits | None = None) -> bytes:
    limits = limits or MultipartLimits()
    for name, value, _ in _parameters(content_type.strip("; \t")):
        if value is None:
            raise JsonError(INVALID_ARGUMENT, "multipart boundary quote is not closed")
        if name == "boundary":
            if not value:
                raise JsonError(INVALID_ARGUMENT, "multipart boundary is empty")
            if len(value.encode()) > limits.max_boundary_bytes:
                raise JsonError(OVERFLOW, "multipart boundary is longer than allowed")
            return value.encode()
    raise JsonError(INVALID_ARGUMENT, "Content-Type has no boundary")


def read_header(line: bytes, part: dict) -> None:
    name, colon, value = line.decode("utf-8", "replace").partition(":")
    if not colon:
        raise JsonError(INVALID_JSON, "invalid multipart header line")
    value = value.strip(" \t")
    part["headers"].append({"name": name, "value": value})
    if name.lower() == "content-disposition":
        for key, got, quoted in _parameters(value.partition(";")[2]):
            if got is None:
                raise JsonError(INVALID_JSON, "multipart Content-Disposition is invalid")
            if key == "name":
                part["name"] = re.sub(r"\\(.)", r"\1", got) if quoted else got
                break
    elif name.lower() == "content-type":
        part["content_type"] = value
    elif name.lower() == "content-length":
        if not value.isascii() or not value.isdigit():
            raise JsonError(INVALID_JSON, "multipart Content-Length is invalid")
        if int(value) >= 1 << 63:
            raise JsonError(OVERFLOW, "multipart Content-Length is out of range")
        part["content_length"] = int(value)


_NO_PART = {"name": None, "content_type": None, "content_length": None, "headers": None, "body": None}


def multipart_parts(data: bytes, content_type: str, limits: MultipartLimits | None = None) -> Iterator[dict]:
    """Parts of a multipart body; parts with a Content-Length are counted, others end before
    the line break in front of a boundary line."""
    limits, seq, at = limits or MultipartLimits(), 0, 0

    def line() -> bytes:
        nonlocal at
        m = _LINE.match(data, at)
        if at >= len(data):
            raise JsonError(INVALID_JSON, "multipart body ends before the closing boundary")
        if len(m[1]) > limits.max_header_line_bytes:
            raise JsonError(OVERFLOW, "multipart line is longer than allowed")
        at = m.end()
        return m[1]

    try:
        mark = b"--" + multipart_boundary(content_type, limits)
        border = re.compile(rb"(?:\A|(?<=\n))" + re.escape(mark) + rb"(--)?\r?(?:\n|\Z)")
        expect = True
        while True:
            if expect:
                while not (got := line()):
                    pass
                if got == mark + b"--":
                    return
                if got != mark:
                    raise JsonError(INVALID_JSON, "unexpected multipart boundary line")
            part = {"name": None, "content_type": None, "content_length": -1, "headers": []}
            while got := line():
                if len(part["headers"]) >= limits.max_headers:
                    raise JsonError(OVERFLOW, "multipart part has more headers than allowed")
                read_header(got, part)
            if part["content_length"] >= 0:
                end = at + part["content_length"]
                if end > len(data):
                    raise JsonError(INVALID_JSON, "multipart body ends before the closing boundary")
                body, at, expect, closing = data[at:end], end, True, False
            else:
                m = border.search(data, at)
                if not m:
                    raise JsonError(INVALID_JSON, "multipart body ends before the closing boundary")
                body, at, expect, closing = re.sub(rb"\r?\n\Z", b"", data[at : m.start()]), m.end(), False, bool(m[1])
            yield {"seq": seq, **part, "body": body, "error": ok_row()}
            seq += 1
            if closing:
                return
    except JsonError as e:
        yield {"seq": seq, **_NO_PART, "error": e.row()}


def chunked(data: bytes, size: int) -> Iterator[dict]:
    """Pieces of at most `size` bytes."""
    if size <= 0:
        raise JsonError(INVALID_ARGUMENT, "chunk size must be positive")
    for n, at in enumerate(range(0, len(data), size)):
        yield {"chunk_no": n, "bytes": data[at : at + size], "eof": at + size >= len(data)}


__all__ = ["AUTO", "SINGLE", "NDJSON", "ARRAY_ITEMS", "candidates", "objects", "array_items", "events", "leaves", "sse_events", "multipart_parts", "multipart_boundary", "read_header", "chunked", "Limits"]

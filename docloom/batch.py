"""Many documents at once: one tokenizer over the bytes of a whole Arrow column.

Tokens(docs) reads texts whose strings have no escapes by vector operations and says in `ok`
which of them it has accepted: valid JSON within the limits, UTF-8, no key twice in one object.
It never reports an error. A text that it does not accept is read again, alone, by the row
tokenizer, which decides and finds the position of the failure."""

from __future__ import annotations

import json
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .limits import INVALID_ARGUMENT, JsonError, Limits, ValueLimits
from .records import _QUOTED_TEXT
from .rewriting import DROP, KEEP, REPLACE, Action, Context, as_raw, plain, read_tree
from .schema import Schema

#: Bytes of texts read together; a longer text goes to the row tokenizer.
PIECE = 1 << 20

# token types
OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA, STRING, SCALAR, KEY, START = range(10)
_SPACE, _OTHER = 20, 21
_CLASS = np.full(256, _OTHER, np.uint8)
for _c, _k in zip(b"{}[]:,", (OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA)):
    _CLASS[_c] = _k
_CLASS[list(b" \t\r\n")] = _SPACE
_CLASS[34] = STRING
#: What may follow (type before, type, container: 0 none, 1 object, 2 array).
_MAY = np.zeros((10, 10, 3), bool)
_VALUES = (OPEN_OBJECT, OPEN_ARRAY, STRING, SCALAR)
for _v in _VALUES:
    _MAY[START, _v, 0] = _MAY[OPEN_ARRAY, _v, 2] = _MAY[COMMA, _v, 2] = _MAY[COLON, _v, 1] = True
for _v in (CLOSE_OBJECT, CLOSE_ARRAY, STRING, SCALAR):
    _MAY[_v, COMMA, 1:] = _MAY[_v, CLOSE_OBJECT, 1] = _MAY[_v, CLOSE_ARRAY, 2] = True
_MAY[OPEN_OBJECT, KEY, 1] = _MAY[COMMA, KEY, 1] = _MAY[OPEN_OBJECT, CLOSE_OBJECT, 1] = _MAY[OPEN_ARRAY, CLOSE_ARRAY, 2] = _MAY[KEY, COLON, 1] = True
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)$"


def parts(lengths: np.ndarray):
    """(first, end) of runs of rows that are read together."""
    total, start = 0, 0
    sums = np.cumsum(lengths)
    while start < len(lengths):
        end = max(int(np.searchsorted(sums, total + PIECE, "right")), start + 1)
        yield start, end
        total, start = sums[end - 1], end


def binary(column: pa.Array) -> pa.Array:
    """A string or binary column as large_binary."""
    return column.cast(pa.large_binary())


def lengths_of(docs: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(docs), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bytes(docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large_binary array."""
    n, o = len(docs), docs.offset
    offsets = np.frombuffer(docs.buffers()[1], np.int64)[o : o + n + 1]
    body = docs.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and n else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: pa.DataType = pa.string(), valid: np.ndarray | None = None) -> pa.Array:
    """Byte ranges as a string or binary array."""
    size = end - begin
    if valid is not None:
        size = np.where(valid, size, 0)
    width = np.int64 if kind in (pa.large_binary(), pa.large_string()) else np.int32
    offsets = np.zeros(len(size) + 1, width)
    np.cumsum(size, out=offsets[1:])
    body = data[ranges(begin, size)]
    bits = pa.array(valid).buffers()[1] if valid is not None and not valid.all() else None
    return pa.Array.from_buffers(kind, len(size), [bits, pa.py_buffer(offsets), pa.py_buffer(body)])


class Tokens:
    """Tokens of the accepted texts. Arrays by token: kind, begin, end, doc (row of `docs`), depth (containers around it),
    parent (token that opens the container, -1 at the root), name (of keys) and member (name of the member that a
    value is, -1 elsewhere) by number in `names`."""

    def __init__(self, docs: pa.Array, limits: ValueLimits, max_depth: int | None = None):
        n = len(docs)
        self.ok = np.zeros(n, bool)
        size = lengths_of(docs)
        good = (size > 0) & (size <= PIECE) & (not limits.max_total_bytes)
        data, at = _bytes(docs)
        # texts with escapes, or with half a string, are not for here
        for mark, odd in ((92, False), (34, True)):
            found = np.flatnonzero(data == mark)
            count = np.searchsorted(found, at[1:]) - np.searchsorted(found, at[:-1])
            good &= count % 2 == 0 if odd else count == 0
        if docs.null_count:
            good &= docs.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(good)
        if len(rows) < n:
            docs = docs.take(pa.array(rows))
            data, at = _bytes(docs)
        self.data, self.rows = data, rows
        self._scan(data, at, limits, max_depth or limits.max_depth)
        self.ok[rows] = self.fine

    def _scan(self, b: np.ndarray, at: np.ndarray, limits: ValueLimits, max_depth: int) -> None:
        n = len(at) - 1
        fine = np.ones(n, bool)
        cls = _CLASS[b]
        quotes = np.flatnonzero(b == 34)
        first, last = quotes[0::2], quotes[1::2]
        inside = np.zeros(len(b) + 1, np.int8)
        inside[first] = 1
        inside[last] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)  # the first quote and the content
        cls[inside] = _SPACE
        cls[last] = _SPACE
        cls[first] = STRING
        other = cls == _OTHER
        before = np.empty_like(other)
        before[:1] = False
        before[1:] = other[:-1]
        before[at[:-1]] = False
        after = np.empty_like(other)
        after[-1:] = False
        after[:-1] = other[1:]
        after[at[1:] - 1] = False
        heads, tails = np.flatnonzero(other & ~before), np.flatnonzero(other & ~after) + 1
        cls[other] = _SPACE
        cls[heads] = SCALAR
        begin = np.flatnonzero(cls < _SPACE)
        kind = cls[begin]
        end = begin + 1
        end[kind == STRING] = last + 1
        end[kind == SCALAR] = tails
        count = np.searchsorted(begin, at[1:]) - np.searchsorted(begin, at[:-1])
        doc = np.repeat(np.arange(n), count)
        bad = lambda where: fine.__setitem__(doc[where], False)
        fine[count == 0] = False
        # bytes: no control characters in strings, UTF-8
        wrong = np.flatnonzero(inside & (b < 32))
        fine[np.searchsorted(at, wrong, "right") - 1] = False
        high = np.flatnonzero(b >= 128)
        if len(high):
            rows = np.unique(np.searchsorted(at, high, "right") - 1)
            for r in rows:
                try:
                    b[at[r] : at[r + 1]].tobytes().decode()
                except UnicodeDecodeError:
                    fine[r] = False
        # containers
        opens = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY)
        closes = (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
        step = opens.astype(np.int32) - closes
        level = np.cumsum(step)
        starts = np.cumsum(count) - count
        some = count > 0
        base = np.zeros(n, np.int64)
        base[some] = (level - step)[starts[some]]
        level -= base[doc].astype(level.dtype)
        depth = level - opens  # of containers around
        bad(depth < 0)
        bad(opens & (depth >= max_depth))
        whole = np.zeros(n, bool)
        whole[some] = level[(starts + count - 1)[some]] == 0
        fine &= whole
        parent = np.full(len(kind), -1, np.int64)
        use = fine[doc]
        deepest = int(depth[use].max()) if use.any() else 0
        opened = {}
        for d in range(deepest + 1):
            here = use & (depth == d)
            if d:
                up = opened[d - 1]
                inner = np.flatnonzero(here)
                parent[inner] = up[np.searchsorted(up, inner) - 1]
            opened[d] = np.flatnonzero(here & opens)
        opener = parent.copy()
        for d in range(deepest + 1):
            up = opened[d]
            inner = np.flatnonzero(use & closes & (depth == d))
            if len(inner):
                opener[inner] = up[np.searchsorted(up, inner) - 1]
        # grammar
        box = np.where(opener < 0, 0, np.where(kind[opener] == OPEN_OBJECT, 1, 2))
        prev = np.empty_like(kind)
        prev[:1] = START
        prev[1:] = kind[:-1]
        prev[starts[some]] = START
        key = (kind == STRING) & (box == 1) & ((prev == OPEN_OBJECT) | (prev == COMMA))
        kind[key] = KEY
        prev[1:][key[:-1]] = KEY
        prev[starts[some]] = START
        bad(~_MAY[prev, kind, box])
        # tokens
        scalars = np.flatnonzero(kind == SCALAR)
        texts = slices(b, begin[scalars], end[scalars], pa.binary())
        bad(scalars[~pc.match_substring_regex(texts, _SCALAR).to_numpy(zero_copy_only=False)])
        length = end - begin
        bad((kind == STRING) & (length - 2 > limits.max_string_bytes))
        bad((kind == KEY) & (length - 2 > limits.max_key_bytes))
        bad((kind == SCALAR) & (length > limits.max_number_bytes))
        # keys
        keys = np.flatnonzero((kind == KEY) & fine[doc])
        names = slices(b, begin[keys] + 1, end[keys] - 1, pa.binary()).dictionary_encode()
        self.names = names.dictionary.to_pylist()
        name = np.full(len(kind), -1, np.int64)
        name[keys] = names.indices.to_numpy(zero_copy_only=False)
        both = parent[keys] * (len(self.names) + 1) + name[keys]
        order = np.argsort(both, kind="stable")
        twice = order[1:][both[order[1:]] == both[order[:-1]]]
        bad(keys[twice])
        # only accepted texts, without commas and colons
        stay = fine[doc] & (kind != COLON) & (kind != COMMA)
        number = np.cumsum(stay) - 1
        remap = lambda x: np.where(x >= 0, number[x], -1)[stay]
        self.fine = fine
        self.begin, self.end, self.kind, self.depth = begin[stay], end[stay], kind[stay], depth[stay]
        self.doc = self.rows[doc[stay]] if len(self.rows) else doc[stay]
        self.parent, self.opener = remap(parent), remap(opener)
        self.name = name[stay]
        self.member = np.full(len(self.kind), -1, np.int64)
        after_key = np.flatnonzero(self.kind[:-1] == KEY) + 1 if len(self.kind) else np.empty(0, np.int64)
        self.member[after_key] = self.name[after_key - 1]
        self._spaces = cls, inside, last, at

    def is_value(self) -> np.ndarray:
        return (self.kind != KEY) & (self.kind != CLOSE_OBJECT) & (self.kind != CLOSE_ARRAY)

    def close_of(self) -> np.ndarray:
        """For opening tokens the token that closes them, for others themselves."""
        out = np.arange(len(self.kind))
        closing = np.flatnonzero((self.kind == CLOSE_OBJECT) | (self.kind == CLOSE_ARRAY))
        out[self.opener[closing]] = closing
        return out

    def compacted(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes without white space between tokens, their number before each position)."""
        _, inside, last, _ = self._spaces
        b = self.data
        keep = ~((b == 32) | (b == 9) | (b == 10) | (b == 13)) | inside
        if keep.all():
            return b, np.arange(len(b) + 1)
        at = np.zeros(len(b) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        return b[keep], at

    def find(self, name: str) -> int:
        raw = name.encode("utf-8", "surrogatepass")
        return self.names.index(raw) if raw in self.names else -2

    def texts(self, which: np.ndarray, kind: pa.DataType = pa.string(), valid: np.ndarray | None = None) -> pa.Array:
        """The texts of tokens, those of strings and keys without quotes."""
        q = ((self.kind[which] == STRING) | (self.kind[which] == KEY)).astype(np.int64)
        return slices(self.data, self.begin[which] + q, self.end[which] - q, kind, valid)

    def reject(self, tokens: np.ndarray) -> None:
        """Leave the texts of these tokens to the row tokenizer."""
        self.ok[self.doc[tokens]] = False

    def items(self, selector: str, only: int | None = None) -> np.ndarray:
        """Values in the selected root array, in order; texts without it are rejected."""
        roots = np.flatnonzero(self.depth == 0)
        roots = roots[self.is_value()[roots]]
        if selector:
            self.reject(roots[self.kind[roots] != OPEN_OBJECT])
            found = np.flatnonzero((self.depth == 1) & (self.member == self.find(selector)))
            has = np.zeros(len(self.ok), bool)
            has[self.doc[found]] = True
            self.ok &= has
        else:
            found = roots
        self.reject(found[self.kind[found] != OPEN_ARRAY])
        chosen = np.zeros(len(self.kind) + 1, bool)
        chosen[found] = True
        chosen[-1] = False
        return np.flatnonzero(chosen[self.parent] & self.is_value())

    # records

    def records(self, objects: np.ndarray, schema: Schema, limits: Limits) -> pa.StructArray:
        """The records of opening tokens; texts that the schema does not plainly fit are rejected."""
        self.reject(objects[self.kind[objects] != OPEN_OBJECT])
        slot = np.full(len(self.kind) + 1, -1, np.int64)
        slot[objects] = np.arange(len(objects))
        slot[-1] = -1
        of = slot[self.parent]  # which object a member is in
        columns = []
        for f in schema.fields:
            hit = np.flatnonzero((of >= 0) & (self.member == self.find(f.name))) if objects.size else np.empty(0, np.int64)
            token = np.full(len(objects), -1, np.int64)
            token[of[hit]] = hit
            there = token >= 0
            if f.required:
                self.reject(objects[~there])
            columns.append(self._field(f, token, there, limits))
        return pa.StructArray.from_arrays(columns, [f.name for f in schema.fields])

    def _field(self, f, token: np.ndarray, there: np.ndarray, limits: Limits) -> pa.Array:
        got = token[there]
        kind = self.kind[got]
        if f.kind == "i64":
            self.reject(got[kind != SCALAR])
            size = self.end[got] - self.begin[got]
            head = self.data[self.begin[got]]
            plain = (kind == SCALAR) & (size < 19) & ((head <= 57) & (head >= 48) | (head == 45))
            value = np.zeros(len(token), np.int64)
            texts = slices(self.data, self.begin[got[plain]], self.end[got[plain]])
            whole = pc.match_substring_regex(texts, "^-?[0-9]+$").to_numpy(zero_copy_only=False)
            self.reject(got[~plain])
            self.reject(got[plain][~whole])
            number = np.zeros(len(got), np.int64)
            at = np.flatnonzero(plain)[whole]
            number[at] = texts.filter(pa.array(whole)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            value[there] = number
            return pa.array(value, mask=~there if f.presence and not there.all() else None)
        if f.kind == "string":
            null = (kind == SCALAR) & (self.data[self.begin[got]] == 110) if len(got) else np.zeros(0, bool)
            self.reject(got[(kind != STRING) & ~null])
            self.reject(got[(self.end[got] - self.begin[got] - 2) > limits.max_dynamic_string_bytes])
            valid = there.copy()
            valid[there] = kind == STRING
            return self.texts(np.where(token >= 0, token, 0), pa.string(), valid) if len(self.kind) else pa.nulls(len(token), pa.string())
        # an array of objects
        self.reject(got[kind != OPEN_ARRAY])
        slot = np.full(len(self.kind) + 1, -1, np.int64)
        slot[token[there]] = np.flatnonzero(there)
        slot[-1] = -1
        items = np.flatnonzero((slot[self.parent] >= 0) & self.is_value())
        # the objects are in the order of the text, and so are their arrays
        offsets = np.zeros(len(token) + 1, np.int32)
        np.cumsum(np.bincount(slot[self.parent[items]], minlength=len(token)), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), self.records(items, Schema(f.fields), limits))


def plain_schema(fields) -> bool:
    """Whether Tokens.records reads a schema."""
    for f in fields:
        if f.kind == "i64" or f.kind == "string" and f.max_bytes is None:
            continue
        if f.kind == "object_array" and f.max_items is None and plain_schema(f.fields):
            continue
        return False
    return len({f.name for f in fields}) == len(fields) > 0


def _places(tokens: Tokens, items: np.ndarray) -> np.ndarray:
    """The number of each value in its container; values of one container stand in order."""
    parent = tokens.parent[items]
    order = np.argsort(parent, kind="stable")
    sorted_ = parent[order]
    start = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(items) else np.empty(0, np.int64)
    rank = np.arange(len(items)) - np.repeat(start, np.diff(np.r_[start, len(items)]))
    out = np.empty(len(items), np.int64)
    out[order] = rank
    return out


def _odd(text: str):
    raise ValueError(text)


#: Integers become ints; a fraction, an exponent or NaN raises ValueError.
_load = json.JSONDecoder(parse_float=_odd, parse_constant=_odd).decode
_dump = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
#: A longer text is not for the C scanner here: one value of it could be beyond a limit.
SHORT = 1 << 16


class Flat:
    """Documents as the C scanner reads them: an object whose selected member is an array of flat objects
    with the same members. It accepts only what Tokens would accept, with the same result: no escapes,
    fractions or exponents, and as many colons as members, so that no key stands twice, no string has a
    colon and no other object is inside."""

    def __init__(self, selector: str, schema: Schema | None, limits: Limits):
        v = limits.value
        self.selector, self.names, self.kinds = selector, None, None
        depth = min(limits.max_depth, v.max_depth) if schema else v.max_depth
        self.fit = bool(selector) and depth >= 3 and not v.max_total_bytes and v.max_number_bytes >= 19
        self.most = min(SHORT, v.max_string_bytes, v.max_key_bytes, limits.max_dynamic_string_bytes)
        if schema:
            self.names, self.kinds = [f.name for f in schema.fields], [f.kind for f in schema.fields]
            self.fit &= set(self.kinds) <= {"i64", "string"}
            pick = itemgetter(*self.names)
            self.pick = pick if len(self.names) > 1 else lambda item: (pick(item),)

    def read(self, docs: pa.Array):
        """(row of the document of each item, number of items of each accepted document, its row, values of the
        fields or texts of the items, rows that are left)."""
        counts, rows, left, values = [], [], [], []
        for i, d in enumerate(docs.to_pylist()):
            if d is None or not self._one(d, values, counts):
                left.append(i)
            else:
                rows.append(i)
        return np.array(counts, np.int64), np.array(rows, np.int64), values, left

    def _one(self, d: bytes, values: list, counts: list) -> bool:
        if len(d) > self.most or b"\\" in d or b"-0" in d:
            return False
        try:
            root = _load(d.decode())
            if type(root) is not dict or type(items := root[self.selector]) is not list:
                return False
            if not set(map(type, items)) <= _DICT or len(root) + sum(map(len, items)) != d.count(b":"):
                return False
            # lists inside of lists could be deep, and numbers long
            if d.count(b"[") + d.count(b"{") != 2 + len(items) or (self.names is None and not all(map(_short, chain([root], items)))):
                return False
            if self.names is None:
                if items:
                    texts = _dump(items)[2:-2].split("},{")
                    if len(texts) != len(items):
                        return False
                    values += texts
            else:
                if not _short(root):
                    return False
                got = list(map(self.pick, items))
                for column, kind in zip(zip(*got), self.kinds):
                    if not set(map(type, column)) <= _TYPES[kind]:
                        return False
                    if kind == "i64" and column and (max(column) >= _MOST or min(column) <= -_MOST):
                        return False
                if sum(map(len, items)) != len(self.names) * len(items) and not all(map(_short, items)):
                    return False
                values += got
        except (ValueError, KeyError, RecursionError):
            return False
        counts.append(len(items))
        return True


_DICT, _MOST = {dict}, 10**17
_TYPES = {"i64": {int}, "string": {str, type(None)}}


def _short(members: dict) -> bool:
    """Whether no number is long."""
    for v in members.values():
        if type(v) is int and not -_MOST < v < _MOST:
            return False
    return True


def item_rows(docs: pa.Array, selector: str, schema: Schema | None, limits: Limits):
    """(accepted, row of the document, columns index and value or record) of an array's items. Documents that
    Flat accepts come first, then those that Tokens accepts."""
    flat = Flat(selector, schema, limits)
    if not flat.fit:
        return _item_rows(docs, selector, schema, limits)
    counts, rows, values, left = flat.read(docs)
    at = np.repeat(rows, counts)
    index = pa.array(np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts))
    if schema is None:
        column = pa.array(["{" + x + "}" for x in values], pa.string())
    else:
        fields = list(zip(*values)) or [()] * len(flat.names)
        column = pa.StructArray.from_arrays([pa.array(c, pa.int64() if k == "i64" else pa.string()) for c, k in zip(fields, flat.kinds)], flat.names)
    ok = np.ones(len(docs), bool)
    if not left:
        return ok, at, [index, column]
    left = np.array(left)
    ok[left], more, columns = _item_rows(docs.take(pa.array(left)), selector, schema, limits)
    return ok, np.concatenate([at, left[more]]), [pa.concat_arrays([a, b if b.type == a.type else b.cast(a.type)]) for a, b in zip([index, column], columns)]


def _item_rows(docs: pa.Array, selector: str, schema: Schema | None, limits: Limits):
    """(accepted, row of the document, columns index and value or record) of an array's items."""
    tokens = Tokens(docs, limits.value, min(limits.max_depth, limits.value.max_depth) if schema else None)
    items = tokens.items(selector)
    if schema:
        column = tokens.records(items, schema, limits)
    else:
        data, at = tokens.compacted()
        column = slices(data, at[tokens.begin[items]], at[tokens.end[tokens.close_of()[items]]])
    index = _places(tokens, items)
    stay = tokens.ok[tokens.doc[items]]
    if stay.all():
        return tokens.ok, tokens.doc[items], [pa.array(index), column]
    return tokens.ok, tokens.doc[items][stay], [pa.array(index[stay]), column.filter(pa.array(stay))]


_EVENT_NAMES = pa.array(["object_begin", "object_end", "array_begin", "array_end", "key", "string", "number", "bool", "null"])


def _paths(tokens: Tokens, which: np.ndarray) -> pa.Array:
    """Lists of keys and item numbers: keys have their parent's path, closing tokens their container's."""
    node = np.where(tokens.kind == KEY, tokens.parent, np.where((tokens.kind == CLOSE_OBJECT) | (tokens.kind == CLOSE_ARRAY), tokens.opener, np.arange(len(tokens.kind))))[which]
    in_array = np.flatnonzero(tokens.is_value() & (tokens.member < 0) & (tokens.parent >= 0))
    code = tokens.member.copy()
    places = _places(tokens, in_array)
    most = int(places.max()) + 1 if len(places) else 0
    code[in_array] = places + len(tokens.names)
    pool = pa.concat_arrays([pa.array(tokens.names, pa.binary()).cast(pa.string()), pa.array(np.arange(most)).cast(pa.string())])
    size = np.where(node >= 0, tokens.depth[node], 0)
    offsets = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    flat = np.zeros(offsets[-1], np.int64)
    row = np.flatnonzero(size > 0)
    now, left = node[row], size[row]
    while len(row):
        left = left - 1
        flat[offsets[row] + left] = code[now]
        more = left > 0
        row, left, now = row[more], left[more], tokens.parent[now[more]]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pool.take(pa.array(flat)))


def event_rows(docs: pa.Array, limits: ValueLimits, with_path: bool, only: tuple[str, ...] | None, numbered: bool):
    """(accepted, row of the document, columns seq, event, depth, text, path). numbered: seq counts the chosen
    events, not all."""
    tokens = Tokens(docs, limits)
    kind = np.zeros(len(tokens.kind), np.int64)
    for token, name in ((OPEN_OBJECT, 0), (CLOSE_OBJECT, 1), (OPEN_ARRAY, 2), (CLOSE_ARRAY, 3), (KEY, 4), (STRING, 5), (SCALAR, 6)):
        kind[tokens.kind == token] = name
    scalars = np.flatnonzero(tokens.kind == SCALAR)
    head = tokens.data[tokens.begin[scalars]]
    kind[scalars[(head == 116) | (head == 102)]] = 7
    kind[scalars[head == 110]] = 8
    chosen = np.arange(len(kind)) if only is None else np.flatnonzero(np.isin(kind, [i for i, n in enumerate(_EVENT_NAMES.to_pylist()) if n in only]))
    doc = tokens.doc
    seq_of = chosen if numbered else np.arange(len(kind))
    d = doc[seq_of]
    start = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.empty(0, np.int64)
    seq = np.arange(len(d)) - np.repeat(start, np.diff(np.r_[start, len(d)]))
    seq = seq if numbered else seq[chosen]
    named = np.isin(kind[chosen], (4, 5, 6, 7))
    return tokens.ok, doc[chosen], [
        pa.array(seq), _EVENT_NAMES.take(pa.array(kind[chosen])), pa.array(tokens.depth[chosen].astype(np.int32)),
        tokens.texts(chosen, pa.string(), named), _paths(tokens, chosen) if with_path else pa.nulls(len(chosen), pa.list_(pa.string())),
    ]


# --- rewriting ----------------------------------------------------------------------------

_PLAIN = (str, int, float, bool, type(None))


class Rewriting:
    """array_rewrite of many documents: arrays are found and texts put together by vector operations, rules
    are judged once for each different value. accepts() says whether the arguments are for here."""

    def __init__(self, segments: list[tuple[str, bool]], rules, append, schema: Schema | None, limits: Limits):
        self.segments, self.rules, self.schema, self.limits = segments, rules, schema, limits
        self.free = callable(rules)
        self.fit = not callable(append) and not (self.free and len(segments) > 1)
        if schema:
            self.fit &= plain_schema(schema.fields) and limits.max_depth >= limits.value.max_depth
        if not self.fit:
            return
        try:
            self.more = [as_raw(v, schema) for v in append or ()]
            self.actions = [] if self.free else [self._parts(r.action) for r in rules]
            for text in self.more + [x for parts in self.actions for x in parts if x is not None]:
                text.encode()
        except (JsonError, UnicodeEncodeError):
            self.fit = False  # an error of the documents that come to it
        if not self.free:
            self.fit &= all(isinstance(v, _PLAIN) for r in rules for v in [*r.where.values(), *r.parent.values()])

    def _parts(self, a: Action) -> list[str | None]:
        """The texts that an item becomes, None for itself."""
        if a.kind not in (KEEP, DROP, REPLACE):
            raise JsonError(INVALID_ARGUMENT, f"unknown action {a.kind}")
        own = [None] if a.kind == KEEP else [as_raw(a.replacement, self.schema)] if a.kind == REPLACE else []
        return [as_raw(v, self.schema) for v in a.before] + own + [as_raw(v, self.schema) for v in a.after]

    def rows(self, docs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(accepted, rows of the accepted documents, their new texts)."""
        tokens = Tokens(docs, self.limits.value)
        arrays, inside = self._arrays(tokens)
        items = np.flatnonzero(_among(tokens, arrays)[tokens.parent] & tokens.is_value())
        record = tokens.records(items, self.schema, self.limits) if self.schema else None
        stay = tokens.ok[tokens.doc[items]]
        if not stay.all():
            items = items[stay]
            record = record.filter(pa.array(stay)) if record is not None else None
        data, at = tokens.compacted()
        close = tokens.close_of()
        begin, end = at[tokens.begin[items]], at[tokens.end[close[items]]]
        made = self._free(tokens, items, record, data, begin, end) if self.free else self._ruled(tokens, items, record, inside)
        left = tokens.ok[tokens.doc[arrays]]
        arrays = arrays[left]
        if not len(arrays):
            tokens.ok[:] = False
            return tokens.ok, np.empty(0, np.int64), pa.array([], pa.string())
        which, own, text, pool = made
        number = np.full(len(tokens.kind) + 1, -1, np.int64)
        number[arrays] = np.arange(len(arrays))
        array = number[tokens.parent[items[which]]]
        # pieces of one buffer: the documents, the new texts, a comma
        pool = pa.array([*pool, *self.more, ","], pa.large_string())
        bodies, edges = _bytes(pool.cast(pa.large_binary()))
        edges = edges + len(data)
        whole = np.concatenate([data, bodies])
        first = np.where(own, begin[which], edges[text])[array >= 0]
        last = np.where(own, end[which], edges[text + 1])[array >= 0]
        array = array[array >= 0]
        if self.more:
            k, n = len(self.more), len(pool) - 1 - len(self.more)
            array = np.concatenate([array, np.repeat(np.arange(len(arrays)), k)])
            first = np.concatenate([first, np.tile(edges[n : n + k], len(arrays))])
            last = np.concatenate([last, np.tile(edges[n + 1 : n + k + 1], len(arrays))])
            order = np.argsort(array, kind="stable")
            array, first, last = array[order], first[order], last[order]
        count = np.bincount(array, minlength=len(arrays))
        place = np.arange(len(array)) - np.repeat(np.cumsum(count) - count, count)
        doc = tokens.doc[arrays]
        ends_doc = np.r_[doc[1:] != doc[:-1], True]
        starts_doc = np.r_[True, ends_doc[:-1]]
        pieces = 1 + count + np.maximum(count - 1, 0) + ends_doc
        start = np.cumsum(pieces) - pieces
        root = np.full(len(docs), -1, np.int64)
        top = np.flatnonzero((tokens.depth == 0) & tokens.is_value())
        root[tokens.doc[top]] = top
        a, b = np.empty(pieces.sum(), np.int64), np.empty(pieces.sum(), np.int64)
        shut = at[tokens.begin[close[arrays]]]
        a[start] = np.where(starts_doc, at[tokens.begin[root[doc]]], np.r_[0, shut[:-1]])
        b[start] = at[tokens.end[arrays]]
        a[start[array] + 1 + 2 * place], b[start[array] + 1 + 2 * place] = first, last
        later = (start[array] + 2 * place)[place > 0]
        a[later], b[later] = edges[-2], edges[-1]
        tail = (start + pieces - 1)[ends_doc]
        a[tail], b[tail] = shut[ends_doc], at[tokens.end[close[root[doc[ends_doc]]]]]
        size = np.add.reduceat(b - a, start[starts_doc])
        ends = np.cumsum(size)
        return tokens.ok, doc[ends_doc], slices(whole[ranges(a, b - a)], ends - size, ends)

    def _arrays(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The selected arrays, and for each token the object of a selected array that it is (-1 elsewhere);
        texts in which the selector fails are rejected."""
        nodes = np.flatnonzero((tokens.depth == 0) & tokens.is_value())
        inside = np.full(len(tokens.kind) + 1, -1, np.int64)
        for name, fan in self.segments:
            nodes = nodes[tokens.kind[nodes] == OPEN_OBJECT]
            found = np.flatnonzero(_among(tokens, nodes)[tokens.parent] & (tokens.member == tokens.find(name)))
            inside = np.full(len(tokens.kind) + 1, -1, np.int64)
            inside[found] = tokens.parent[found]
            if fan:
                tokens.reject(found[tokens.kind[found] != OPEN_ARRAY])
                found = np.flatnonzero(_among(tokens, found)[tokens.parent] & tokens.is_value())
            nodes = found
        tokens.reject(nodes[tokens.kind[nodes] != OPEN_ARRAY])
        has = np.zeros(len(tokens.ok), bool)
        has[tokens.doc[nodes]] = True
        tokens.ok &= has
        return nodes[tokens.kind[nodes] == OPEN_ARRAY], inside

    def _ruled(self, tokens: Tokens, items: np.ndarray, record, inside: np.ndarray):
        """(item, whether it is the item itself, number in the pool) of each new item, and the pool."""
        choice = np.full(len(items), len(self.rules), np.int64)
        for r in range(len(self.rules) - 1, -1, -1):
            rule, meets = self.rules[r], np.ones(len(items), bool)
            if rule.where and record is None:
                meets &= tokens.kind[items] == OPEN_OBJECT
            for k, v in rule.where.items():
                if record is None:
                    meets &= _equal(tokens, _members(tokens, items, k), v)
                elif k in record.type.names:
                    meets &= _same(record.field(k), v)
                else:
                    meets &= v is None
            arrays = tokens.parent[items]
            for k, v in rule.parent.items():
                if len(self.segments) <= 1:
                    meets &= v is None
                    continue
                got = _members(tokens, inside[arrays], k)
                meets &= _equal(tokens, np.where(got < arrays, got, -1), v)
            choice[meets] = r
        parts = [*self.actions, [None]]
        pool = [x for p in parts for x in p if x is not None]
        most = max(map(len, parts))
        own, text = np.zeros((len(parts), most + 1), bool), np.zeros((len(parts), most + 1), np.int64)
        n = 0
        for i, p in enumerate(parts):
            for j, x in enumerate(p):
                own[i, j], text[i, j] = x is None, 0 if x is None else n
                n += x is not None
        count = np.array([len(p) for p in parts])[choice]
        which = np.repeat(np.arange(len(items)), count)
        j = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return which, own[choice[which], j], text[choice[which], j], pool

    def _free(self, tokens: Tokens, items: np.ndarray, record, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """The same by calls."""
        if record is not None:
            names = record.type.names
            values = [dict(zip(names, v)) for v in zip(*(c.to_pylist() for c in record.flatten()))]
        else:
            values = [plain(read_tree(x)) for x in slices(data, begin, end).to_pylist()]
        which, text, new = [], [], []

        def put(i: int, values) -> None:
            for v in values:
                which.append(i)
                text.append(len(new))
                new.append(v)

        for i, (value, index) in enumerate(zip(values, _places(tokens, items).tolist())):
            try:
                a = self.rules(value, Context(index))
            except (JsonError, RecursionError):
                tokens.reject(items[i : i + 1])
                continue
            put(i, a.before)
            if a.kind == REPLACE:
                put(i, (a.replacement,))
            elif a.kind == KEEP:
                which.append(i)
                text.append(-1)
            elif a.kind != DROP:
                tokens.reject(items[i : i + 1])
            put(i, a.after)
        which, text = np.array(which, np.int64), np.array(text, np.int64)
        pool = self._texts(new)
        failed = np.flatnonzero([x is None for x in pool])
        if len(failed):
            tokens.reject(items[which[np.isin(text, failed)]])
            pool = [x or "" for x in pool]
        return which, text < 0, np.maximum(text, 0), pool

    def _texts(self, values: list) -> list[str | None]:
        """The texts of new items, None for those that fail. Records of integers and strings are written
        field by field."""
        out = [None] * len(values)
        fields = self.schema.fields if self.schema else ()
        if fields and all(f.kind in ("i64", "string") and not f.presence and not f.omit for f in fields):
            rows = [i for i, v in enumerate(values) if type(v) is dict]
            quoted: dict = {}
            members = []
            for f in fields:
                column = [values[i].get(f.name) for i in rows]
                if f.kind == "i64":
                    members.append([str(v) if type(v) is int else None for v in column])
                    continue
                for v in {v for v in column if type(v) is str}:
                    quoted[v] = None if _QUOTED_TEXT.search(v) else f'"{v}"'
                members.append([quoted[v] if type(v) is str else None for v in column])
            form = "{" + ",".join(f.label.replace("%", "%%") + ":%s" for f in fields) + "}"
            most = Limits().max_output_bytes // 4
            for i, m in zip(rows, zip(*members)):
                if None not in m and len(text := form % m) <= most:
                    out[i] = text
        for i, v in enumerate(values):
            if out[i] is None:
                try:
                    text = as_raw(v, self.schema)
                    text.encode()
                    out[i] = text
                except (JsonError, RecursionError, UnicodeEncodeError):
                    pass
        return out


def _among(tokens: Tokens, chosen: np.ndarray) -> np.ndarray:
    """Whether each token (and, last, none) is one of the chosen."""
    out = np.zeros(len(tokens.kind) + 1, bool)
    out[chosen] = True
    return out


def _members(tokens: Tokens, objects: np.ndarray, name: str) -> np.ndarray:
    """The member of this name of each object, -1 where there is none."""
    of = np.full(len(tokens.kind) + 1, -1, np.int64)
    hit = np.flatnonzero(tokens.member == tokens.find(name))
    of[tokens.parent[hit]] = hit
    of[-1] = -1
    return of[objects]


def _same(column: pa.Array, value) -> np.ndarray:
    """Python's equality of each value, asked once for each different one; lists equal no plain value."""
    if pa.types.is_nested(column.type):
        return np.zeros(len(column), bool)
    coded = column.dictionary_encode()
    equal = np.array([*(x == value for x in coded.dictionary.to_pylist()), value is None], bool)
    return equal[pc.fill_null(coded.indices, len(equal) - 1).to_numpy(zero_copy_only=False)]


def _equal(tokens: Tokens, members: np.ndarray, value) -> np.ndarray:
    """The same for members of documents; -1 is None."""
    there = members >= 0
    got = members[there]
    out = np.full(len(members), value is None)
    coded = slices(tokens.data, tokens.begin[got], tokens.end[got]).dictionary_encode()
    equal = np.array([x not in ("{", "[") and plain(read_tree(x)) == value for x in coded.dictionary.to_pylist()], bool)
    out[there] = equal[coded.indices.to_numpy(zero_copy_only=False)] if len(got) else False
    return out

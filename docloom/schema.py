"""Record schemas: declared up front, never inferred.

A Schema is an ordered set of fields with rules; struct() gives the Spark type, whose field
metadata carries the rules, so that a StructType alone is enough to decode and encode."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from .limits import INVALID_ARGUMENT, JsonError
from .strict import quote

U64 = T.DecimalType(20, 0)

#: kind -> Spark type of one value; arrays and objects are built from these.
SCALARS = {
    "string": T.StringType(), "i64": T.LongType(), "u64": U64, "f64": T.DoubleType(), "bool": T.BooleanType(),
    "text_stream": T.StringType(), "bytes_stream": T.BinaryType(), "text_source": T.StringType(),
    "bytes_source": T.BinaryType(), "json_value": T.StringType(),
}
ARRAYS = {
    "string_array": "string", "i64_array": "i64", "u64_array": "u64", "f64_array": "f64", "bool_array": "bool",
    "object_array": "object", "string_items": "string", "object_items": "object",
}
KINDS = (*SCALARS, "object", *ARRAYS)
#: Decoding accepts these only as input to encoding, or the other way round.
ENCODE_ONLY = ("text_source", "bytes_source")
DECODE_ONLY = ("string_items", "object_items")
OVERFLOWS = ("fail", "truncate", "truncate_silent")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    omit: str = ""  # "", "null" or "empty" (which implies null)
    presence: bool = False
    nullable: bool = False
    max_bytes: int | None = None  # fixed capacity of a string
    overflow: str = "fail"
    spool: str = ""
    max_items: int | None = None  # fixed capacity of an array
    fields: tuple[Field, ...] = ()

    def check(self) -> None:
        bad = lambda why: JsonError(INVALID_ARGUMENT, f"invalid field layout: {self.name}: {why}")
        if self.kind not in KINDS:
            raise bad(f"unknown kind {self.kind}")
        if self.presence and self.kind not in ("i64", "u64", "f64", "bool"):
            raise bad("presence is for i64, u64, f64 and bool")
        if self.nullable and not self.presence:
            raise bad("nullable needs presence")
        if self.required and (self.omit or self.presence or self.nullable):
            raise bad("a required field can't be omitted or absent")
        if self.omit not in ("", "null", "empty"):
            raise bad(f"unknown omit rule {self.omit}")
        if self.overflow not in OVERFLOWS:
            raise bad(f"unknown overflow policy {self.overflow}")
        if (self.max_bytes is not None and (self.max_bytes < 0 or self.kind != "string")) or (self.max_items is not None and self.kind not in ARRAYS):
            raise bad("capacity does not fit the kind")
        if bool(self.fields) != (self.kind in ("object", "object_array", "object_items")):
            raise bad("members are for objects")
        for f in self.fields:
            f.check()

    @property
    def item(self) -> Field:
        """The field of an array's items."""
        got = self.__dict__.get("_item")
        if got is None:
            got = replace(self, kind=ARRAYS[self.kind], required=False, omit="", max_items=None)
            object.__setattr__(self, "_item", got)  # kept: it is asked for once a record
        return got

    @property
    def label(self) -> str:
        """The key as a JSON string."""
        got = self.__dict__.get("_label")
        if got is None:
            got = quote(self.name.encode("utf-8", "surrogatepass")).decode("utf-8", "replace")
            object.__setattr__(self, "_label", got)
        return got

    def type(self) -> T.DataType:
        if self.kind in SCALARS:
            return SCALARS[self.kind]
        if self.kind == "object":
            return T.StructType([f.struct_field() for f in self.fields])
        return T.ArrayType(self.item.type(), True)

    def struct_field(self) -> T.StructField:
        rules = {"kind": self.kind, "required": self.required, "omit": self.omit, "presence": self.presence, "nullable": self.nullable, "max_bytes": self.max_bytes, "overflow": self.overflow, "spool": self.spool, "max_items": self.max_items}
        return T.StructField(self.name, self.type(), True, {k: v for k, v in rules.items() if v not in (None, False, "")})

    @classmethod
    def of(cls, f: T.StructField) -> Field:
        m = dict(f.metadata or {})
        t = f.dataType
        members: tuple[Field, ...] = ()
        kind = m.pop("kind", None)
        if isinstance(t, T.ArrayType):
            inner = t.elementType
            kind = kind or ("object_array" if isinstance(inner, T.StructType) else _kind(inner) + "_array")
            members = tuple(map(cls.of, inner.fields)) if isinstance(inner, T.StructType) else ()
        elif isinstance(t, T.StructType):
            kind, members = kind or "object", tuple(map(cls.of, t.fields))
        return cls(f.name, kind or _kind(t), fields=members, **{k: v for k, v in m.items() if k in cls.__dataclass_fields__})


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "i64"
    if isinstance(t, T.DecimalType) and t.scale == 0:
        return "u64"
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "f64"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BinaryType):
        return "bytes_stream"
    raise JsonError(INVALID_ARGUMENT, f"no JSON kind for {t.simpleString()}")


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    name: str = "record"

    def check(self) -> Schema:
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise JsonError(INVALID_ARGUMENT, "invalid field layout: repeated key")
        for f in self.fields:
            f.check()
        return self

    def struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def plain(self) -> T.StructType:
        """The type without the rules: what comes out of a UDF (Arrow carries no metadata)."""

        def bare(t: T.DataType) -> T.DataType:
            if isinstance(t, T.StructType):
                return T.StructType([T.StructField(f.name, bare(f.dataType)) for f in t.fields])
            return T.ArrayType(bare(t.elementType)) if isinstance(t, T.ArrayType) else t

        return bare(self.struct())

    def only(self, *names: str) -> Schema:
        """The schema pruned to some fields: decoding skips the others."""
        return replace(self, fields=tuple(f for f in self.fields if f.name in names))

    def json(self) -> str:
        return json.dumps(self.struct().jsonValue())

    @classmethod
    def of(cls, given) -> Schema:
        """From a Schema, a StructType, a DDL string, or fields."""
        if isinstance(given, Schema):
            return given.check()
        if isinstance(given, str):
            given = T._parse_datatype_string(given)
        if isinstance(given, T.StructType):
            return cls(tuple(map(Field.of, given.fields))).check()
        return cls(tuple(given)).check()


def _maker(kind: str):
    def make(name: str, **rules) -> Field:
        return Field(name, kind, **rules)

    make.__name__ = kind
    make.__doc__ = f"A field of kind {kind}."
    return make


string, i64, u64, f64, boolean = (_maker(k) for k in ("string", "i64", "u64", "f64", "bool"))
string_array, i64_array, u64_array, f64_array, bool_array = (_maker(f"{k}_array") for k in ("string", "i64", "u64", "f64", "bool"))
spooled_text, spooled_bytes, text_source, bytes_source, json_value, string_items = (_maker(k) for k in ("text_stream", "bytes_stream", "text_source", "bytes_source", "json_value", "string_items"))


def _members(kind: str):
    def make(name: str, *fields: Field, **rules) -> Field:
        return Field(name, kind, fields=fields, **rules)

    make.__name__ = kind
    return make


obj, object_array, object_items = (_members(k) for k in ("object", "object_array", "object_items"))


def schema(*fields: Field, name: str = "record") -> Schema:
    return Schema(fields, name).check()

"""Limits and policies of a run, and the status codes that operators report.

All limits count bytes. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

OK = "ok"
INVALID_ARGUMENT = "invalid_argument"
INVALID_JSON = "invalid_json"
TYPE_MISMATCH = "type_mismatch"
MISSING_REQUIRED_FIELD = "missing_required_field"
DUPLICATE_FIELD = "duplicate_field"
OVERFLOW = "overflow"
TRUNCATED = "truncated"
ALLOCATION_FAILED = "allocation_failed"
CALLBACK_FAILED = "callback_failed"
IO_ERROR = "io_error"
INTERNAL_ERROR = "internal_error"

#: In the order of their numeric codes.
STATUSES = (
    OK, INVALID_ARGUMENT, INVALID_JSON, TYPE_MISMATCH, MISSING_REQUIRED_FIELD, DUPLICATE_FIELD,
    OVERFLOW, TRUNCATED, ALLOCATION_FAILED, CALLBACK_FAILED, IO_ERROR, INTERNAL_ERROR,
)


class JsonError(Exception):
    """A failure with its status; at is a 0-based byte position, or None."""

    def __init__(self, code: str, message: str, at: int | None = None, data: bytes = b""):
        super().__init__(message)
        self.code, self.message, self.at, self.data = code, message, at, data

    def row(self, truncated: bool = False) -> dict:
        """The error column's value: 1-based line, column and offset in bytes."""
        line = column = offset = None
        if self.at is not None:
            head = self.data[: self.at]
            line = head.count(b"\n") + 1
            column = self.at - (head.rfind(b"\n") + 1) + 1
            offset = self.at + 1
        return {"code": self.code, "line": line, "column": column, "offset": offset, "truncated": truncated, "message": self.message[:159]}


def ok_row(truncated: bool = False) -> dict:
    """The error column's value of a success (one shared dict for each case; not to be changed)."""
    return _CUT if truncated else _FINE


_FINE, _CUT = ({"code": OK, "line": None, "column": None, "offset": None, "truncated": t, "message": None} for t in (False, True))


@dataclass(frozen=True)
class SpoolClass:
    memory_limit: int = 64 << 10
    max_bytes: int = 10 << 20


@dataclass(frozen=True)
class ValueLimits:
    """Limits of arbitrary values: visits, candidates, rewrites, json_value fields."""

    max_depth: int = 64
    max_string_bytes: int = 1 << 20
    max_number_bytes: int = 256
    max_key_bytes: int = 64 << 10
    max_total_bytes: int = 0  # 0: unlimited


@dataclass(frozen=True)
class SseLimits:
    max_line_bytes: int = 64 << 10
    max_event_data_bytes: int = 1 << 20


@dataclass(frozen=True)
class MultipartLimits:
    max_boundary_bytes: int = 200
    max_header_line_bytes: int = 64 << 10
    max_headers: int = 64
    max_part_bytes: int = 1 << 20  # of a pushed part that waits for its boundary


@dataclass(frozen=True)
class Limits:
    """Captured by the closures of one Engine; never changes during a query."""

    max_depth: int = 64
    reject_duplicate_keys: bool = True
    max_dynamic_string_bytes: int = 128 << 10
    max_output_bytes: int = 8 << 20
    value: ValueLimits = field(default_factory=ValueLimits)
    spool: SpoolClass = field(default_factory=SpoolClass)
    spool_classes: tuple[tuple[str, SpoolClass], ...] = ()
    sse: SseLimits = field(default_factory=SseLimits)
    multipart: MultipartLimits = field(default_factory=MultipartLimits)

    def check(self) -> Limits:
        for name in ("max_depth", "max_dynamic_string_bytes", "max_output_bytes"):
            if getattr(self, name) <= 0:
                raise JsonError(INVALID_ARGUMENT, f"{name} must be positive")
        return self

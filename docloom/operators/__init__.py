"""Table operators: one document in, rows out."""

from .tables import (  # noqa: F401
    array_items, candidates, chunks, json_events, json_leaves, multipart_parts, object_stream, register, sse_events, sse_json,
)

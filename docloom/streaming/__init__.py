"""Resumable parsing of chunked streams in Structured Streaming."""

from .push import (  # noqa: F401
    ItemSplitter, MultipartSplitter, ObjectSplitter, SseSplitter, push_items, push_multipart, push_objects, push_sse, push_string_chunks,
)

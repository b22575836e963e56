"""Sources and sinks of JSON documents."""

from .files import read_candidates, read_documents, read_items, read_jsonl, read_objects, rewrite_files, rewrite_lines, scratch, write_files, write_jsonl, write_text  # noqa: F401
from .http import fetch, fetch_items, fetch_objects, upload  # noqa: F401

"""Column functions over JSON documents."""

from .columns import (  # noqa: F401
    append_item, array_rewrite, assign_string, canonical_json, decode, decode_base64, encode, encode_any, encode_buffer, f64_text,
    json_quote, json_typeof, measure, merge_record, parse_f64, parse_i64, parse_u64, path_count, path_get, present_keys,
    pretty_json, spilled, status_code, status_name, truncate_bytes, validate_json, value_rewrite, value_rewrite_many, write_json,
)

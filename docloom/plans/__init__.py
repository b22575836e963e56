"""Plans that stay in Catalyst: rewriting typed documents and assembling JSON text."""

from .assemble import array_of, concat_string, jsonl, object_of, splice  # noqa: F401
from .typed import drop_path, rewrite_items, set_path  # noqa: F401

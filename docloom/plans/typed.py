"""Rewriting of typed documents with higher-order functions: no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..rewriting import parse_array_selector, parse_path


def rewrite_items(record, selector: str, item: Callable, append: Callable | None = None) -> Column:
    """A struct (or array, for selector "") column with the items of the selected arrays
    rewritten. item(item, parents) gives an array column: empty to drop, one element to keep
    or replace, more to insert. parents are the struct columns on the path, outermost first.
    append(parents) gives an array column put at the end of each selected array."""
    segments = parse_array_selector(selector)

    def items(array: Column, parents: tuple[Column, ...]) -> Column:
        out = F.flatten(F.transform(array, lambda x: item(x, parents)))
        return F.concat(out, append(parents)) if append else out

    def go(node: Column, at: int, parents: tuple[Column, ...]) -> Column:
        if at == len(segments):
            return items(node, parents)
        name, fan = segments[at]
        inside = (*parents, node)
        if fan:
            return node.withField(name, F.transform(node[name], lambda x: go(x, at + 1, inside)))
        return node.withField(name, go(node[name], at + 1, inside))

    return go(col_of(record), 0, ())


def set_path(record, path: str, value: Column) -> Column:
    """A struct column with the member at a dotted path set (made where it is missing)."""
    return col_of(record).withField(".".join(f"`{s}`" for s in parse_path(path)), value)


def drop_path(record, path: str) -> Column:
    return col_of(record).dropFields(".".join(f"`{s}`" for s in parse_path(path)))

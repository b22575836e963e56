"""Assembling JSON text from columns and groups. Inputs of the *_of functions are JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import col_of, json_quote
from ..strict import quote


def object_of(**members) -> Column:
    """An object of members in the given order; a NULL text leaves its member out."""
    parts = [F.when(col_of(c).isNotNull(), F.concat(F.lit(quote(k.encode()).decode() + ":"), col_of(c))) for k, c in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _ordered(order, text) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(col_of(order).alias("o"), col_of(text).alias("t"))))
    return F.transform(rows, lambda r: r["t"])


def array_of(order, text) -> Column:
    """Aggregate: an array of a group's texts, sorted by `order`."""
    return F.concat(F.lit("["), F.array_join(_ordered(order, text), ","), F.lit("]"))


def jsonl(order, text) -> Column:
    """Aggregate: a group's texts as lines, a line feed after each."""
    return F.array_join(F.transform(_ordered(order, text), lambda t: F.concat(t, F.lit("\n"))), "")


def concat_string(order, chunk) -> Column:
    """Aggregate: one JSON string of a group's text chunks."""
    return json_quote(F.array_join(_ordered(order, chunk), ""))


def splice(*arrays) -> Column:
    """One array text with the items of several array texts (compact and valid)."""
    inner = [F.substring(col_of(a), F.lit(2), F.char_length(col_of(a)) - 2) for a in arrays]
    return F.concat(F.lit("["), F.concat_ws(",", *[F.when(i != "", i) for i in inner]), F.lit("]"))

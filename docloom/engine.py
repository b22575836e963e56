"""One handle for a session and its limits."""

from __future__ import annotations

from functools import partial

from pyspark.sql import SparkSession

from . import functions, operators, sources
from .limits import Limits


class Engine:
    """Functions, table operators and sources with the limits of this engine filled in, e.g.
    Engine(spark, Limits(max_depth=8)).decode("doc", schema)."""

    _FUNCTIONS = ("validate_json", "canonical_json", "decode", "encode", "value_rewrite", "value_rewrite_many", "array_rewrite")
    _OPERATORS = ("candidates", "object_stream", "array_items", "json_events", "json_leaves", "sse_events", "sse_json", "multipart_parts")
    _SOURCES = ("read_objects", "read_items", "read_candidates")

    def __init__(self, spark: SparkSession, limits: Limits | None = None):
        self.spark, self.limits = spark, (limits or Limits()).check()
        for home, names in ((functions, self._FUNCTIONS), (operators, self._OPERATORS)):
            for n in names:
                setattr(self, n, partial(getattr(home, n), limits=self.limits))
        for n in self._SOURCES:
            setattr(self, n, partial(getattr(sources, n), spark, limits=self.limits))

    def register(self) -> None:
        """The table functions for SQL."""
        operators.register(self.spark, self.limits)

"""Filters on attributes of chunks."""

from __future__ import annotations

import math
import operator
from collections.abc import Collection
from numbers import Number

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ChunkFilter, Chunks

#: What breaks ties, as far as chunks have it: natural keys before ids.
NATURAL = ("document", "constraint", "ordinal", "start", "end", "id")


def _column(chunks: Chunks, attr: str):
    if attr not in chunks.chunks.columns:
        raise KeyError(attr)
    kind = chunks.chunks.schema[attr].dataType
    return F.col(f"`{attr}`"), kind, isinstance(kind, T.FloatType | T.DoubleType)


def _comparable(kind: T.DataType, value) -> bool:
    if isinstance(kind, T.NumericType):
        return isinstance(value, Number) and not isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    return True


class TopK(ChunkFilter):
    """The ``k`` chunks with the highest attribute, or with ``reverse`` the lowest; null and NaN are never among them.

    Ties go to the smaller natural key.  Tables made of these chunks come in this order.
    """

    def __init__(self, attr: str, k: int, reverse: bool = False):
        if k < 0:
            raise ValueError("k must not be negative")
        self.attr, self.k, self.reverse = attr, k, reverse

    def __call__(self, chunks: Chunks) -> Chunks:
        column, _, floating = _column(chunks, self.attr)
        usable = chunks.keep(column.isNotNull() & ~F.isnan(column) if floating else column.isNotNull())
        ties = [F.col(c) for c in NATURAL if c in chunks.chunks.columns and c != self.attr]
        return usable.first(self.k, column.asc() if self.reverse else column.desc(), *ties)


class Threshold(ChunkFilter):
    """Chunks whose attribute compares with a value as ``direction`` says; null and NaN never do."""

    COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}

    def __init__(self, attr: str, direction: str, value):
        if direction not in self.COMPARE:
            raise ValueError(f"direction must be one of {list(self.COMPARE)}")
        self.attr, self.direction, self.value = attr, direction, value

    def __call__(self, chunks: Chunks) -> Chunks:
        column, kind, floating = _column(chunks, self.attr)
        if self.value is None or not _comparable(kind, self.value):
            raise TypeError(f"{self.attr} is {kind.simpleString()}, not comparable with {self.value!r}")
        test = self.COMPARE[self.direction](column, F.lit(self.value))
        if floating:
            test &= ~F.isnan(column)
        if isinstance(self.value, float) and math.isnan(self.value):
            test = F.lit(False)
        return chunks.keep(test)


class EqualTo(ChunkFilter):
    """Chunks whose attribute is one of ``values``; ``None`` among them matches null, NaN matches NaN."""

    def __init__(self, attr: str, values: Collection):
        self.attr, self.values = attr, list(values)

    def __call__(self, chunks: Chunks) -> Chunks:
        column, _, _ = _column(chunks, self.attr)
        own = [v for v in self.values if v is not None]
        test = column.isin(own) if own else F.lit(False)
        if len(own) < len(self.values):
            test |= column.isNull()
        return chunks.keep(test)

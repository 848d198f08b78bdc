"""Filters over keys, pages and iterators. Keys compare bytewise. Filters go on the log, below the aggregation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def prefix(rows: DataFrame, start: str) -> DataFrame:
    return rows.filter(F.col("key").startswith(start))


def inclusive(rows: DataFrame, start: str, end: str) -> DataFrame:
    """start <= key <= end; nothing if start > end."""
    return rows.filter(F.col("key").between(start, end))


def within(key: Column, start: Column, end: Column) -> Column:
    """start <= key < end; an empty end or start is unbounded."""
    return ((start == "") | (key >= start)) & ((end == "") | (key < end))


def half_open(rows: DataFrame, start: str, end: str) -> DataFrame:
    out = rows if start == "" else rows.filter(F.col("key") >= start)
    return out if end == "" else out.filter(F.col("key") < end)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """1-based page in key order; past the end it is empty."""
    if number < 1 or size < 1:
        raise ValueError("page and page size must be at least 1")
    return rows.orderBy("key").offset((number - 1) * size).limit(size)


class KeyIterator:
    """Cursor over rows in key order, a partition at a time on the driver."""

    def __init__(self, rows: DataFrame):
        self._rows = rows.orderBy("key").select("key", "value")
        self.reset()

    def reset(self) -> None:
        self._from: Iterator[Row] = self._rows.toLocalIterator(prefetchPartitions=True)
        self._ahead: Row | None = None
        self._stopped = False
        self._advance()

    def _advance(self) -> None:
        self._ahead = None if self._stopped else next(self._from, None)

    def has_next(self) -> bool:
        return self._ahead is not None

    def next(self) -> tuple[str, str, bool] | None:
        """(key, value, whether more follow), or None at the end."""
        if self._ahead is None:
            return None
        key, value = self._ahead
        self._advance()
        return key, value, self.has_next()

    def stop(self) -> None:
        self._stopped, self._ahead = True, None

    def __iter__(self) -> Iterator[tuple[str, str]]:
        while (found := self.next()) is not None:
            yield found[0], found[1]

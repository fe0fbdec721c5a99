"""What a read returns: the rows, and counts that are computed when asked for."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row


@dataclass
class Page:
    number: int
    size: int
    count: int
    total: int
    pages: int


@dataclass
class Result:
    """``data`` is lazy; ``total`` counts the same query without its page, as a job of its own."""

    data: DataFrame
    unpaged: DataFrame
    limit: int | None = None
    offset: int = 0
    meta: dict = field(default_factory=dict)
    #: Of a cursor page, the rows from its cursor on.
    after: DataFrame | None = None

    @cached_property
    def total(self) -> int:
        return self.unpaged.count()

    @cached_property
    def count(self) -> int:
        if self.limit is None:
            return self.total
        if self.after is not None:
            return self.after.limit(self.limit).count()
        return max(0, min(self.limit, self.total - self.offset))

    @property
    def page(self) -> Page:
        size = self.limit or max(self.total, 1)
        number = self.offset // size + 1 if self.after is None else (self.total - self.after.count()) // size + 1
        return Page(number, size, self.count, self.total, -(-self.total // size))

    def stream(self) -> Iterator[Row]:
        """Rows one by one; the driver holds a partition at a time."""
        return self.data.toLocalIterator(prefetchPartitions=True)

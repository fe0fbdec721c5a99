"""Sets of documents: fluent filters, sorting, slices, grouping and statistics over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def exact_median(values: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row ``median`` of the column ``x`` of doubles (null of none): the mean of the middle two values."""
    shape = values.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not shape.n or shape.lo == shape.hi:
        return values.sparkSession.createDataFrame([(shape.lo,)], "median double")
    lo, hi, below, inside = shape.lo, shape.hi, 0, values
    first, last = (shape.n - 1) // 2, shape.n // 2
    for _ in range(8):
        if inside.limit(100_001).count() <= 100_000:
            break
        cut = F.least(F.lit(buckets - 1), F.floor((F.col("x") - lo) / F.lit((hi - lo) / buckets))).cast("int")
        per = sorted((r.b, r.n, r.lo, r.hi) for r in inside.groupBy(cut.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        chosen, at = [], below
        for b in per:
            if at + b[1] > first and at <= last:
                chosen.append((at, b))
            at += b[1]
        below, lo, hi = chosen[0][0], chosen[0][1][2], chosen[-1][1][3]
        inside = values.where(F.col("x").between(lo, hi))
        if lo == hi:
            return values.sparkSession.createDataFrame([(lo,)], "median double")
    near = [r.x for r in inside.orderBy("x").offset(first - below).limit(last - first + 1).collect()]
    return values.sparkSession.createDataFrame([(sum(near) / len(near),)], "median double")


class DocumentSet:
    """An immutable set; every step gives a new one over a lazy DataFrame."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[Any], schema: Any = None) -> DocumentSet:
        return cls(spark.createDataFrame(list(rows), schema))

    def _to(self, df: DataFrame) -> DocumentSet:
        return DocumentSet(df)

    def where(self, path: str, value: Any) -> DocumentSet:
        return self._to(self.df.where(F.col(path).eqNullSafe(F.lit(value))))

    def where_func(self, f: Callable[[DataFrame], Column]) -> DocumentSet:
        return self._to(self.df.where(f(self.df)))

    filter = where_func

    def greater_than(self, path: str, v: Any) -> DocumentSet:
        return self._to(self.df.where(F.col(path) > v))

    def less_than(self, path: str, v: Any) -> DocumentSet:
        return self._to(self.df.where(F.col(path) < v))

    def contains(self, path: str, text: str) -> DocumentSet:
        return self._to(self.df.where(F.contains(F.lower(F.col(path)), F.lit(text.lower()))))

    def is_in(self, path: str, values: list) -> DocumentSet:
        return self._to(self.df.where(F.col(path).isin(values)))

    def sort_by(self, *paths: str) -> DocumentSet:
        return self._to(self.df.orderBy(*[F.col(p).asc_nulls_first() for p in paths]))

    def sort_by_desc(self, *paths: str) -> DocumentSet:
        return self._to(self.df.orderBy(*[F.col(p).desc_nulls_last() for p in paths]))

    def limit(self, n: int) -> DocumentSet:
        return self._to(self.df.limit(n))

    def offset(self, n: int) -> DocumentSet:
        return self._to(self.df.offset(n))

    skip = offset

    def map(self, **columns: Column) -> DocumentSet:
        return self._to(self.df.withColumns(columns))

    def reduce(self, **aggregates: Column) -> Row:
        return self.df.agg(*[c.alias(k) for k, c in aggregates.items()]).first()

    def find(self, f: Callable[[DataFrame], Column]) -> Row | None:
        return self.df.where(f(self.df)).first()

    def first(self) -> Row | None:
        return self.df.first()

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def count(self) -> int:
        return self.df.count()

    def group_by(self, path: str) -> DataFrame:
        """(key, documents): keys as strings, ``undefined`` where missing. A group's documents are one value: for small
        groups; ``grouped`` counts or aggregates groups of any size.
        """
        key = F.coalesce(F.col(path).cast("string"), F.lit("undefined"))
        return self.df.groupBy(key.alias("key")).agg(F.collect_list(F.struct("*")).alias("documents"))

    def grouped(self, path: str, **aggregates: Column) -> DataFrame:
        """(key, n, aggregates): the same groups, aggregated before they are shuffled."""
        key = F.coalesce(F.col(path).cast("string"), F.lit("undefined"))
        return self.df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in aggregates.items()])

    def aggregate(self, path: str) -> DataFrame:
        """One row: count, sum, average, min, max, median and population standard deviation of a numeric field.

        The median is exact: values are counted in ranges of the value's order until the middle's own range is known,
        which alone is sorted, so no task holds all distinct values.
        """
        x = F.col(path).try_cast("double")
        rest = self.df.agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("average"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std_dev"))
        return rest.crossJoin(F.broadcast(exact_median(self.df.select(x.alias("x")).where("x is not null"))))

    def index(self, path: str) -> Callable[[Any], DataFrame]:
        """A lookup of documents by a field's value."""
        return lambda v: self.df.where(F.col(path) == F.lit(v))

    def to_maps(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.toLocalIterator()]

"""Lenient conversions between primitive types as Column expressions; what does not convert becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS", "yyyy-MM-dd", "dd MMM yy HH:mm z", "dd MMM yy HH:mm Z", "dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z")
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def to_bool(c: Column, kind: T.DataType) -> Column:
    """``true`` and ``false`` in any case and between blanks; numbers other than 0."""
    if isinstance(kind, T.StringType):
        s = F.lower(F.trim(c))
        return F.when(s == "true", True).when(s == "false", False)
    if isinstance(kind, T.BooleanType):
        return c
    return c != 0 if isinstance(kind, T.NumericType) else F.lit(None).cast("boolean")


def to_int(c: Column, kind: T.DataType, to: str = "bigint") -> Column:
    """Whole numbers in the range of ``to``; fractions are cut off; booleans count as 1 and 0."""
    if isinstance(kind, T.BooleanType):
        return c.cast(to)
    if isinstance(kind, T.StringType):
        return F.trim(c).try_cast(to)
    return c.try_cast(to) if isinstance(kind, T.NumericType) else F.lit(None).cast(to)


def to_unsigned(c: Column, kind: T.DataType, bits: int = 32) -> Column:
    """Whole numbers from 0 on that fit ``bits`` bits, as the next wider signed type (64 bits: decimal)."""
    to = {8: "smallint", 16: "int", 32: "bigint"}.get(bits, "decimal(20,0)")
    x = c.cast(to) if isinstance(kind, T.BooleanType) else F.floor(F.trim(c).try_cast("decimal(38,6)") if isinstance(kind, T.StringType) else c.try_cast("decimal(38,6)")).cast("decimal(38,0)")
    return F.when((x >= 0) & (x <= F.lit((1 << bits) - 1).cast("decimal(20,0)")), x.try_cast(to))


def to_float(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.trim(c).try_cast("double")
    return c.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else F.lit(None).cast("double")


def to_string(c: Column, kind: T.DataType) -> Column:
    """Whole floats are written without fraction."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.when((c == F.floor(c)) & (F.abs(c) < 9e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string") if isinstance(kind, T.AtomicType) else F.lit(None).cast("string")


def to_time(c: Column, kind: T.DataType) -> Column:
    """Numbers are seconds; texts of digits seconds up to ten characters and nanoseconds beyond; other texts by layout."""
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.timestamp_seconds(c.cast("long"))
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("timestamp")
    n = c.try_cast("bigint")
    number = F.when(F.length(c) > 10, F.timestamp_micros(F.floor(n / 1000).cast("long"))).otherwise(F.timestamp_seconds(n))
    return F.when(c.rlike(r"^[+-]?\d+$"), number).otherwise(F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), F.lit(x)) for x in _LAYOUTS]))


def to_array(c: Column, kind: T.ArrayType, one) -> Column:
    """Every item converted by ``one`` (item, its type); null if an item does not convert."""
    made = F.transform(c, lambda x: one(x, kind.elementType))
    return F.when(~F.exists(made, lambda x: x.isNull()), made)

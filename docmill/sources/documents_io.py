"""Documents in and out: JSON text by schema, plain rows, generated rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.docs import canonical_json
from docmill.operators.schema import struct_type


def read_json(spark: SparkSession, path: str, schema: dict | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines under a declared schema; strict fails on text that is not such JSON, lenient gives nulls."""
    kind = schema if isinstance(schema, T.StructType) else struct_type(schema)
    return spark.read.schema(kind).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def parse_json(column: Column, schema: dict | T.StructType, strict: bool = True) -> Column:
    kind = schema if isinstance(schema, T.StructType) else struct_type(schema)
    return F.from_json(column, kind, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def to_json(df: DataFrame, canonical: bool = False, under: str | None = None) -> DataFrame:
    """One column ``json``: each row, or the struct ``under`` alone; canonical has sorted keys and nulls."""
    if under:
        df = df.select(f"{under}.*")
    return df.select((canonical_json(df, df.columns) if canonical else F.to_json(F.struct("*"))).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def rows(spark: SparkSession, data: Any, schema: dict | T.StructType | None = None) -> DataFrame:
    """Dicts, tuples, Rows, dataclasses or JSON texts as a DataFrame."""
    data = list(data) if isinstance(data, (list, tuple)) else [data]
    kind = struct_type(schema) if isinstance(schema, dict) else schema
    if data and isinstance(data[0], str):
        text = spark.createDataFrame([(d,) for d in data], "json string")
        kind = kind or T.StructType.fromDDL(spark.range(1).select(F.schema_of_json(F.lit(data[0]))).first()[0].removeprefix("STRUCT<").removesuffix(">"))
        return text.select(F.from_json("json", kind).alias("d")).select("d.*")
    if data and hasattr(data[0], "__dataclass_fields__"):
        from dataclasses import asdict

        data = [asdict(d) for d in data]
    return spark.createDataFrame(data, kind)


def generated(spark: SparkSession, schema: dict | T.StructType, n: int, seed: int = 0) -> DataFrame:
    """``n`` deterministic rows of a schema; a row depends on its number and the seed alone, so tasks need not agree."""
    kind = schema if isinstance(schema, T.StructType) else struct_type(schema)

    def make(t: T.DataType, path: str) -> Column:
        h = F.pmod(F.xxhash64(F.lit(seed), F.lit(path), F.col("id")), F.lit(1_000_003))
        if isinstance(t, T.StructType):
            return F.struct(*[make(f.dataType, f"{path}.{f.name}").alias(f.name) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return F.transform(F.sequence(F.lit(1), F.pmod(h, F.lit(4)) + 1), lambda i: _item(t.elementType, h, i))
        if isinstance(t, T.MapType):
            return F.create_map(F.concat(F.lit("k"), F.pmod(h, F.lit(9)).cast("string")), make(t.valueType, path + ".v"))
        if isinstance(t, T.BooleanType):
            return h % 2 == 0
        if isinstance(t, T.StringType):
            return F.concat(F.lit(path.split(".")[-1] + "_"), h.cast("string"))
        if isinstance(t, T.NumericType):
            return (h / 100 if isinstance(t, (T.FractionalType,)) else F.pmod(h, F.lit(120))).cast(t)
        return F.lit(None).cast(t)

    def _item(t: T.DataType, h: Column, i: Column) -> Column:
        if isinstance(t, T.NumericType):
            return F.pmod(h * i, F.lit(1000)).cast(t)
        return F.concat(F.lit("item_"), F.pmod(h * i, F.lit(1000)).cast("string")) if isinstance(t, T.StringType) else F.lit(None).cast(t)

    return spark.range(n).select(*[make(f.dataType, f.name).alias(f.name) for f in kind.fields])

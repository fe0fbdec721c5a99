"""Validation of documents as a dataflow: one expression gives every row its issues."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.operators.schema import _referred, fields_of

MODES = ("strict", "partial", "loose")
DEPTH = 20
SYSTEM = ("_id_", "_metadata_")
_NONE = "array<struct<path:string,code:string,message:string>>"

#: Named predicates: (field, arguments) to whether it holds.
PREDICATES: dict[str, Callable[[Column, Any], Column]] = {
    "min": lambda c, a: c >= a, "max": lambda c, a: c <= a, "minLength": lambda c, a: F.length(c) >= a, "maxLength": lambda c, a: F.length(c) <= a,
    "pattern": lambda c, a: c.rlike(a), "equals": lambda c, a: c == a, "oneOf": lambda c, a: c.isin(a), "notEmpty": lambda c, a: F.length(F.trim(c)) > 0,
}


def _issue(bad: Column, path: str, code: str, message: str) -> Column:
    return F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message")))


def combined(op: str, parts: list[Column]) -> Column:
    """The seven logical operators over booleans, unknown taken as false."""
    true = sum(F.coalesce(p, F.lit(False)).cast("int") for p in parts)
    n = len(parts)
    return {"and": true == n, "or": true > 0, "not": true == 0, "nor": true == 0, "xor": true == 1, "nand": true < n, "xnor": true % 2 == 0}[op]


def _type_ok(kind: str, t: T.DataType) -> bool:
    fits = {"string": T.StringType, "number": T.NumericType, "integer": T.IntegralType, "decimal": (T.NumericType, T.StringType), "boolean": T.BooleanType, "bytes": T.BinaryType, "array": T.ArrayType, "object": (T.StructType, T.MapType, T.VariantType), "composite": (T.StructType, T.VariantType), "record": (T.MapType, T.StructType, T.VariantType), "geometry": T.ArrayType}
    return kind not in fits or isinstance(t, fits[kind])


def _value(c: Column, t: T.DataType, f: dict, root: dict, path: str, mode: str, depth: int) -> list[Column]:
    """Issues of one present value."""
    kind, refs, out = f.get("type", "unknown"), _referred(f, root), []
    if not _type_ok(kind, t):
        return [_issue(c.isNotNull(), path, "TYPE", f"expected {kind}, found {t.simpleString()}")]
    if kind == "decimal" and isinstance(t, T.StringType):
        out.append(_issue(c.isNotNull() & c.try_cast("decimal(38,18)").isNull(), path, "TYPE", "no decimal number"))
    if kind == "enum" and refs:
        out.append(_issue(c.isNotNull() & ~c.isin(list(refs[0].get("values") or [])), path, "ENUM", "not one of the values"))
    if depth >= DEPTH:
        return out
    if kind in ("object", "composite") and isinstance(t, T.StructType):
        for r in refs:
            out += _fields(t, r, root, lambda n: c[n], f"{path}.", mode, depth + 1, c.isNotNull(), closed=kind == "object")
    if kind == "array" and isinstance(t, T.ArrayType) and refs:
        inner = refs[0] if "type" in refs[0] and not refs[0].get("fields") else {"type": "object", "schema": refs[0]}
        bad = F.exists(c, lambda x: F.size(_kept(_value(x, t.elementType, inner, root, f"{path}[]", mode, depth + 1))) > 0)
        out.append(_issue(F.coalesce(bad, F.lit(False)), path, "ITEMS", "an item does not fit"))
    if kind == "record" and isinstance(t, T.MapType) and refs:
        inner = refs[0] if "type" in refs[0] and not refs[0].get("fields") else {"type": "object", "schema": refs[0]}
        bad = F.exists(F.map_values(c), lambda x: F.size(_kept(_value(x, t.valueType, inner, root, f"{path}.*", mode, depth + 1))) > 0)
        out.append(_issue(F.coalesce(bad, F.lit(False)), path, "VALUES", "a value does not fit"))
    if kind == "union" and refs:
        fits = [F.size(_kept(_value(c, t, r if "type" in r else {"type": "object", "schema": r}, root, path, mode, depth + 1))) == 0 for r in refs]
        out.append(_issue(c.isNotNull() & ~combined("or", fits), path, "UNION", "fits no variant"))
    if kind == "geometry":
        out.append(_issue(F.coalesce(F.exists(c, lambda p: p.isNull() | (F.size(p) < 2)), F.lit(False)), path, "GEOMETRY", "points have two numbers or more"))
    return out


def _fields(t: T.StructType, schema: dict, root: dict, get: Callable[[str], Column], prefix: str, mode: str, depth: int, present: Column, closed: bool = True) -> list[Column]:
    out, fields = [], fields_of(schema)
    if closed:
        out += [_issue(present & get(n).isNotNull(), prefix + n, "UNEXPECTED", "not in the schema") for n in t.names if n not in fields and n not in SYSTEM and mode != "loose"]
    for n, f in fields.items():
        if n not in t.names:
            if f.get("required") and mode == "strict":
                out.append(_issue(present, prefix + n, "REQUIRED", "missing"))
            continue
        c = get(n)
        if f.get("required") and not f.get("nullable") and mode == "strict":
            out.append(_issue(present & c.isNull(), prefix + n, "REQUIRED", "missing"))
        out += _value(c, t[n].dataType, f, root, prefix + n, mode, depth)
    return out


def _rule(r: dict, get: Callable[[str], Column], mode: str, predicates: dict) -> Column:
    if "rules" in r:
        return combined(r.get("operator", "and"), [_rule(x, get, mode, predicates) for x in r["rules"]])
    c = get(r["fields"][0] if isinstance(r.get("fields"), list) else r["field"])
    ok = predicates[r["predicate"]](c, r.get("parameters"))
    return F.coalesce(ok, F.lit(mode != "strict"))


def _kept(found: list[Column]) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast(_NONE)


def issues(df: DataFrame, schema: dict, mode: str = "strict", predicates: dict | None = None) -> Column:
    """array of (path, code, message) for each row: unexpected, missing and ill-typed fields, and broken constraints.

    ``partial`` does not miss absent fields; ``loose`` allows unexpected ones as well.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    get = lambda n: F.col("`" + n.replace(".", "`.`") + "`")
    found = _fields(df.schema, schema, schema, get, "", mode, 0, F.lit(True))
    for k, r in (schema.get("constraints") or {}).items():
        found.append(_issue(~_rule(r, get, mode, PREDICATES | (predicates or {})), r.get("name", k), "CONSTRAINT", r.get("message", "broken")))
    return _kept(found)


def valid(df: DataFrame, schema: dict, mode: str = "strict") -> DataFrame:
    return df.where(F.size(issues(df, schema, mode)) == 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) that several rows share: breaks of a unique constraint."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

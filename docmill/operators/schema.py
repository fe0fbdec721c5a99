"""Declared schemas: JSON definitions to Spark types, structural rules, differences and version bumps."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.plans.ir import QueryError

SIMPLE = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "union": T.VariantType(), "unknown": T.VariantType(), "geometry": T.ArrayType(T.ArrayType(T.DoubleType()))}
TYPES = {*SIMPLE, "decimal", "enum", "array", "object", "record", "composite"}
INDEXES = {"normal", "unique", "primary", "spatial", "fulltext"}
#: Recursive references are unrolled so deep, then become variants.
UNROLL = 3


def fields_of(schema: dict) -> dict[str, dict]:
    """The fields by name; definitions key them by stable id and may leave the name out."""
    return {f.get("name", k): {"id": k, **f} for k, f in (schema.get("fields") or {}).items()}


def _referred(f: dict, root: dict) -> list[dict]:
    ref = f.get("schema")
    refs = ref if isinstance(ref, list) else [ref] if ref else []
    out = []
    for r in refs:
        if isinstance(r, dict) and "id" in r:
            r = {**(root.get("schemas") or {}).get(r["id"], {}), **{k: v for k, v in r.items() if k != "id"}}
        elif isinstance(r, str):
            r = (root.get("schemas") or {}).get(r, {})
        out.append(r)
    return out


def spark_type(f: dict, root: dict, depth: int = 0) -> T.DataType:
    kind, refs = f.get("type", "unknown"), _referred(f, root)
    if kind in SIMPLE:
        return SIMPLE[kind]
    if kind == "decimal":
        return T.DecimalType(38, int((f.get("metadata") or {}).get("scale", 18)))
    if kind == "enum":
        base = (refs[0].get("type") if refs else None) or "string"
        return SIMPLE.get(base, T.StringType())
    if depth > UNROLL * 3:
        return T.VariantType()
    if kind in ("array", "record"):
        inner = refs[0] if refs else {}
        item = struct_type(inner, root, depth + 1) if inner.get("fields") else spark_type({"type": inner.get("type", "unknown"), "schema": inner.get("schema")}, root, depth + 1)
        return T.ArrayType(item) if kind == "array" else T.MapType(T.StringType(), item)
    if kind in ("object", "composite"):
        parts = {n: x for r in refs for n, x in fields_of(r).items()}
        return T.StructType([_field(n, x, root, depth + 1) for n, x in parts.items()]) if parts else T.VariantType()
    raise QueryError("SCHEMA", f"unknown type {kind!r}")


def _field(name: str, f: dict, root: dict, depth: int) -> T.StructField:
    meta = {k: f[k] for k in ("id", "unique", "deprecated", "description") if k in f}
    return T.StructField(name, spark_type(f, root, depth), not f.get("required") or bool(f.get("nullable")), meta)


def struct_type(schema: dict, root: dict | None = None, depth: int = 0) -> T.StructType:
    """The StructType of a definition."""
    return T.StructType([_field(n, f, root or schema, depth) for n, f in fields_of(schema).items()])


def from_struct(kind: T.StructType, name: str = "", version: str = "1.0.0") -> dict:
    """A definition of a DataFrame's schema: the result schema of any query."""

    def one(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "schema": {"fields": {f.name: {"name": f.name, "required": not f.nullable, **one(f.dataType)} for f in t.fields}}}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "schema": one(t.elementType)}
        if isinstance(t, T.MapType):
            return {"type": "record", "schema": one(t.valueType)}
        if isinstance(t, T.DecimalType):
            return {"type": "decimal", "metadata": {"scale": t.scale}}
        if isinstance(t, T.BooleanType):
            return {"type": "boolean"}
        if isinstance(t, T.BinaryType):
            return {"type": "bytes"}
        if isinstance(t, T.IntegralType):
            return {"type": "integer"}
        if isinstance(t, T.FractionalType):
            return {"type": "number"}
        return {"type": "unknown" if isinstance(t, T.VariantType) else "string"}

    return {"name": name, "version": version, "fields": one(kind)["schema"]["fields"]}


def rule_breaks(schema: dict) -> list[str]:
    """Structural rules that a definition breaks."""
    out, ids = [], schema.get("schemas") or {}
    if not re.fullmatch(r"\d+\.\d+\.\d+", str(schema.get("version", "1.0.0"))):
        out.append("version: three numbers")

    def walk(s: dict, at: str) -> None:
        names = [f.get("name", k) for k, f in (s.get("fields") or {}).items()]
        out.extend(f"{at}: name {n!r} twice" for n in {n for n in names if names.count(n) > 1})
        for n, f in fields_of(s).items():
            here = f"{at}.{n}"
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n):
                out.append(f"{here}: no identifier")
            if f.get("type") not in TYPES:
                out.append(f"{here}: unknown type {f.get('type')!r}")
            refs = f.get("schema")
            for r in refs if isinstance(refs, list) else [refs] if refs else []:
                rid = r.get("id") if isinstance(r, dict) else r
                if rid and rid not in ids:
                    out.append(f"{here}: no schema {rid!r}")
            if f.get("type") in ("enum", "array", "object", "record", "union", "composite") and not refs:
                out.append(f"{here}: {f['type']} refers to a schema")
            if f.get("type") in ("union", "composite") and isinstance(refs, list) and len(refs) < 2:
                out.append(f"{here}: {f['type']} has two parts or more")
            if f.get("required") and f.get("default") is not None and f.get("nullable"):
                out.append(f"{here}: required, nullable and with default")
        for k, i in (s.get("indexes") or {}).items():
            if i.get("type", "normal") not in INDEXES:
                out.append(f"{at}: index {k} of unknown type")
            out.extend(f"{at}: index {k} on no field {x!r}" for x in i.get("fields") or [] if x not in names and x not in (s.get("fields") or {}))

    walk(schema, schema.get("name") or "schema")
    for k, s in ids.items():
        walk(s, k)
        if s.get("type") == "enum" and not s.get("values"):
            out.append(f"{k}: an enum has values")
    return out


def difference(old: dict, new: dict) -> dict[str, Any]:
    """Added, removed, renamed and changed fields, by stable id."""
    a, b = old.get("fields") or {}, new.get("fields") or {}
    name = lambda fs, k: fs[k].get("name", k)
    changed = {k: {p: (a[k].get(p), b[k].get(p)) for p in {*a[k], *b[k]} - {"name", "description", "metadata"} if a[k].get(p) != b[k].get(p)} for k in a.keys() & b.keys()}
    return {
        "added": {name(b, k): b[k] for k in b.keys() - a.keys()},
        "removed": sorted(name(a, k) for k in a.keys() - b.keys()),
        "renamed": {name(a, k): name(b, k) for k in a.keys() & b.keys() if name(a, k) != name(b, k)},
        "changed": {name(b, k): v for k, v in changed.items() if v},
    }


def impact(diff: dict) -> str:
    """major, minor, patch or none: what the version has to rise by."""
    if diff["removed"] or diff["renamed"] or any({"type", "schema"} & c.keys() or c.get("required", (0, 0))[1] or c.get("unique", (0, 0))[1] for c in diff["changed"].values()):
        return "major"
    if any(f.get("required") and f.get("default") is None for f in diff["added"].values()):
        return "major"
    return "minor" if diff["added"] else "patch" if diff["changed"] else "none"


def bumped(version: str, how: str) -> str:
    x, y, z = map(int, version.split("."))
    return {"major": f"{x + 1}.0.0", "minor": f"{x}.{y + 1}.0", "patch": f"{x}.{y}.{z + 1}", "none": version}[how]


def migrated(df: DataFrame, old: dict, new: dict, transform=None) -> DataFrame:
    """Rows of the old definition under the new one: renames, defaults, casts, drops; then ``transform``, DataFrame to DataFrame."""
    d, root = difference(old, new), new
    for a, b in d["renamed"].items():
        df = df.withColumnRenamed(a, b)
    df = df.drop(*d["removed"])
    kinds = fields_of(new)
    for n, f in d["added"].items():
        df = df.withColumn(n, F.lit(f.get("default")).cast(spark_type(f, root)))
    for n, c in d["changed"].items():
        if "type" in c:
            kind = spark_type(kinds[n], root)
            df = df.withColumn(n, F.col(n).cast(kind) if isinstance(kind, T.StringType) else F.col(n).try_cast(kind))
    return transform(df) if transform else df

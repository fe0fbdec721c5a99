"""Functions on documents: paths, merges, differences, checksums, JSON Patch and JSONPath."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

SYSTEM = ("_id_", "_metadata_")

# -- columns ----------------------------------------------------------------------------------------------------------


def canonical(c: Column, kind: DataType) -> Column:
    """Structs with sorted keys and whole floats as integers, at any depth, for a canonical JSON text."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, (DoubleType, FloatType)):  # a variant writes a whole number without fraction
        whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
        return F.when(whole, F.parse_json(c.cast("long").cast("string"))).otherwise(F.parse_json(c.cast("string")))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.sort_array(F.map_entries(F.transform_values(c, lambda _, v: canonical(v, kind.valueType)))))
    return c


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row's user fields as JSON: sorted keys, nulls kept, whole floats without fraction."""
    fields = sorted((f for f in df.schema.fields if f.name in (columns or [c for c in df.columns if c not in SYSTEM])), key=lambda f: f.name)
    parts = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
            text = F.when(c.isNull(), "null").when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
            parts.append(F.concat(F.lit(json.dumps(f.name) + ":"), text))
        else:
            body = F.to_json(F.struct(canonical(c, f.dataType).alias(f.name)), {"ignoreNullFields": "false"})
            parts.append(F.substring(body, F.lit(2), F.length(body) - 2))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def checksum(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(df, columns), 256)


def verified(df: DataFrame, stored: Column, columns: list[str] | None = None) -> Column:
    return checksum(df, columns).eqNullSafe(stored)


def merged(left: DataFrame, right: DataFrame, key: str = "_id_") -> DataFrame:
    """Shallow merge by key: where the right document is, each of its fields wins, null or not."""
    l, r = left.alias("l"), right.withColumn("__there", F.lit(True)).alias("r")  # noqa: E741
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    def one(n: str) -> Column:
        if n not in right.columns or n not in left.columns:
            return F.col(f"{'r' if n in right.columns else 'l'}.`{n}`")
        return F.when(F.col("r.__there"), F.col(f"r.`{n}`")).otherwise(F.col(f"l.`{n}`"))

    pick = [one(n).alias(n) for n in names]
    return l.join(r, F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")), "full").select(*pick)


def deep_merge(a: Column, b: Column, kind: StructType) -> Column:
    """Two structs of one type, field by field at any depth; the right one's given fields win."""
    each = [(deep_merge(a[f.name], b[f.name], f.dataType) if isinstance(f.dataType, StructType) else F.coalesce(b[f.name], a[f.name])).alias(f.name) for f in kind.fields]
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(*each))


def equal_documents(a: str, b: str, columns: list[str]) -> Column:
    """Equality of two aliased rows on user fields, null equal to null."""
    return F.struct(*[F.col(f"{a}.`{c}`") for c in columns if c not in SYSTEM]).eqNullSafe(F.struct(*[F.col(f"{b}.`{c}`") for c in columns if c not in SYSTEM]))


def difference(old: DataFrame, new: DataFrame, key: str = "_id_") -> DataFrame:
    """(key, change, fields, old, new): added and removed documents, and modified ones with the names of the changed
    fields and their values before and after, as JSON texts by field. Null keys match each other.
    """
    both = [c for c in old.columns if c in new.columns and c != key and c not in SYSTEM]
    o, n = old.alias("o").withColumn("_o", F.lit(True)), new.alias("n").withColumn("_n", F.lit(True))
    j = o.alias("o").join(n.alias("n"), F.col(f"o.`{key}`").eqNullSafe(F.col(f"n.`{key}`")), "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")), F.lit(c)) for c in both]), lambda x: x.isNotNull())
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.size(changed) > 0, "modified")
    return j.select(F.coalesce(F.col(f"n.`{key}`"), F.col(f"o.`{key}`")).alias(key), change.alias("change"), F.when(change == "modified", changed).alias("fields"), *[F.when(change == "modified", _values(side, both)).alias(name) for side, name in (("o", "old"), ("n", "new"))]).where("change is not null")


def _values(side: str, fields: list[str]) -> Column:
    """The changed fields of one side, as a map from name to JSON text (null: null)."""
    pairs = [F.when(~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")), F.struct(F.lit(c).alias("k"), F.to_json(F.struct(F.col(f"{side}.`{c}`").alias("v"))).alias("v"))) for c in fields]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def applied(old: DataFrame, diff: DataFrame, new: DataFrame, key: str = "_id_") -> DataFrame:
    """``old`` after a difference: removed documents go, modified ones take the changed fields' new values from the
    difference, added ones come from ``new``.
    """
    d = diff.select(F.col(key).alias("__k"), "change", F.col("new").alias("__new"))
    j = old.join(d, F.col(key).eqNullSafe(F.col("__k")), "left").where("change is null or change <> 'removed'")
    kinds = {f.name: f.dataType.simpleString() for f in old.schema.fields}
    pick = [F.when(F.array_contains(F.map_keys("__new"), c), F.from_json(F.col("__new")[c], f"v {kinds[c]}")["v"]).otherwise(F.col(f"`{c}`")).alias(c) if c != key else F.col(f"`{c}`") for c in old.columns]
    more = new.join(diff.where("change = 'added'").select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_semi")
    return j.select(*pick).unionByName(more.select(*old.columns), allowMissingColumns=True)


# -- plain documents --------------------------------------------------------------------------------------------------

_STEP = re.compile(r"\.([^.\[\]]+)|\[(\d+)\]|\[\*\]|\['([^']*)'\]|\[\"([^\"]*)\"\]")


def json_path(doc: Any, path: str) -> list:
    """The values at a JSONPath of keys, indices and wildcards; a list at the last step is flattened."""
    if not path.startswith("$"):
        raise ValueError("a path starts with $")
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad path at {path[at:]!r}")
        steps.append(int(m[2]) if m[2] is not None else "*" if m[0] in ("[*]", ".*") else next(g for g in (m[1], m[3], m[4]) if g is not None))
        at = m.end()
    now = [doc]
    for s in steps:
        nxt = []
        for x in now:
            if s == "*":
                nxt += list(x.values()) if isinstance(x, dict) else list(x) if isinstance(x, list) else []
            elif isinstance(s, int):
                nxt += [x[s]] if isinstance(x, list) and s < len(x) else []
            elif isinstance(x, dict) and s in x:
                nxt.append(x[s])
        now = nxt
    return [y for x in now for y in (x if isinstance(x, list) else [x])] if steps and steps[-1] != "*" else now


def get_path(doc: dict, path: str, default: Any = None) -> Any:
    for part in path.split("."):
        if not isinstance(doc, dict) or part not in doc:
            return default
        doc = doc[part]
    return doc


def set_path(doc: dict, path: str, value: Any) -> dict:
    out = copy.deepcopy(doc)
    at, *_ = [out]
    *head, last = path.split(".")
    for part in head:
        at = at.setdefault(part, {})
    at[last] = value
    return out


def delete_path(doc: dict, path: str) -> dict:
    out = copy.deepcopy(doc)
    *head, last = path.split(".")
    at = get_path(out, ".".join(head)) if head else out
    if isinstance(at, dict):
        at.pop(last, None)
    return out


def _pointer(path: str) -> list[str]:
    if path and not path.startswith("/"):
        raise ValueError(f"bad pointer {path!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]


def _at(doc: Any, parts: list[str]) -> Any:
    for p in parts:
        if isinstance(doc, list):
            if not p.isdigit() or int(p) >= len(doc):
                raise ValueError(f"no item {p}")
            doc = doc[int(p)]
        elif isinstance(doc, dict) and p in doc:
            doc = doc[p]
        else:
            raise ValueError(f"no member {p}")
    return doc


def apply_patch(doc: Any, ops: list[dict]) -> Any:
    """JSON Patch: add, remove, replace, move, copy, test, and removeValue (an item of a list by its value)."""
    doc = copy.deepcopy(doc)

    def add(parts: list[str], v: Any) -> None:
        nonlocal doc
        if not parts:
            doc = v
            return
        at, k = _at(doc, parts[:-1]), parts[-1]
        if isinstance(at, list):
            i = len(at) if k == "-" else int(k)
            if not 0 <= i <= len(at):
                raise ValueError(f"no place {k}")
            at.insert(i, v)
        elif isinstance(at, dict):
            at[k] = v
        else:
            raise ValueError("only lists and objects take members")

    def remove(parts: list[str]) -> Any:
        at, k = _at(doc, parts[:-1]), parts[-1]
        _at(at, [k])
        return at.pop(int(k) if isinstance(at, list) else k)

    for op in ops:
        kind, parts = op["op"], _pointer(op.get("path", ""))
        if kind == "add":
            add(parts, copy.deepcopy(op.get("value")))
        elif kind == "remove":
            remove(parts)
        elif kind == "replace":
            if parts:
                at = _at(doc, parts[:-1])
                _at(at, [parts[-1]])
                at[int(parts[-1]) if isinstance(at, list) else parts[-1]] = copy.deepcopy(op.get("value"))
            else:
                doc = copy.deepcopy(op.get("value"))
        elif kind == "move":
            add(parts, remove(_pointer(op["from"])))
        elif kind == "copy":
            add(parts, copy.deepcopy(_at(doc, _pointer(op["from"]))))
        elif kind == "test":
            if _at(doc, parts) != op.get("value"):
                raise ValueError(f"test failed at {op['path']}")
        elif kind == "removeValue":
            at = _at(doc, parts)
            if op.get("value") not in at:
                raise ValueError("no such value")
            at.remove(op["value"])
        else:
            raise ValueError(f"unknown operation {kind!r}")
    return doc


def create_patch(old: Any, new: Any, path: str = "") -> list[dict]:
    """Operations that turn ``old`` into ``new``."""
    if isinstance(old, dict) and isinstance(new, dict):
        esc = lambda k: k.replace("~", "~0").replace("/", "~1")
        out = [{"op": "remove", "path": f"{path}/{esc(k)}"} for k in sorted(old.keys() - new.keys())]
        for k in sorted(new):
            out += create_patch(old[k], new[k], f"{path}/{esc(k)}") if k in old else [{"op": "add", "path": f"{path}/{esc(k)}", "value": new[k]}]
        return out
    if isinstance(old, list) and isinstance(new, list):
        n, out = min(len(old), len(new)), []
        for i in range(n):
            out += create_patch(old[i], new[i], f"{path}/{i}")
        out += [{"op": "remove", "path": f"{path}/{i}"} for i in range(len(old) - 1, n - 1, -1)]
        return out + [{"op": "add", "path": f"{path}/-", "value": v} for v in new[n:]]
    return [] if old == new and type(old) is type(new) else [{"op": "replace", "path": path, "value": new}]


def patched(df: DataFrame, column: str, ops: list[dict]) -> DataFrame:
    """A JSON text column with the patch applied to each document; documents that it does not fit become null."""
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(apply_patch(json.loads(text), ops), ensure_ascii=False)
        except (ValueError, KeyError, IndexError, TypeError):
            return None

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(one)

    return df.withColumn(column, run(F.col(column)))

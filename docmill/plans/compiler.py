"""Compiles queries to DataFrames: from, joins, where, group, having, project, distinct, set operation, order, page."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Collection
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.types import DataType, MapType, VariantType

from docmill.functions.scalar import Registry
from docmill.plans import ir
from docmill.plans.ir import QueryError

TOTAL = "__matches__"
_MARK = "__row_of_"
_UNORDERED = (MapType, VariantType)


def _unqualified(path: str, sources: Collection[str]) -> list[str]:
    """The parts of a path, without the alias of its source."""
    parts = path.split(".")
    return parts[1:] if len(parts) > 1 and parts[0] in sources else parts


def _alias(item: dict) -> str:
    return (item.get("computed_field_expression") or item.get("case_expression") or item)["alias"]


class Scope:
    """The sources a query can name: alias to columns, with the enclosing query's scope behind it."""

    def __init__(self, parent: Scope | None = None) -> None:
        self.parent, self.sources, self.extra = parent, {}, set()

    def column(self, path: str, outer: bool = False) -> Column | None:
        """The field at ``path``: a qualified name, a field of a source (the first that has it), a computed alias; else None."""
        head, *rest = path.split(".")
        if head in self.sources and rest:
            first = rest[0]
            if first in self.sources[head]:
                return self._at(f"`{head}`.`{first}`", rest[1:], outer)
        for alias, columns in self.sources.items():
            if head in columns:
                return self._at(f"`{alias}`.`{head}`", rest, outer)
        if head in self.extra:
            return self._at(f"`{head}`", rest, outer)
        return None

    @staticmethod
    def _at(base: str, rest: list[str], outer: bool) -> Column:
        c = F.col(base).outer() if outer else F.col(base)
        for part in rest:
            c = c[part]
        return c

    def resolve(self, path: str) -> Column:
        scope, outer = self, False
        while scope is not None:
            c = scope.column(ir.name(path), outer)
            if c is not None:
                return c
            scope, outer = scope.parent, True
        raise QueryError("FIELD", f"no field {path!r} here")


class Compiler:
    """``tables`` gives the DataFrame of a collection's name. ``doc_mode``: comparisons know only true and false.

    In the default mode a comparison with null is unknown, as in SQL; in document mode null equals null and differs from
    all else, and other comparisons with null are false.
    """

    def __init__(self, tables: Callable[[str], DataFrame], registry: Registry | None = None, doc_mode: bool = False, case_insensitive: bool = False, raw: Callable[[dict], DataFrame] | None = None) -> None:
        self.tables, self.registry, self.raw = tables, registry or Registry(), raw
        self.doc_mode, self.case_insensitive = doc_mode, case_insensitive

    def compile(self, q: dict) -> DataFrame:
        ir.check(q, frozenset(self.registry.predicates), frozenset(self.registry.aggregates))
        return self._query(q, None, 0)

    # -- values and filters -------------------------------------------------------------------------------------------

    def value(self, v: Any, scope: Scope, depth: int) -> Column:
        kind = ir.value_kind(v)
        if kind == "field":
            return scope.resolve(v["field"])
        if kind == "function":
            return self.registry.call(v["function"], [self.value(a, scope, depth) for a in v.get("arguments") or []])
        if kind == "subquery":
            return self._query(v["query"], scope, depth + 1).scalar()
        if kind == "array":
            return F.array(*[self.value(x, scope, depth) for x in v])
        return self._literal(v)

    def _literal(self, v: Any) -> Column:
        if isinstance(v, dict):
            return F.struct(*[self._literal(x).alias(k) for k, x in v.items()])
        return F.lit(v)

    def condition(self, c: dict, scope: Scope, depth: int) -> Column:
        field, op, v = scope.resolve(c["field"]), c["operator"], c.get("value")
        if op in self.registry.predicates:
            return self.registry.predicates[op](field, self.value(v, scope, depth))
        if op in ("exists", "nexists"):
            return field.isNotNull() if op == "exists" else field.isNull()
        if op in ("in", "nin"):
            if ir.value_kind(v) == "subquery":
                if op == "nin":
                    return self._not_in(c["field"], v["query"], scope, depth)
                found = field.isin(self._query(v["query"], scope, depth + 1))
            else:
                found = field.isin(*[self.value(x, scope, depth) if isinstance(x, dict) else F.lit(x) for x in v]) if v else F.lit(False)
            found = F.coalesce(found, F.lit(False)) if self.doc_mode and ir.value_kind(v) != "subquery" else found
            return ~found if op == "nin" else found
        if v is None and op in ("eq", "neq"):
            return field.isNull() if op == "eq" else field.isNotNull()
        value = self.value(v, scope, depth)
        if op in ("contains", "ncontains"):
            has = F.contains(F.lower(field), F.lower(value)) if self.case_insensitive else F.contains(field, value)
            has = F.coalesce(has, F.lit(False)) if self.doc_mode else has
            return ~has if op == "ncontains" else has
        if self.doc_mode and op in ("eq", "neq"):
            same = field.eqNullSafe(value)
            return same if op == "eq" else ~same
        compare = {"eq": operator.eq, "neq": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}[op]
        out = compare(field, value)
        return F.coalesce(out, F.lit(False)) if self.doc_mode else out

    def _not_in(self, path: str, query: dict, scope: Scope, depth: int) -> Column:
        """NOT IN with its three values, as an equality join: Spark's own null-aware anti join broadcasts any right side.

        One value tells whether the right side is empty (null), has a null (true) or has none (false).
        """
        field, inner = scope.resolve(path), Scope(scope).resolve(path)
        right = lambda: self._query(query, scope, depth + 1).toDF("__v")
        nulls = right().select(F.max(F.col("__v").isNull())).scalar()
        there = right().where(F.col("__v") == inner).exists()
        return F.when(nulls.isNull(), True).when(there, False).when(field.isNotNull() & ~nulls, True)

    def filter(self, f: dict, scope: Scope, depth: int = 0) -> Column:
        kind, body = ir.filter_kind(f)
        if kind == "condition":
            return self.condition(body, scope, depth)
        if kind == "text":
            return self._text(body, scope)
        op, parts = body["operator"], [self.filter(x, scope, depth) for x in body["conditions"]]
        if op in ("and", "nand"):
            out = functools.reduce(operator.and_, parts)
            return ~out if op == "nand" else out
        if op in ("or", "nor"):
            out = functools.reduce(operator.or_, parts)
            return ~out if op == "nor" else out
        if op == "not":
            return ~F.coalesce(parts[0], F.lit(False)) if self.doc_mode else ~parts[0]
        true = functools.reduce(operator.add, [F.coalesce(p, F.lit(False)).cast("int") for p in parts])
        return true == 1 if op == "xor" else true % 2 == 0

    def _text(self, t: dict, scope: Scope) -> Column:
        fold = (lambda c: c) if t.get("case_sensitive") else F.lower
        text, each = fold(F.lit(t["query"])), []
        for path in t["fields"]:
            c = fold(scope.resolve(path).cast("string"))
            each.append(c == text if t.get("type", "contains") == "exact" else F.contains(c, text))
        return functools.reduce(operator.and_ if t.get("operator", "or") == "and" else operator.or_, each)

    # -- projections --------------------------------------------------------------------------------------------------

    def computed(self, item: dict, scope: Scope, depth: int) -> Column:
        if item.get("computed_field_expression") or item.get("case_expression"):
            item = item.get("computed_field_expression") or item["case_expression"]
        if item["type"] == "case":
            out = None
            for w in item["conditions"]:
                cond, then = self.filter(w["when"], scope, depth), self.value(w["then"], scope, depth)
                out = F.when(cond, then) if out is None else out.when(cond, then)
            return out.otherwise(self.value(item.get("else"), scope, depth)).alias(item["alias"])
        return self.value(item["expression"], scope, depth).alias(item["alias"])

    def _included(self, fields: list[dict], resolve: Callable[[str], Column], sources: Collection[str] = ()) -> list[Column]:
        """The included fields; dotted paths rebuild their nesting, fields that share a parent in one struct."""
        out: dict[str, Any] = {}
        for f in fields:
            c = resolve(f["name"])
            if f.get("nested"):
                c = self._nested(c, f["nested"])
            parts = [f["alias"]] if f.get("alias") else _unqualified(f["name"], sources)
            at = out
            for p in parts[:-1]:
                at = at.setdefault(p, {})
                if not isinstance(at, dict):
                    raise QueryError("PROJECTION", f"{f['name']} is included twice")
            if parts[-1] in at:
                raise QueryError("PROJECTION", f"{f['name']} needs an alias: its name is taken")
            at[parts[-1]] = c

        def build(x: Any) -> Column:
            return F.struct(*[build(v).alias(k) for k, v in x.items()]) if isinstance(x, dict) else x

        return [build(v).alias(k) for k, v in out.items()]

    def _nested(self, c: Column, p: dict) -> Column:
        if p.get("include"):
            made = F.struct(*self._included(p["include"], lambda path: functools.reduce(lambda a, k: a[k], path.split("."), c)))
        else:
            made = c.dropFields(*[f["name"] for f in p.get("exclude") or []])
        return F.when(c.isNotNull(), made)

    # -- queries ------------------------------------------------------------------------------------------------------

    def _source(self, target: dict, projection: dict | None, mark: bool) -> tuple[str, DataFrame, dict[str, DataType]]:
        df, alias = self.tables(ir.name(target["name"])), target.get("alias") or target["name"]
        if projection:
            df = self._projected(df, projection)
        columns = {f.name: f.dataType for f in df.schema.fields}
        if mark:
            df = df.withColumn(f"{_MARK}{alias}", F.lit(True))
        return alias, df.alias(alias), columns

    def _projected(self, df: DataFrame, p: dict) -> DataFrame:
        scope = Scope()
        scope.extra = set(df.columns)
        computed = [self.computed(c, scope, 0) for c in p.get("computed") or []]
        if p.get("include"):
            return df.select(*self._included(p["include"], scope.resolve), *computed)
        return self._excluded(df, p.get("exclude") or []).select("*", *computed)

    @staticmethod
    def _excluded(df: DataFrame, fields: list[dict]) -> DataFrame:
        for f in fields:
            head, _, rest = f["name"].partition(".")
            if f.get("nested"):
                rest_all = [x["name"] for x in f["nested"].get("exclude") or []]
                df = df.withColumn(head, F.col(head).dropFields(*rest_all))
            elif rest:
                df = df.withColumn(head, F.col(head).dropFields(rest))
            else:
                df = df.drop(head)
        return df

    def _query(self, q: dict, parent: Scope | None, depth: int) -> DataFrame:
        if depth > ir.MAX_DEPTH:
            raise QueryError("DEPTH", f"sub-queries nest at most {ir.MAX_DEPTH} deep")
        if q.get("raw"):
            return self.raw(q["raw"])
        ir.check(q, frozenset(self.registry.predicates), frozenset(self.registry.aggregates), depth)
        joins = q.get("joins") or []
        scope = Scope(parent)
        outer = any(j.get("type", "inner") != "inner" for j in joins)
        alias, df, scope.sources[alias] = self._source(q["target"], None, outer)
        for j in joins:
            a, right, columns = self._source(j["target"], j.get("projection"), outer)
            if a in scope.sources:
                raise QueryError("JOIN", f"the alias {a!r} is taken")
            scope.sources[a] = columns
            df = df.join(right, self.filter(j["on"], scope, depth), j.get("type", "inner")) if j.get("on") else df.crossJoin(right)
        if q.get("filters"):
            df = df.where(self.filter(q["filters"], scope, depth))
        page = q.get("pagination") or {}
        if page.get("type") == "cursor" and page.get("cursor"):
            order = (page.get("order") or [{"field": page["cursor"]["field"], "direction": "asc"}])[0]
            at = scope.resolve(page["cursor"]["field"])
            v = self.value(page["cursor"]["cursor"], scope, depth)
            df = df.where(at < v if order.get("direction") == "desc" else at > v)
        p = q.get("projection") or {}
        sort = [*(q.get("sort") or []), *(page.get("order") or [])]
        if q.get("aggregations"):
            df, order, names = self._aggregated(df, q["aggregations"], p, sort, scope, depth)
        else:
            df, order, names = self._rows(df, p, sort, q.get("distinct"), scope, depth, alias, outer)
        if page.get("include_total") and depth == 0 and parent is None:
            # a count of its own, joined as one row: a window over all rows would bring them to one task
            df = df.crossJoin(F.broadcast(df.select(F.lit(1)).agg(F.count(F.lit(1)).alias(TOTAL))))
        if q.get("distinct") is True or (q.get("distinct") or {}) != {} and isinstance(q["distinct"], dict) and q["distinct"].get("is_distinct"):
            order = [o for o in order if o[0] in names]
            df = df.select(*[F.col(f"`{c}`") for c in names]).distinct()
        if q.get("union"):
            order = [o for o in order if o[0] in names]
            df = self._set(df.select(*[F.col(f"`{c}`") for c in names]), q["union"], depth, parent)
        hidden = [c for c, _ in order if c.startswith("__sort_")]
        if order:
            df = df.orderBy(*[F.col(f"`{c}`").desc() if d == "desc" else F.col(f"`{c}`").asc() for c, d in order])
        if page.get("type", "offset") == "offset" and page.get("offset"):
            df = df.offset(page["offset"])
        limit = page.get("limit") or q.get("limit")
        df = df.limit(limit) if limit else df
        return df.drop(*hidden) if hidden else df

    def _order(self, sort: list[dict], scope: Scope, out: list[str]) -> tuple[list[Column], list[tuple[str, str]]]:
        """Columns to carry for sorting (those not in the output), and the order by output names."""
        carry, order = [], []
        for i, s in enumerate(sort):
            if s["field"] in out:
                order.append((s["field"], s.get("direction", "asc")))
            else:
                carry.append(scope.resolve(s["field"]).alias(f"__sort_{i}"))
                order.append((f"__sort_{i}", s.get("direction", "asc")))
        return carry, order

    def _rows(self, df: DataFrame, p: dict, sort: list[dict], distinct: Any, scope: Scope, depth: int, alias: str, outer: bool):
        by = distinct.get("fields") if isinstance(distinct, dict) else None
        if by:  # the first row of each key, by the query's order, then by all columns
            keys = [scope.resolve(f) for f in by]
            first = [scope.resolve(s["field"]).desc() if s.get("direction") == "desc" else scope.resolve(s["field"]).asc() for s in sort]
            rest = [F.col(f"`{a}`.`{c}`") for a, cs in scope.sources.items() for c, t in cs.items() if not isinstance(t, _UNORDERED)]
            # ordered by the query's order and a hash of the row; a row's other columns are no part of the sort
            n = F.row_number().over(W.partitionBy(*keys).orderBy(*first, F.xxhash64(*rest)))
            df = df.withColumn("__n", n).where("__n = 1").drop("__n")
        computed = [self.computed(c, scope, depth) for c in p.get("computed") or []]
        if p.get("include"):
            columns = self._included(p["include"], scope.resolve, scope.sources)
        elif computed and not p.get("exclude") and not p.get("include") and p.get("computed"):
            columns = []
        elif len(scope.sources) > 1:
            columns = [self._whole(a, cs, outer) for a, cs in scope.sources.items()]
        else:
            columns = [F.col(f"`{alias}`.`{c}`") for c in scope.sources[alias]]
        if p.get("include"):
            names = list(dict.fromkeys(f.get("alias") or _unqualified(f["name"], scope.sources)[0] for f in p["include"]))
        else:
            names = ([] if not columns else list(scope.sources) if len(scope.sources) > 1 else list(scope.sources[alias]))
        names += [_alias(c) for c in p.get("computed") or []]
        carry, order = self._order(sort, scope, names)
        df = df.select(*columns, *computed, *carry)
        return self._excluded(df, p.get("exclude") or []), order, self._left(names, p)

    @staticmethod
    def _left(names: list[str], p: dict) -> list[str]:
        gone = {f["name"] for f in p.get("exclude") or [] if not f.get("nested")}
        return [n for n in names if n not in gone]

    @staticmethod
    def _whole(alias: str, columns: list[str], outer: bool) -> Column:
        whole = F.struct(*[F.col(f"`{alias}`.`{c}`") for c in columns])
        return (F.when(F.col(f"`{alias}`.`{_MARK}{alias}`").isNotNull(), whole) if outer else whole).alias(alias)

    def _aggregated(self, df: DataFrame, aggs: list[dict], p: dict, sort: list[dict], scope: Scope, depth: int):
        groups = list(dict.fromkeys(g for a in aggs for g in a.get("groups") or []))
        names = {g: g.split(".")[-1] for g in groups}
        outputs = []
        for a in aggs:
            if a.get("type"):
                outputs.append(self._aggregate(a, scope, depth).alias(self._agg_name(a)))
        keys = [scope.resolve(g).alias(names[g]) for g in groups]
        if not keys:  # a plain select of aggregates leaves outer fields open, which agg would not
            df = df.select(*outputs)
        else:
            df = df.groupBy(*keys).agg(*outputs) if outputs else df.select(*keys).distinct()
        out = [self._agg_name(a) for a in aggs if a.get("type")]
        done = Scope(scope.parent)
        done.extra = {*names.values(), *out}
        inner = done.resolve
        done.resolve = lambda path: inner(names.get(path, path))  # type: ignore[method-assign]
        for a in aggs:
            if a.get("filter"):
                df = df.where(self.filter(a["filter"], done, depth))
        keep = [names[g] for g in groups]
        computed = [self.computed(c, done, depth) for c in p.get("computed") or []]
        shown = {c: c for c in [*keep, *out]}
        if p.get("include"):
            picked = {f.get("alias") or names.get(f["name"], f["name"]): names.get(f["name"], f["name"]) for f in p["include"]}
            shown = {k: c for k, c in picked.items() if c in done.extra} | {c: c for c in out if c not in picked.values()}
        final = [*shown, *[_alias(c) for c in p.get("computed") or []]]
        carry, order = self._order([{**s, "field": names.get(s["field"], s["field"])} for s in sort], done, final)
        df = df.select(*[F.col(f"`{c}`").alias(k) for k, c in shown.items()], *computed, *carry)
        return self._excluded(df, p.get("exclude") or []), order, self._left(final, p)

    @staticmethod
    def _agg_name(a: dict) -> str:
        plain = a.get("field") in (None, "", "*")
        return a.get("alias") or (a["type"] if plain else f"{a['type']}_{a['field'].replace('.', '_')}")

    def _aggregate(self, a: dict, scope: Scope, depth: int) -> Column:
        """An aggregate; ``where`` filters its rows before, ``filter`` (HAVING) is the group's and applied after."""
        star = a.get("field") in (None, "", "*")
        c = F.lit(1) if star else scope.resolve(a["field"])
        if a.get("where"):
            c = F.when(self.filter(a["where"], scope, depth), c)
        if a["type"] in self.registry.aggregates:
            return self.registry.aggregates[a["type"]](c)
        return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a["type"]](c)

    def _set(self, df: DataFrame, u: dict | None, depth: int, parent: Scope | None) -> DataFrame:
        parts = [df, *[self._query(m, parent, depth + 1) for m in u["queries"]]]
        step = {"union": lambda a, b: a.union(b), "all": lambda a, b: a.union(b), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}[u["type"]]
        out = functools.reduce(step, parts)
        return out.distinct() if u["type"] == "union" else out



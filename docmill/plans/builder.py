"""The fluent builder of queries."""

from __future__ import annotations

from typing import Any

from docmill.plans import ir
from docmill.plans.ir import Query


def field(path: str) -> dict:
    """A reference to a field, as a value."""
    return {"type": "field", "field": path}


def subquery(q: dict | QueryBuilder) -> dict:
    """A query as a value."""
    return {"type": "subquery", "query": dict(q.build() if isinstance(q, QueryBuilder) else q)}


def call(function: str, *args: Any) -> dict:
    """A function call as a value."""
    return {"function": function, "arguments": [value(a) for a in args]}


def value(v: Any) -> Any:
    return subquery(v) if isinstance(v, (QueryBuilder, Query)) else [value(x) for x in v] if isinstance(v, (list, tuple, set)) else v


class Condition:
    def __init__(self, owner, path: str, add) -> None:
        self.owner, self.path, self.add = owner, path, add

    def _done(self, op: str, v: Any = None):
        self.add({"field": self.path, "operator": op, "value": value(v)})
        return self.owner

    def eq(self, v): return self._done("eq", v)  # noqa: E704
    def neq(self, v): return self._done("neq", v)  # noqa: E704
    def lt(self, v): return self._done("lt", v)  # noqa: E704
    def lte(self, v): return self._done("lte", v)  # noqa: E704
    def gt(self, v): return self._done("gt", v)  # noqa: E704
    def gte(self, v): return self._done("gte", v)  # noqa: E704
    def is_in(self, v): return self._done("in", v)  # noqa: E704
    def not_in(self, v): return self._done("nin", v)  # noqa: E704
    def contains(self, v): return self._done("contains", v)  # noqa: E704
    def not_contains(self, v): return self._done("ncontains", v)  # noqa: E704
    def exists(self): return self._done("exists")  # noqa: E704
    def not_exists(self): return self._done("nexists")  # noqa: E704
    def custom(self, op: str, v: Any = None): return self._done(op, v)  # noqa: E704


class TextSearch:
    def __init__(self, owner, fields, add) -> None:
        self.owner, self.fields, self.add = owner, list(fields), add

    def _done(self, kind: str, text: str, operator: str, case_sensitive: bool):
        self.add({"query": text, "fields": self.fields, "type": kind, "operator": operator, "case_sensitive": case_sensitive})
        return self.owner

    def contains(self, text: str, operator: str = "or", case_sensitive: bool = False): return self._done("contains", text, operator, case_sensitive)  # noqa: E704
    def exact(self, text: str, operator: str = "or", case_sensitive: bool = False): return self._done("exact", text, operator, case_sensitive)  # noqa: E704
    def phrase(self, text: str, operator: str = "or", case_sensitive: bool = False): return self._done("phrase", text, operator, case_sensitive)  # noqa: E704


class Group:
    def __init__(self, owner, operator: str, add) -> None:
        self.owner, self.body, self.add = owner, {"operator": operator, "conditions": []}, add

    def _more(self, f: dict) -> None:
        self.body["conditions"].append(f)

    def where(self, path: str) -> Condition: return Condition(self, path, self._more)  # noqa: E704
    def where_group(self, operator: str) -> Group: return Group(self, operator, self._more)  # noqa: E704
    def where_text_search(self, *fields: str) -> TextSearch: return TextSearch(self, fields, self._more)  # noqa: E704

    def group(self, f: dict) -> Group:
        self._more(f)
        return self

    def end(self):
        self.add(self.body)
        return self.owner


class Case:
    def __init__(self, owner: Projection, alias: str) -> None:
        self.owner, self.item = owner, {"type": "case", "conditions": [], "else": None, "alias": alias}

    def when(self, f: dict, then: Any) -> Case:
        self.item["conditions"].append({"when": f, "then": value(then)})
        return self

    def otherwise(self, v: Any) -> Case:
        self.item["else"] = value(v)
        return self

    def end(self) -> Projection:
        self.owner.body = ir.add_computed(self.owner.body, self.item)
        return self.owner


class Projection:
    def __init__(self, owner: QueryBuilder | None = None) -> None:
        self.owner, self.body = owner, {}

    def include(self, *fields: str, alias: str | None = None) -> Projection:
        self.body.setdefault("include", []).extend({"name": f} | ({"alias": alias} if alias else {}) for f in fields)
        return self

    def include_nested(self, path: str, nested: Projection | dict) -> Projection:
        self.body.setdefault("include", []).append({"name": path, "nested": nested.body if isinstance(nested, Projection) else nested})
        return self

    def exclude(self, *fields: str) -> Projection:
        self.body.setdefault("exclude", []).extend({"name": f} for f in fields)
        return self

    def add_computed(self, alias: str, function: str, *args: Any) -> Projection:
        self.body = ir.add_computed(self.body, {"type": "computed", "expression": call(function, *args), "alias": alias})
        return self

    def add_case(self, alias: str) -> Case:
        return Case(self, alias)

    def end(self) -> QueryBuilder:
        self.owner.query["projection"] = self.body
        return self.owner


class Join:
    def __init__(self, owner: QueryBuilder, kind: str, target: str) -> None:
        self.owner, self.body = owner, {"type": kind, "target": {"name": target}}

    def on(self, f: dict) -> Join:
        self.body["on"] = f
        return self

    def alias(self, a: str) -> Join:
        self.body["target"]["alias"] = a
        return self

    def schema(self, s: dict) -> Join:
        self.body["target"]["schema"] = s
        return self

    def with_projection(self, p: Projection | dict) -> Join:
        self.body["projection"] = p.body if isinstance(p, Projection) else p
        return self

    def end(self) -> QueryBuilder:
        self.owner.query.setdefault("joins", []).append(self.body)
        return self.owner


class Aggregation:
    def __init__(self, owner: QueryBuilder) -> None:
        self.owner, self.body = owner, {"type": ""}

    def _set(self, k: str, v: Any) -> Aggregation:
        self.body[k] = v
        return self

    def type(self, t: str): return self._set("type", t)  # noqa: E704
    def field(self, f: str): return self._set("field", f)  # noqa: E704
    def alias(self, a: str): return self._set("alias", a)  # noqa: E704
    def with_filter(self, f: dict): return self._set("filter", f)  # noqa: E704
    def where(self, f: dict): return self._set("where", f)  # noqa: E704

    def add_group(self, *groups: str) -> Aggregation:
        self.body.setdefault("groups", []).extend(groups)
        return self

    def end(self) -> QueryBuilder:
        self.owner.query.setdefault("aggregations", []).append(self.body)
        return self.owner


class QueryBuilder:
    def __init__(self, query: dict | None = None) -> None:
        self.query = Query(query or {})

    def _set(self, k: str, v: Any) -> QueryBuilder:
        self.query[k] = v
        return self

    def build(self) -> Query: return self.query.clone()  # noqa: E704
    def clone(self) -> QueryBuilder: return QueryBuilder(self.query.clone())  # noqa: E704
    def __str__(self) -> str: return self.query.to_json()  # noqa: E704

    def reset(self) -> QueryBuilder:
        self.query = Query()
        return self

    def validate(self) -> QueryBuilder:
        self.query.validate()
        return self

    def from_(self, target: str) -> QueryBuilder: return self._set("target", {**self.query.get("target", {}), "name": target})  # noqa: E704
    def alias(self, a: str) -> QueryBuilder: return self._set("target", {**self.query.get("target", {}), "alias": a})  # noqa: E704
    def schema(self, s: dict) -> QueryBuilder: return self._set("target", {**self.query.get("target", {}), "schema": s})  # noqa: E704

    def and_filter(self, f: dict) -> QueryBuilder: return self._set("filters", ir.combine("and", self.query.get("filters"), f))  # noqa: E704
    def or_filter(self, f: dict) -> QueryBuilder: return self._set("filters", ir.combine("or", self.query.get("filters"), f))  # noqa: E704
    def apply_filter(self, f: dict) -> QueryBuilder: return self._set("filters", f)  # noqa: E704
    def where(self, path: str) -> Condition: return Condition(self, path, self.and_filter)  # noqa: E704
    def where_group(self, operator: str) -> Group: return Group(self, operator, self.and_filter)  # noqa: E704
    def text_search(self, *fields: str) -> TextSearch: return TextSearch(self, fields, self.and_filter)  # noqa: E704

    def order_by(self, path: str, direction: str = "asc") -> QueryBuilder: return self._set("sort", [{"field": path, "direction": direction}])  # noqa: E704
    def order_by_asc(self, path: str) -> QueryBuilder: return self.order_by(path)  # noqa: E704
    def order_by_desc(self, path: str) -> QueryBuilder: return self.order_by(path, "desc")  # noqa: E704
    def then_sort_by(self, path: str, direction: str = "asc") -> QueryBuilder: return self._set("sort", [*self.query.get("sort", []), {"field": path, "direction": direction}])  # noqa: E704
    def then_sort_by_asc(self, path: str) -> QueryBuilder: return self.then_sort_by(path)  # noqa: E704
    def then_sort_by_desc(self, path: str) -> QueryBuilder: return self.then_sort_by(path, "desc")  # noqa: E704

    def _page(self, **kw: Any) -> QueryBuilder: return self._set("pagination", {"type": "offset", **self.query.get("pagination", {}), **kw})  # noqa: E704
    def limit(self, n: int) -> QueryBuilder: return self._page(limit=n)  # noqa: E704
    def offset(self, n: int) -> QueryBuilder: return self._page(offset=n)  # noqa: E704
    def include_total(self) -> QueryBuilder: return self._page(include_total=True)  # noqa: E704
    def cursor(self, path: str, after: Any, limit: int, direction: str = "asc") -> QueryBuilder: return self._page(type="cursor", limit=limit, cursor={"field": path, "cursor": after}, order=[{"field": path, "direction": direction}])  # noqa: E704

    def select(self) -> Projection: return Projection(self)  # noqa: E704
    def join(self, kind: str, target: str) -> Join: return Join(self, kind, target)  # noqa: E704
    def inner_join(self, target: str) -> Join: return Join(self, "inner", target)  # noqa: E704
    def left_join(self, target: str) -> Join: return Join(self, "left", target)  # noqa: E704
    def right_join(self, target: str) -> Join: return Join(self, "right", target)  # noqa: E704
    def full_join(self, target: str) -> Join: return Join(self, "full", target)  # noqa: E704

    def aggregate(self) -> Aggregation: return Aggregation(self)  # noqa: E704
    def _agg(self, kind: str, path: str, alias: str | None) -> QueryBuilder: return self._set("aggregations", [*self.query.get("aggregations", []), {"type": kind, "field": path, **({"alias": alias} if alias else {})}])  # noqa: E704
    def count(self, path: str = "*", alias: str | None = None): return self._agg("count", path, alias)  # noqa: E704
    def sum(self, path: str, alias: str | None = None): return self._agg("sum", path, alias)  # noqa: E704
    def avg(self, path: str, alias: str | None = None): return self._agg("avg", path, alias)  # noqa: E704
    def min(self, path: str, alias: str | None = None): return self._agg("min", path, alias)  # noqa: E704
    def max(self, path: str, alias: str | None = None): return self._agg("max", path, alias)  # noqa: E704
    def group_by(self, *paths: str) -> QueryBuilder: return self._set("aggregations", [*self.query.get("aggregations", []), {"type": "", "groups": list(paths)}])  # noqa: E704
    def distinct(self) -> QueryBuilder: return self._set("distinct", True)  # noqa: E704
    def distinct_by(self, *paths: str) -> QueryBuilder: return self._set("distinct", {"fields": list(paths)})  # noqa: E704

    def _union(self, kind: str, queries) -> QueryBuilder:
        u = self.query.get("union") or {"type": kind, "queries": []}
        return self._set("union", {**u, "queries": [*u["queries"], *[dict(q.build() if isinstance(q, QueryBuilder) else q) for q in queries]]})

    def union(self, *q): return self._union("union", q)  # noqa: E704
    def union_all(self, *q): return self._union("all", q)  # noqa: E704
    def intersect(self, *q): return self._union("intersect", q)  # noqa: E704
    def except_(self, *q): return self._union("except", q)  # noqa: E704

    def add_hint(self, h: dict) -> QueryBuilder: return self._set("hints", [*self.query.get("hints", []), h])  # noqa: E704
    def use_index(self, i: str): return self.add_hint({"type": "use_index", "index": i})  # noqa: E704
    def force_index(self, i: str): return self.add_hint({"type": "force_index", "index": i})  # noqa: E704
    def no_index(self): return self.add_hint({"type": "no_index"})  # noqa: E704
    def max_execution_time(self, ms: int): return self.add_hint({"type": "max_execution_time", "ms": ms})  # noqa: E704
    def raw(self, template: str, args: list | None = None, collections: dict | None = None): return self._set("raw", {"template": template, "args": args or [], "from": collections or {}})  # noqa: E704


def increment(path: str, delta: float) -> dict:
    """A computed update that adds ``delta`` to a field."""
    return {path: call("ADD", field(path), delta)}

"""The query model: plain JSON objects, checked on the way in.

A query is a dict with target, filters, projection, sort, limit, pagination, joins, distinct, aggregations, union,
hints and raw. Values are literals, ``{"type": "field", "field": …}``, ``{"type": "subquery", "query": …}`` or
``{"function": …, "arguments": […]}``. Filters are conditions, groups or text searches, bare or under a key of their own.
"""

from __future__ import annotations

import copy
import json
import re
from typing import Any

COMPARISONS = ("eq", "neq", "lt", "lte", "gt", "gte", "in", "nin", "contains", "ncontains", "exists", "nexists")
GROUPS = ("and", "or", "not", "nor", "xor", "nand", "xnor")
TEXT_TYPES = ("contains", "exact", "phrase")
JOINS = ("inner", "left", "right", "full")
SETS = ("union", "all", "intersect", "except")
AGGREGATES = ("count", "sum", "avg", "min", "max")
MAX_DEPTH = 10
IDENTIFIER = re.compile(r"[A-Za-z0-9_.]+\Z")


class QueryError(ValueError):
    """A query that cannot be compiled; ``code`` names the rule it breaks."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def name(x: Any) -> str:
    if not isinstance(x, str) or not IDENTIFIER.match(x):
        raise QueryError("IDENTIFIER", f"{x!r} is no identifier")
    return x


def filter_kind(f: dict) -> tuple[str, dict]:
    """("condition" | "group" | "text", its body); exactly one must be given."""
    if not isinstance(f, dict):
        raise QueryError("FILTER", "a filter is an object")
    wrapped = [(k, f[k2]) for k, k2 in (("condition", "condition"), ("group", "group"), ("text", "text_search_query")) if f.get(k2) is not None]
    if len(wrapped) > 1:
        raise QueryError("FILTER", "a filter is one of condition, group and text search")
    if wrapped:
        return wrapped[0]
    if "conditions" in f:
        return "group", f
    if "query" in f:
        return "text", f
    if "field" in f:
        return "condition", f
    raise QueryError("FILTER", "a filter is a condition, a group or a text search")


def value_kind(v: Any) -> str:
    """literal, array, field, subquery or function."""
    if isinstance(v, dict):
        if v.get("type") == "field" and "field" in v:
            return "field"
        if v.get("type") == "subquery" and "query" in v:
            return "subquery"
        return "function" if "function" in v else "literal"
    return "array" if isinstance(v, (list, tuple)) else "literal"


def check_filter(f: dict, operators: frozenset[str] = frozenset()) -> None:
    kind, body = filter_kind(f)
    if kind == "condition":
        name(body.get("field"))
        op = body.get("operator")
        if op not in COMPARISONS and op not in operators:
            raise QueryError("OPERATOR", f"unknown operator {op!r}")
        if op in ("in", "nin") and value_kind(body.get("value")) not in ("array", "subquery"):
            raise QueryError("OPERATOR", f"{op} takes a list or a subquery")
    elif kind == "group":
        op, of = body.get("operator"), body.get("conditions")
        if op not in GROUPS:
            raise QueryError("GROUP", f"unknown logical operator {op!r}")
        if not of:
            raise QueryError("GROUP", "a group has at least one condition")
        if op == "not" and len(of) != 1:
            raise QueryError("GROUP", "not takes exactly one condition")
        for g in of:
            check_filter(g, operators)
    else:
        if body.get("type", "contains") not in TEXT_TYPES:
            raise QueryError("TEXT", f"unknown text search {body.get('type')!r}")
        if not body.get("fields"):
            raise QueryError("TEXT", "a text search names its fields")
        if body.get("operator", "or") not in ("and", "or"):
            raise QueryError("TEXT", "fields combine with and or or")


def check(q: dict, operators: frozenset[str] = frozenset(), aggregates: frozenset[str] = frozenset(), depth: int = 0) -> dict:
    """``q`` itself if every clause is well-formed; sub-queries nest at most MAX_DEPTH deep."""
    if depth > MAX_DEPTH:
        raise QueryError("DEPTH", f"sub-queries nest at most {MAX_DEPTH} deep")
    if q.get("raw"):
        if not q["raw"].get("template"):
            raise QueryError("RAW", "a raw query has a template")
        return q
    if not (q.get("target") or {}).get("name"):
        raise QueryError("TARGET", "a query has a target")
    if q.get("filters"):
        check_filter(q["filters"], operators)
    p = q.get("projection") or {}
    if p.get("include") and p.get("exclude"):
        raise QueryError("PROJECTION", "include or exclude, not both")
    for s in q.get("sort") or []:
        name(s.get("field"))
        if s.get("direction", "asc") not in ("asc", "desc"):
            raise QueryError("SORT", f"unknown direction {s.get('direction')!r}")
    page = q.get("pagination")
    if page:
        if page.get("type", "offset") not in ("offset", "cursor"):
            raise QueryError("PAGINATION", f"unknown pagination {page.get('type')!r}")
        if not isinstance(page.get("limit"), int) or page["limit"] <= 0:
            raise QueryError("PAGINATION", "a page has a limit above 0")
        if (page.get("offset") or 0) < 0:
            raise QueryError("PAGINATION", "an offset is not negative")
    if q.get("limit") is not None and q["limit"] <= 0:
        raise QueryError("PAGINATION", "a limit is above 0")
    for j in q.get("joins") or []:
        if j.get("type", "inner") not in JOINS:
            raise QueryError("JOIN", f"unknown join {j.get('type')!r}")
        if j.get("on"):
            check_filter(j["on"], operators)
    for a in q.get("aggregations") or []:
        if a.get("type") and a["type"] not in AGGREGATES and a["type"] not in aggregates:
            raise QueryError("AGGREGATE", f"unknown aggregate {a['type']!r}")
    u = q.get("union")
    if u:
        if u.get("type") not in SETS:
            raise QueryError("UNION", f"unknown set operation {u.get('type')!r}")
        for m in u.get("queries") or []:
            check(m, operators, aggregates, depth + 1)
    return q


class Query(dict):
    """A query object with the utilities users expect of one."""

    @classmethod
    def parse(cls, text: str | bytes | dict) -> Query:
        raw = json.loads(text) if isinstance(text, (str, bytes)) else copy.deepcopy(text)
        return cls(check(raw))

    def clone(self) -> Query:
        return Query(copy.deepcopy(dict(self)))

    def to_json(self) -> str:
        return json.dumps(self, sort_keys=True, ensure_ascii=False)

    def merge(self, other: dict) -> Query:
        """Clause by clause; the other's win."""
        return Query({**self.clone(), **{k: copy.deepcopy(v) for k, v in other.items() if v is not None}})

    def validate(self) -> Query:
        check(self)
        return self


# -- projections ------------------------------------------------------------------------------------------------------


def included(p: dict) -> list[str]:
    return [f["name"] for f in p.get("include") or []]


def has_field(p: dict, field: str) -> bool:
    """Whether a projection yields the field: included, or not excluded where nothing is included."""
    if p.get("include"):
        return field in included(p)
    return field not in [f["name"] for f in p.get("exclude") or []]


def include_field(p: dict, field: str) -> dict:
    return p if field in included(p) else {**p, "include": [*(p.get("include") or []), {"name": field}]}


def unexclude_field(p: dict, field: str) -> dict:
    return {**p, "exclude": [f for f in p.get("exclude") or [] if f["name"] != field]}


def add_computed(p: dict, item: dict) -> dict:
    """The projection with ``item``, in place of another of the same alias."""
    return {**p, "computed": [c for c in p.get("computed") or [] if c["alias"] != item["alias"]] + [item]}


def combine(op: str, *filters: dict | None) -> dict | None:
    """The filters under one group; none and one need no group."""
    given = [f for f in filters if f]
    return given[0] if len(given) == 1 else {"operator": op, "conditions": given} if given else None

"""Named scalar functions of queries as Column expressions, and the registries of users' own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd HH:mm:ss"


def _moment(x: Column) -> Column:
    """A string or timestamp as a timestamp; the word ``now`` is the current one."""
    s = x.cast("string")
    return F.when(F.lower(s) == "now", F.current_timestamp()).otherwise(F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))))


def _number(x: Column) -> Column:
    return x.try_cast("double")


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(_number(a), _number(b)),
    "json_extract": lambda doc, path: F.call_function("get_json_object", doc, path),
    "json_valid": lambda doc: F.try_parse_json(doc).isNotNull(),
    "upper": F.upper,
    "lower": F.lower,
    "length": F.length,
    "substr": lambda s, start, n=None: F.substr(s, start.cast("int"), n.cast("int")) if n is not None else F.substr(s, start.cast("int")),
    "concat": lambda *xs: F.concat_ws("", *[x.cast("string") for x in xs]),
    "abs": F.abs,
    "round": lambda x, n=None: F.round(x, n.cast("int")) if n is not None else F.round(x),
    "datetime": lambda x=None: F.date_format(F.current_timestamp() if x is None else _moment(x), STAMP),
    "date": lambda x=None: F.date_format(F.current_timestamp() if x is None else _moment(x), "yyyy-MM-dd"),
    "coalesce": F.coalesce,
    "trim": F.trim,
}
ARITY = {"add": (2, 2), "subtract": (2, 2), "multiply": (2, 2), "divide": (2, 2), "json_extract": (2, 2), "json_valid": (1, 1), "upper": (1, 1), "lower": (1, 1), "length": (1, 1), "substr": (2, 3), "abs": (1, 1), "round": (1, 2)}


class Registry:
    """Users' functions: scalar (Columns to Column), predicates (field, value to Column) and aggregates (Column to Column)."""

    def __init__(self) -> None:
        self.scalars: dict[str, Callable[..., Column]] = {}
        self.predicates: dict[str, Callable[[Column, Column], Column]] = {}
        self.aggregates: dict[str, Callable[[Column], Column]] = {}

    def scalar(self, name: str, f: Callable[..., Column]) -> Registry:
        self.scalars[name.lower()] = f
        return self

    def predicate(self, name: str, f: Callable[[Column, Column], Column]) -> Registry:
        self.predicates[name] = f
        return self

    def aggregate(self, name: str, f: Callable[[Column], Column]) -> Registry:
        self.aggregates[name] = f
        return self

    def call(self, name: str, args: list[Column]) -> Column:
        """Own functions first, then the named ones, then any function that Spark itself has."""
        key = name.lower()
        if key in self.scalars:
            return self.scalars[key](*args)
        low, high = ARITY.get(key, (0, 1 << 30))
        if not low <= len(args) <= high:
            raise ValueError(f"{name} takes {low} to {high} arguments, not {len(args)}")
        return FUNCTIONS[key](*args) if key in FUNCTIONS else F.call_function(name, *args)

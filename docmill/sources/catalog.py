"""Collections by name and version, queries over them, and templated SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.scalar import Registry
from docmill.plans.builder import QueryBuilder
from docmill.plans.compiler import Compiler
from docmill.plans.ir import Query, QueryError, combine
from docmill.plans.result import Result

_SLOT = re.compile(r"\{\{\s*collections\.([A-Za-z0-9_]+)\s*\}\}")


class Catalog:
    """Names, with versions, to DataFrames. A collection may be a DataFrame, a path of Parquet, or a function that gives one."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None) -> None:
        self.spark, self.registry = spark, registry or Registry()
        self._sources: dict[tuple[str, str], Any] = {}
        self._active: dict[str, str] = {}

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        out = cls(spark)
        for n in names:
            out.register(n, f"{folder}/{n}.parquet")
        return out

    def register(self, name: str, source: DataFrame | str | Callable[[], DataFrame], version: str = "1.0.0", activate: bool = True) -> Catalog:
        self._sources[name, version] = source
        if activate or name not in self._active:
            self._active[name] = version
        return self

    def activate(self, name: str, version: str) -> None:
        if (name, version) not in self._sources:
            raise QueryError("COLLECTION", f"{name} has no version {version}")
        self._active[name] = version

    def names(self) -> list[str]:
        return sorted(self._active)

    def exists(self, name: str) -> bool:
        return name in self._active

    def drop(self, name: str) -> None:
        self._active.pop(name, None)
        self._sources = {k: v for k, v in self._sources.items() if k[0] != name}

    def table(self, name: str, version: str | None = None) -> DataFrame:
        source = self._sources.get((name, version or self._active.get(name, "")))
        if source is None:
            raise QueryError("COLLECTION", f"no collection {name!r}")
        if isinstance(source, str):
            return self.spark.read.parquet(source)
        return source if isinstance(source, DataFrame) else source()

    def sql(self, raw: dict) -> DataFrame:
        """Templated SQL: each ``{{collections.key}}`` is a collection (renamed or pinned by ``from``), each ``?`` an argument."""
        given: dict[str, DataFrame] = {}

        def slot(m: re.Match) -> str:
            to = (raw.get("from") or {}).get(m[1], {"collection": m[1]})
            given[m[1]] = self.table(to["collection"], to.get("version"))
            return "{" + m[1] + "}"

        # braces that are no slot are text of the query, which the formatter wants doubled
        text, at = "", 0
        for m in _SLOT.finditer(raw["template"]):
            text += raw["template"][at : m.start()].replace("{", "{{").replace("}", "}}") + slot(m)
            at = m.end()
        text += raw["template"][at:].replace("{", "{{").replace("}", "}}")
        args = raw.get("args") or []
        if not given:
            text = raw["template"]
        return self.spark.sql(text, args=list(args) or None, **given)

    def execute(self, raw: dict) -> dict:
        """A templated statement of any kind: rows of a query, or how many rows another statement says it touched."""
        df = self.sql(raw)
        words = raw["template"].split(None, 1)
        if words and words[0].lower() in ("select", "with", "values", "table", "from", "show", "describe", "explain"):
            return {"type": "rows", "columns": df.columns, "data": df}
        first = df.first()
        affected = next((v for k, v in (first.asDict() if first else {}).items() if k.startswith("num_") and k.endswith("_rows")), None)
        return {"type": "exec", "rows_affected": affected}

    def envelope(self, raw: dict, key: str = "result") -> DataFrame:
        """The rows of a templated query as one JSON array in one row, ``{"result": [...]}``, with their number.

        The array is one value, so as large as the result: for results of a page's size.
        """
        df = self.sql(raw)
        return df.agg(F.count(F.lit(1)).alias("count"), F.to_json(F.struct(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(key)), {"ignoreNullFields": "false"}).alias("json"))

    def compiler(self, doc_mode: bool = False, case_insensitive: bool = False) -> Compiler:
        return Compiler(self.table, self.registry, doc_mode, case_insensitive, self.sql)

    def frame(self, query: dict | str | QueryBuilder, **options: bool) -> DataFrame:
        """The query's rows as a lazy DataFrame."""
        q = query.build() if isinstance(query, QueryBuilder) else Query.parse(query)
        return self.compiler(**options).compile(q)

    def read(self, query: dict | str | QueryBuilder, **options: bool) -> Result:
        """The query's rows with totals and page information."""
        q = query.build() if isinstance(query, QueryBuilder) else Query.parse(query)
        page = q.get("pagination") or {}
        plain = Query({k: v for k, v in q.items() if k not in ("pagination", "limit", "sort")})
        after = None
        if page.get("type") == "cursor" and page.get("cursor"):  # the rows from the cursor on, for the page's own count
            at = page["cursor"]
            down = (page.get("order") or [{}])[0].get("direction") == "desc"
            beyond = {"field": at["field"], "operator": "lt" if down else "gt", "value": at["cursor"]}
            after = self.frame(Query({**plain, "filters": combine("and", plain.get("filters"), beyond)}), **options)
        shown = Query({**q, "pagination": {k: v for k, v in page.items() if k != "include_total"}}) if page else q
        return Result(self.frame(shown, **options), self.frame(plain, **options), page.get("limit") or q.get("limit"), page.get("offset") or 0, after=after)

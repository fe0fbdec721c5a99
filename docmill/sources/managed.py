"""Managed collections: copy-on-write tables of Parquet versions with updates, deletes, uniqueness and a change log.

A version is a list of data folders. A commit is one file, named by its number and made by a rename that does not
replace: of two writers of one number the second fails. It holds the list and the commit's change rows, so both become
visible at once; the change log is the commit files themselves. Readers see the version that was active when they asked.
"""

from __future__ import annotations

import json
import os
import re
import secrets
import shutil
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.plans.compiler import Compiler, Scope
from docmill.plans.ir import QueryError


def uuid7(ms: int | None = None) -> str:
    """A UUIDv7 without dashes."""
    ms = int(time.time() * 1000) if ms is None else ms
    rand = secrets.randbits(74)
    return f"{(ms << 80) | (7 << 76) | ((rand >> 62) << 64) | (2 << 62) | (rand & ((1 << 62) - 1)):032x}"


def uuid7_column() -> Column:
    """UUIDv7-shaped ids from built-in functions: milliseconds, then random hex."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    r = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(ms, F.lit("7"), F.substring(r, 14, 3), F.substring(r, 17, 16))


def _scope(df: DataFrame, name: str) -> tuple[DataFrame, Scope]:
    scope = Scope()
    scope.sources[name] = {f.name: f.dataType for f in df.schema.fields}
    return df.alias(name), scope


def _compiler(catalog: Any) -> Compiler:
    def none(name: str) -> DataFrame:
        raise QueryError("COLLECTION", f"no collection {name!r}")

    return catalog.compiler() if catalog is not None else Compiler(none)


def matches(df: DataFrame, filters: dict | None, name: str = "rows", catalog: Any = None) -> tuple[DataFrame, Column]:
    """The aliased rows and whether each matches; unknown counts as no."""
    rows, scope = _scope(df, name)
    hit = F.lit(True) if not filters else F.coalesce(_compiler(catalog).filter(filters, scope), F.lit(False))
    return rows, hit


def updated(df: DataFrame, set_: dict[str, Any] | None = None, compute: dict[str, Any] | None = None, filters: dict | None = None, name: str = "rows", catalog: Any = None) -> DataFrame:
    """The rows after an update: ``set_`` to literals, ``compute`` to functions, field references or (correlated) sub-queries.

    Dotted paths replace a field inside its struct. Values are those before the update, and keep the field's type.
    """
    if not set_ and not compute:
        raise QueryError("UPDATE", "an update sets something")
    rows, scope = _scope(df, name)
    compiler = _compiler(catalog)
    if filters or any(isinstance(v, dict) and v.get("type") == "subquery" for v in (compute or {}).values()):
        rows, hit = matches(df, filters, name, catalog)
    else:
        hit = F.lit(True)
    new = {p: compiler._literal(v) for p, v in (set_ or {}).items()} | {p: compiler.value(v, scope, 0) for p, v in (compute or {}).items()}
    # sub-queries may stand in a projection, so all new values are made first, then chosen
    marked = rows.select(*[F.col(f"`{name}`.`{c}`") for c in df.columns], hit.alias("_hit"), *[v.alias(f"_new{i}") for i, v in enumerate(new.values())])
    out = {c: F.col(f"`{c}`") for c in df.columns}
    for i, path in enumerate(new):
        head, _, rest = path.partition(".")
        if head not in out:
            raise QueryError("FIELD", f"no field {path!r} here")
        value = F.col(f"_new{i}")
        if rest:
            kind = df.select(F.col(f"`{head}`.{rest}")).schema[0].dataType
            changed = out[head].withField(rest, value.cast(kind))
        else:
            changed = value.cast(df.schema[head].dataType)
        out[head] = F.when(F.col("_hit"), changed).otherwise(out[head])
    return marked.select(*[c.alias(n) for n, c in out.items()])


def remaining(df: DataFrame, filters: dict | None, unsafe: bool = False, name: str = "rows", catalog: Any = None) -> DataFrame:
    """The rows that a delete leaves; without filter only if ``unsafe``."""
    if not filters and not unsafe:
        raise QueryError("DELETE", "a delete has a filter, or is marked unsafe")
    rows, hit = matches(df, filters, name, catalog)
    return rows.where(~hit)


class Conflict(RuntimeError):
    """Another writer committed first, or a document's version is not the expected one."""


class ManagedTable:
    """One collection below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, unique: list[str] | None = None, name: str | None = None, catalog: Any = None) -> None:
        self.spark, self.path, self.unique, self.catalog = spark, path.rstrip("/"), list(unique or []), catalog
        self.name = name or os.path.basename(self.path)
        self.fs, self.root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        self._pending: list[dict] | None = None
        self._staged: dict | None = None

    # -- manifest -----------------------------------------------------------------------------------------------------

    def _manifest(self) -> dict:
        if self._staged is not None:
            return self._staged
        folder = f"{self.root}/commits"
        if self.fs.get_file_info(folder).type == pafs.FileType.NotFound:
            return {"commit": 0, "data": None, "schema": None, "log": []}
        last = max((i.path for i in self.fs.get_file_info(pafs.FileSelector(folder)) if re.fullmatch(r"\d{12}\.json", i.base_name)), default=None)
        if last is None:
            return {"commit": 0, "data": None, "schema": None, "log": []}
        with self.fs.open_input_file(last) as f:
            return json.loads(f.read().split(b"\n", 1)[0])["state"]

    def _commit(self, old: dict, data: list[str], events: list[dict]) -> None:
        new = {**old, "commit": old["commit"] + 1, "data": data}
        if self._staged is not None:
            self._staged = new
            self._pending += events
            return
        self._write(old, new, events)

    def _write(self, old: dict, new: dict, events: list[dict]) -> None:
        """One file for the state and its events. A local file is linked, which fails if the number is taken; other file
        systems are asked first, which leaves a moment between the question and the move.
        """
        folder = f"{self.root}/commits"
        self.fs.create_dir(folder, recursive=True)
        where, beside = f"{folder}/{new['commit']:012d}.json", f"{folder}/.{uuid7()}"
        lines = [{"state": new}, *[{**e, "commit": new["commit"]} for e in events]]
        with self.fs.open_output_stream(beside) as f:
            f.write("".join(json.dumps(x) + "\n" for x in lines).encode())
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                os.link(beside, where)
            elif self.fs.get_file_info(where).type != pafs.FileType.NotFound:
                raise FileExistsError(where)
            else:
                self.fs.move(beside, where)
                return
        except FileExistsError:
            raise Conflict(f"{self.name}: commit {new['commit']} came before") from None
        finally:
            if self.fs.get_file_info(beside).type != pafs.FileType.NotFound:
                self.fs.delete_file(beside)

    def _save(self, df: DataFrame) -> str:
        data = f"data-{uuid7()}"
        df.write.parquet(f"{self.path}/{data}")
        return data

    @contextmanager
    def transaction(self) -> Iterator[ManagedTable]:
        """All or nothing: versions and change rows become visible together at the end, and not at all after an error."""
        if self._staged is not None:
            yield self  # joins the one that is open
            return
        start = self._manifest()
        self._staged, self._pending = dict(start), []
        try:
            yield self
            done, events = self._staged, self._pending
        finally:
            self._staged, self._pending = None, None
        if done["commit"] != start["commit"]:
            self._write(start, {**done, "commit": start["commit"] + 1}, events)

    # -- reads --------------------------------------------------------------------------------------------------------

    def df(self) -> DataFrame:
        m = self._manifest()
        if m["data"] is None:
            raise QueryError("COLLECTION", f"{self.name} holds nothing yet")
        return self.spark.read.option("mergeSchema", len(m["data"]) > 1).parquet(*[f"{self.path}/{d}" for d in m["data"]])

    def find(self, id_: str) -> DataFrame:
        return self.df().where(F.col("_id_") == id_)

    def read_as(self, fields: dict[str, str], filters: dict | None = None) -> DataFrame:
        """The documents in another shape: ``fields`` from name to path; ids and metadata always come along."""
        rows, hit = matches(self.df(), filters, self.name, self.catalog)
        system = [c for c in ("_id_", "_metadata_") if c in rows.columns and c not in fields]
        return rows.where(hit).select(*system, *[F.col(p).alias(n) for n, p in fields.items()])

    def create_from(self, rows: DataFrame, fields: dict[str, str]) -> int:
        """Insert documents given in another shape: ``fields`` from the shape's name to the document's field."""
        return self.insert(rows.select(*[F.col(f"`{n}`").alias(to) for n, to in fields.items()], *[c for c in ("_id_", "_metadata_") if c in rows.columns and c not in fields]))

    def update_from(self, rows: DataFrame, fields: dict[str, str]) -> int:
        """Update by ``_id_`` the fields that a shape has; other fields stay, and ids that are not there do nothing."""
        old, before = self._manifest(), self.df()
        new = rows.select(F.col("_id_").alias("__id"), F.lit(True).alias("__hit"), *[F.col(f"`{n}`").cast(before.schema[to].dataType).alias(f"__{to}") for n, to in fields.items()])
        j = before.join(new, F.col("_id_") == F.col("__id"), "left")
        now = {to: F.when(F.col("__hit"), F.col(f"__{to}")).otherwise(F.col(f"`{to}`")) for to in fields.values()}
        if "_metadata_" in before.columns:
            kept = F.col("_metadata_")
            now["_metadata_"] = F.when(F.col("__hit"), kept.withField("version", kept["version"] + 1).withField("updated", F.lit(str(time.time_ns())))).otherwise(kept)
        saved = self._save(j.select(*[now.get(c, F.col(f"`{c}`")).alias(c) for c in before.columns]))
        self._check_unique(self.spark.read.parquet(f"{self.path}/{saved}"))
        n = before.join(new, F.col("_id_") == F.col("__id"), "left_semi").count()
        self._commit(old, [saved], [self._event("document:update:success", count=n)])
        return n

    # -- writes -------------------------------------------------------------------------------------------------------

    def _event(self, kind: str, **more: Any) -> dict:
        return {"id": uuid7(), "type": kind, "collection": self.name, "at": int(time.time() * 1e9), **more}

    def _enriched(self, df: DataFrame) -> DataFrame:
        if "_id_" not in df.columns:
            df = df.withColumn("_id_", uuid7_column())
        if "_metadata_" not in df.columns:
            now = F.lit(str(time.time_ns()))
            df = df.withColumn("_metadata_", F.struct(F.lit(1.0).alias("version"), now.alias("created"), now.alias("updated"), F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("string").alias("signature")))
        return df

    def _check_unique(self, df: DataFrame) -> None:
        for k in ["_id_", *self.unique]:
            if not df.where(F.col(k).isNotNull()).groupBy(k).count().where("count > 1").isEmpty():
                raise Conflict(f"{self.name}: {k} is not unique")

    def insert(self, df: DataFrame, schema: dict | None = None) -> int:
        """Append documents, all or none; ids and metadata are added where missing; given a schema they are validated first."""
        if schema is not None:
            from docmill.operators.validation import issues

            bad = df.select(issues(df, schema).alias("i")).where(F.size("i") > 0).first()
            if bad:
                raise QueryError("VALIDATION", str([x.asDict() for x in bad.i]))
        old = self._manifest()
        rows = self._enriched(df)
        saved = self._save(rows)  # ids are drawn once
        rows = self.spark.read.parquet(f"{self.path}/{saved}")
        n = rows.count()
        self._check_unique(rows)
        if old["data"] is not None:  # the rows that are there are not rewritten; only the new keys are looked up among them
            before = self.df()
            for k in ["_id_", *self.unique]:
                if k in before.columns and not before.select(k).join(rows.select(k).where(F.col(k).isNotNull()), k, "left_semi").isEmpty():
                    raise Conflict(f"{self.name}: {k} is not unique")
        self._commit(old, [*(old["data"] or []), saved], [self._event("document:create:success", count=n)])
        return n

    def update(self, filters: dict | None, set_: dict[str, Any] | None = None, compute: dict[str, Any] | None = None, version: float | None = None) -> DataFrame:
        """Update matching documents and return them as they are after; ``version`` demands that version of them."""
        old, before = self._manifest(), self.df()
        if version is not None:
            filters_v = {"operator": "and", "conditions": [f for f in (filters, {"field": "_metadata_.version", "operator": "eq", "value": version}) if f]}
            _, hit = matches(before, filters_v, self.name, self.catalog)
            if before.alias(self.name).where(hit).isEmpty():
                raise Conflict(f"{self.name}: no document of version {version}")
            filters = filters_v
        compute = dict(compute or {})
        if "_metadata_" in before.columns:
            compute |= {"_metadata_.version": {"function": "ADD", "arguments": [{"type": "field", "field": "_metadata_.version"}, 1]}}
            set_ = dict(set_ or {}) | {"_metadata_.updated": str(time.time_ns())}
        rows, hit = matches(before, filters, self.name, self.catalog)
        ids = rows.where(hit).select("_id_")
        after = updated(before, set_, compute, filters, self.name, self.catalog)
        saved = self._save(after)
        new = self.spark.read.parquet(f"{self.path}/{saved}")
        if any(k in self.unique for k in [*(set_ or {}), *compute]):
            self._check_unique(new)
        self._commit(old, [saved], [self._event("document:update:success", count=ids.count())])
        return new.join(ids, "_id_", "left_semi")

    def replace(self, id_: str, document: DataFrame) -> None:
        """Another document in place of the one with this id."""
        old, before = self._manifest(), self.df()
        kept = before.where(F.col("_id_") != id_)
        one = document.withColumn("_id_", F.lit(id_))
        saved = self._save(kept.unionByName(self._enriched(one), allowMissingColumns=True))
        self._check_unique(self.spark.read.parquet(f"{self.path}/{saved}"))
        self._commit(old, [saved], [self._event("document:update:success", count=1, document=id_)])

    def delete(self, filters: dict | None, unsafe: bool = False) -> int:
        old, before = self._manifest(), self.df()
        kept = remaining(before, filters, unsafe, self.name, self.catalog)
        saved = self._save(kept)
        n = before.count() - self.spark.read.parquet(f"{self.path}/{saved}").count()
        self._commit(old, [saved], [self._event("document:delete:success", count=n)])
        return n

    # -- schema changes -----------------------------------------------------------------------------------------------

    def rewrite(self, step, event: str = "collection:update:success") -> None:
        """Replace the data by ``step`` of them: added, dropped and renamed columns, row transformers."""
        old = self._manifest()
        self._commit(old, [self._save(step(self.df()))], [self._event(event)])

    def add_column(self, name: str, kind: str, default: Any = None) -> None:
        self.rewrite(lambda d: d.withColumn(name, F.lit(default).cast(kind)))

    def drop_column(self, name: str) -> None:
        self.rewrite(lambda d: d.drop(name))

    def rename_column(self, old: str, new: str) -> None:
        self.rewrite(lambda d: d.withColumnRenamed(old, new))

    def rollback(self, data: str | list[str]) -> None:
        """Make an earlier version active."""
        data = [data] if isinstance(data, str) else data
        self._commit(self._manifest(), data, [self._event("collection:rollback:success", data=",".join(data))])

    def drop(self) -> None:
        if isinstance(self.fs, pafs.LocalFileSystem):
            shutil.rmtree(self.root, ignore_errors=True)
        else:
            self.fs.delete_dir(self.root)

    def vacuum(self, older_than_s: float = 7 * 24 * 3600) -> int:
        """Delete data folders of no active version that are older than any writer may still be at work; the number deleted."""
        active, n = self._manifest()["data"] or [], 0
        for info in self.fs.get_file_info(pafs.FileSelector(self.root)):
            if info.base_name.startswith("data-") and info.base_name not in active and int(info.base_name[5:17], 16) / 1000 < time.time() - older_than_s:
                self.fs.delete_dir(info.path)
                n += 1
        return n

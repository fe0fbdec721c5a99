"""Managed tables, change logs, schemas, validation, masking and document functions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from docmill.functions import docs as D
from docmill.functions import masking as M
from docmill.functions.json_schema import errors, json_schema_errors
from docmill.operators import schema as S
from docmill.operators import validation as V
from docmill.operators.document_set import DocumentSet
from docmill.plans.builder import field, increment
from docmill.plans.ir import QueryError
from docmill.sources import documents_io as IO
from docmill.sources.managed import Conflict, ManagedTable, updated, uuid7
from docmill.streaming import changes as C


def eq(f, v):
    return {"field": f, "operator": "eq", "value": v}


def test_managed_table(spark, tmp_path):
    t = ManagedTable(spark, str(tmp_path / "products"), unique=["name"])
    assert t.insert(spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 5)], "name string, price double, stock long")) == 2
    one = t.df().where("name = 'a'").first()
    assert len(one["_id_"]) == 32 and one["_metadata_"]["version"] == 1.0
    with pytest.raises(Conflict):
        t.insert(spark.createDataFrame([("a", 9.0, 1)], "name string, price double, stock long"))
    assert t.df().count() == 2
    got = t.update(eq("name", "a"), {"price": 7.5}, increment("stock", 2)).collect()
    assert [(r["name"], r["price"], r["stock"], r["_metadata_"]["version"]) for r in got] == [("a", 7.5, 5, 2.0)]
    with pytest.raises(Conflict):
        t.update(eq("name", "a"), {"price": 1.0}, version=1.0)
    with pytest.raises(QueryError):
        t.delete(None)
    with pytest.raises(ZeroDivisionError), t.transaction():
        t.delete(eq("name", "a"))
        raise ZeroDivisionError
    assert t.df().count() == 2
    with t.transaction():
        t.delete(eq("name", "a"))
        t.insert(spark.createDataFrame([("c", 1.0, 1)], "name string, price double, stock long"))
    assert {r["name"] for r in t.df().collect()} == {"b", "c"}
    t.replace(t.df().where("name = 'c'").first()["_id_"], spark.createDataFrame([("d", 4.0, 4)], "name string, price double, stock long"))
    assert {r["name"] for r in t.df().collect()} == {"b", "d"}
    t.rename_column("stock", "amount")
    t.add_column("note", "string", "x")
    t.drop_column("price")
    assert {"amount", "note"} < set(t.df().columns) and "price" not in t.df().columns
    log = C.changes(spark, t.path, "document:*")
    assert {r.type for r in log.collect()} == {"document:create:success", "document:update:success", "document:delete:success"}
    assert C.changes(spark, t.path, "/^collection/").count() == 3
    first = log.orderBy("id").first()
    assert C.changes(spark, t.path, "*", first.id).count() == C.changes(spark, t.path).count() - 1
    q = C.change_stream(spark, t.path, "*:delete:*").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 1
    assert t.vacuum() == 0 and t.vacuum(0) > 0 and t.df().count() == 2
    t.drop()


def test_updates(spark):
    df = spark.createDataFrame([("doc-1", (1, "John"), "pending"), ("doc-2", (2, "Jane"), "pending")], "id string, meta struct<version:int,author:string>, status string")
    out = updated(df, {"meta.author": "Ann", "status": "done"}, {"meta.version": {"function": "ADD", "arguments": [field("meta.version"), 1]}}, eq("id", "doc-1"))
    assert {tuple(r.meta) + (r.status,) for r in out.collect()} == {(2, "Ann", "done"), (2, "Jane", "pending")}
    assert out.schema == df.schema or out.dtypes == df.dtypes
    with pytest.raises(QueryError):
        updated(df, {"nothing": 1})


def test_ids():
    ids = [uuid7() for _ in range(50)]
    assert len(set(ids)) == 50 and all(len(i) == 32 and i[12] == "7" and i[16] in "89ab" for i in ids)


SCHEMA = {
    "name": "user", "version": "1.0.0",
    "fields": {"f1": {"name": "name", "type": "string", "required": True}, "f2": {"name": "age", "type": "integer"}, "f3": {"name": "role", "type": "enum", "schema": {"id": "role"}}, "f4": {"name": "tags", "type": "array", "schema": {"type": "string"}}, "f5": {"name": "home", "type": "object", "schema": {"id": "home"}}},
    "schemas": {"role": {"name": "role", "type": "enum", "values": ["admin", "user"]}, "home": {"fields": {"h1": {"name": "city", "type": "string", "required": True}}}},
    "constraints": {"c1": {"name": "adult", "field": "age", "predicate": "min", "parameters": 18}},
}


def test_schema_and_validation(spark):
    kind = S.struct_type(SCHEMA)
    assert kind.simpleString() == "struct<name:string,age:bigint,role:string,tags:array<string>,home:struct<city:string>>"
    assert S.rule_breaks(SCHEMA) == []
    assert len(S.rule_breaks({"name": "x", "version": "1", "fields": {"a": {"name": "b c", "type": "text"}, "d": {"name": "e", "type": "array"}}})) == 4
    assert S.struct_type(S.from_struct(kind)).simpleString().replace("role:string", "role:string") == kind.simpleString()
    df = spark.createDataFrame([("a", 20, "admin", ["x"], ("c",), None), (None, 7, "boss", [], None, 1), ("b", None, None, None, (None,), None)], kind.simpleString()[7:-1].replace(":", " ", 1) and "name string, age long, role string, tags array<string>, home struct<city:string>, extra int")
    codes = [sorted(i.code for i in r.i) for r in df.select(V.issues(df, SCHEMA).alias("i")).collect()]
    assert codes == [[], ["CONSTRAINT", "ENUM", "REQUIRED", "UNEXPECTED"], ["CONSTRAINT", "REQUIRED"]]
    loose = [sorted(i.code for i in r.i) for r in df.select(V.issues(df, SCHEMA, "loose").alias("i")).collect()]
    assert loose[1] == ["CONSTRAINT", "ENUM"] and loose[2] == []
    assert V.valid(df, SCHEMA).count() == 1
    assert V.duplicates(df.select("role").union(df.select("role")), ["role"]).count() == 3


def test_migration(spark):
    new = {"name": "user", "version": "1.1.0", "fields": {**{k: v for k, v in SCHEMA["fields"].items() if k not in ("f4",)}, "f2": {"name": "years", "type": "string"}, "f9": {"name": "active", "type": "boolean", "default": True}}, "schemas": SCHEMA["schemas"]}
    d = S.difference(SCHEMA, new)
    assert d["removed"] == ["tags"] and d["renamed"] == {"age": "years"} and set(d["added"]) == {"active"}
    assert S.impact(d) == "major" and S.bumped("1.0.0", "major") == "2.0.0"
    df = spark.createDataFrame([("a", 20, "admin", ["x"], ("c",))], S.struct_type(SCHEMA))
    row = S.migrated(df, SCHEMA, new, lambda x: x.withColumn("name", F.upper("name"))).first()
    assert (row["name"], row["years"], row["active"], "tags" in row) == ("A", "20", True, False)


def test_json_schema(spark):
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"$ref": "#/definitions/e"}}, "additionalProperties": False, "definitions": {"e": {"format": "email"}}}
    assert errors({"a": 2, "b": "x@y.z"}, s) == []
    assert len(errors({"a": 0, "b": "no", "c": 1}, s)) == 3
    assert errors([1, 1.0], {"uniqueItems": True}) and not errors([1, True], {"uniqueItems": True})
    assert not errors(5, {"oneOf": [{"type": "string"}, {"minimum": 3}]}) and errors(2, {"if": {"type": "integer"}, "then": {"minimum": 3}})
    assert errors({"a": 1}, {"dependencies": {"a": ["b"]}}) and errors("x", {"not": {"type": "string"}}) and not errors(0.3, {"multipleOf": 0.1})
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": "x"}',), ("{",), (None,)], "j string")
    assert [len(r.e) for r in df.select(json_schema_errors(F.col("j"), s).alias("e")).collect()] == [0, 1, 1, 0]


def test_masks(spark):
    df = spark.createDataFrame([("alice@example.com", "pw", ("12 Main St", ["t1", "t2"])), (None, None, None)], "email string, password string, home struct<street:string,tags:array<string>>")
    p = M.Policy(fields={"home.tags[]": "redact", "email": "hash"}, secret="k").with_stock()
    r = M.masked(df, p).collect()
    want = hmac.new(b"k", b"alice@example.com", hashlib.sha256).hexdigest()[:8]
    assert r[0].email == f"[HASH:{want}]" and r[0].password == "***" and r[0].home.tags == ["***", "***"] and r[0].home.street == "12******St"
    assert r[1].email is None and r[1].home is None
    assert M.Policy(fields={"a": "obscure"}).combined(M.Policy(fields={"a": "redact"})).of("a") == "redact"


def test_document_functions(spark):
    doc = {"a": {"b": [1, {"c": 2}]}, "x": [3, 4]}
    assert D.json_path(doc, "$.a.b[1].c") == [2] and D.json_path(doc, "$.x") == [3, 4] and D.json_path(doc, "$['x'][*]") == [3, 4] and D.json_path(doc, "$.no") == []
    assert D.get_path(D.set_path(doc, "a.z.y", 5), "a.z.y") == 5 and D.get_path(D.delete_path(doc, "a.b"), "a.b") is None
    for old, new in (({"a": 1}, {"b": [1]}), ([1, 2, 3], [1, 4]), ({"a/b": {"c": 1}}, {"a/b": {"c": [True]}}), (1, {"x": None})):
        assert D.apply_patch(old, D.create_patch(old, new)) == new
    assert D.apply_patch({"t": ["go", "json"]}, [{"op": "add", "path": "/t/1", "value": "p"}, {"op": "removeValue", "path": "/t", "value": "go"}, {"op": "move", "from": "/t", "path": "/u"}, {"op": "test", "path": "/u/0", "value": "p"}]) == {"u": ["p", "json"]}
    with pytest.raises(ValueError):
        D.apply_patch({}, [{"op": "test", "path": "/a", "value": 1}])
    df = spark.createDataFrame([("1", 2.0, None), ("2", 2.5, "x")], "_id_ string, n double, s string")
    r = df.select(D.canonical_json(df).alias("j"), D.checksum(df).alias("h"), D.verified(df, D.checksum(df)).alias("ok")).collect()
    assert r[0].j == '{"n":2,"s":null}' and r[1].j == '{"n":2.5,"s":"x"}' and r[0].h == hashlib.sha256(r[0].j.encode()).hexdigest() and r[1].ok
    new = spark.createDataFrame([("2", 3.0, "x"), ("3", 1.0, "y")], "_id_ string, n double, s string")
    assert {(x["_id_"], x.change, tuple(x.fields or ())) for x in D.difference(df, new).collect()} == {("1", "removed", ()), ("2", "modified", ("n",)), ("3", "added", ())}
    assert {(x["_id_"], x.n) for x in D.merged(df, new).collect()} == {("1", 2.0), ("2", 3.0), ("3", 1.0)}
    p = spark.createDataFrame([('{"a": 1}',), ("[]",)], "j string")
    assert [x.j for x in D.patched(p, "j", [{"op": "replace", "path": "/a", "value": 2}]).collect()] == ['{"a": 2}', None]


def test_sets_and_io(spark, tmp_path):
    s = DocumentSet.of(spark, [(1, "a", 10.0), (2, "b", 30.0), (3, None, 20.0)], "id int, k string, v double")
    assert s.greater_than("v", 15).sort_by_desc("v").limit(1).first().id == 2
    assert s.contains("k", "A").count() == 1 and s.is_in("id", [1, 3]).exists() and s.skip(2).count() == 1
    a = s.aggregate("v").first()
    assert (a["count"], a["sum"], a["median"], round(a["std_dev"], 4)) == (3, 60.0, 20.0, 8.165)
    assert {r.key for r in s.group_by("k").collect()} == {"a", "b", "undefined"}
    assert s.reduce(t=F.sum("v")).t == 60.0 and s.find(lambda d: d.id == 2).k == "b" and len(s.to_maps()) == 3
    assert s.index("k")("a").first().id == 1
    IO.write_json(s.df, str(tmp_path / "j"))
    assert IO.read_json(spark, str(tmp_path / "j"), s.df.schema).count() == 3
    assert IO.to_json(s.df.where("id = 3"), canonical=True).first().json == '{"id":3,"k":null,"v":20}'
    assert IO.rows(spark, ['{"a": 1, "b": {"c": "x"}}']).first().b.c == "x"
    assert IO.generated(spark, SCHEMA, 5).count() == 5 and IO.generated(spark, SCHEMA, 5).collect() == IO.generated(spark, SCHEMA, 5).collect()


def test_shapes_and_commits(spark, tmp_path):
    t = ManagedTable(spark, str(tmp_path / "goods"), unique=["name"])
    assert t.create_from(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "label string, cost double"), {"label": "name", "cost": "price"}) == 2
    assert t.insert(spark.createDataFrame([("c", 3.0)], "name string, price double")) == 1
    assert len(t._manifest()["data"]) == 2 and t.df().count() == 3
    with pytest.raises(Conflict):
        t.insert(spark.createDataFrame([("a", 9.0)], "name string, price double"))
    shaped = t.read_as({"label": "name"}, {"field": "price", "operator": "gt", "value": 1})
    assert set(shaped.columns) == {"_id_", "_metadata_", "label"} and shaped.count() == 2
    assert t.update_from(shaped.selectExpr("_id_", "upper(label) as label"), {"label": "name"}) == 2
    assert sorted(r.name for r in t.df().collect()) == ["B", "C", "a"]
    assert sorted(r.v for r in t.df().selectExpr("_metadata_.version as v").collect()) == [1.0, 2.0, 2.0]
    late = t._manifest()
    assert t.delete({"field": "name", "operator": "eq", "value": "a"}) == 1
    with pytest.raises(Conflict):  # a writer that began before
        t._commit(late, late["data"], [])
    assert C.changes(spark, t.path, "document:*").count() == 4

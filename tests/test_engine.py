"""The engine over small fixtures: filters, projections, joins, aggregates, pages, codec."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.plans.builder import Projection, QueryBuilder, call, field, increment
from docmill.plans.builder import QueryBuilder as Q
from docmill.plans.ir import Query, QueryError, add_computed, has_field, include_field, unexclude_field
from docmill.sources.catalog import Catalog

PEOPLE = [(1, "Alice", 30, True, ("New York",)), (2, "Bob", 25, False, ("Los Angeles",)), (3, "Charlie", 35, True, ("New York",)), (4, "David", 30, True, ("Chicago",)), (5, "Eve", 25, False, None)]


@pytest.fixture(scope="module")
def cat(spark):
    c = Catalog(spark)
    c.register("people", spark.createDataFrame(PEOPLE, "id int, name string, age int, active boolean, address struct<city:string>"))
    c.register("users", spark.createDataFrame([(1, "Alice", 101), (2, "Bob", 102), (3, "Charlie", 101), (4, "David", 103), (5, "Eve", 999)], "id int, name string, city_id int"))
    c.register("cities", spark.createDataFrame([(101, "New York", "USA"), (102, "Los Angeles", "USA"), (103, "London", "UK")], "id int, name string, country string"))
    c.register("sales", spark.createDataFrame([(1, "North", 100.0), (2, "North", 150.0), (3, "South", 200.0), (4, "South", 250.0), (5, "East", 50.0), (6, "West", 300.0)], "_id_ long, region string, amount double"))
    c.register("nulls", spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, x int"))
    return c


def c(f, op, v=None):
    return {"field": f, "operator": op, "value": v}


def g(op, *fs):
    return {"operator": op, "conditions": list(fs)}


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        (c("age", "eq", 30), {1, 4}),
        (c("address.city", "eq", "New York"), {1, 3}),
        (g("and", c("age", "gte", 30), c("active", "eq", True)), {1, 3, 4}),
        (g("or", c("age", "eq", 25), c("active", "eq", True)), {1, 2, 3, 4, 5}),
        (c("name", "in", ["Alice", "Eve"]), {1, 5}),
        (c("name", "nin", ["Alice", "Eve"]), {2, 3, 4}),
        (g("not", c("active", "eq", True)), {2, 5}),
        (g("nor", c("age", "eq", 30), c("name", "eq", "Bob")), {3, 5}),
        (g("xor", c("age", "eq", 30), c("active", "eq", True)), {3}),
        (g("nand", c("age", "eq", 30), c("active", "eq", True)), {2, 3, 5}),
        (g("xnor", c("age", "eq", 30), c("active", "eq", True)), {1, 2, 4, 5}),
        (c("name", "contains", "li"), {1, 3}),
        (c("name", "ncontains", "li"), {2, 4, 5}),
        (c("address", "exists"), {1, 2, 3, 4}),
        (c("address", "nexists"), {5}),
        (c("address", "eq", None), {5}),
        (c("age", "lt", 30), {2, 5}),
        ({"query": "ALI", "fields": ["name"], "type": "contains"}, {1}),
        ({"query": "bob", "fields": ["name", "address.city"], "type": "exact", "operator": "or"}, {2}),
        ({"query": "ALI", "fields": ["name"], "case_sensitive": True}, set()),
        (c("age", "gt", {"function": "ADD", "arguments": [field("id"), 28]}), {1, 3}),
        (c("age", "in", []), set()),
    ],
)
def test_filters(cat, filters, ids):
    assert {r.id for r in cat.frame({"target": {"name": "people"}, "filters": filters}).collect()} == ids


def test_null_modes(cat):
    q = {"target": {"name": "nulls"}, "filters": c("x", "neq", 5)}
    assert [r.id for r in cat.frame(q).collect()] == [3]
    assert {r.id for r in cat.frame(q, doc_mode=True).collect()} == {2, 3}
    low = {"target": {"name": "nulls"}, "filters": g("not", c("x", "lt", 6))}
    assert {r.id for r in cat.frame(low).collect()} == {3}
    assert {r.id for r in cat.frame(low, doc_mode=True).collect()} == {2, 3}


def test_sort_and_pages(cat):
    assert [r.id for r in cat.frame(Q().from_("people").order_by("age").then_sort_by("id")).collect()] == [2, 5, 1, 4, 3]
    assert [r.id for r in cat.frame(Q().from_("people").order_by_desc("age").then_sort_by("name")).collect()] == [3, 1, 4, 2, 5]
    r = cat.read(Q().from_("people").order_by("id").limit(2).offset(2))
    assert [x.id for x in r.data.collect()] == [3, 4]
    assert (r.total, r.count, r.page.number, r.page.pages) == (5, 2, 2, 3)
    assert [x.id for x in cat.frame(Q().from_("people").cursor("id", 2, 2)).collect()] == [3, 4]
    assert cat.frame(Q().from_("people").order_by("id").limit(1).include_total()).first()["__matches__"] == 5
    assert [x.name for x in cat.frame(Q().from_("people").order_by("age").then_sort_by("id").select().include("name").end()).collect()][:2] == ["Bob", "Eve"]
    assert [x.id for x in r.stream()] == [3, 4]


def test_projections(cat):
    one = cat.frame(Q().from_("people").where("id").eq(1).select().include("id", "address.city").end()).first()
    assert one.asDict(recursive=True) == {"id": 1, "address": {"city": "New York"}}
    assert cat.frame(Q().from_("people").select().exclude("address", "age").end()).columns == ["id", "name", "active"]
    nested = cat.frame(Q().from_("people").where("id").eq(5).select().include("id").include_nested("address", Projection().include("city")).end()).first()
    assert nested.address is None
    case = Q().from_("people").select().include("id").add_case("k").when(c("age", "gte", 30), field("name")).otherwise("young").end().end()
    assert {r.k for r in cat.frame(case).collect()} == {"Alice", "Charlie", "David", "young"}
    calc = Q().from_("people").where("id").eq(1).select().add_computed("x", "DIVIDE", field("age"), 0).add_computed("s", "SUBSTR", field("name"), 1, 2).end()
    assert cat.frame(calc).first().asDict() == {"x": None, "s": "Al"}
    with pytest.raises(QueryError):
        cat.frame({"target": {"name": "people"}, "projection": {"include": [{"name": "id"}], "exclude": [{"name": "age"}]}})


@pytest.mark.parametrize(("kind", "n"), [("inner", 4), ("left", 5), ("right", 4), ("full", 5)])
def test_joins(cat, kind, n):
    q = Q().from_("users").alias("user").join(kind, "cities").alias("city").on(c("user.city_id", "eq", field("city.id"))).end()
    rows = cat.frame(q).collect()
    assert len(rows) == n
    assert set(rows[0].asDict()) == {"user", "city"}
    if kind in ("left", "full"):
        assert [r.city for r in rows if r.user.name == "Eve"] == [None]


def test_aggregates(cat):
    having = {"field": "total_revenue", "operator": "gt", "value": 300}
    q = Q().from_("sales").count("*", "n").sum("amount", "total_revenue").avg("amount", "a").min("amount", "lo").max("amount", "hi").aggregate().add_group("region").with_filter(having).end().order_by_desc("total_revenue")
    assert [tuple(r) for r in cat.frame(q).collect()] == [("South", 2, 450.0, 225.0, 200.0, 250.0)]
    assert cat.frame(Q().from_("sales").sum("amount")).first().asDict() == {"sum_amount": 1050.0}
    assert cat.frame(Q().from_("sales").where("amount").gt(999).sum("amount", "s")).first().s is None
    assert cat.frame(Q().from_("people").select().include("age").end().distinct()).count() == 3
    assert {r.id for r in cat.frame(Q().from_("people").distinct_by("age").order_by("id")).collect()} == {1, 2, 3}


def test_own_functions(cat):
    cat.registry.scalar("twice", lambda x: x * 2).predicate("divides", lambda f, v: f % v == 0).aggregate("spread", lambda x: F.max(x) - F.min(x))
    q = Q().from_("people").where("age").custom("divides", 10).select().add_computed("t", "twice", field("age")).end()
    assert {r.t for r in cat.frame(q).collect()} == {60}
    assert cat.frame(Q().from_("people").aggregate().type("spread").field("age").alias("s").end()).first().s == 10


def test_raw_sql(cat):
    r = cat.frame(Q().raw("SELECT name FROM {{collections.people}} WHERE age > ? ORDER BY name", [29]))
    assert [x.name for x in r.collect()] == ["Alice", "Charlie", "David"]
    pinned = cat.frame(Q().raw("WITH p AS (SELECT * FROM {{collections.p}}) SELECT count(*) AS n FROM p", collections={"p": {"collection": "people", "version": "1.0.0"}}))
    assert pinned.first().n == 5


@pytest.mark.parametrize(
    "bad",
    [
        {},
        {"target": {"name": "people"}, "filters": {"operator": "and", "conditions": []}},
        {"target": {"name": "people"}, "filters": {"field": "age", "operator": "like", "value": 1}},
        {"target": {"name": "people"}, "filters": {"operator": "not", "conditions": [c("age", "eq", 1), c("age", "eq", 2)]}},
        {"target": {"name": "people"}, "filters": {"field": "age; drop", "operator": "eq", "value": 1}},
        {"target": {"name": "people"}, "pagination": {"type": "offset", "limit": 0}},
        {"target": {"name": "people"}, "limit": -1},
        {"target": {"name": "people"}, "sort": [{"field": "age", "direction": "up"}]},
        {"target": {"name": "people"}, "union": {"type": "minus", "queries": []}},
        {"target": {"name": "people"}, "aggregations": [{"type": "median", "field": "age"}]},
        {"target": {"name": "nobody"}},
        {"target": {"name": "people"}, "filters": c("nothing", "eq", 1)},
    ],
)
def test_rejects(cat, bad):
    with pytest.raises(QueryError):
        cat.frame(bad)


def test_depth(cat):
    q = Q().from_("people").select().include("id").end()
    for _ in range(12):
        q = Q().from_("people").where("id").is_in(q).select().include("id").end()
    with pytest.raises(QueryError):
        cat.frame(q)


def test_codec_and_utilities():
    q = Q().from_("people").where("age").gt(3).or_filter(c("name", "eq", "x")).order_by("age").limit(3).build()
    assert Query.parse(q.to_json()) == q == Query.parse(json.loads(q.to_json()))
    assert q.merge({"limit": 5})["limit"] == 5 and "limit" not in q
    assert QueryBuilder(q).clone().reset().build() == {}
    p = include_field({}, "a")
    assert has_field(p, "a") and not has_field(p, "b") and has_field(unexclude_field({"exclude": [{"name": "a"}]}, "a"), "a")
    assert len(add_computed(add_computed({}, {"alias": "x", "type": "case"}), {"alias": "x", "type": "computed"})["computed"]) == 1
    assert increment("n", 2) == {"n": call("ADD", field("n"), 2)}
    assert Q().from_("a").use_index("i").no_index().max_execution_time(5).build()["hints"][2]["ms"] == 5


ATOMS = st.one_of(
    st.tuples(st.sampled_from(["age", "id"]), st.sampled_from(["eq", "neq", "lt", "lte", "gt", "gte"]), st.integers(0, 40)).map(lambda t: c(*t)),
    st.tuples(st.just("name"), st.sampled_from(["contains", "ncontains"]), st.sampled_from(["a", "li", "B", ""])).map(lambda t: c(*t)),
)
TREES = st.recursive(ATOMS, lambda t: st.tuples(st.sampled_from(["and", "or", "nor", "xor", "nand", "xnor"]), st.lists(t, min_size=1, max_size=3)).map(lambda x: g(x[0], *x[1])) | t.map(lambda x: g("not", x)), max_leaves=6)


def holds(f, row):
    if "conditions" in f:
        n, of = sum(holds(x, row) for x in f["conditions"]), len(f["conditions"])
        return {"and": n == of, "or": n > 0, "not": n == 0, "nor": n == 0, "xor": n == 1, "nand": n < of, "xnor": n % 2 == 0}[f["operator"]]
    a, v = row[f["field"]], f["value"]
    return {"eq": a == v, "neq": a != v, "contains": isinstance(a, str) and str(v) in a, "ncontains": isinstance(a, str) and str(v) not in a}.get(f["operator"]) if isinstance(a, str) else {"eq": a == v, "neq": a != v, "lt": a < v, "lte": a <= v, "gt": a > v, "gte": a >= v}[f["operator"]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TREES)
def test_random_filters(cat, tree):
    want = {p[0] for p in PEOPLE if holds(tree, {"id": p[0], "name": p[1], "age": p[2]})}
    assert {r.id for r in cat.frame({"target": {"name": "people"}, "filters": tree}, doc_mode=True).collect()} == want

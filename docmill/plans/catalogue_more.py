"""Further queries over the driver's tables: sources, sinks, validation, document functions, masks, sets, extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import coerce
from docmill.functions import docs as D
from docmill.functions import masking, scalar
from docmill.functions.json_schema import json_schema_errors
from docmill.operators import schema as S
from docmill.operators.document_set import DocumentSet
from docmill.operators.validation import issues, valid
from docmill.plans import ir
from docmill.plans.builder import QueryBuilder as Q
from docmill.plans.builder import call, field
from docmill.sources import documents_io
from docmill.sources.catalog import Catalog
from docmill.sources.managed import updated

Made = Callable[[SparkSession, str], DataFrame]
MADE: dict[str, tuple[Made, str]] = {}


def made(sql: str) -> Callable[[Made], Made]:
    def keep(f: Made) -> Made:
        MADE[f.__name__] = (f, sql)
        return f

    return keep


def _catalog(spark: SparkSession, sf_dir: str, registry: scalar.Registry | None = None) -> Catalog:
    from docmill.plans.catalogue import TABLES

    c = Catalog(spark, registry)
    for t in TABLES:
        c.register(t, f"{sf_dir}/{t}.parquet")
    return c


def cond(path: str, op: str, v=None) -> dict:
    return {"field": path, "operator": op, "value": v}


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir).table("customer")
    return c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place")).alias("who"), F.array("c_mktsegment", "c_name").alias("tags"), "c_acctbal")


# -- projections, filters, sorting --------------------------------------------------------------------------------------


@made("select c_custkey, c_name as name, c_mktsegment as segment from customer where c_nationkey = 3")
def project_nested_path(spark, sf_dir):
    cat = _catalog(spark, sf_dir).register("people", _nested(spark, sf_dir))
    out = cat.frame(Q().from_("people").where("who.place.nation").eq(3).select().include("c_custkey", "who.name", "who.place.segment").end())
    return out.select("c_custkey", "who.name", "who.place.segment")


@made("select c_custkey, c_name as name from customer")
def project_nested_exclude(spark, sf_dir):
    cat = _catalog(spark, sf_dir).register("people", _nested(spark, sf_dir))
    out = cat.frame(Q({"projection": {"exclude": [{"name": "who", "nested": {"exclude": [{"name": "place"}]}}, {"name": "tags"}, {"name": "c_acctbal"}]}}).from_("people"))
    return out.select("c_custkey", "who.*")


@made("select o_orderkey, coalesce(o_orderpriority, '-') as p, trim(o_orderstatus) as s from orders")
def scalar_coalesce_trim(spark, sf_dir):
    return _catalog(spark, sf_dir).frame(Q().from_("orders").select().include("o_orderkey").add_computed("p", "coalesce", field("o_orderpriority"), "-").add_computed("s", "trim", field("o_orderstatus")).end())


@made("select c_custkey, reverse(c_name) as r from customer")
def scalar_any_function(spark, sf_dir):
    return _catalog(spark, sf_dir).frame(Q().from_("customer").select().include("c_custkey").add_computed("r", "reverse", field("c_name")).end())


@made("select c_custkey, round(c_acctbal * 1.5, 4) as scaled from customer")
def custom_scalar(spark, sf_dir):
    reg = scalar.Registry().scalar("scaled", lambda x, by: F.round(x * by, 4))
    return _catalog(spark, sf_dir, reg).frame(Q().from_("customer").select().include("c_custkey").add_computed("scaled", "scaled", field("c_acctbal"), 1.5).end())


@made("select c_custkey from customer where c_name like '%7'")
def custom_predicate(spark, sf_dir):
    reg = scalar.Registry().predicate("ends_with", lambda c, v: c.endswith(v))
    return _catalog(spark, sf_dir, reg).frame(Q().from_("customer").where("c_name").custom("ends_with", "7").select().include("c_custkey").end())


@made("select c_mktsegment, max(c_acctbal) - min(c_acctbal) as spread from customer group by c_mktsegment")
def custom_aggregate(spark, sf_dir):
    reg = scalar.Registry().aggregate("range", lambda c: F.max(c) - F.min(c))
    return _catalog(spark, sf_dir, reg).frame(Q({"aggregations": [{"type": "range", "field": "c_acctbal", "alias": "spread", "groups": ["c_mktsegment"]}]}).from_("customer"))


@made("select d.doc_id, l.quality from documents d left join labels l on l.doc_id = d.doc_id order by l.quality asc nulls first, d.doc_id limit 50")
def sort_nulls_first(spark, sf_dir):
    return _catalog(spark, sf_dir).frame(Q().from_("documents").alias("d").left_join("labels").alias("l").on(cond("l.doc_id", "eq", field("d.doc_id"))).end().order_by("l.quality").then_sort_by("d.doc_id").limit(50).select().include("d.doc_id", "l.quality").end())


@made("select n_nationkey from nation where (n_regionkey = 1 and n_nationkey > 3) or n_name like '%AN%'")
def filter_combination(spark, sf_dir):
    f = ir.combine("or", ir.combine("and", cond("n_regionkey", "eq", 1), cond("n_nationkey", "gt", 3)), cond("n_name", "contains", "AN"))
    return _catalog(spark, sf_dir).frame(ir.Query({"target": {"name": "nation"}, "filters": f, "projection": {"include": [{"name": "n_nationkey"}]}}).to_json())


@made("select c.c_custkey, o.o_orderkey from customer c join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > (select avg(o_totalprice) from orders)")
def join_on_subquery(spark, sf_dir):
    average = {"type": "subquery", "query": Q().from_("orders").avg("o_totalprice", "a").build()}
    on = {"operator": "and", "conditions": [cond("o.o_custkey", "eq", field("c.c_custkey")), cond("o.o_totalprice", "gt", average)]}
    return _catalog(spark, sf_dir).frame(Q().from_("customer").alias("c").inner_join("orders").alias("o").on(on).end().select().include("c.c_custkey", "o.o_orderkey").end())


@made("select c_nationkey as k from customer union select s_nationkey from supplier union select n_nationkey from nation where n_regionkey = 1")
def union_three(spark, sf_dir):
    one = lambda t, c: Q().from_(t).select().include(c, alias="k").end()
    members = [one("supplier", "s_nationkey").build(), Q().from_("nation").where("n_regionkey").eq(1).select().include("n_nationkey", alias="k").end().build()]
    return _catalog(spark, sf_dir).frame(Q({"union": {"type": "union", "queries": members}}).from_("customer").select().include("c_nationkey", alias="k").end())


@made("""select c_custkey from customer where c_acctbal is distinct from 0 and not coalesce(c_mktsegment = 'BUILDING', false)""")
def filter_document_mode(spark, sf_dir):
    return _catalog(spark, sf_dir).frame(Q().from_("customer").where("c_acctbal").neq(0).where("c_mktsegment").neq("BUILDING").select().include("c_custkey").end(), doc_mode=True)


@made("select p_partkey from part where lower(p_name) like '%a%'")
def filter_contains_any_case(spark, sf_dir):
    return _catalog(spark, sf_dir).frame(Q().from_("part").where("p_name").contains("A").select().include("p_partkey").end(), case_insensitive=True)


@made("""select '{"open"}' as braces, count(*) as n from customer""")
def raw_braces(spark, sf_dir):
    return _catalog(spark, sf_dir).sql({"template": """select '{"open"}' as braces, count(*) as n from {{collections.customer}}"""})


@made("select count(*) as count, '{\"result\":[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' order by r_regionkey) || ']}' as json from region")
def raw_envelope(spark, sf_dir):
    return _catalog(spark, sf_dir).envelope({"template": "select r_regionkey, r_name from {{collections.region}} order by r_regionkey"})


@made("select o_orderkey from orders where o_orderkey > 500")
def cursor_rest(spark, sf_dir):
    return _catalog(spark, sf_dir).read(Q().from_("orders").cursor("o_orderkey", 500, 25).select().include("o_orderkey").end()).after


# -- sources and sinks --------------------------------------------------------------------------------------------------

_CUSTOMER = {"name": "customer", "version": "1.0.0", "fields": {"a": {"name": "c_custkey", "type": "integer", "required": True}, "b": {"name": "c_name", "type": "string", "required": True}, "c": {"name": "c_mktsegment", "type": "string"}}}


@made("select c_custkey, c_name, c_mktsegment from customer")
def json_round_trip(spark, sf_dir):
    c = _catalog(spark, sf_dir).table("customer").select("c_custkey", "c_name", "c_mktsegment")
    return documents_io.to_json(c).select(documents_io.parse_json(F.col("json"), c.schema).alias("d")).select("d.*")


@made("""select n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as json from nation""")
def json_canonical(spark, sf_dir):
    t = _catalog(spark, sf_dir).table("nation")
    return t.select("n_nationkey", D.canonical_json(t, ["n_nationkey", "n_name", "n_regionkey"]).alias("json"))


@made("select 1::bigint as id, 'one' as name union all select 2, null")
def memory_rows(spark, sf_dir):
    return documents_io.rows(spark, [{"id": 1, "name": "one"}, {"id": 2, "name": None}], S.T.StructType.fromDDL("id long, name string"))


@made("select count(*) as n, 1000::bigint as ids from range(1000)")
def generated_rows(spark, sf_dir):
    g = documents_io.generated(spark, S.T.StructType.fromDDL("id long, name string, tags array<string>, price double"), 1000)
    return g.agg(F.count("*").alias("n"), F.count("name").alias("ids"))


@made("select c_custkey, c_name, case when c_nationkey < 5 then 'NEAR' else c_mktsegment end as segment from customer")
def update_nested_path(spark, sf_dir):
    u = updated(_nested(spark, sf_dir), {"who.place.segment": "NEAR"}, filters=cond("who.place.nation", "lt", 5))
    return u.select("c_custkey", F.col("who.name").alias("c_name"), "who.place.segment")


@made("select c_custkey, upper(c_name) as c_name from customer")
def update_all_rows(spark, sf_dir):
    return updated(_catalog(spark, sf_dir).table("customer"), compute={"c_name": call("UPPER", field("c_name"))}).select("c_custkey", "c_name")


# -- document sets ------------------------------------------------------------------------------------------------------


@made("select c_custkey, c_acctbal * 2 as twice from customer where c_acctbal > 100 and c_acctbal < 5000 and c_nationkey in (1, 2, 3) and lower(c_name) like '%1%' order by c_acctbal desc, c_custkey desc limit 30 offset 5")
def set_chain(spark, sf_dir):
    s = DocumentSet(_catalog(spark, sf_dir).table("customer")).greater_than("c_acctbal", 100).less_than("c_acctbal", 5000).is_in("c_nationkey", [1, 2, 3]).contains("c_name", "1")
    return s.sort_by_desc("c_acctbal", "c_custkey").offset(5).limit(30).map(twice=F.col("c_acctbal") * 2).df.select("c_custkey", "twice")


@made("select n_nationkey, n_name from nation where n_regionkey = 2")
def set_index(spark, sf_dir):
    return DocumentSet(_catalog(spark, sf_dir).table("nation")).index("n_regionkey")(2).select("n_nationkey", "n_name")


@made("select median(l_extendedprice) as med, count(*) as n from lineitem")
def set_median(spark, sf_dir):
    return DocumentSet(_catalog(spark, sf_dir).table("lineitem").select("l_extendedprice")).aggregate("l_extendedprice").select(F.col("median").alias("med"), F.col("count").alias("n"))


# -- documents ----------------------------------------------------------------------------------------------------------


def _other(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _catalog(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("_id_"), "c_name", "c_acctbal")
    changed = F.when(F.col("_id_") % 5 != 0, F.col("c_acctbal"))
    return c.where("_id_ % 7 <> 0"), c.where("_id_ % 11 <> 0").withColumn("c_acctbal", F.when(F.col("_id_") % 3 == 0, F.col("c_acctbal") + 1).otherwise(changed))


_NEW = "case when c_custkey % 3 = 0 then c_acctbal + 1 when c_custkey % 5 <> 0 then c_acctbal end"


@made(f"select c_custkey as _id_, c_name, case when c_custkey % 11 <> 0 then {_NEW} else c_acctbal end as c_acctbal from customer where c_custkey % 7 <> 0 or c_custkey % 11 <> 0")
def merge_documents(spark, sf_dir):
    return D.merged(*_other(spark, sf_dir))


@made(f"select c_custkey as _id_, case when c_custkey % 7 = 0 then 'added' when c_custkey % 11 = 0 then 'removed' else 'modified' end as change from customer where (c_custkey % 7 = 0 and c_custkey % 11 <> 0) or (c_custkey % 7 <> 0 and c_custkey % 11 = 0) or (c_custkey % 7 <> 0 and c_custkey % 11 <> 0 and c_acctbal is distinct from {_NEW})")
def diff_documents(spark, sf_dir):
    return D.difference(*_other(spark, sf_dir)).select("_id_", "change")


@made(f"select c_custkey as _id_, c_name, {_NEW} as c_acctbal from customer where c_custkey % 11 <> 0")
def diff_apply(spark, sf_dir):
    old, new = _other(spark, sf_dir)
    return D.applied(old, D.difference(old, new), new)


@made(f"select count(*) as n from customer where c_custkey % 7 <> 0 and c_custkey % 11 <> 0 and c_acctbal is not distinct from {_NEW}")
def equal_documents(spark, sf_dir):
    old, new = _other(spark, sf_dir)
    both = old.alias("a").join(new.alias("b"), F.col("a._id_") == F.col("b._id_"))
    return both.where(D.equal_documents("a", "b", ["c_name", "c_acctbal"])).agg(F.count("*").alias("n"))


@made("select n_nationkey, true as ok from nation")
def checksum_verified(spark, sf_dir):
    t = _catalog(spark, sf_dir).table("nation")
    stored = t.withColumn("sum", D.checksum(t, ["n_nationkey", "n_name"]))
    return stored.select("n_nationkey", D.verified(stored, F.col("sum"), ["n_nationkey", "n_name"]).alias("ok"))


@made("""select n_nationkey, '{"x":' || n_nationkey || ',"a":"b"}' as doc from nation""")
def json_patch(spark, sf_dir):
    t = _catalog(spark, sf_dir).table("nation").select("n_nationkey", F.concat(F.lit('{"x": '), "n_nationkey", F.lit("}")).alias("doc"))
    return D.patched(t, "doc", [{"op": "add", "path": "/a", "value": "b"}]).withColumn("doc", F.regexp_replace("doc", " ", ""))


@made("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as i, try_cast(json_extract_string(props, '$.k') as double) as f, true as b, cast(cast(event_id as bigint) as varchar) as s from events")
def coerce_values(spark, sf_dir):
    e = _catalog(spark, sf_dir).table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    text, number = S.T.StringType(), S.T.DoubleType()
    return e.select("event_id", coerce.to_int(F.col("k"), text).alias("i"), coerce.to_float(F.col("k"), text).alias("f"), coerce.to_bool(F.lit(" TRUE "), text).alias("b"), coerce.to_string(F.col("event_id").cast("double"), number).alias("s"))


@made("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as a, strftime(o_orderdate, '%Y-%m-%d') as b from orders")
def coerce_times(spark, sf_dir):
    o = _catalog(spark, sf_dir).table("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    text = S.T.StringType()
    layout, seconds = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.unix_seconds("t").cast("string")
    return o.select("o_orderkey", *[F.date_format(coerce.to_time(x, text), "yyyy-MM-dd").alias(n) for n, x in (("a", layout), ("b", seconds))])


@made("select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1 union all select null)")
def subq_not_in_null(spark, sf_dir):
    cat = _catalog(spark, sf_dir)
    cat.register("some", lambda: cat.table("nation").where("n_regionkey = 1").select(F.col("n_nationkey")).union(spark.sql("select cast(null as bigint)")))
    return cat.frame(Q().from_("supplier").where("s_nationkey").not_in(Q().from_("some")).select().include("s_suppkey").end())


# -- masks --------------------------------------------------------------------------------------------------------------


@made("select c_custkey, '***' as c_name from customer")
def mask_two_scopes(spark, sf_dir):
    policy = masking.Policy(patterns=[("name", "obscure")]).combined(masking.Policy(patterns=[("name", "redact")]))
    return masking.masked(_catalog(spark, sf_dir).table("customer").select("c_custkey", "c_name"), policy)


@made("select c_custkey, '***' as name, '***' as tag from customer")
def mask_nested(spark, sf_dir):
    policy = masking.Policy(fields={"who.name": "redact", "tags[]": "redact"})
    return masking.masked(_nested(spark, sf_dir), policy).select("c_custkey", "who.name", F.col("tags")[0].alias("tag"))


@made("select c_custkey, length(c_name) > 0 as shaped from customer")
def mask_hash(spark, sf_dir):
    c = _catalog(spark, sf_dir).table("customer")
    return c.select("c_custkey", masking.hashed(F.col("c_name"), "key").rlike(r"^\[HASH:[0-9a-f]{8}\]$").alias("shaped"))


# -- schemas and validation ---------------------------------------------------------------------------------------------


def _issues(spark: SparkSession, sf_dir: str, schema: dict, mode: str = "strict") -> DataFrame:
    c = _catalog(spark, sf_dir).table("customer")
    return c.select("c_custkey", F.size(issues(c, schema, mode)).alias("n"))


@made("select c_custkey, 2 as n from customer")
def validate_unexpected(spark, sf_dir):
    return _issues(spark, sf_dir, _CUSTOMER)


@made("select c_custkey, 0 as n from customer")
def validate_loose(spark, sf_dir):
    return _issues(spark, sf_dir, _CUSTOMER, "loose")


@made("select c_custkey, 1 as n from customer")
def validate_required(spark, sf_dir):
    fields = {**_CUSTOMER["fields"], "d": {"name": "phone", "type": "string", "required": True}, "e": {"name": "c_nationkey", "type": "integer"}, "f": {"name": "c_acctbal", "type": "number"}}
    return _issues(spark, sf_dir, {**_CUSTOMER, "fields": fields})


_ALL = {**_CUSTOMER, "fields": {**_CUSTOMER["fields"], "e": {"name": "c_nationkey", "type": "integer"}, "f": {"name": "c_acctbal", "type": "number"}}}


@made("select c_custkey, case when c_acctbal >= 0 and c_acctbal <= 5000 then 0 else 1 end as n from customer")
def validate_constraint(spark, sf_dir):
    rule = {"operator": "and", "rules": [{"predicate": "min", "field": "c_acctbal", "parameters": 0}, {"predicate": "max", "field": "c_acctbal", "parameters": 5000}]}
    return _issues(spark, sf_dir, {**_ALL, "constraints": {"r": rule}})


@made("select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 1 else 0 end as n from customer")
def validate_not_rule(spark, sf_dir):
    return _issues(spark, sf_dir, {**_ALL, "constraints": {"r": {"operator": "not", "rules": [{"predicate": "oneOf", "field": "c_mktsegment", "parameters": ["BUILDING", "MACHINERY"]}]}}})


@made("select c_custkey from customer where length(c_name) <= 18 and regexp_matches(c_name, '[0-9]$')")
def validate_kept(spark, sf_dir):
    rules = {"a": {"predicate": "maxLength", "field": "c_name", "parameters": 18}, "b": {"predicate": "pattern", "field": "c_name", "parameters": "[0-9]$"}}
    return valid(_catalog(spark, sf_dir).table("customer"), {**_ALL, "constraints": rules}).select("c_custkey")


@made("select c_custkey, 1 as n from customer")
def validate_type(spark, sf_dir):
    return _issues(spark, sf_dir, {**_ALL, "fields": {**_ALL["fields"], "c": {"name": "c_mktsegment", "type": "number"}}})


@made("select n_nationkey, case when n_nationkey > 10 then 1 else 0 end as n from nation")
def validate_json_schema(spark, sf_dir):
    t = _catalog(spark, sf_dir).table("nation")
    kind = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 10}}}
    return t.select("n_nationkey", F.size(json_schema_errors(F.to_json(F.struct(F.col("n_nationkey").alias("k"))), kind)).alias("n"))


@made("select c_custkey, c_name as full_name, c_acctbal::varchar is not null as balance, 'new' as state from customer")
def schema_migration(spark, sf_dir):
    fields = dict(_ALL["fields"])
    new = {**_ALL, "fields": {"a": fields["a"], "b": {**fields["b"], "name": "full_name"}, "f": {**fields["f"], "type": "string"}, "g": {"name": "state", "type": "string", "default": "new"}}}
    out = S.migrated(_catalog(spark, sf_dir).table("customer"), _ALL, new)
    return out.select("c_custkey", "full_name", F.col("c_acctbal").isNotNull().alias("balance"), "state")


def queries() -> dict[str, Made]:
    return {k: f for k, (f, _) in MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in MADE.items()}

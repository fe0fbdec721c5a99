"""The engine's queries over the driver's tables, built with the fluent builder, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import masking
from docmill.operators.document_set import DocumentSet
from docmill.plans import catalogue_more
from docmill.plans.builder import Projection, QueryBuilder, call, field
from docmill.plans.builder import QueryBuilder as Q
from docmill.sources.catalog import Catalog
from docmill.sources.managed import updated

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cond(path: str, op: str, v=None) -> dict:
    return {"field": path, "operator": op, "value": v}


def group(op: str, *fs: dict) -> dict:
    return {"operator": op, "conditions": list(fs)}


def on(a: str, b: str) -> dict:
    return cond(a, "eq", field(b))


def revenue() -> dict:
    return call("MULTIPLY", field("l_extendedprice"), call("SUBTRACT", 1, field("l_discount")))


BUILT: dict[str, tuple[Callable[[], QueryBuilder], str]] = {
    "filter_eq_and_range": (lambda: Q().from_("orders").where("o_orderstatus").eq("F").where("o_totalprice").gte(100000).where("o_totalprice").lt(200000).select().include("o_orderkey", "o_totalprice").end(), "select o_orderkey,o_totalprice from orders where o_orderstatus='F' and o_totalprice>=100000 and o_totalprice<200000"),
    "filter_or_group": (lambda: Q().from_("customer").where_group("or").where("c_mktsegment").eq("BUILDING").where("c_acctbal").lt(0).end().select().include("c_custkey").end(), "select c_custkey from customer where c_mktsegment='BUILDING' or c_acctbal<0"),
    "filter_xor_exactly_one": (lambda: Q().from_("customer").where_group("xor").where("c_mktsegment").eq("BUILDING").where("c_acctbal").gt(0).where("c_nationkey").lt(5).end().select().include("c_custkey").end(), "select c_custkey from customer where (case when c_mktsegment='BUILDING' then 1 else 0 end)+(case when c_acctbal>0 then 1 else 0 end)+(case when c_nationkey<5 then 1 else 0 end)=1"),
    "filter_xnor_even": (lambda: Q().from_("customer").where_group("xnor").where("c_mktsegment").eq("BUILDING").where("c_acctbal").gt(0).end().select().include("c_custkey").end(), "select c_custkey from customer where ((case when c_mktsegment='BUILDING' then 1 else 0 end)+(case when c_acctbal>0 then 1 else 0 end))%2=0"),
    "filter_nand_nor_not": (lambda: Q().from_("customer").and_filter(group("nand", cond("c_mktsegment", "eq", "BUILDING"), cond("c_acctbal", "gt", 0))).and_filter(group("nor", cond("c_nationkey", "lt", 3), cond("c_nationkey", "gt", 20))).and_filter(group("not", cond("c_acctbal", "lt", -500))).select().include("c_custkey").end(), "select c_custkey from customer where not (c_mktsegment='BUILDING' and c_acctbal>0) and not (c_nationkey<3 or c_nationkey>20) and not (c_acctbal < -500)"),
    "filter_in_nin": (lambda: Q().from_("nation").where("n_regionkey").is_in([1, 2]).where("n_nationkey").not_in([3, 7]).select().include("n_nationkey", "n_name").end(), "select n_nationkey,n_name from nation where n_regionkey in (1,2) and n_nationkey not in (3,7)"),
    "filter_contains": (lambda: Q().from_("part").where("p_name").contains("ring").select().include("p_partkey", "p_name").end(), "select p_partkey,p_name from part where p_name like '%ring%'"),
    "filter_ncontains_neq": (lambda: Q().from_("part").where("p_name").not_contains("ring").where("p_brand").neq("Brand#1").where("p_size").lte(10).select().include("p_partkey").end(), "select p_partkey from part where p_name not like '%ring%' and p_brand != 'Brand#1' and p_size<=10"),
    "filter_exists_nexists": (lambda: Q().from_("documents").alias("d").left_join("labels").alias("l").on(on("l.doc_id", "d.doc_id")).end().where_group("or").where("l.quality").not_exists().group(group("and", cond("l.quality", "exists"), cond("l.quality", "eq", 0))).end().select().include("d.doc_id").end(), "select d.doc_id from documents d left join labels l on l.doc_id=d.doc_id where l.quality is null or (l.quality is not null and l.quality=0)"),
    "text_search_or_fields": (lambda: Q().from_("part").text_search("p_name", "p_type").contains("SMALL").select().include("p_partkey").end(), "select p_partkey from part where lower(p_name) like '%small%' or lower(p_type) like '%small%'"),
    "text_search_exact": (lambda: Q().from_("customer").text_search("c_mktsegment").exact("building").select().include("c_custkey").end(), "select c_custkey from customer where lower(c_mktsegment)='building'"),
    "text_search_phrase_and": (lambda: Q().from_("part").text_search("p_name", "p_type").phrase("s", operator="and").select().include("p_partkey").end(), "select p_partkey from part where lower(p_name) like '%s%' and lower(p_type) like '%s%'"),
    "text_search_documents": (lambda: Q().from_("documents").text_search("text").contains("the ").select().include("doc_id", "lang").end(), "select doc_id, lang from documents where lower(text) like '%the %'"),
    "project_alias": (lambda: Q().from_("nation").select().include("n_nationkey", alias="key").include("n_name", alias="label").end(), "select n_nationkey as key, n_name as label from nation"),
    "project_exclude": (lambda: Q().from_("customer").select().exclude("c_name", "c_acctbal").end(), "select c_custkey, c_nationkey, c_mktsegment from customer"),
    "project_all_fields": (lambda: Q().from_("region"), "select r_regionkey, r_name from region"),
    "project_computed": (lambda: Q().from_("lineitem").select().include("l_orderkey", "l_linenumber").add_computed("revenue", "MULTIPLY", field("l_extendedprice"), call("SUBTRACT", 1, field("l_discount"))).end(), "select l_orderkey,l_linenumber,l_extendedprice*(1-l_discount) as revenue from lineitem"),
    "project_divide": (lambda: Q().from_("lineitem").select().include("l_orderkey", "l_linenumber").add_computed("ratio", "DIVIDE", field("l_tax"), field("l_discount")).add_computed("plus", "ADD", field("l_tax"), field("l_discount")).end(), "select l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) as ratio, l_tax + l_discount as plus from lineitem"),
    "project_case": (lambda: Q().from_("customer").select().include("c_custkey").add_case("tier").when(cond("c_acctbal", "gte", 5000), "high").when(cond("c_acctbal", "gte", 0), "mid").otherwise("neg").end().end(), "select c_custkey,case when c_acctbal>=5000 then 'high' when c_acctbal>=0 then 'mid' else 'neg' end as tier from customer"),
    "scalar_functions": (lambda: Q().from_("customer").select().include("c_custkey").add_computed("u", "UPPER", field("c_mktsegment")).add_computed("l", "LOWER", field("c_name")).add_computed("n", "LENGTH", field("c_name")).add_computed("s", "SUBSTR", field("c_name"), 1, 8).add_computed("a", "ABS", field("c_acctbal")).add_computed("r", "ROUND", field("c_acctbal")).end(), "select c_custkey,upper(c_mktsegment) as u,lower(c_name) as l,length(c_name) as n,substr(c_name,1,8) as s,abs(c_acctbal) as a,round(c_acctbal) as r from customer"),
    "scalar_concat_dates": (lambda: Q().from_("orders").select().include("o_orderkey").add_computed("c", "concat", field("o_orderstatus"), "-", field("o_orderpriority")).add_computed("d", "date", field("o_orderdate")).add_computed("t", "datetime", field("o_orderdate")).end(), "select o_orderkey, concat(o_orderstatus, '-', o_orderpriority) as c, strftime(o_orderdate, '%Y-%m-%d') as d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as t from orders"),
    "json_valid": (lambda: Q().from_("events").select().include("event_id").add_computed("ok", "json_valid", field("props")).end(), "select event_id, json_valid(props) as ok from events"),
    "join_inner": (lambda: Q().from_("orders").alias("o").inner_join("customer").alias("c").on(on("o.o_custkey", "c.c_custkey")).end().where("c.c_nationkey").eq(3).select().include("o.o_orderkey", "c.c_name").end(), "select o.o_orderkey,c.c_name from orders o join customer c on o.o_custkey=c.c_custkey where c.c_nationkey=3"),
    "join_left_theta": (lambda: Q().from_("customer").alias("c").left_join("orders").alias("o").on(group("and", on("c.c_custkey", "o.o_custkey"), cond("o.o_totalprice", "gt", 350000))).end().select().include("c.c_custkey", "o.o_orderkey").end(), "select c.c_custkey,o.o_orderkey from customer c left join orders o on c.c_custkey=o.o_custkey and o.o_totalprice>350000"),
    "join_right": (lambda: Q().from_("labels").alias("l").right_join("documents").alias("d").on(on("l.doc_id", "d.doc_id")).end().select().include("l.doc_id", alias="ldoc").include("d.doc_id", alias="doc_id").end(), "select l.doc_id as ldoc,d.doc_id from labels l right join documents d on l.doc_id=d.doc_id"),
    "join_full": (lambda: Q().from_("labels").alias("l").full_join("toxic_labels").alias("b").on(group("and", on("l.doc_id", "b.doc_id"), cond("l.quality", "eq", 1))).end().select().include("l.doc_id", alias="ldoc").include("b.doc_id", alias="bdoc").end(), "select l.doc_id as ldoc,b.doc_id as bdoc from labels l full join (select doc_id from labels where toxic=1) b on l.doc_id=b.doc_id and l.quality=1"),
    "join_chain_4": (lambda: Q().from_("region").alias("r").inner_join("nation").alias("n").on(on("r.r_regionkey", "n.n_regionkey")).end().inner_join("customer").alias("c").on(on("c.c_nationkey", "n.n_nationkey")).end().inner_join("orders").alias("o").on(on("o.o_custkey", "c.c_custkey")).end().count("*", "n").group_by("r.r_name"), "select r.r_name,count(*) as n from region r join nation n on r.r_regionkey=n.n_regionkey join customer c on c.c_nationkey=n.n_nationkey join orders o on o.o_custkey=c.c_custkey group by r.r_name"),
    "join_cross": (lambda: Q({"joins": [{"type": "inner", "target": {"name": "nation"}}]}).from_("region").select().include("r_name", "n_name").end(), "select r.r_name,n.n_name from region r cross join nation n"),
    "join_self": (lambda: Q().from_("nation").alias("a").inner_join("nation").alias("b").on(group("and", on("a.n_regionkey", "b.n_regionkey"), cond("a.n_nationkey", "lt", field("b.n_nationkey")))).end().select().include("a.n_nationkey", alias="x").include("b.n_nationkey", alias="y").end(), "select a.n_nationkey as x,b.n_nationkey as y from nation a join nation b on a.n_regionkey=b.n_regionkey and a.n_nationkey<b.n_nationkey"),
    "join_range": (lambda: Q().from_("nation").alias("n").inner_join("part").alias("p").on(group("and", cond("p.p_size", "gte", field("n.n_nationkey")), cond("p.p_size", "lte", call("ADD", field("n.n_nationkey"), 1)))).end().select().include("n.n_nationkey", "p.p_partkey").end(), "select n.n_nationkey,p.p_partkey from nation n join part p on p.p_size between n.n_nationkey and n.n_nationkey+1"),
    "join_projected_side": (lambda: Q().from_("supplier").alias("s").left_join("nation").alias("n").with_projection(Projection().include("n_nationkey").add_computed("upper_name", "UPPER", field("n_name"))).on(on("s.s_nationkey", "n.n_nationkey")).end().select().include("s.s_suppkey", "n.upper_name").end(), "select s_suppkey, upper(n_name) as upper_name from supplier left join nation on s_nationkey=n_nationkey"),
    "agg_global": (lambda: Q().from_("lineitem").count("*", "n").sum("l_quantity", "q").min("l_discount", "mi").max("l_tax", "ma").select().add_computed("a", "ROUND", field("avg_price"), 4).exclude("avg_price").end().avg("l_extendedprice", "avg_price"), "select count(*) as n,sum(l_quantity) as q,round(avg(l_extendedprice),4) as a,min(l_discount) as mi,max(l_tax) as ma from lineitem"),
    "agg_group_having": (lambda: Q().from_("lineitem").group_by("l_returnflag", "l_linestatus").aggregate().type("count").field("*").alias("n").with_filter(cond("n", "gt", 10000)).end().sum("l_extendedprice", "raw_sum").select().add_computed("s", "ROUND", field("raw_sum"), 2).exclude("raw_sum").end(), "select l_returnflag,l_linestatus,count(*) as n,round(sum(l_extendedprice),2) as s from lineitem group by l_returnflag,l_linestatus having count(*)>10000"),
    "agg_filter_where": (lambda: Q().from_("customer").group_by("c_nationkey").aggregate().type("count").field("*").alias("pos").where(cond("c_acctbal", "gt", 0)).end().count("*", "n"), "select c_nationkey,count(*) filter (where c_acctbal>0) as pos,count(*) as n from customer group by c_nationkey"),
    "agg_count_field": (lambda: Q().from_("documents").alias("d").left_join("labels").alias("l").on(on("d.doc_id", "l.doc_id")).end().group_by("d.lang").count("l.quality", "labelled").count("*", "n"), "select d.lang, count(l.quality) as labelled, count(*) as n from documents d left join labels l on d.doc_id=l.doc_id group by d.lang"),
    "agg_default_alias": (lambda: Q().from_("supplier").group_by("s_nationkey").max("s_acctbal").count(), 'select s_nationkey, max(s_acctbal) as max_s_acctbal, count(*) as "count" from supplier group by s_nationkey'),
    "distinct_rows": (lambda: Q().from_("part").select().include("p_brand", "p_type").end().distinct(), "select distinct p_brand,p_type from part"),
    "distinct_by_first": (lambda: Q().from_("orders").distinct_by("o_custkey").order_by("o_orderkey").select().include("o_custkey", "o_orderkey").end(), "select o_custkey,o_orderkey from (select o_custkey,o_orderkey,row_number() over(partition by o_custkey order by o_orderkey) rn from orders) t where rn=1"),
    "sort_limit_offset": (lambda: Q().from_("orders").order_by_desc("o_totalprice").then_sort_by_asc("o_orderkey").limit(20).offset(40).select().include("o_orderkey", "o_totalprice").end(), "select o_orderkey,o_totalprice from orders order by o_totalprice desc,o_orderkey asc limit 20 offset 40"),
    "sort_by_computed": (lambda: Q().from_("lineitem").select().include("l_orderkey", "l_linenumber").add_computed("revenue", "MULTIPLY", field("l_extendedprice"), call("SUBTRACT", 1, field("l_discount"))).end().order_by_desc("revenue").then_sort_by("l_orderkey").then_sort_by("l_linenumber").limit(15), "select l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) as revenue from lineitem order by revenue desc, l_orderkey, l_linenumber limit 15"),
    "sort_by_aggregate": (lambda: Q().from_("orders").group_by("o_custkey").sum("o_totalprice", "spent").order_by_desc("spent").then_sort_by("o_custkey").limit(10), "select o_custkey, sum(o_totalprice) as spent from orders group by o_custkey order by spent desc, o_custkey limit 10"),
    "cursor_page": (lambda: Q().from_("orders").cursor("o_orderkey", 500, 25).select().include("o_orderkey").end(), "select o_orderkey from orders where o_orderkey>500 order by o_orderkey asc limit 25"),
    "cursor_page_desc": (lambda: Q().from_("orders").cursor("o_orderkey", 500, 25, "desc").select().include("o_orderkey").end(), "select o_orderkey from orders where o_orderkey<500 order by o_orderkey desc limit 25"),
    "union_distinct": (lambda: Q().from_("customer").select().include("c_nationkey", alias="k").end().union(Q().from_("supplier").select().include("s_nationkey", alias="k").end()), "select c_nationkey as k from customer union select s_nationkey from supplier"),
    "union_all": (lambda: Q().from_("customer").select().include("c_nationkey", alias="k").end().union_all(Q().from_("supplier").select().include("s_nationkey", alias="k").end()), "select c_nationkey as k from customer union all select s_nationkey from supplier"),
    "intersect": (lambda: Q().from_("customer").select().include("c_nationkey", alias="k").end().intersect(Q().from_("supplier").select().include("s_nationkey", alias="k").end()), "select c_nationkey as k from customer intersect select s_nationkey from supplier"),
    "except": (lambda: Q().from_("nation").select().include("n_nationkey", alias="k").end().except_(Q().from_("supplier").where("s_acctbal").gt(5000).select().include("s_nationkey", alias="k").end()), "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal>5000"),
    "subq_scalar": (lambda: Q().from_("customer").where("c_acctbal").gt(Q().from_("customer").avg("c_acctbal", "a")).select().include("c_custkey").end(), "select c_custkey from customer where c_acctbal>(select avg(c_acctbal) from customer)"),
    "subq_in_join": (lambda: Q().from_("orders").where("o_custkey").is_in(Q().from_("customer").alias("c").inner_join("nation").alias("n").on(on("c.c_nationkey", "n.n_nationkey")).end().where("n.n_regionkey").eq(2).select().include("c.c_custkey").end()).select().include("o_orderkey").end(), "select o_orderkey from orders where o_custkey in (select c.c_custkey from customer c join nation n on c.c_nationkey=n.n_nationkey where n.n_regionkey=2)"),
    "subq_not_in": (lambda: Q().from_("supplier").where("s_nationkey").not_in(Q().from_("customer").where("c_acctbal").gt(9900).select().include("c_nationkey").end()).select().include("s_suppkey").end(), "select s_suppkey from supplier where s_nationkey not in (select c_nationkey from customer where c_acctbal>9900)"),
    "subq_nested_in": (lambda: Q().from_("orders").where("o_custkey").is_in(Q().from_("customer").where("c_nationkey").is_in(Q().from_("nation").where("n_regionkey").is_in(Q().from_("region").where("r_name").eq("ASIA").select().include("r_regionkey").end()).select().include("n_nationkey").end()).select().include("c_custkey").end()).select().include("o_orderkey").end(), "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name='ASIA')))"),
    "subq_correlated": (lambda: Q().from_("orders").alias("o").where("o.o_totalprice").gte(Q().from_("orders").alias("x").where("x.o_custkey").eq(field("o.o_custkey")).max("x.o_totalprice", "m")).select().include("o.o_orderkey").end(), "select o.o_orderkey from orders o where o.o_totalprice>=(select max(x.o_totalprice) from orders x where x.o_custkey=o.o_custkey)"),
    "raw_sql": (lambda: Q().raw("select n_name, count(*) as n from {{collections.customer}} c join {{collections.nation}} n on c.c_nationkey = n.n_nationkey where c.c_acctbal > ? group by n_name", [1000]), "select n_name, count(*) as n from customer c join nation n on c.c_nationkey=n.n_nationkey where c.c_acctbal>1000 group by n_name"),
    "raw_group_concat": (lambda: Q().raw("select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from {{collections.nation}} group by n_regionkey"), "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey"),
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = Catalog.of_folder(spark, sf_dir, TABLES)
    return c.register("toxic_labels", lambda: c.table("labels").where("toxic = 1").select("doc_id"))


def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q().from_("orders").where("o_orderstatus").eq("O").order_by("o_orderkey").limit(10).include_total().select().include("o_orderkey").end()
    return catalog(spark, sf_dir).frame(q).withColumnRenamed("__matches__", "total")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q().from_("events").select().include("event_id").add_computed("k", "json_extract", field("props"), "$.k").end()
    return catalog(spark, sf_dir).frame(q).select("event_id", F.col("k").try_cast("long").alias("k")).where("k > 50")


def join_nested_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q().from_("customer").alias("c").left_join("orders").alias("o").on(group("and", on("c.c_custkey", "o.o_custkey"), cond("o.o_totalprice", "gt", 350000))).end()
    return catalog(spark, sf_dir).frame(q).select("c.c_custkey", F.col("o").isNull().alias("unmatched"), "o.o_totalprice")


def set_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = DocumentSet(catalog(spark, sf_dir).table("customer")).aggregate("c_acctbal")
    return s.select(F.col("median").alias("med"), F.round("std_dev", 6).alias("sd"), "count", F.round("sum", 4).alias("s"), "min", "max")


def set_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DocumentSet(catalog(spark, sf_dir).table("documents")).grouped("lang", longest=F.max("n_chars"))


def update_compute_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = catalog(spark, sf_dir).table("part")
    return updated(part, compute={"p_retailprice": call("MULTIPLY", field("p_retailprice"), 2)}, filters=cond("p_brand", "eq", "Brand#2")).select("p_partkey", "p_retailprice")


def update_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    spent = Q().from_("orders").alias("o").where("o.o_custkey").eq(field("customer.c_custkey")).max("o.o_totalprice", "m").build()
    return updated(c.table("customer"), compute={"c_acctbal": {"type": "subquery", "query": spent}}, filters=cond("c_mktsegment", "eq", "BUILDING"), name="customer", catalog=c).select("c_custkey", "c_acctbal")


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.sources.managed import remaining

    return remaining(catalog(spark, sf_dir).table("customer"), group("or", cond("c_acctbal", "lt", 0), cond("c_mktsegment", "eq", "MACHINERY"))).select("c_custkey")


def mask_obscure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).table("customer").select("c_custkey", masking.obscure(F.col("c_name"), prefix=2, suffix=2, short=5).alias("m"))


def mask_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = masking.Policy(fields={"c_name": "redact", "c_mktsegment": "obscure"}, default="preserve")
    return masking.masked(catalog(spark, sf_dir).table("customer").select("c_custkey", "c_name", "c_mktsegment"), policy)


def checksum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.functions.docs import checksum

    t = catalog(spark, sf_dir).table("nation")
    return t.select("n_nationkey", checksum(t, ["n_nationkey", "n_name", "n_regionkey"]).alias("sum"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.operators.validation import duplicates

    return duplicates(catalog(spark, sf_dir).table("conversations"), ["conv_id"])


MADE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "total_count": (total_count, "select o_orderkey,count(*) over() as total from orders where o_orderstatus='O' order by o_orderkey limit 10"),
    "json_extract": (json_extract, "select event_id,cast(json_extract_string(props,'$.k') as bigint) as k from events where cast(json_extract_string(props,'$.k') as bigint)>50"),
    "join_nested_result": (join_nested_result, "select c.c_custkey, o.o_orderkey is null as unmatched, o.o_totalprice from customer c left join orders o on c.c_custkey=o.o_custkey and o.o_totalprice>350000"),
    "set_stats": (set_stats, 'select median(c_acctbal) as med,round(stddev_pop(c_acctbal),6) as sd,count(*) as "count",round(sum(c_acctbal),4) as s,min(c_acctbal) as "min",max(c_acctbal) as "max" from customer'),
    "set_group_by": (set_group_by, "select coalesce(lang,'undefined') as key, count(*) as n, max(n_chars) as longest from documents group by 1"),
    "update_compute_case": (update_compute_case, "select p_partkey,case when p_brand='Brand#2' then p_retailprice*2 else p_retailprice end as p_retailprice from part"),
    "update_correlated": (update_correlated, "select c_custkey, case when c_mktsegment='BUILDING' then (select max(o.o_totalprice) from orders o where o.o_custkey=customer.c_custkey) else c_acctbal end as c_acctbal from customer"),
    "delete_rows": (delete_rows, "select c_custkey from customer where not (c_acctbal<0 or c_mktsegment='MACHINERY')"),
    "mask_obscure": (mask_obscure, "select c_custkey,case when length(c_name)<=5 then '[OBSCURED]' else concat(substr(c_name,1,2),repeat('*',length(c_name)-4),substr(c_name,length(c_name)-1,2)) end as m from customer"),
    "mask_policy": (mask_policy, "select c_custkey, '***' as c_name, case when length(c_mktsegment)<=4 then '[OBSCURED]' else concat(substr(c_mktsegment,1,2),repeat('*',length(c_mktsegment)-4),substr(c_mktsegment,length(c_mktsegment)-1,2)) end as c_mktsegment from customer"),
    "checksum_rows": (checksum_rows, """select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as "sum" from nation"""),
    "duplicate_keys": (duplicate_keys, "select conv_id, count(*) as n from conversations group by conv_id having count(*)>1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    built = {k: (lambda spark, sf_dir, q=q: catalog(spark, sf_dir).frame(q())) for k, (q, _) in BUILT.items()}
    return built | {k: f for k, (f, _) in MADE.items()} | catalogue_more.queries()


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in BUILT.items()} | {k: sql for k, (_, sql) in MADE.items() if sql} | catalogue_more.oracle_sql()

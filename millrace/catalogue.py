"""The registered queries over the engine's operators, each with DuckDB SQL that gives the same rows.

Queries are declared with ``@case(sql)``; their names are the functions' names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.functions.expressions import TRUE, field, from_json, negate, opaque, param, to_json
from millrace.functions.text import Tokenizer
from millrace.operators import changes as C
from millrace.operators import search as X
from millrace.operators.query import Composer, Query, cosine_distance, query
from millrace.plans import wire
from millrace.sources import tables
from millrace.streaming import live

Run = Callable[[SparkSession, str], DataFrame]
_CASES: dict[str, tuple[Run, str | None]] = {}

KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"]}


def case(sql: str | None) -> Callable[[Run], Run]:
    def add(f: Run) -> Run:
        _CASES[f.__name__] = (f, sql)
        return f

    return add


def q(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return query(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *KEYS[name])


def queries() -> dict[str, Run]:
    return {n: f for n, (f, _) in _CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _CASES.items() if sql is not None}


# -- the flagship: filter, sort, page, project -----------------------------------------------------------------------


@case("""
select o_orderkey as id, o_totalprice as price from orders where o_orderstatus = 'F' and o_totalprice > 50000
order by o_totalprice desc, o_orderkey limit 20 offset 5""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q(spark, sf_dir, "orders").where((field("o_orderstatus") == "F") & (field("o_totalprice") > 50000))
    return found.sort_descending("o_totalprice").skip(5).take(20).map(id="o_orderkey", price="o_totalprice").to_df()


# -- filters ---------------------------------------------------------------------------------------------------------


@case("select l_orderkey, l_linenumber from lineitem where l_quantity >= 45 and l_discount < 0.03 and l_tax <= 0.04 and l_extendedprice > 30000")
def filter_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (field("l_quantity") >= 45) & (field("l_discount") < 0.03) & (field("l_tax") <= 0.04) & (field("l_extendedprice") > 30000)
    return q(spark, sf_dir, "lineitem").where(e).map("l_orderkey", "l_linenumber").to_df()


@case("select l_orderkey, l_linenumber from lineitem where not (l_returnflag = 'N' or l_quantity > 5) and not (l_linestatus = 'O' and l_discount > 0.05)")
def filter_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ~((field("l_returnflag") == "N") | (field("l_quantity") > 5)) & ~((field("l_linestatus") == "O") & (field("l_discount") > 0.05))
    return q(spark, sf_dir, "lineitem").where(e).map("l_orderkey", "l_linenumber").to_df()


@case("select l_orderkey, l_linenumber from lineitem where l_discount > l_tax and l_partkey <> l_suppkey")
def filter_prop_vs_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (field("l_discount") > field("l_tax")) & (field("l_partkey") != field("l_suppkey"))
    return q(spark, sf_dir, "lineitem").where(e).map("l_orderkey", "l_linenumber").to_df()


def _with_null_status(spark: SparkSession, sf_dir: str) -> Query:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return query(rows.select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority")), "o_orderkey")


@case("select o_orderkey from orders where nullif(o_orderstatus, 'O') is distinct from 'F'")
def filter_not_equal_keeps_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_null_status(spark, sf_dir).where(field("status") != "F").map("o_orderkey").to_df()


@case("select o_orderkey from orders where nullif(o_orderstatus, 'O') = 'F' and nullif(o_orderpriority, '1-URGENT') is not distinct from nullif(o_orderpriority, '1-URGENT')")
def filter_eq_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_null_status(spark, sf_dir).where((field("status") == "F") & (field("priority") == field("priority"))).map("o_orderkey").to_df()


@case("select o_orderkey, nullif(o_orderstatus, 'O') is null as gone from orders where nullif(o_orderstatus, 'O') is null or nullif(o_orderpriority, '1-URGENT') is null")
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _with_null_status(spark, sf_dir).where(field("status").is_null() | field("priority").is_null())
    return found.map("o_orderkey", gone=F.col("status").isNull()).to_df()


@case("select p_partkey, p_name from part where starts_with(p_type, 'PROMO') or (ends_with(p_type, 'COPPER') and contains(p_type, 'STEEL') = false) or contains(p_name, '1')")
def filter_starts_ends_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = field("p_type")
    return q(spark, sf_dir, "part").where(t.startswith("PROMO") | (t.endswith("COPPER") & ~t.contains("STEEL")) | field("p_name").contains("1")).map("p_partkey", "p_name").to_df()


@case("select p_partkey from part where contains(lower(p_type), 'brass') or starts_with(upper(p_name), 'PART#00000001') or contains(lower(p_brand), '#1')")
def filter_case_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = field("p_type").lower().contains("brass") | field("p_name").upper().startswith("PART#00000001") | field("p_brand").lower().contains("#1")
    return q(spark, sf_dir, "part").where(e).map("p_partkey").to_df()


@case("select doc_id, length(text) as size from documents where length(text) > 2000 and length(lang) = 2")
def filter_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "documents").where((field("text").length() > 2000) & (field("lang").length() == 2)).map("doc_id", size=field("text").length()).to_df()


@case("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('P')")
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = field("o_orderpriority").is_in(["1-URGENT", "2-HIGH"]) & ~field("o_orderstatus").is_in(["P"])
    return q(spark, sf_dir, "orders").where(e).map("o_orderkey").to_df()


@case("select o_orderkey from orders where not coalesce(nullif(o_orderstatus, 'O') in ('F'), false)")
def filter_not_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_null_status(spark, sf_dir).where(~field("status").is_in(["F"])).map("o_orderkey").to_df()


@case("select doc_id from documents where 1 = 0")
def filter_in_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "documents").where(field("lang").is_in([])).map("doc_id").to_df()


@case("select doc_id from documents where list_contains([lang, source], 'src3') and not list_contains([lang, source], 'en')")
def filter_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array("lang", "source").alias("tags"))
    return query(rows, "doc_id").where(field("tags").contains("src3") & ~field("tags").contains("en")).map("doc_id").to_df()


@case("select o_orderkey from orders where o_totalprice between 1000 and 20000 and o_orderstatus in ('F', 'O')")
def filter_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (field("o_totalprice") >= param("low")) & (field("o_totalprice") <= param("high")) & field("o_orderstatus").is_in(param("states"))
    return q(spark, sf_dir, "orders").where(e, {"low": 1000, "high": 20000, "states": ["F", "O"]}).map("o_orderkey").to_df()


@case("select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1995-03-01' and o_orderdate < timestamp '1995-09-01'")
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").where((field("o_orderdate") >= "1995-03-01") & (field("o_orderdate") < "1995-09-01")).map("o_orderkey", "o_orderdate").to_df()


@case("select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0 and c_nationkey < 10")
def filter_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    scoped = query(rows, "c_custkey", scopes=[field("c_mktsegment") == "BUILDING", lambda df: df["c_acctbal"] > 0])
    return scoped.where(field("c_nationkey") < 10).map("c_custkey").to_df()


@case("select c_custkey, c_acctbal as balance from customer where c_mktsegment = 'MACHINERY' and c_acctbal < 500")
def filter_nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), F.struct("c_acctbal").alias("money")).alias("info"))
    return query(rows, "c_custkey").where((field("info").segment == "MACHINERY") & (field("info.money.c_acctbal") < 500)).map("c_custkey", balance="info.money.c_acctbal").to_df()


@case("select o_orderkey from orders where (o_totalprice > 100000) = true and not (o_orderstatus = 'F') ")
def filter_boolean_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("large"), (F.col("o_orderstatus") == "F").alias("done"))
    return query(rows, "o_orderkey").where(field("large").is_true() & ~field("done").is_true()).map("o_orderkey").to_df()


@case("select n_nationkey from nation where n_nationkey % 7 = 3")
def filter_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "nation").where(opaque(lambda k: k % 7 == 3, "n_nationkey")).map("n_nationkey").to_df()


@case("select (select count(*) from orders where o_totalprice > 30000 and o_orderstatus <> 'P') as holds, (select count(*) from orders where not (o_totalprice > 30000 and o_orderstatus <> 'P')) as fails")
def filter_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (field("o_totalprice") > 30000) & (field("o_orderstatus") != "P")
    orders = q(spark, sf_dir, "orders")
    return orders.where(e).count_df("holds").join(orders.where(negate(e)).count_df("fails"))


# -- projection ------------------------------------------------------------------------------------------------------


@case("select c_name from customer")
def map_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "customer").map("c_name").to_df()


@case("select c_custkey as id, c_name as label, c_mktsegment as segment from customer")
def map_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "customer").map(id="c_custkey", label="c_name", segment="c_mktsegment").to_df()


@case("select c_custkey, c_acctbal * 2 + 1 as doubled, c_name || '/' || c_mktsegment as label, c_acctbal < 0 as negative from customer")
def map_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("c_name", F.lit("/"), "c_mktsegment")
    return q(spark, sf_dir, "customer").map("c_custkey", doubled=F.col("c_acctbal") * 2 + 1, label=label, negative=F.col("c_acctbal") < 0).to_df()


@case("select c_custkey as id, upper(c_name) as shout, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment, c_acctbal > 5000 as rich from customer")
def schema_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S.define(
        "customer",
        id=S.number("long").key().stored_as("c_custkey"),
        shout=S.string().stored_as("c_name").deserialize(F.upper),
        segment=S.string().stored_as("c_mktsegment").deserialize(lambda c: F.nullif(c, F.lit("BUILDING"))).default("none"),
        balance=S.number().stored_as("c_acctbal"),
        rich=S.computed("boolean", lambda r: r["balance"] > 5000),
    )
    return schema.enrich(schema.read(spark.read.parquet(f"{sf_dir}/customer.parquet"))).select("id", "shout", "segment", "rich")


# -- order and windows -----------------------------------------------------------------------------------------------


@case("select o_orderkey, o_totalprice from (select * from orders order by o_totalprice asc nulls first, o_orderkey limit 10) union all select o_orderkey, o_totalprice from (select * from orders order by o_totalprice desc nulls last, o_orderkey limit 10)")
def sort_asc_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = q(spark, sf_dir, "orders")
    return orders.sort("o_totalprice").take(10).map("o_orderkey", "o_totalprice").df.union(orders.sort_descending("o_totalprice").take(10).map("o_orderkey", "o_totalprice").df)


@case("select o_orderkey from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 50")
def sort_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").sort_descending("o_totalprice").sort("o_orderpriority").take(50).map("o_orderkey").to_df()


@case("select o_orderkey from orders order by o_orderdate, o_orderkey limit 25 offset 100")
def skip_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").sort("o_orderdate").skip(100).take(25).map("o_orderkey").to_df()


@case("select o_orderkey from orders where 1 = 0")
def skip_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").sort("o_orderdate").skip(100_000_000).take(0).map("o_orderkey").to_df()


@case("select o_orderkey from (select * from orders order by o_totalprice desc, o_orderkey limit 100) where o_orderstatus = 'O'")
def take_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").sort_descending("o_totalprice").take(100).where(field("o_orderstatus") == "O").map("o_orderkey").to_df()


@case("select o_orderkey from (select * from orders order by o_totalprice desc, o_orderkey limit 10) order by o_totalprice desc, o_orderkey offset 4")
def take_then_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").sort_descending("o_totalprice").take(10).skip(4).map("o_orderkey").to_df()


@case("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "lineitem").sort_descending("l_extendedprice").take(100).map("l_orderkey", "l_linenumber", "l_extendedprice").to_df()


# -- terminals -------------------------------------------------------------------------------------------------------


@case("select count(*) as n from lineitem where l_quantity > 25")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "lineitem").where(field("l_quantity") > 25).count_df("n")


@case("select count(*) as n from (select * from orders order by o_orderkey limit 30 offset 10)")
def count_after_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").sort("o_orderkey").skip(10).take(30).count_df("n")


@case("select round(sum(l_extendedprice), 2) as total from lineitem where l_returnflag = 'R'")
def sum(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: A001
    found = q(spark, sf_dir, "lineitem").where(field("l_returnflag") == "R").map("l_extendedprice").sum_df("total")
    return found.select(F.round("total", 2).alias("total"))


@case("select round(sum(o_totalprice), 2) as total from (select * from orders order by o_totalprice desc, o_orderkey limit 3)")
def sum_after_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").sort_descending("o_totalprice").take(3).map("o_totalprice").sum_df("total").select(F.round("total", 2).alias("total"))


@case("select min(o_orderdate) as low, max(o_orderdate) as high, min(nullif(o_orderstatus, 'F')) as least from orders")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = q(spark, sf_dir, "orders")
    dates = orders.map("o_orderdate")
    return dates.min_df("low").join(dates.max_df("high")).join(orders.map(s=F.nullif("o_orderstatus", F.lit("F"))).min_df("least"))


@case("select distinct nullif(o_orderpriority, '1-URGENT') as p from orders where nullif(o_orderpriority, '1-URGENT') is not null")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").map(p=F.nullif("o_orderpriority", F.lit("1-URGENT"))).distinct()


@case("select exists(select 1 from orders where o_totalprice > 400000) as large, exists(select 1 from orders where o_totalprice < 0) as negative")
def some(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = q(spark, sf_dir, "orders")
    return orders.some_df(field("o_totalprice") > 400000, "large").join(orders.some_df(field("o_totalprice") < 0, "negative"))


@case("select (select count(*) from orders where not (o_totalprice > 0)) = 0 as all_paid, (select count(*) from orders where not (o_orderstatus = 'F')) = 0 as all_done, true as of_none")
def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = q(spark, sf_dir, "orders")
    none = orders.where(field("o_totalprice") < -1)
    return orders.every_df(field("o_totalprice") > 0, "all_paid").join(orders.every_df(field("o_orderstatus") == "F", "all_done")).join(none.every_df(field("o_orderstatus") == "F", "of_none"))


@case("select o_orderkey, o_totalprice from orders where o_orderstatus = 'P' order by o_totalprice, o_orderkey limit 1")
def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "orders").where(field("o_orderstatus") == "P").sort("o_totalprice").take(1).map("o_orderkey", "o_totalprice").to_df()


@case("select cast(n_regionkey as varchar) as key, count(*) as n, cast(sum(n_nationkey) as bigint) as keys, min(n_name) as first_name from nation group by n_regionkey")
def to_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = q(spark, sf_dir, "nation").to_group("n_regionkey")
    keys = F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, r: a + r["n_nationkey"])
    return groups.select("key", F.size("rows").cast("bigint").alias("n"), keys.alias("keys"), F.array_min(F.transform("rows", lambda r: r["n_name"])).alias("first_name"))


# -- joins -----------------------------------------------------------------------------------------------------------


@case("select c_custkey, o_orderkey, o_totalprice from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING'")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = q(spark, sf_dir, "customer").where(field("c_mktsegment") == "BUILDING")
    return customers.join(q(spark, sf_dir, "orders"), "c_custkey", "o_custkey").map(c_custkey="outer.c_custkey", o_orderkey="inner.o_orderkey", o_totalprice="inner.o_totalprice")


@case("select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 300000) on c_custkey = o_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = q(spark, sf_dir, "orders").where(field("o_totalprice") > 300000)
    return q(spark, sf_dir, "customer").left_join(large, "c_custkey", "o_custkey").map(c_custkey="outer.c_custkey", o_orderkey="inner.o_orderkey")


@case("select n_name, s_suppkey from nation left join (select * from supplier where s_acctbal > 0 and s_suppkey > 3) on n_nationkey = s_nationkey where n_regionkey = 1")
def join_left_inner_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = query(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", scopes=[field("s_acctbal") > 0]).where(field("s_suppkey") > 3)
    return q(spark, sf_dir, "nation").where(field("n_regionkey") == 1).left_join(suppliers, "n_nationkey", "s_nationkey").map(n_name="outer.n_name", s_suppkey="inner.s_suppkey")


@case("select n_name, r_name from (select *, nullif(n_regionkey, 2) as k from nation) left join (select *, nullif(r_regionkey, 2) as rk from region) on k = rk")
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = query(spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("k", F.nullif("n_regionkey", F.lit(2))), "n_nationkey")
    regions = query(spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("rk", F.nullif("r_regionkey", F.lit(2))), "r_regionkey")
    return nations.left_join(regions, "k", "rk").map(n_name="outer.n_name", r_name="inner.r_name")


@case("select n_nationkey, s_suppkey from (select *, case when n_nationkey < 5 then 'nan'::double else n_nationkey end as k from nation) n join (select *, case when s_nationkey < 5 then 'nan'::double else s_nationkey end as k from supplier) s on n.k = s.k and not isnan(n.k)")
def join_nan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    some_nan = lambda c: F.when(F.col(c) < 5, F.lit(float("nan"))).otherwise(F.col(c).cast("double"))
    nations = query(spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("k", some_nan("n_nationkey")), "n_nationkey")
    suppliers = query(spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("k", some_nan("s_nationkey")), "s_suppkey")
    return nations.join(suppliers, "k", "k").map(n_nationkey="outer.n_nationkey", s_suppkey="inner.s_suppkey")


@case("select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey where o_totalprice > c_acctbal * 50")
def join_theta_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = q(spark, sf_dir, "customer").join(q(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    return pairs.where(F.col("inner.o_totalprice") > F.col("outer.c_acctbal") * 50).map(c_custkey="outer.c_custkey", o_orderkey="inner.o_orderkey")


@case("select c_custkey, o_orderkey from (select * from customer order by c_acctbal desc, c_custkey limit 10) join orders on c_custkey = o_custkey")
def join_outer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = q(spark, sf_dir, "customer").sort_descending("c_acctbal").take(10)
    return top.join(q(spark, sf_dir, "orders"), "c_custkey", "o_custkey").map(c_custkey="outer.c_custkey", o_orderkey="inner.o_orderkey")


@case("select count(*) as n from customer left join (select * from orders where o_orderstatus = 'P') on c_custkey = o_custkey")
def join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = q(spark, sf_dir, "orders").where(field("o_orderstatus") == "P")
    return q(spark, sf_dir, "customer").left_join(part, "c_custkey", "o_custkey").count_df("n")


@case("select n_name, s_suppkey, c_custkey from (select n_nationkey, n_name from nation where n_nationkey < 3) join supplier on n_nationkey = s_nationkey join (select * from customer where c_acctbal > 9000) on n_nationkey = c_nationkey")
def join_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = q(spark, sf_dir, "nation").where(field("n_nationkey") < 3)
    pairs = query(few.join(q(spark, sf_dir, "supplier"), "n_nationkey", "s_nationkey").map(n_nationkey="outer.n_nationkey", n_name="outer.n_name", s_suppkey="inner.s_suppkey"), "s_suppkey")
    rich = q(spark, sf_dir, "customer").where(field("c_acctbal") > 9000)
    return pairs.join(rich, "n_nationkey", "c_nationkey").map(n_name="outer.n_name", s_suppkey="outer.s_suppkey", c_custkey="inner.c_custkey")


@case("select c_custkey, o_orderkey, o_totalprice from customer join orders on c_custkey = o_custkey where c_nationkey = 7 order by o_totalprice desc, c_custkey, o_orderkey limit 12 offset 3")
def join_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = q(spark, sf_dir, "customer").join(q(spark, sf_dir, "orders"), "c_custkey", "o_custkey").where(field("outer").c_nationkey == 7)
    return pairs.sort_descending("inner.o_totalprice").skip(3).take(12).map(c_custkey="outer.c_custkey", o_orderkey="inner.o_orderkey", o_totalprice="inner.o_totalprice")


@case("select n_name, r_name from nation join region on cast(n_regionkey as varchar) = cast(r_regionkey as varchar)")
def join_text_and_number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = query(spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("k", F.col("r_regionkey").cast("string")), "r_regionkey")
    return q(spark, sf_dir, "nation").join(regions, "n_regionkey", "k").map(n_name="outer.n_name", r_name="inner.r_name")


# -- vectors ---------------------------------------------------------------------------------------------------------

#: A fixed query vector of the embeddings' width.
PROBE = [((i * 37) % 17 - 8) / 8 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(f"{x}::double" for x in PROBE) + "]"
_DISTANCE = f"1 - list_inner_product(v, {_PROBE_SQL}) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product({_PROBE_SQL}, {_PROBE_SQL})))"
_VECTORS = "(select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


@case(f"select vec_id, round({_DISTANCE}, 6) as distance from {_VECTORS} order by {_DISTANCE}, vec_id limit 10")
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q(spark, sf_dir, "embeddings").nearest("embedding", PROBE, 10)
    return found.map("vec_id", distance=F.round(cosine_distance("embedding", PROBE), 6)).to_df()


@case(f"select vec_id from (select * from {_VECTORS} where label < 3 order by {_DISTANCE}, vec_id limit 15) order by vec_id limit 5")
def nearest_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = q(spark, sf_dir, "embeddings").where(field("label") < 3).nearest("embedding", PROBE, 15)
    return near.sort("vec_id").take(5).map("vec_id").to_df()


@case("select vec_id, vec_id % 3 < 2 as last from embeddings")
def nearest_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by distance: null and zero ones come after the others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    zero = F.transform("embedding", lambda x: x * 0)
    spoilt = rows.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, None).when(F.col("vec_id") % 3 == 1, zero).otherwise(F.col("embedding")))
    n = rows.count()
    near = query(spoilt, "vec_id").nearest("embedding", PROBE, n).to_df()
    distance = cosine_distance("embedding", PROBE)
    return near.select("vec_id", (distance == float("inf")).alias("last"))


@case(f"select vec_id, round({_DISTANCE}, 6) as distance from {_VECTORS} order by {_DISTANCE}, vec_id limit 10")
def nearest_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 768 dimensions, each the given one repeated: the distances stay."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.flatten(F.array_repeat("embedding", 12)))
    found = query(rows, "vec_id").nearest("embedding", PROBE * 12, 10)
    return found.map("vec_id", distance=F.round(cosine_distance("embedding", PROBE * 12), 6)).to_df()


# -- search ----------------------------------------------------------------------------------------------------------

_TERMS = "(select doc_id as source_id, field, unnest(list_filter(list_transform(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2), lambda w: w[1:64]), lambda w: true)) as term from (select doc_id, 'text' as field, text as t from documents union all select doc_id, 'source' as field, source as t from documents))"
_INDEX = f"(select term, field, source_id, count(*) as frequency from {_TERMS} group by all)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", ["text", "source"])


@case(f"select term, field, source_id, frequency from {_INDEX}")
def search_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@case(f"select source_id as doc_id, cast(sum(frequency) as bigint) as score, any_value(lang) as lang from {_INDEX} join documents on doc_id = source_id where term in ('license', 'general') group by source_id order by score desc, doc_id limit 20")
def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.search(q(spark, sf_dir, "documents"), _index(spark, sf_dir), "doc_id", "License GENERAL license").take(20).map("doc_id", "score", "lang").to_df()


@case(f"select source_id as doc_id, cast(sum(frequency) as bigint) as score from {_INDEX} where term in ('the', 'license') group by source_id having count(distinct term) = 2")
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.search(q(spark, sf_dir, "documents"), _index(spark, sf_dir), "doc_id", "the license", match="all").map("doc_id", "score").to_df()


@case(f"select source_id as doc_id, cast(sum(frequency) as bigint) as score from {_INDEX} where term = 'src3' and field = 'source' group by source_id")
def search_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.search(q(spark, sf_dir, "documents"), _index(spark, sf_dir), "doc_id", "src3", fields=["source"], indexed=["text", "source"]).map("doc_id", "score").to_df()


@case(f"select doc_id from (select source_id, sum(frequency) as score from {_INDEX} where term in ('license', 'mit') group by source_id) join documents on doc_id = source_id where lang = 'en' and n_chars > 500 order by n_chars, score desc, doc_id limit 8 offset 1")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.search(q(spark, sf_dir, "documents").where(field("lang") == "en"), _index(spark, sf_dir), "doc_id", "mit license").where(field("n_chars") > 500)
    return X.sort_found(found, ("n_chars", False), ("score", True)).skip(1).take(8).map("doc_id").to_df()


@case("select doc_id, len(list_filter(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4), lambda w: w[1:6] not in ('with', 'that', 'this'))) as n from documents")
def search_tokens_with_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tokenizer(lowercase=False, min_length=4, max_length=6, stop_words=["with", "that", "this"])
    return q(spark, sf_dir, "documents").map("doc_id", n=F.size(t.column(F.col("text"))).cast("bigint")).to_df()


@case(f"select term, field, source_id, case when source_id % 10 = 1 then 'missing' else 'stale' end as problem from {_INDEX} where source_id % 10 = 1 or source_id % 10 = 2")
def search_index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = X.build_index(docs, "doc_id", ["text", "source"])
    spoilt = index.where("source_id % 10 <> 1").withColumn("frequency", F.when(F.col("source_id") % 10 == 2, F.col("frequency") + 1).otherwise(F.col("frequency")))
    return X.check_index(spoilt, docs, "doc_id", ["text", "source"])


@case(f"select term, field, source_id, frequency from {_INDEX}")
def search_index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    before = docs.withColumn("source", F.when(F.col("doc_id") % 4 == 0, "old words").otherwise(F.col("source")))
    changed = F.col("doc_id") % 4 == 0
    fields = ["text", "source"]
    return X.update_index(X.build_index(before, "doc_id", fields), before.where(changed), docs.where(changed), "doc_id", fields)


# -- changes, views, live queries ------------------------------------------------------------------------------------


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after: some are added, some go, some change their state."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    new = rows.where(k % 7 != 1).withColumn("o_orderstatus", F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return rows.where(k % 7 != 2), new


_OLD = "(select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 7 <> 2)"
_NEW = "(select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders where o_orderkey % 7 <> 1)"


_DIFF = f"""(
select case when a.o_orderkey is null then 'add' when b.o_orderkey is null then 'remove' else 'update' end as _op,
  coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) as o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) as o_totalprice
from {_OLD} a full join {_NEW} b on a.o_orderkey = b.o_orderkey
where a.o_orderkey is null or b.o_orderkey is null or a.o_orderstatus is distinct from b.o_orderstatus or a.o_totalprice is distinct from b.o_totalprice)"""


@case(f"select * from {_DIFF}")
def view_mirror_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    return C.mirror(old, new, ["o_orderkey"], ["o_totalprice"])


@case(f"select * from {_NEW}")
def view_mirror_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    return C.apply_diff(old, C.diff(old, new, ["o_orderkey"]), ["o_orderkey"])


@case(f"select count(*) as versions, count(distinct o_orderkey) as orders_seen from (select * from {_OLD} union select * from {_NEW})")
def view_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    stored = C.accumulate(old.withColumn("id", F.lit("")).limit(0), old, "id")
    return stored.unionByName(C.accumulate(stored, new, "id")).agg(F.count("*").alias("versions"), F.count_distinct("o_orderkey").alias("orders_seen"))


@case("select c_custkey from customer where c_acctbal >= 0")
def soft_delete_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    stamped = C.soft_delete(rows, rows.where("c_acctbal < 0"), ["c_custkey"], "deleted_at", F.current_timestamp())
    return query(stamped, "c_custkey", scopes=[field("deleted_at").is_null()]).map("c_custkey").to_df()


@case(f"select cast(case _op when 'remove' then 0 when 'update' then 1 else 2 end as integer) as place, _op as op, '{{\"o_orderkey\":' || o_orderkey || '}}' as entity_key, '{{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_totalprice\":' || o_totalprice || '}}' as content, timestamp '2024-01-01' as at from {_DIFF}")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    return C.audit_rows(C.diff(old, new, ["o_orderkey"]), ["o_orderkey"], at)


@case("select o_orderkey, o_orderkey % 3 as __seen, o_orderkey % 4 as __version from orders where o_orderkey % 3 <> o_orderkey % 4 and o_orderkey % 2 = 0")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    stored = rows.withColumn("__version", F.col("o_orderkey") % 4)
    updates = rows.withColumn("__version", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3))
    return C.conflicts(stored, updates, ["o_orderkey"])


@case("select event_id from events where event_type = 'purchase' and value > 20")
def live_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("_op", F.lit("update"))
    return live.relevant(batch, (F.col("event_type") == "purchase") & (F.col("value") > 20)).select("event_id")


@case("select event_id from events where event_type = 'purchase' and event_id % 6 = 0")
def live_leave_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    delivered = rows.where("event_type = 'purchase'").select("event_id")
    batch = rows.where("event_id % 6 = 0").withColumns({"event_type": F.lit("view"), "_op": F.lit("update")})
    return live.leaving(batch, delivered, ["event_id"], F.col("event_type") == "purchase").select("event_id")


# -- plans -----------------------------------------------------------------------------------------------------------


@case("select o_orderkey as id, o_totalprice from orders where o_orderstatus is distinct from 'P' and o_orderpriority in ('1-URGENT', '5-LOW') and o_totalprice > 1000 and o_custkey < 1000 order by o_totalprice desc, o_orderkey limit 30")
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    orders = q(spark, sf_dir, "orders")
    asked = orders.where((field("o_orderstatus") != "P") & field("o_orderpriority").is_in(param("which")) & (field("o_totalprice") > 1000), {"which": ["1-URGENT", "5-LOW"]})
    plan = json.loads(json.dumps(wire.encode("orders", asked.sort_descending("o_totalprice").take(30).map("o_totalprice", id="o_orderkey"))))
    found, error = wire.handle(plan, {"orders": orders}, scope=lambda _: field("o_custkey") < 1000)
    assert error is None, error
    return found


@case("select o_orderkey from orders where o_totalprice > 100000 and o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 5 offset 2")
def composer(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Composer().where(field("o_totalprice") > 100000).sort("o_orderdate").skip(2).take(5)
    return q(spark, sf_dir, "orders").where(field("o_orderstatus") == "O").apply(page).map("o_orderkey").to_df()


# -- schemas, sources and views over whole tables ----------------------------------------------------------------------

def _orders() -> S.Schema:
    return S.define(
        "orders",
        o_orderkey=S.number("long").key(),
        status=S.string().stored_as("o_orderstatus"),
        o_totalprice=S.number(),
        o_orderpriority=S.string().serialize(lambda c: F.lower(c)).deserialize(lambda c: F.upper(c)),
        cents=S.computed("long", lambda c: F.round(c["o_totalprice"] * 100)),
    )


@case("select o_orderkey, o_orderstatus as status, o_totalprice, upper(o_orderpriority) as o_orderpriority, cast(round(o_totalprice * 100) as bigint) as cents from orders")
def schema_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.FileSource(spark, sf_dir).read(_orders())


@case("select o_orderkey, o_orderstatus, o_totalprice, lower(o_orderpriority) as o_orderpriority from orders")
def schema_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders().write(tables.MemorySource(spark, orders=spark.read.parquet(f"{sf_dir}/orders.parquet")).read(_orders()))


@case("select o_orderstatus as status, o_totalprice, upper(o_orderpriority) as o_orderpriority from orders")
def schema_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders().strip(schema_file_read(spark, sf_dir))


@case("select o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'N' else o_orderstatus end as status, o_totalprice from orders")
def update_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema_file_read(spark, sf_dir)
    k = F.col("o_orderkey") % 5
    changed = rows.where(k < 2).select("o_orderkey", F.when(k == 1, "N").alias("status"))
    return _orders().merge(rows, changed).select("o_orderkey", "status", "o_totalprice")


@case("select o_orderkey, o_orderkey % 2 = 0 as same from orders")
def schema_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema_file_read(spark, sf_dir)
    other = rows.withColumn("status", F.when(F.col("o_orderkey") % 2 == 0, F.col("status")).otherwise(F.concat("status", F.lit("!"))))
    pairs = rows.select("o_orderkey", _orders().hash().alias("h"), _orders().content().alias("a")).join(other.select("o_orderkey", _orders().hash().alias("g"), _orders().content().alias("b")), "o_orderkey")
    return pairs.select("o_orderkey", (F.col("a").eqNullSafe(F.col("b")) & (F.col("h") == F.col("g"))).alias("same"))


@case("select count(*) as n, count(distinct number) as numbers, min(number) as first, max(number) as last, sum(case when state = 'new' then 1 else 0 end) as defaulted from (select row_number() over () + 100 as number, case when c_custkey % 2 = 0 then 'new' else 'old' end as state from customer)")
def schema_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that the store gives, and defaults; which row gets which number is open."""
    made = S.define("customers", number=S.number("long").key().identity(), name=S.string(), state=S.string().default("new"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 1, "old").alias("state"))
    found = made.enrich(rows, 100)
    return found.agg(F.count("*").alias("n"), F.count_distinct("number").alias("numbers"), F.min("number").alias("first"), F.max("number").alias("last"), F.sum((F.col("state") == "new").cast("int")).alias("defaulted"))


@case("select problem, rows from (select 'name is too long' as problem, count(*) as rows from customer where length(c_name) > 17 union all select 'segment has an unknown value', count(*) from customer where c_mktsegment not in ('BUILDING', 'MACHINERY') union all select 'nation is not unique', count(*) from (select c_nationkey from customer group by 1 having count(*) > 1)) where rows > 0")
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = S.define("customer", id=S.number("long").key(), name=S.string(max_length=17), segment=S.string("BUILDING", "MACHINERY"), nation=S.number("int").distinct())
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return rules.problems(rows)


@case("select c_custkey from customer")
def filter_tautology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir, "customer").where(TRUE).map("c_custkey").to_df()


@case("select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal >= 100")
def filter_dynamic_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties named at run time, through the JSON form of a plan."""
    wanted = {"c_mktsegment": "BUILDING"}
    tests = [field(name) == value for name, value in wanted.items()]
    kept = from_json(to_json(tests[0] & (field("c_acctbal") >= 100)))
    return q(spark, sf_dir, "customer").where(kept).map("c_custkey").to_df()


@case("select term, field, source_id, count(*) as frequency from (select doc_id as source_id, 'source' as field, unnest([source, 'x-' || source]) as term from documents) group by all")
def search_custom_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tokenizer(custom=lambda s: [s, "x-" + s])
    return X.build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", ["source"], t)


@case("select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey")
def view_mirror_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several derived rows of a key the last one is kept; here the derivation goes by order key."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey").orderBy("o_orderkey")
    return C.mirror(rows.limit(0), rows, ["o_custkey"]).drop("_op")


@case("select 'filter' as kind, 'scan' as place union all select 'sort', 'engine' union all select 'take', 'engine'")
def explain_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = q(spark, sf_dir, "orders").where(field("o_orderstatus") == "F").sort("o_totalprice").take(3).explain()[1]
    return spark.createDataFrame([(kind, place) for kind, place, _ in told.steps], "kind string, place string")

"""The queries of the relational operators, each beside its DuckDB SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from .. import operators as O
from .. import service, sources
from ..session import shared_folder
from ..streaming import read_folder, windowed

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, build: Query, sql: str | None) -> None:
    _QUERIES[name] = build
    if sql is not None:
        _SQL[name] = sql


def _on(table: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: build(sources.parquet(spark, f"{d}/{table}.parquet"))


def _two(left: str, right: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: build(sources.parquet(spark, f"{d}/{left}.parquet"), sources.parquet(spark, f"{d}/{right}.parquet"))


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


c, lit = F.col, F.lit


def _ranked(df: DataFrame, columns: list, shown: list[str], **orders: list) -> DataFrame:
    """Columns of a table with a place in each of the given orders, in the last of them."""
    df = df.select(*columns)
    for name, keys in orders.items():
        df = O.ranked(df, name, *keys)
    return df.select(*shown, *orders)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per market segment: scan, filter, join, group, having, top-k."""
    customer = sources.parquet(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_mktsegment"])
    orders = O.where(sources.parquet(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"]), c("o_totalprice") > 1000.0)
    joined = O.join(orders, customer, O.JoinClause(("o_custkey",), ("c_custkey",)))
    grouped = O.group_by(joined, [c("c_mktsegment").alias("segment")], O.Agg("sum", "o_totalprice", "revenue"), O.Agg("count", "o_orderkey", "n_orders"))
    top = O.top_k(O.having(grouped, c("n_orders") > 1), 3, O.sort_key("revenue"), O.sort_key("segment", asc=True))
    return top.withColumn("revenue", F.round("revenue", 2))


_add(
    "segment_revenue",
    flagship,
    """SELECT segment, round(revenue, 2) revenue, n_orders FROM (SELECT c_mktsegment segment, sum(o_totalprice::double) revenue, count(o_orderkey)::double n_orders
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(o_orderkey) > 1 ORDER BY 2 DESC, 1 LIMIT 3)""",
)

# Sources


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scratch-{os.getpid()}-{uuid.uuid4().hex}"


def _csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    nation = sources.parquet(spark, f"{d}/nation.parquet", ["n_nationkey", "n_name", "n_regionkey"])
    return sources.csv(spark, sources.write(nation, _scratch(spark), "csv"))


def _json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    region = sources.parquet(spark, f"{d}/region.parquet", ["r_regionkey", "r_name"])
    return sources.json(spark, sources.write(region, _scratch(spark), "json")).select(c("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")


def _parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    region = sources.parquet(spark, f"{d}/region.parquet", ["r_name", "r_regionkey"])
    return sources.open_source(spark, sources.write(region, _scratch(spark)), "parquet").select(c("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")


_add("scan_pruned", lambda spark, d: sources.parquet(spark, f"{d}/region.parquet", ["r_regionkey", "r_name"]), "SELECT r_regionkey, r_name FROM region")
_add("scan_full", _on("supplier", lambda df: df), "SELECT * FROM supplier")
_add("scan_csv_roundtrip", _csv_round_trip, "SELECT n_nationkey::bigint n_nationkey, n_name, n_regionkey::bigint n_regionkey FROM nation")
_add("scan_json_roundtrip", _json_round_trip, "SELECT r_regionkey::bigint r_regionkey, r_name FROM region")
_add("sink_parquet_roundtrip", _parquet_round_trip, "SELECT r_regionkey::bigint r_regionkey, r_name FROM region")
_add("scan_memory", lambda spark, d: sources.memory(spark, ["id", "name"], [[1, 2, 3], ["a", None, "c"]]), "SELECT id::bigint id, name FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) t(id, name)")



def _text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    sources.parquet(spark, f"{d}/nation.parquet", ["n_name"]).write.text(path := _scratch(spark))
    return sources.open_source(spark, path, "text/plain")


_TYPED = {"i8": pa.array([1, None, -3], pa.int8()), "u16": pa.array([1, None, 65535], pa.uint16()), "i32": pa.array([4, None, 6], pa.int32()), "f32": pa.array([1.5, None, -2.25], pa.float32()), "ok": pa.array([True, None, False]), "name": pa.array(["a", None, ""])}
_add("scan_text", _text_round_trip, "SELECT n_name AS value FROM nation")
_add("scan_memory_typed", lambda spark, d: sources.memory(spark, [*_TYPED], [*_TYPED.values()]), "SELECT i8::tinyint i8, u16::int u16, i32::int i32, f32::float f32, ok, name FROM (VALUES (1, 1, 4, 1.5, true, 'a'), (NULL, NULL, NULL, NULL, NULL, NULL), (-3, 65535, 6, -2.25, false, '')) t(i8, u16, i32, f32, ok, name)")

# Streams


def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and kind, counted by a stream that reads what is there and ends."""
    schema = sources.parquet(spark, f"{d}/events.parquet").schema
    totals = windowed(read_folder(spark, f"{d}/events.parque[t]", schema).withColumn("ts", c("ts").cast("timestamp")), "ts", "1 hour", "1 day", ["event_type"], O.Agg("count", "*", "n"))
    out = _scratch(spark)
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    totals.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", _scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", c("n").cast("bigint").alias("n"))


_add("stream_windows", _stream_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")

# Projection and expressions

_LITERALS = {"int8": 7, "int16": -8, "int32": 9, "int64": 1 << 40, "uint8": 200, "uint16": 60000, "uint32": 4000000000, "float32": 1.5, "float64": -2.25, "bool": True, "string": "it's", "large_utf8": ""}
_LITERAL_SQL = "7::tinyint int8, -8::smallint int16, 9::int int32, 1099511627776::bigint int64, 200::smallint uint8, 60000::int uint16, 4000000000::bigint uint32, 1.5::float float32, -2.25::double float64, true \"bool\", 'it''s' \"string\", '' large_utf8"
_add("project_literals", _on("region", lambda df: O.project(df, "r_regionkey", *(X.typed_literal(v, k).alias(k) for k, v in _LITERALS.items()))), f"SELECT r_regionkey, {_LITERAL_SQL} FROM region")
_add("project_empty", _on("nation", lambda df: O.project(O.where(df, c("n_nationkey") < 0), "n_name", (c("n_nationkey") + lit(1)).alias("next"))), "SELECT n_name, n_nationkey + 1 AS next FROM nation WHERE n_nationkey < 0")
_add("sort_boolean", _on("customer", lambda df: _ranked(df, ["c_custkey", (c("c_acctbal") > 0).alias("ok")], ["c_custkey", "ok"], rk=[O.sort_key("ok"), c("c_custkey")])), "SELECT c_custkey, c_acctbal > 0 ok, row_number() OVER (ORDER BY c_acctbal > 0 DESC, c_custkey) rk FROM customer")
_add("sort_text", _on("customer", lambda df: _ranked(df, ["c_name"], ["c_name"], rk=[O.sort_key("c_name")])), "SELECT c_name, row_number() OVER (ORDER BY c_name DESC) rk FROM customer")

_add("project_alias_literal", _on("nation", lambda df: O.project(df, c("n_name").alias("nm"), X.typed_literal(1, "int64").alias("one"))), "SELECT n_name nm, 1::bigint one FROM nation")
_add("project_autoname", _on("part", lambda df: O.project(df, "p_partkey", "p_name", c("p_retailprice") * lit(2.0))), "SELECT p_partkey, p_name, p_retailprice * 2.0::double AS col_2 FROM part")
_add("project_prune", _on("customer", lambda df: O.prune(df, "c_name", "c_custkey")), "SELECT c_name, c_custkey FROM customer")
_add(
    "arith_add_sub_mul_div",
    _on("lineitem", lambda df: O.project(df, "l_orderkey", "l_linenumber", X.arithmetic(df, c("l_extendedprice"), "*", lit(1.0) - c("l_discount")).alias("net"), X.arithmetic(df, c("l_extendedprice"), "+", c("l_tax")).alias("plus"), X.arithmetic(df, c("l_extendedprice"), "/", c("l_quantity")).alias("each"))),
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1::double - l_discount) net, l_extendedprice + l_tax plus, l_extendedprice / l_quantity each FROM lineitem",
)
_add("arith_int_div", _on("part", lambda df: O.project(df, "p_partkey", X.int_div(c("p_size"), lit(3)).alias("third"), X.int_div(-c("p_size"), lit(3)).alias("minus"))), "SELECT p_partkey, (p_size // 3)::bigint third, (-p_size // 3)::bigint minus FROM part")
_add("nested_expr", _on("lineitem", lambda df: O.project(df, "l_orderkey", "l_linenumber", (c("l_quantity") - (lit(5.0) + lit(4.0))).alias("less"))), "SELECT l_orderkey, l_linenumber, l_quantity - (5::double + 4::double) less FROM lineitem")
_add("cast_widen", _on("part", lambda df: O.project(df, "p_partkey", X.safe_cast(df, c("p_size"), "float64").alias("size"))), "SELECT p_partkey, p_size::double size FROM part")
_add("cast_string_int", _on("part", lambda df: O.project(df, "p_partkey", X.safe_cast(df, F.concat(lit("4"), c("p_size").cast("string")), "int64").alias("n"))), "SELECT p_partkey, ('4' || p_size)::bigint n FROM part")
_add("cast_float_int", _on("part", lambda df: O.project(df, "p_partkey", X.safe_cast(df, F.floor("p_retailprice").cast("double"), "int64").alias("n"))), "SELECT p_partkey, floor(p_retailprice)::bigint n FROM part")
_add("upper_lower", _on("part", lambda df: O.project(df, "p_partkey", X.upper(df, c("p_name")).alias("up"), X.lower(df, c("p_brand")).alias("low"))), "SELECT p_partkey, upper(p_name) up, lower(p_brand) low FROM part")
_add("abs_round", _on("customer", lambda df: O.project(df, "c_custkey", X.rounded(df, X.absolute(df, c("c_acctbal") - 5000.0)).alias("r"))), "SELECT c_custkey, round_even(abs(c_acctbal - 5000::double), 0) r FROM customer")
_add(
    "text_functions",
    _on("customer", lambda df: O.project(df, "c_custkey", X.concat(c("c_name"), lit("-"), c("c_mktsegment")).alias("joined"), X.substring(c("c_name"), 1, 4).alias("head"), X.length(c("c_name")).cast("bigint").alias("size"), X.negate(c("c_acctbal")).alias("minus"), X.coalesce(F.nullif(c("c_mktsegment"), lit("BUILDING")), lit("none")).alias("seg"))),
    "SELECT c_custkey, c_name || '-' || c_mktsegment joined, substring(c_name, 1, 4) head, length(c_name)::bigint AS size, -c_acctbal minus, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') seg FROM customer",
)

# Filter, limit, distinct

for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _add(f"filter_{_name}", _on("part", lambda df, op=_op: O.where(df, X.compare(df, c("p_size"), op, lit(25))).select("p_partkey", "p_size")), f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25")
_add("filter_and", _on("part", lambda df: O.where(df, (c("p_size") > 10) & (c("p_retailprice") < 1500.0)).select("p_partkey")), "SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 1500")
_add("filter_or", _on("customer", lambda df: O.where(df, (c("c_acctbal") < 0) | (c("c_mktsegment") == "BUILDING")).select("c_custkey")), "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
_add("filter_or_null", _on("part", lambda df: O.where(df, (F.nullif(c("p_size"), lit(1)) > 10) | (c("p_size") == 1)).select("p_partkey")), "SELECT p_partkey FROM part WHERE nullif(p_size, 1) > 10 OR p_size = 1")
_add("filter_strict_or", _on("part", lambda df: O.where(df, X.strict_or(F.nullif(c("p_size"), lit(1)) > 10, c("p_size") < 5)).select("p_partkey")), "SELECT p_partkey FROM part WHERE nullif(p_size, 1) IS NOT NULL AND (p_size > 10 OR p_size < 5)")
_add("filter_strict_and", _on("part", lambda df: O.project(df, "p_partkey", X.strict_and(F.nullif(c("p_size"), lit(1)) > 10, c("p_size") < 5).alias("both"))), "SELECT p_partkey, CASE WHEN nullif(p_size, 1) IS NULL THEN NULL ELSE p_size > 10 AND p_size < 5 END AS both FROM part".replace("AS both", 'AS "both"'))
_add("filter_not_null", _on("part", lambda df: O.where(df, X.is_valid(F.nullif(c("p_size"), lit(1)))).select("p_partkey")), "SELECT p_partkey FROM part WHERE nullif(p_size, 1) IS NOT NULL")
_add("filter_is_null", _on("part", lambda df: O.where(df, X.is_valid(F.nullif(c("p_size"), lit(1))) == lit(False)).select("p_partkey")), "SELECT p_partkey FROM part WHERE nullif(p_size, 1) IS NULL")
_add("filter_bool_column", _on("part", lambda df: O.where(O.project(df, "p_partkey", (c("p_size") > 25).alias("large")), c("large"))), "SELECT p_partkey, true AS large FROM part WHERE p_size > 25")
_add("filter_arithmetic", _on("lineitem", lambda df: O.where(df, c("l_quantity") + c("l_discount") > c("l_tax") + 30.0).select("l_orderkey", "l_linenumber")), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + l_discount > l_tax + 30")
for _name, _table, _key, _column, _pattern in (
    ("prefix", "part", "p_partkey", "p_name", "b%"),
    ("suffix", "customer", "c_custkey", "c_name", "%7"),
    ("contains", "part", "p_partkey", "p_name", "%e%"),
    ("underscore", "part", "p_partkey", "p_brand", "Brand#_2"),
    ("mixed", "customer", "c_custkey", "c_name", "C%_1_"),
    ("all", "part", "p_partkey", "p_name", "%"),
):
    _add(f"like_{_name}", _on(_table, lambda df, k=_key, n=_column, p=_pattern: O.where(df, X.like(c(n), p)).select(k, n)), f"SELECT {_key}, {_column} FROM {_table} WHERE {_column} LIKE '{_pattern}'")
for _name, _n in (("ordered", 17), ("zero", 0), ("over", 10_000_000)):
    _add(f"limit_{_name}", _on("customer", lambda df, n=_n: O.limit(O.sort(df, O.sort_key("c_custkey", asc=True)), n).select("c_custkey", "c_name")), f"SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT {_n}")
_add("distinct_one", _on("customer", lambda df: O.distinct(df, "c_mktsegment")), "SELECT DISTINCT c_mktsegment FROM customer")
_add("distinct_two", _on("lineitem", lambda df: O.distinct(df, "l_returnflag", "l_linestatus")), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add("distinct_on_first", _on("orders", lambda df: O.distinct_on(df.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [c("o_totalprice").desc(), c("o_orderkey")])), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
_add("distinct_on_expr", _on("orders", lambda df: O.distinct_on(df.select("o_orderkey", "o_custkey"), [c("o_custkey") % 7], [c("o_orderkey")])), "SELECT DISTINCT ON (o_custkey % 7) o_orderkey, o_custkey FROM orders ORDER BY o_custkey % 7, o_orderkey")

# Sort and top-k: the rank is a column, so that a comparison without order still sees it

_add("sort_asc", _on("customer", lambda df: _ranked(df, ["c_custkey", "c_acctbal"], ["c_custkey"], rk=[O.sort_key("c_acctbal", asc=True), c("c_custkey")])), "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal ASC NULLS FIRST, c_custkey) rk FROM customer")
_add("sort_desc", _on("customer", lambda df: _ranked(df, ["c_custkey", "c_acctbal"], ["c_custkey"], rk=[O.sort_key("c_acctbal"), c("c_custkey")])), "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) rk FROM customer")
_add("sort_multi", _on("customer", lambda df: _ranked(df, ["c_custkey", "c_mktsegment", "c_name"], ["c_custkey"], rk=[O.sort_key("c_mktsegment"), O.sort_key("c_name", asc=True)])), "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_name ASC) rk FROM customer")
_add("sort_nulls", _on("part", lambda df: _ranked(df, ["p_partkey", F.nullif(c("p_size"), lit(1)).alias("size")], ["p_partkey"], down=[O.sort_key("size"), c("p_partkey")], up=[O.sort_key("size", asc=True), c("p_partkey")], last=[O.sort_key("size", asc=True, nulls_first=False), c("p_partkey")])), "SELECT p_partkey, row_number() OVER (ORDER BY nullif(p_size, 1) DESC NULLS LAST, p_partkey) down, row_number() OVER (ORDER BY nullif(p_size, 1) ASC NULLS FIRST, p_partkey) up, row_number() OVER (ORDER BY nullif(p_size, 1) ASC NULLS LAST, p_partkey) AS last FROM part")
_add("topk_one", _on("orders", lambda df: O.top_k(df.select("o_orderkey", "o_totalprice"), 10, O.sort_key("o_totalprice"), c("o_orderkey"))), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
_add("topk_multi", _on("lineitem", lambda df: O.top_k(df.select("l_orderkey", "l_linenumber", "l_quantity"), 25, O.sort_key("l_quantity"), O.sort_key("l_orderkey", asc=True), O.sort_key("l_linenumber", asc=True))), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 25")

# Aggregation


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Sums of floating numbers depend on their order: compare them rounded."""
    return df.withColumns({n: F.round(n, 2) for n in names})


for _fn in ("sum", "count", "avg", "min", "max"):
    _add(f"agg_{_fn}", _on("lineitem", lambda df, fn=_fn: _r(O.aggregate(df, O.Agg(fn, "l_quantity", "v")), "v")), f"SELECT round({_fn}(l_quantity)::double, 2) v FROM lineitem")
_add("agg_all", _on("orders", lambda df: _r(O.aggregate(df, *(O.Agg(f, "o_totalprice", f"v_{f}") for f in O.AGGREGATES), O.Agg("count", "*", "n")), "v_sum", "v_avg")), "SELECT round(sum(o_totalprice), 2) v_sum, count(o_totalprice)::double v_count, round(avg(o_totalprice), 2) v_avg, min(o_totalprice)::double v_min, max(o_totalprice)::double v_max, count(*)::double n FROM orders")
_add("agg_empty", _on("orders", lambda df: O.aggregate(df.where("o_orderkey < 0"), O.Agg("sum", "o_totalprice", "s"), O.Agg("avg", "o_totalprice", "a"), O.Agg("count", "o_totalprice", "n"))), "SELECT sum(o_totalprice)::double s, avg(o_totalprice)::double a, count(o_totalprice)::double n FROM orders WHERE o_orderkey < 0")
_add("agg_empty_zero", _on("orders", lambda df: O.aggregate(df.where("o_orderkey < 0"), O.Agg("sum", "o_totalprice", "s"), O.Agg("min", "o_totalprice", "m"), zero_on_empty=True)), "SELECT coalesce(sum(o_totalprice)::double, 0::double) s, coalesce(min(o_totalprice)::double, 0::double) m FROM orders WHERE o_orderkey < 0")
_add("agg_expr", _on("lineitem", lambda df: _r(O.aggregate(df, O.Agg("sum", c("l_extendedprice") * (1 - c("l_discount")), "revenue")), "revenue")), "SELECT round(sum(l_extendedprice * (1 - l_discount))::double, 2) revenue FROM lineitem")
_add("group_string", _on("customer", lambda df: _r(O.group_by(df, [c("c_mktsegment").alias("seg")], O.Agg("sum", "c_acctbal", "s"), O.Agg("count", "c_custkey", "n")), "s")), "SELECT c_mktsegment seg, round(sum(c_acctbal)::double, 2) s, count(c_custkey)::double n FROM customer GROUP BY 1")
_add("group_int", _on("customer", lambda df: O.group_by(df, [c("c_nationkey").alias("k")], O.Agg("max", "c_acctbal", "m"))), "SELECT c_nationkey k, max(c_acctbal)::double m FROM customer GROUP BY 1")
_add("group_multi", _on("lineitem", lambda df: _r(O.group_by(df, [c("l_returnflag").alias("f"), c("l_linestatus").alias("s")], O.Agg("avg", "l_quantity", "q"), O.Agg("count", "*", "n")), "q")), "SELECT l_returnflag f, l_linestatus s, round(avg(l_quantity)::double, 2) q, count(*)::double n FROM lineitem GROUP BY 1, 2")
_add("group_expr", _on("part", lambda df: O.group_by(df, [(c("p_size") % 5).alias("k")], O.Agg("min", "p_retailprice", "m"))), "SELECT p_size % 5 k, min(p_retailprice)::double m FROM part GROUP BY 1")
_add("group_nullkey", _on("part", lambda df: O.group_by(df, [F.nullif(c("p_size"), lit(1)).alias("k")], O.Agg("count", "p_partkey", "n"))), "SELECT nullif(p_size, 1) k, count(p_partkey)::double n FROM part GROUP BY 1")
_add("group_bool", _on("part", lambda df: O.group_by(df, [(c("p_size") > 25).alias("k")], O.Agg("count", "p_partkey", "n"))), "SELECT p_size > 25 k, count(p_partkey)::double n FROM part GROUP BY 1")
_add("group_autoname", _on("customer", lambda df: O.group_by(df, ["c_mktsegment"], O.Agg("max", "c_acctbal"))), 'SELECT c_mktsegment AS "group_Column(c_mktsegment)", max(c_acctbal)::double AS "max_Column(c_acctbal)" FROM customer GROUP BY 1')
for _name, _least in (("some", 20.0), ("none", 1e12), ("all", 0.0)):
    _add(f"having_{_name}", _on("customer", lambda df, n=_least: O.having(O.group_by(df, [c("c_nationkey").alias("k")], O.Agg("count", "c_custkey", "n")), c("n") > n)), f"SELECT c_nationkey k, count(c_custkey)::double n FROM customer GROUP BY 1 HAVING count(c_custkey) > {_least}")

# Joins

_CO = O.JoinClause(("c_custkey",), ("o_custkey",))
_few = lambda o: o.where("o_totalprice > 450000").select("o_orderkey", "o_custkey")
_add("join_inner", _two("customer", "orders", lambda cu, o: O.join(cu.select("c_custkey"), _few(o), _CO)), "SELECT c_custkey, o_orderkey, o_custkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
_add("join_left", _two("customer", "orders", lambda cu, o: O.join(cu.select("c_custkey"), _few(o), _CO, "left")), "SELECT c_custkey, o_orderkey, o_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey")
_add("join_right", _two("orders", "customer", lambda o, cu: O.join(_few(o), cu.select("c_custkey"), O.JoinClause(("o_custkey",), ("c_custkey",)), "right")), "SELECT o_orderkey, o_custkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 450000) RIGHT JOIN customer ON o_custkey = c_custkey")
_add("join_multikey", _two("lineitem", "lineitem", lambda a, b: O.join(a.select("l_orderkey", "l_linenumber", "l_quantity"), b.select(c("l_orderkey").alias("k"), (c("l_linenumber") + 1).alias("line"), c("l_quantity").alias("before")), O.JoinClause(("l_orderkey", "l_linenumber"), ("k", "line")))), "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_orderkey k, b.l_linenumber + 1 line, b.l_quantity AS before FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1")
_add("join_computed", _two("nation", "region", lambda n, r: O.join(n.select("n_name", "n_regionkey"), r.select("r_name", "r_regionkey"), O.JoinClause((F.lower(F.substring("n_name", 1, 1)),), (F.lower(F.substring("r_name", 1, 1)),)))), "SELECT n_name, n_regionkey, r_name, r_regionkey FROM nation JOIN region ON lower(substring(n_name, 1, 1)) = lower(substring(r_name, 1, 1))")
_add("join_nullkey", _two("nation", "region", lambda n, r: O.join(n.select("n_name", F.nullif(c("n_regionkey"), lit(1)).alias("k")), r.select("r_name", F.nullif(c("r_regionkey"), lit(1)).alias("rk")), O.JoinClause(("k",), ("rk",)), "left")), "SELECT n_name, nullif(n_regionkey, 1) k, r_name, rk FROM nation LEFT JOIN (SELECT r_name, nullif(r_regionkey, 1) rk FROM region) ON nullif(n_regionkey, 1) = rk")
_add("join_many", _two("supplier", "customer", lambda s, cu: O.join_count(s.select("s_nationkey"), cu.select("c_nationkey"), O.JoinClause(("s_nationkey",), ("c_nationkey",)), [c("s_nationkey").alias("k")], "n")), "SELECT s_nationkey k, count(*)::double n FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1")
_add("join_dup_names", _two("nation", "nation", lambda a, b: O.join(a.select("n_name", "n_regionkey"), b.select("n_name", "n_regionkey"), O.JoinClause(("n_regionkey",), ("n_regionkey",)))), "SELECT a.n_name left_n_name, a.n_regionkey left_n_regionkey, b.n_name right_n_name, b.n_regionkey right_n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_add("join_residual", _two("customer", "orders", lambda cu, o: O.join(cu.select("c_custkey", "c_acctbal"), o.select("o_orderkey", "o_custkey", "o_totalprice"), _CO, "left", residual=lambda l, r: r("o_totalprice") > l("c_acctbal") * 40)), "SELECT c_custkey, c_acctbal, o_orderkey, o_custkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 40")

# Composed pipelines

_add("pipe_1a", _on("customer", lambda df: O.limit(O.sort(O.project(O.where(df, c("c_acctbal") > 3000.0), "c_custkey", "c_name", "c_acctbal"), c("c_custkey")), 10)), "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 3000 ORDER BY c_custkey LIMIT 10")
_add("pipe_1b", _on("customer", lambda df: O.limit(O.sort(O.project(O.where(df, (c("c_nationkey") > 5) & (c("c_acctbal") < 2500.0)), "c_name", "c_acctbal"), c("c_name")), 3)), "SELECT c_name, c_acctbal FROM customer WHERE c_nationkey > 5 AND c_acctbal < 2500 ORDER BY c_name LIMIT 3")
_add("pipe_1c", _on("customer", lambda df: O.limit(O.sort(O.project(O.where(df, c("c_mktsegment") == "BUILDING"), "c_custkey", "c_mktsegment"), c("c_custkey")), 7)), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 7")
_add("pipe_2a", _on("customer", lambda df: O.project(O.where(df, F.upper("c_mktsegment") == "BUILDING"), "c_custkey", "c_name", F.lower("c_mktsegment"))), "SELECT c_custkey, c_name, lower(c_mktsegment) col_2 FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")
_add("pipe_2b", _on("customer", lambda df: O.project(O.where(df, F.upper("c_name") == "ALICE"), "c_name", F.lower("c_mktsegment"))), "SELECT c_name, lower(c_mktsegment) col_1 FROM customer WHERE upper(c_name) = 'ALICE'")
_add("pipe_3a", _on("customer", lambda df: O.sort(O.project(df, "c_name", "c_acctbal"), O.sort_key("c_acctbal", asc=True), c("c_name"))), "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_name")
_add("pipe_3b", _on("customer", lambda df: O.sort(O.project(df, "c_name", "c_mktsegment"), O.sort_key("c_mktsegment", asc=True), c("c_name"))), "SELECT c_name, c_mktsegment FROM customer ORDER BY c_mktsegment, c_name")
_add("pipe_4a", _two("orders", "customer", lambda o, cu: O.project(O.join(o, cu, O.JoinClause(("o_custkey",), ("c_custkey",))), "o_orderkey", "c_name", "o_totalprice")), "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
_add("pipe_4b", _two("supplier", "nation", lambda s, n: O.project(O.join(s, n, O.JoinClause(("s_nationkey",), ("n_nationkey",))), "s_name", "n_name")), "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_add("pipe_5a", _on("customer", lambda df: O.sort(_r(O.group_by(df, [c("c_mktsegment").alias("seg")], O.Agg("avg", "c_nationkey", "a"), O.Agg("sum", "c_acctbal", "s")), "a", "s"), c("a"))), "SELECT c_mktsegment seg, round(avg(c_nationkey)::double, 2) a, round(sum(c_acctbal)::double, 2) s FROM customer GROUP BY 1")
_add("pipe_5b", _on("customer", lambda df: _r(O.group_by(O.project(df, (c("c_acctbal") > 0).alias("active"), "c_nationkey"), [c("active").alias("k")], O.Agg("count", "*", "n"), O.Agg("avg", "c_nationkey", "a")), "a")), "SELECT c_acctbal > 0 k, count(*)::double n, round(avg(c_nationkey)::double, 2) a FROM customer GROUP BY 1")
_add("pipe_6a", _on("customer", lambda df: O.sort(O.distinct(df, "c_mktsegment"), O.sort_key("c_mktsegment"))), "SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 DESC")
_add("pipe_6b", _on("customer", lambda df: O.sort(O.distinct(df, (c("c_acctbal") > 0).alias("active")), O.sort_key("active"))), "SELECT DISTINCT c_acctbal > 0 active FROM customer ORDER BY 1 DESC")
_OC = O.JoinClause(("o_custkey",), ("c_custkey",))
_add("pipe_7a", _two("orders", "customer", lambda o, cu: O.limit(O.sort(O.project(O.where(O.join(o, cu, _OC), c("o_totalprice") > 100000.0), "o_orderkey", "c_name"), c("o_orderkey")), 10)), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 10")
_add("pipe_7b", _two("orders", "customer", lambda o, cu: O.limit(O.sort(O.project(O.where(O.join(o, cu, _OC), c("c_mktsegment") == "BUILDING"), "o_orderkey", "c_mktsegment"), c("o_orderkey")), 5)), "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderkey LIMIT 5")
_add("pipe_7c", _two("orders", "customer", lambda o, cu: O.limit(O.sort(O.project(O.where(O.join(o, cu, _OC), (c("c_acctbal") < 0) & (c("o_totalprice") < 90000.0)), "o_orderkey", "c_acctbal"), c("o_orderkey")), 8)), "SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 AND o_totalprice < 90000 ORDER BY o_orderkey LIMIT 8")
_add("pipe_8a", _on("customer", lambda df: O.project(O.where(df, F.abs("c_acctbal") > 5.0), "c_custkey", X.round_half_even(F.abs("c_acctbal")).alias("r"))), "SELECT c_custkey, round_even(abs(c_acctbal), 0) r FROM customer WHERE abs(c_acctbal) > 5")
_add("pipe_8b", _on("customer", lambda df: O.project(O.where(df, F.abs("c_acctbal") > 5000.0), "c_custkey", X.round_half_even(c("c_acctbal")).alias("r"))), "SELECT c_custkey, round_even(c_acctbal, 0) r FROM customer WHERE abs(c_acctbal) > 5000")
_add("pipe_9a", _on("customer", lambda df: _ranked(df, ["c_name", "c_acctbal"], ["c_name"], rk=[O.sort_key("c_acctbal"), O.sort_key("c_name", asc=True)])), "SELECT c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_name) rk FROM customer")
_add("pipe_9b", _on("customer", lambda df: _ranked(df, ["c_name", "c_nationkey"], ["c_name"], rk=[O.sort_key("c_nationkey", asc=True), O.sort_key("c_name")])), "SELECT c_name, row_number() OVER (ORDER BY c_nationkey, c_name DESC) rk FROM customer")
_add("pipe_10", _on("customer", lambda df: O.where(df, c("c_acctbal") > 2500.0)), "SELECT * FROM customer WHERE c_acctbal > 2500")
_add("sql_entry", lambda spark, d: service.run_query(spark, "SELECT c_mktsegment, count(*) AS n FROM data WHERE c_acctbal > 0 GROUP BY c_mktsegment", uri=f"{d}/customer.parquet")["result"], "SELECT c_mktsegment, count(*)::bigint n FROM customer WHERE c_acctbal > 0 GROUP BY 1")

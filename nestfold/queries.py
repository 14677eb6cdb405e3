"""Queries over the driver tables, one for each operator, with the same query in DuckDB SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestfold import session
from nestfold.functions import arrays, dates, objects, registry, scalar, variants, vectors
from nestfold.operators import aggregates, joins, sets, temporal, windows
from nestfold.plans import lineage, querypack
from nestfold.sources import catalog, extract, readers, search
from nestfold.streaming import cursors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of (t), where t(name) is a table."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def same(name: str, sql: str, duck: str | None = None) -> None:
    """Register SQL that reads {table}; `duck` where DuckDB spells it differently."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[name] = run
    ORACLE[name] = duck or re.sub(r"\{(\w+)\}", r"\1", sql)


# --- scans, filters, projections -------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filter_project(t):
    return t("lineitem").filter((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


same("scan_records", "SELECT * FROM {nation}")
same("scan_primary_keys", "SELECT o_orderkey FROM {orders}")
same("scan_use_keys", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey IN (1, 2, 3, 7, 32, 99)")
same("scan_index_range", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= 1000 AND o_totalprice < 20000")
same("scan_index_cover", "SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_custkey BETWEEN 10 AND 60 GROUP BY o_custkey")
same("scan_union_of_indexes", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' OR o_custkey = 7")
same("scan_intersect_of_indexes", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
same("scan_distinct", "SELECT DISTINCT o_orderpriority FROM {orders}")
same("scan_count", "SELECT count(*) AS n FROM {lineitem}")
same("scan_dummy", "SELECT 1 + 1 AS two, 'x' AS x")
same("scan_false", "SELECT o_orderkey FROM {orders} WHERE 1 = 0")
same("scan_expr_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
same("filter_like_prefix", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 'a%' OR p_type LIKE '%BRASS%'")
same("filter_like_escape", r"SELECT count(*) AS n FROM {part} WHERE p_name NOT LIKE '%!%%' ESCAPE '!'")
same("filter_between_in", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
same("project_star_exclude", "SELECT * EXCEPT (c_acctbal, c_mktsegment) FROM {customer}", "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
same("project_raw", "SELECT n_name AS raw FROM {nation}")
same("project_let", "SELECT l_orderkey, l_linenumber, gross * (1 + l_tax) AS charge FROM (SELECT *, l_extendedprice * (1 - l_discount) AS gross FROM {lineitem})")
same("with_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
same("with_recursive", "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 50) SELECT k FROM n")
same("subquery_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
same("subquery_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice >= (SELECT max(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
same("subquery_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')")
same("subquery_exists", "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity = 50)")
same("subquery_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def parameters(t):
    df = t("orders")
    return df.sparkSession.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_totalprice > :least AND o_orderstatus = :status", {"least": 150000, "status": "O"}, o=df)


@query("WITH RECURSIVE up AS (SELECT 1 AS n UNION SELECT (n * 7) % 41 FROM up) SELECT n FROM up")
def recursive_union_distinct(t):
    spark = t("region").sparkSession
    return sets.recursive(spark.range(1, 2).select(F.col("id").cast("int").alias("n")), lambda level: level.select(((F.col("n") * 7) % 41).cast("int").alias("n")))


# --- joins -------------------------------------------------------------------------------------------

same("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
same("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 200000")
same("join_right", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey")
same("join_full", "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
same("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
same("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same("join_band", "SELECT l_orderkey, l_linenumber, o_orderkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 5")
same("join_left_band", "SELECT o_orderkey, l_linenumber FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey AND l_quantity > 48")
same("join_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
same("join_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
same("join_merge_hint", "SELECT /*+ MERGE(o) */ l_orderkey, l_linenumber, o_orderdate FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey")


@query("SELECT c_custkey, x.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x")
def join_lateral(t):
    order = [F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")]
    return joins.lateral(t("customer"), t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), [("c_custkey", "o_custkey")], order).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, x.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice, o_orderkey LIMIT 1) x ON true")
def join_lateral_left(t):
    order = [F.asc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")]
    return joins.lateral(t("customer"), t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), [("c_custkey", "o_custkey")], order, how="left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice / 100 BETWEEN p_retailprice AND p_retailprice + 5")
def join_range(t):
    o = t("orders").withColumn("at", F.col("o_totalprice") / 100)
    p = t("part").withColumn("top", F.col("p_retailprice") + 5)
    return joins.range_join(o, p, "at", "p_retailprice", "top", 50.0).select("o_orderkey", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(t):
    s = t("supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return joins.salted_join(t("lineitem"), s, "l_suppkey", 4).select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT r_regionkey, list_aggregate(list_sort(list(n_nationkey)), 'string_agg', ',') AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def nest_inner(t):
    n = joins.nest(t("region"), t("nation").select("n_nationkey", "n_regionkey"), [("r_regionkey", "n_regionkey")], "ns", order=["n_nationkey"])
    return n.select("r_regionkey", F.array_join(F.transform("ns", lambda e: e["n_nationkey"].cast("string")), ",").alias("nations"))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def nest_left(t):
    n = joins.nest(t("customer"), t("orders").select("o_orderkey", "o_custkey"), [("c_custkey", "o_custkey")], "os", how="left")
    return n.select("c_custkey", F.size("os").cast("long").alias("n"), F.aggregate("os", F.lit(0).cast("long"), lambda a, e: a + e["o_orderkey"]).alias("keys"))


_KEYS = "list_filter([o_custkey, o_custkey + 1], lambda x: x % 2 = 0)"


@query(f"SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, unnest({_KEYS}) AS k FROM orders) JOIN customer ON c_custkey = k")
def join_on_keys(t):
    keys = F.filter(F.array(F.col("o_custkey"), F.col("o_custkey") + 1), lambda x: x % 2 == 0)
    return joins.join_on_keys(t("orders"), keys, t("customer"), "c_custkey").select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' THEN [o_custkey] ELSE [NULL] END) AS k FROM orders) LEFT JOIN customer ON c_custkey = k")
def join_on_keys_left(t):
    keys = F.when(F.col("o_orderstatus") == "F", F.array("o_custkey"))
    return joins.join_on_keys(t("orders"), keys, t("customer"), "c_custkey", "left").select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey DESC) AS found FROM (SELECT o_orderkey, unnest([o_custkey + 1, o_custkey]) AS k FROM orders) JOIN customer ON c_custkey = k GROUP BY o_orderkey")
def nest_on_keys(t):
    n = joins.nest_on_keys(t("orders"), F.array(F.col("o_custkey") + 1, F.col("o_custkey")), t("customer").select("c_custkey"), "c_custkey", "cs", "o_orderkey")
    return n.select("o_orderkey", F.array_join(F.transform("cs", lambda e: e["c_custkey"].cast("string")), ",").alias("found"))


@query("SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations")
def unnest_inner(t):
    return joins.unnest(t("conversations"), F.split("text", " "), "word").select("conv_id", "turn", "word")


@query("SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN [1, 2] ELSE [NULL] END)::INT AS x FROM part")
def unnest_left(t):
    return joins.unnest(t("part"), F.when(F.col("p_size") > 25, F.array(F.lit(1), F.lit(2))), "x", "left").select("p_partkey", "x")


def _events(t) -> DataFrame:
    return t("events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


_PURCHASE = "(SELECT * FROM events WHERE event_type = 'purchase')"
_CLICK = "(SELECT event_id AS click_id, ts AS cts, user_id AS cuser FROM events WHERE event_type = 'click')"


def _asof(t, **options) -> DataFrame:
    e = _events(t)
    p = e.filter("event_type = 'purchase'")
    c = e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("sec").alias("csec"), F.col("user_id").alias("cuser"))
    out = joins.asof_join(p, c, "sec", "csec", direction=options.pop("direction", "backward"), tie="click_id", **options)
    return out.select("event_id", F.col("match.click_id").alias("click_id"))


def _asof_duck(by: str, cmp: str, order: str, extra: str = "") -> str:
    return f"SELECT p.event_id, (SELECT click_id FROM {_CLICK} c WHERE {by} cts {cmp} p.ts {extra} ORDER BY cts {order}, click_id {order} LIMIT 1) AS click_id FROM {_PURCHASE} p"


@query(_asof_duck("cuser = p.user_id AND", "<=", "DESC"))
def asof_backward_by(t):
    return _asof(t, by={"user_id": "cuser"})


@query(_asof_duck("", "<=", "DESC"))
def asof_backward(t):
    return _asof(t)


@query(_asof_duck("cuser = p.user_id AND", ">=", "ASC"))
def asof_forward_by(t):
    return _asof(t, by={"user_id": "cuser"}, direction="forward")


@query(_asof_duck("", ">=", "ASC"))
def asof_forward(t):
    return _asof(t, direction="forward")


@query(_asof_duck("cuser = p.user_id AND", "<=", "DESC", "AND epoch_us(p.ts) - epoch_us(cts) <= 3600000000"))
def asof_tolerance(t):
    return _asof(t, by={"user_id": "cuser"}, tolerance=3600.0)


@query(f"SELECT * FROM ({_asof_duck('cuser = p.user_id AND', '<=', 'DESC')}) WHERE click_id IS NOT NULL")
def asof_inner(t):
    return _asof(t, by={"user_id": "cuser"}, how="inner")


# --- aggregation -------------------------------------------------------------------------------------

same("agg_group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 5")
same("agg_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
same("agg_ungrouped", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem} WHERE l_discount > 0.05")
same("agg_metadata_only", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM {orders}")
same("agg_computed_key", "SELECT p_size % 10 AS bucket, count(*) AS n FROM {part} GROUP BY p_size % 10")
same("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag")
same("agg_sum_avg_distinct", "SELECT l_returnflag, round(sum(DISTINCT l_quantity), 2) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM {lineitem} GROUP BY l_returnflag")
same("agg_statistics", "SELECT l_suppkey, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, median(l_quantity) AS med FROM {lineitem} GROUP BY l_suppkey")
same("agg_statistics_distinct", "SELECT l_suppkey, round(var_samp(q), 6) AS vs, round(stddev_pop(q), 6) AS sp, median(q) AS med FROM (SELECT DISTINCT l_suppkey, l_quantity AS q FROM {lineitem}) GROUP BY l_suppkey")
same("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
same("agg_filter_clause", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM {orders} GROUP BY o_custkey")
same("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
same("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
same("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY o_custkey")
def agg_min_by_max_by(t):
    o = t("orders")
    return o.groupBy("o_custkey").agg(aggregates.min_by(F.col("o_orderkey"), F.col("o_totalprice")).alias("cheapest"), aggregates.max_by(F.col("o_orderkey"), F.col("o_totalprice")).alias("dearest"))


@query("SELECT source, count(TRY_CAST(s AS DOUBLE)) AS n, count(*) AS every FROM (SELECT source, regexp_extract(text, '[0-9]+') AS s FROM documents) GROUP BY source")
def agg_countn(t):
    return t("documents").groupBy("source").agg(aggregates.countn(F.regexp_extract("text", "[0-9]+", 0)).alias("n"), F.count("*").alias("every"))


@query("SELECT o_custkey, string_agg(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END::VARCHAR, 'null'), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def agg_array_agg(t):
    x = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey"))
    a = t("orders").groupBy("o_custkey").agg(aggregates.array_agg(x, F.col("o_orderkey")).alias("a"))
    return a.select("o_custkey", F.array_join(F.transform("a", lambda e: e.cast("string")), ",", "null").alias("keys"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def agg_array_agg_distinct(t):
    return t("orders").groupBy("o_custkey").agg(F.array_join(aggregates.array_agg_distinct(F.col("o_orderpriority")), ",").alias("priorities"))


@query("SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS g, sum(p_retailprice::DECIMAL(38, 12) + p_partkey * 0.000000001::DECIMAL(38, 9))::VARCHAR AS d FROM part GROUP BY p_brand")
def agg_geomean_decimal(t):
    x = F.col("p_retailprice")
    exact = x.cast("decimal(20,2)") + F.col("p_partkey").cast("decimal(18,0)") * F.lit(Decimal("0.000000001"))
    return t("part").groupBy("p_brand").agg(F.round(aggregates.geomean(x), 4).alias("g"), aggregates.decimal_sum(exact, 12).cast("string").alias("d"))


@query("SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey) AS grouped FROM nation GROUP BY n_regionkey")
def agg_group_as(t):
    n = t("nation")
    g = n.groupBy("n_regionkey").agg(aggregates.group_as(n, "n_nationkey").alias("g"))
    return g.select("n_regionkey", F.array_join(F.transform("g", lambda e: F.concat(e["n_nationkey"].cast("string"), F.lit(":"), e["n_name"])), ";").alias("grouped"))


@query("SELECT l_returnflag, abs(count(DISTINCT l_partkey) - count(DISTINCT l_partkey)) < 1 AS close FROM lineitem GROUP BY l_returnflag")
def agg_hll(t):
    g = t("lineitem").groupBy("l_returnflag").agg(aggregates.hll(F.col("l_partkey")).alias("h"), F.count_distinct("l_partkey").alias("d"))
    return g.select("l_returnflag", (F.abs(F.col("h") - F.col("d")) <= 0.1 * F.col("d")).alias("close"))


@query()
def agg_sparkline(t):
    return t("orders").groupBy("o_orderstatus").agg(aggregates.sparkline(F.col("o_totalprice"), F.col("o_orderkey")).alias("sparkline"))


@query("""
SELECT l_returnflag, string_agg(substr('▁▂▃▄▅▆▇█', 1 + coalesce(floor((n - lo)::DOUBLE / nullif(hi - lo, 0) * 7 + 0.5), 0)::INT, 1), '' ORDER BY bin) AS histogram FROM (
  SELECT *, min(n) OVER (PARTITION BY l_returnflag) AS lo, max(n) OVER (PARTITION BY l_returnflag) AS hi FROM (
    SELECT f AS l_returnflag, b AS bin, count(q) AS n FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem) CROSS JOIN range(20) r(b)
    LEFT JOIN (SELECT l_returnflag AS g, least(floor((l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w) * 20), 19) AS place, l_quantity AS q
      FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) ON g = f AND place = b GROUP BY ALL)) GROUP BY l_returnflag""")
def agg_histogram(t):
    return aggregates.histogram(t("lineitem"), ["l_returnflag"], "l_quantity")


@query("SELECT 'k' AS path, 'number' AS val_type, count(*) AS n FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')")
def agg_census(t):
    return aggregates.census(t("events").select(variants.parse(F.col("props")).alias("v")), "v")


@query()
def agg_chart(t):
    return aggregates.vega_lite(t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), "o_orderstatus", "n")


# --- order, limits, sets -----------------------------------------------------------------------------

same("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
same("order_nulls_last", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS c FROM {orders} ORDER BY c ASC NULLS LAST, o_orderkey LIMIT 30")
same("order_by_aggregate", "SELECT o_custkey FROM {orders} GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 5")
same("order_unprojected", "SELECT o_orderkey FROM {orders} ORDER BY o_orderdate, o_totalprice, o_orderkey LIMIT 25")


def _keys(t, name: str, column: str, where: str) -> DataFrame:
    return t(name).filter(where).select((F.col(column) % 20).alias("k"))


_A, _B = "(SELECT o_custkey % 20 AS k FROM orders WHERE o_orderstatus = 'F')", "(SELECT c_custkey % 20 AS k FROM customer WHERE c_acctbal > 5000)"


def _ab(t) -> tuple[DataFrame, DataFrame]:
    return _keys(t, "orders", "o_custkey", "o_orderstatus = 'F'"), _keys(t, "customer", "c_custkey", "c_acctbal > 5000")


@query(f"SELECT * FROM {_A} UNION ALL SELECT * FROM {_B}")
def set_union_all(t):
    return sets.union_all(*_ab(t))


@query(f"SELECT * FROM {_A} UNION SELECT * FROM {_B}")
def set_union(t):
    return sets.union(*_ab(t))


@query("SELECT s_suppkey AS k, s_name AS name, NULL::DOUBLE AS bal FROM supplier UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def set_union_by_name(t):
    s, c = t("supplier").selectExpr("s_suppkey as k", "s_name as name"), t("customer").selectExpr("c_acctbal as bal", "c_custkey as k")
    return sets.union_all(s, c)


@query(f"SELECT * FROM {_A} INTERSECT SELECT * FROM {_B}")
def set_intersect(t):
    return sets.intersect(*_ab(t))


@query(f"SELECT * FROM {_A} INTERSECT ALL SELECT * FROM {_B}")
def set_intersect_all(t):
    return sets.intersect(*_ab(t), all=True)


@query(f"SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}")
def set_except(t):
    return sets.except_(*_ab(t))


@query(f"SELECT * FROM {_A} EXCEPT ALL SELECT * FROM {_B}")
def set_except_all(t):
    return sets.except_(*_ab(t), all=True)


@query("SELECT event_id, event_type FROM events")
def merge_scan(t):
    e = t("events").select("event_id", "event_type", "ts")
    return sets.merge_scan("ts", *[e.filter(F.col("event_type") == k) for k in ("signup", "purchase", "error", "view", "click")]).select("event_id", "event_type")


@query("SELECT event_id FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) WHERE high - event_id > 20")
def merge_late_rows(t):
    e = t("events").withColumn("lane", F.col("user_id") % 5).withColumn("pos", F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id"))
    return sets.late_rows(e, "event_id", "pos", 20, ["lane"]).select("event_id")


# --- windows -----------------------------------------------------------------------------------------

_W = "(PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
same("window_ranks", f"SELECT o_orderkey, CAST(row_number() OVER {_W} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS d, CAST(ntile(4) OVER {_W} AS BIGINT) AS q FROM {{orders}}")
same("window_percent", "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS p, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS c FROM {orders}")
same("window_values", f"SELECT o_orderkey, first_value(o_orderkey) OVER {_W} AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER {_W} AS n FROM {{orders}}")
same("window_lag_lead", f"SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER {_W} AS p, lead(o_orderkey, 2) OVER {_W} AS n FROM {{orders}}")
same("window_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
same("window_range_frame", "SELECT p_partkey, count(*) OVER w AS n, round(avg(p_retailprice) OVER w, 6) AS a FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING)")
same("window_default_frames", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS upto, count(*) OVER (PARTITION BY o_custkey) AS every FROM {orders}")
same("window_over_group", "SELECT o_custkey, n, CAST(rank() OVER (ORDER BY n DESC, o_custkey) AS BIGINT) AS r FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey)")
same("window_ignore_nulls", "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM {orders}", "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM orders")


@query("SELECT p_partkey, (sum(p_size) OVER w)::BIGINT AS s, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def window_groups_frame(t):
    return windows.groups_frame(t("part"), ["p_brand"], ["p_size"], 2, 1, s=F.sum("p_size"), n=F.count(F.lit(1))).select("p_partkey", "s", "n")


def _excluding(kind: str, unit: str) -> tuple[str, Callable]:
    frame, order = ("ROWS", "p_size, p_partkey") if unit == "rows" else ("GROUPS", "p_size")
    duck = f"SELECT p_partkey, sum(p_size) OVER w::DOUBLE AS s, count(p_size) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY {order} {frame} BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE {kind.upper().replace('_', ' ')})"

    def run(t):
        p = t("part")
        for agg, name in (("sum", "s"), ("count", "n")):
            p = windows.exclude_frame(p, ["p_brand"], ["p_size"], 2, 2, kind, "p_size", "p_partkey", name, agg, unit)
        return p.select("p_partkey", "s", "n")

    return duck, run


for _kind in ("current_row", "group", "ties", "no_others"):
    _duck, _run = _excluding(_kind, "groups")
    _run.__name__ = f"window_exclude_{_kind}"
    query(_duck)(_run)


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS ratio FROM orders")
def window_ratio_to_report(t):
    return t("orders").select("o_orderkey", F.round(windows.ratio_to_report(F.col("o_totalprice"), ["o_custkey"]), 9).alias("ratio"))


@query("SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders")
def window_nth_from_last(t):
    return t("orders").select("o_orderkey", windows.nth_from_last("o_orderkey", 2, ["o_custkey"], [F.col("o_orderkey").desc()]).alias("n"))


@query("SELECT p_partkey, count(DISTINCT p_size) OVER (PARTITION BY p_brand) AS c, sum(DISTINCT p_size) OVER (PARTITION BY p_brand)::DOUBLE AS s FROM part")
def window_distinct_aggregate(t):
    return t("part").select("p_partkey", windows.distinct_over("count", "p_size", ["p_brand"]).alias("c"), windows.distinct_over("sum", "p_size", ["p_brand"]).alias("s"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_per_group(t):
    return windows.top_per_group(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


# --- events ------------------------------------------------------------------------------------------


@query("""SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000, true) THEN 1 ELSE 0 END AS new FROM events)""")
def sessionize(t):
    return temporal.sessionize(_events(t), ["user_id"], "sec", 1800.0, "event_id").select("event_id", "session")


@query("""SELECT event_id, "from", event_type AS "to" FROM (SELECT *, lag(event_type) OVER w AS "from", row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND "from" IS DISTINCT FROM event_type""")
def transitions(t):
    return temporal.transitions(t("events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "from", "to")


@query("""SELECT event_id, event_type = 'error' AS is_match FROM (SELECT *, max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM events) WHERE near = 1""")
def grep_context(t):
    return temporal.grep_context(t("events"), F.col("event_type") == "error", 2, 1, ["user_id"], ["ts", "event_id"]).select("event_id", "is_match")


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS hour, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window(t):
    g = t("events").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return g.select("event_type", F.unix_seconds(F.col("window.start").cast("timestamp")).alias("hour"), "n")


# --- scalar functions --------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * o_custkey AS m, round(o_totalprice / nullif(o_orderkey % 3, 0), 6) AS d,
  o_totalprice % 7 AS md, o_orderkey // nullif(o_custkey % 4, 0) AS id, o_orderkey % nullif(o_custkey % 4, 0) AS im, -o_orderkey AS n FROM orders""")
def fn_arithmetic(t):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return t("orders").select("o_orderkey", scalar.add(k, c).cast("long").alias("a"), scalar.sub(k, c).cast("long").alias("s"), scalar.mult(k, c).cast("long").alias("m"), F.round(scalar.div(p, k % 3), 6).alias("d"),
        scalar.mod(p, F.lit(7)).alias("md"), scalar.idiv(k, c % 4).alias("id"), scalar.imod(k, c % 4).alias("im"), scalar.neg(k).alias("n"))


@query("""SELECT p_partkey, abs(x) AS a, ceil(x)::BIGINT AS c, floor(x)::BIGINT AS f, round(sqrt(abs(x)), 9) AS s, sign(x)::DOUBLE AS g, round(ln(abs(x)), 9) AS l, round(log10(abs(x)), 9) AS l10,
  round(degrees(x), 6) AS d, round(radians(x), 9) AS r, round(sin(x), 9) AS si, round(cos(x), 9) AS co, round(atan(x), 9) AS at, round(atan2(x, 2), 9) AS a2, round(power(abs(x), 0.3), 9) AS p,
  round(exp(x / 1000), 9) AS e, round(asin(x / 10000), 9) AS asi, round(acos(x / 10000), 9) AS aco, round(tan(x / 10000), 9) AS ta, trunc(x)::DOUBLE AS t FROM (SELECT p_partkey, 1005.3 - p_retailprice AS x FROM part)""")
def fn_math(t):
    x = 1005.3 - F.col("p_retailprice")
    r = lambda c, n=9: F.round(c, n)
    made = {"a": F.abs(x), "c": F.ceil(x), "f": F.floor(x), "s": r(F.sqrt(F.abs(x))), "g": F.signum(x), "l": r(F.ln(F.abs(x))), "l10": r(scalar.log(F.abs(x))), "d": r(F.degrees(x), 6), "r": r(F.radians(x)), "si": r(F.sin(x)), "co": r(F.cos(x)), "at": r(F.atan(x)),
        "a2": r(F.atan2(x, F.lit(2.0))), "p": r(F.pow(F.abs(x), F.lit(0.3))), "e": r(F.exp(x / 1000)), "asi": r(F.asin(x / 10000)), "aco": r(F.acos(x / 10000)), "ta": r(F.tan(x / 10000)), "t": scalar.trunc(x)}
    return t("part").select("p_partkey", *[c.alias(n) for n, c in made.items()])


@query("SELECT p_partkey, round_even(p_size / 2.0::DOUBLE, 0)::DOUBLE AS half, trunc(p_retailprice / 10) * 10 AS tens FROM part")
def fn_round_trunc(t):
    return t("part").select("p_partkey", scalar.round_even(F.col("p_size") / 2).alias("half"), scalar.trunc(F.col("p_retailprice"), -1).alias("tens"))


@query("""SELECT doc_id, strlen(s) AS bytes, length(s) AS chars, upper(replace(s, 'ß', 'ss')) AS u, lower(s) AS l, reverse(s) AS r, lpad(lang, 5, '*') AS lp, rpad(lang, 5, '*') AS rp, repeat(s, 2) AS rep,
  replace(s, 'e', 'E') AS rpl, contains(s, 'th') AS c, s || '!' AS cat, trim(s, 'TtAa') AS tr, regexp_matches(s, '^[A-Z][a-z]+ ') AS rc, regexp_full_match(s, '(?s).*a.*') AS rl, array_to_string(string_split(s, ' '), '|') AS sp, decode(from_base64('aGVsbG8=')) AS b64
  FROM (SELECT doc_id, lang, text AS s FROM documents)""")
def fn_strings(t):
    s = F.col("s")
    d = t("documents").select("doc_id", "lang", F.col("text").alias("s"))
    made = {"bytes": scalar.length(s).cast("long"), "chars": scalar.mb_length(s).cast("long"), "u": F.upper(F.replace(s, F.lit("ß"), F.lit("ss"))), "l": F.lower(s), "r": F.reverse(s), "lp": F.lpad("lang", 5, "*"), "rp": F.rpad("lang", 5, "*"), "rep": F.repeat(s, 2),
        "rpl": F.replace(s, F.lit("e"), F.lit("E")), "c": scalar.contains(s, F.lit("th")), "cat": F.concat(s, F.lit("!")), "tr": scalar.trim(s, "TtAa"), "rc": scalar.regexp_contains(s, "^[A-Z][a-z]+ "), "rl": scalar.regexp_like(s, "(?s).*a.*"), "sp": F.array_join(scalar.split(s, " "), "|"), "b64": scalar.base64_decode_string(F.lit("aGVsbG8="))}
    return d.select("doc_id", *[c.alias(n) for n, c in made.items()])


@query("""SELECT doc_id, substr(source, 3, 2) AS s0, strlen(s) > 500 AS far, CASE WHEN contains(s, 'th') THEN strlen(split_part(s, 'th', 1)) ELSE -1 END AS p0,
  CASE WHEN contains(s, 'th') THEN strlen(split_part(s, 'th', 1)) + 1 ELSE 0 END AS p1 FROM (SELECT doc_id, source, text AS s FROM documents)""")
def fn_byte_positions(t):
    c = F.col("text")
    return t("documents").select("doc_id", scalar.substr0(F.col("source"), 2, 2).alias("s0"), F.when(c.isNotNull(), scalar.substr0(c, 500, 1).isNotNull()).alias("far"), scalar.position0(c, F.lit("th")).cast("long").alias("p0"), scalar.position1(c, F.lit("th")).cast("long").alias("p1"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, p_size * 9 / 5 + 32 AS f, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\\W+'), lambda x: x <> ''))), ' ') AS toks FROM part")
def fn_samples(t):
    return t("part").select("p_partkey", scalar.slugify(F.col("p_type")).alias("slug"), scalar.celsius_to_fahrenheit(F.col("p_size")).alias("f"), F.array_join(F.array_sort(scalar.tokens(F.col("p_name"))), " ").alias("toks"))


@query("""SELECT o_orderkey, coalesce(x, -1) AS co, nullif(o_custkey, 7) AS nu, x IS NULL AS isn, x IS DISTINCT FROM 5 AS dis, greatest(x, o_custkey) AS gr, least(x, o_custkey) AS le,
  CASE WHEN x > 100 THEN 'big' WHEN x IS NULL THEN 'none' ELSE 'small' END AS cs, (x > 10 AND o_custkey > 50) AS an, (x > 10 OR o_custkey > 50) AS o, NOT (x > 10) AS no FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS x FROM orders)""")
def fn_conditions(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = F.when(k % 3 > 0, k)
    made = {"co": scalar.if_missing_or_null(x, -1), "nu": scalar.missing_if(c, 7), "isn": x.isNull(), "dis": scalar.is_distinct(x, 5), "gr": scalar.greatest(x, c), "le": scalar.least(x, c), "cs": F.when(x > 100, "big").when(x.isNull(), "none").otherwise("small"), "an": (x > 10) & (c > 50), "o": (x > 10) | (c > 50), "no": ~(x > 10)}
    return t("orders").select("o_orderkey", *[v.alias(n) for n, v in made.items()])


_DATE_PARTS = {"millennium": "millennium", "century": "century", "decade": "decade", "year": "year", "quarter": "quarter", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "dow": "dow", "doy": "doy", "iso_week": "week", "iso_year": "isoyear", "iso_dow": "isodow"}


@query("SELECT event_id, " + ", ".join(f"extract({d} FROM ts)::BIGINT AS {n}" for n, d in _DATE_PARTS.items()) + ", ceil(extract(doy FROM ts) / 7.0)::BIGINT AS week, (epoch_us(ts) // 1000 % 1000)::BIGINT AS millisecond FROM events")
def fn_date_parts(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", *[dates.date_part_millis(ms, p).alias(p) for p in [*_DATE_PARTS, "week", "millisecond"]])


@query("""SELECT event_id, (epoch_us(ts + INTERVAL 3 MONTH) // 1000)::BIGINT AS m, (epoch_us(ts + INTERVAL 40 DAY) // 1000)::BIGINT AS d, (epoch_us(ts - INTERVAL 90 MINUTE) // 1000)::BIGINT AS mi, epoch_ms(date_trunc('month', ts))::BIGINT AS tr,
  strftime(ts, '%Y-%m-%d %H:%M') AS f, (epoch_us(ts) // 1000 - 1700000000000) // 86400000 AS dd FROM events""")
def fn_date_arithmetic(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    made = {"m": dates.date_add_millis(ms, 3, "month"), "d": dates.date_add_millis(ms, 40, "day"), "mi": dates.date_add_millis(ms, -90, "minute"), "tr": dates.date_trunc_millis(ms, "month"), "f": dates.millis_to_str(ms, "yyyy-MM-dd HH:mm"), "dd": dates.date_diff_millis(ms, F.lit(1700000000000), "day")}
    return t("events").select("event_id", *[v.alias(n) for n, v in made.items()])


_ARR = "[p_size, p_partkey % 7, NULL, p_size % 5, p_partkey % 7]"


def _arr() -> Column:
    return F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 7, F.lit(None).cast("long"), (F.col("p_size") % 5).cast("long"), F.col("p_partkey") % 7)


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",", "null")


def _duck_joined(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: coalesce(x::VARCHAR, 'null')), ',')"


@query(f"""SELECT p_partkey, len(a) AS ln, len(list_filter(a, lambda x: x IS NOT NULL)) AS ct, list_sum(a)::DOUBLE AS sm, round(list_avg(a), 9) AS av, list_min(a) AS mn, list_max(a) AS mx, list_contains(a, 3) AS con, coalesce(list_position(a, 3), 0)::BIGINT - 1 AS pos,
  {_duck_joined('list_append(a, 9)')} AS ap, {_duck_joined('list_prepend(9, a)')} AS pr, {_duck_joined('list_concat(a, [1, 2])')} AS cc, {_duck_joined("list_sort(a, 'ASC', 'NULLS FIRST')")} AS so, {_duck_joined('list_reverse(a)')} AS rv, {_duck_joined('list_sort(list_distinct(a))')} AS di,
  a[1] AS e0, a[-1] AS em, a[10] AS far, {_duck_joined('a[2:3]')} AS sl FROM (SELECT p_partkey, {_ARR} AS a FROM part)""")
def fn_arrays(t):
    a = F.col("a")
    made = {"ln": arrays.length(a).cast("long"), "ct": arrays.count(a).cast("long"), "sm": arrays.total(a), "av": F.round(arrays.average(a), 9), "mn": arrays.minimum(a), "mx": arrays.maximum(a), "con": F.coalesce(arrays.contains(a, 3), F.lit(False)), "pos": arrays.position(a, 3),
        "ap": _joined(arrays.append(a, F.lit(9).cast("long"))), "pr": _joined(arrays.prepend(F.lit(9).cast("long"), a)), "cc": _joined(arrays.concat(a, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))), "so": _joined(arrays.sort(a)), "rv": _joined(arrays.reverse(a)), "di": _joined(F.filter(arrays.sort(arrays.distinct(a)), lambda x: x.isNotNull())),
        "e0": arrays.element(a, 0), "em": arrays.element(a, -1), "far": arrays.element(a, 9), "sl": _joined(arrays.part(a, 1, 3))}
    return t("part").select("p_partkey", _arr().alias("a")).select("p_partkey", *[v.alias(n) for n, v in made.items()])


@query(f"""SELECT p_partkey, len(list_filter(a, lambda x: x > 40)) > 0 AS an, len(list_filter(a, lambda x: x >= 0)) = len(a) AS ev, list_transform(list_filter(a, lambda x: x > 3), lambda x: x * 2)[1] AS fi, {_duck_joined('list_transform(list_filter(a, lambda x: x > 3), lambda x: x * 2)')} AS ar
  FROM (SELECT p_partkey, list_filter({_ARR}, lambda x: x IS NOT NULL) AS a FROM part)""")
def fn_comprehensions(t):
    a = F.col("a")
    d = t("part").select("p_partkey", F.filter(_arr(), lambda x: x.isNotNull()).alias("a"))
    twice, over3 = (lambda x: x * 2), (lambda x: x > 3)
    return d.select("p_partkey", arrays.any_satisfies(a, lambda x: x > 40).alias("an"), arrays.every_satisfies(a, lambda x: x >= 0).alias("ev"), arrays.first_for(a, twice, over3).alias("fi"), _joined(arrays.array_for(a, twice, over3)).alias("ar"))


@query("SELECT p_partkey, array_to_string(list_transform(flatten([[p_size], [1, 2]]), lambda x: x::VARCHAR), ',') AS fl, array_to_string(list_transform(range(2, 10, 3), lambda x: x::VARCHAR), ',') AS rg FROM part")
def fn_array_flatten_range(t):
    return t("part").select("p_partkey", _joined(arrays.flatten(F.array(F.array("p_size"), F.array(F.lit(1), F.lit(2))))).alias("fl"), _joined(arrays.span(2, 10, 3)).alias("rg"))


@query("""SELECT n_nationkey, 2 AS len, 'key,name' AS names, n_nationkey || ',' || n_name AS vals, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 3 END AS added, 'name' AS removed, 'new' AS put FROM nation""")
def fn_objects(t):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    made = {"len": objects.length(m), "names": F.array_join(objects.names(m), ","), "vals": F.array_join(objects.values(m), ","), "added": objects.length(objects.add(m, "x", "1")), "removed": F.array_join(objects.names(objects.remove(m, "key")), ","), "put": objects.put(m, "name", "new")["name"]}
    return t("nation").select("n_nationkey", *[v.alias(n) for n, v in made.items()])


@query("SELECT conv_id, turn, len(text) > 0 AS ok, strlen(role) AS n FROM conversations WHERE list_contains(['user'], role)")
def fn_object_for(t):
    pairs = F.array(F.struct(F.lit("role").alias("k"), F.col("role").alias("v")), F.struct(F.lit("text").alias("k"), F.col("text").alias("v")))
    m = arrays.object_for(pairs, lambda e: e["k"], lambda e: e["v"])
    return t("conversations").select("conv_id", "turn", m.alias("m")).filter(F.col("m")["role"] == "user").select("conv_id", "turn", (F.length(F.col("m")["text"]) > 0).alias("ok"), F.octet_length(F.col("m")["role"]).cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, 'number' AS kind, json_extract_string(props, '$.zz') IS NULL AS missing FROM events")
def variant_fields(t):
    v = variants.parse(F.col("props"))
    k = variants.field(v, "$.k")
    return t("events").select("event_id", variants.number(k).alias("k"), variants.kind(k).alias("kind"), variants.is_missing(variants.field(v, "$.zz")).alias("missing"))


_MIXED = ["null", "false", "true", "-1", "0", "2.5", "10", '""', '"a"', '"b"', "[]", "[1]", "{}", '{"a":1}', '{"b":0}', '{"a":1,"b":2}']


@query("SELECT rn - 1 AS place, rn AS rn FROM range(1, 18) r(rn)")
def variant_collation(t):
    """Values of every type in the order of `collate_key`: each stands at its place."""
    spark = t("region").sparkSession
    rows = [(k + 2, x) for k, x in enumerate(_MIXED)] + [(1, None)]
    v = spark.createDataFrame(rows[::-1], "rn long, text string").select("rn", variants.collate_key(variants.parse(F.col("text"))).alias("key"))
    return v.select((F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("place"), "rn")


@query("SELECT event_id, 1 AS n, json_extract_string(props, '$.k') AS v FROM events")
def variant_within(t):
    found = variants.within(variants.parse(F.col("props")), 2)
    return t("events").select("event_id", F.size(found).alias("n"), F.get(found, 0).alias("v"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN contains(p_type, 'TIN') THEN strlen(split_part(p_type, 'TIN', 1)) ELSE -1 END AS place FROM part")
def registered_functions(t):
    df = t("part")
    registry.register_all(df.sparkSession)
    return df.sparkSession.sql("SELECT p_partkey, slugify(p_type) AS slug, CAST(position0(p_type, 'TIN') AS BIGINT) AS place FROM {p}", p=df)


@query("SELECT range AS value FROM range(0, 100, 7)")
def table_function(t):
    spark = t("region").sparkSession
    registry.register_all(spark)
    return spark.sql("SELECT value FROM series(0, 100, 7)")


# --- vectors -----------------------------------------------------------------------------------------

_V0 = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _query_vector(t) -> list[float]:
    return [float(x) for x in t("embeddings").filter("vec_id = 0").first()["embedding"]]


@query(f"""SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 5) AS l2, round(-list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 5) AS dot,
  round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS cosine FROM embeddings, {_V0}""")
def vector_distances(t):
    q = F.array(*[F.lit(x) for x in _query_vector(t)])
    return t("embeddings").select("vec_id", *[F.round(vectors.distance(F.col("embedding"), q, m), 5).alias(m) for m in ("l2", "dot", "cosine")])


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS distance FROM embeddings, {_V0} ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10")
def vector_top_k(t):
    return vectors.top_k(t("embeddings"), _query_vector(t), 10).select("vec_id", F.round("distance", 5).alias("distance"))


_CENTRES = "(SELECT list(embedding ORDER BY vec_id) AS cs FROM embeddings WHERE vec_id < 4)"


@query(f"SELECT vec_id, list_position(ds, list_min(ds)) - 1 AS cluster FROM (SELECT vec_id, list_transform(cs, lambda c: list_distance(embedding::DOUBLE[], c::DOUBLE[])) AS ds FROM embeddings, {_CENTRES})")
def vector_nearest(t):
    centres = [[float(x) for x in r["embedding"]] for r in t("embeddings").filter("vec_id < 4").orderBy("vec_id").collect()]
    return t("embeddings").select("vec_id", vectors.nearest(F.col("embedding"), centres)["index"].alias("cluster"))


@query()
def vector_kmeans(t):
    e = t("embeddings")
    return e.select("vec_id", vectors.nearest(F.col("embedding"), vectors.kmeans(e, 4, 3))["index"].alias("cluster"))


@query()
def vectorize_batch(t):
    return t("documents").select("doc_id", vectors.vectorize(F.col("text")).alias("embedding"))


# --- query packs -------------------------------------------------------------------------------------

_PACK = [
    querypack.PackQuery("errors", "events", "event_type = 'error'", ("event_id",)),
    querypack.PackQuery("dear", "events", "event_type = 'purchase' AND value > 50", ("event_id", "user_id")),
    querypack.PackQuery("user3", "events", "user_id = 3", ("event_id",)),
]


@query("""SELECT 'errors' AS label, '{"event_id":' || event_id || '}' AS result FROM events WHERE event_type = 'error'
UNION ALL SELECT 'dear', '{"event_id":' || event_id || ',"user_id":' || user_id || '}' FROM events WHERE event_type = 'purchase' AND value > 50
UNION ALL SELECT 'user3', '{"event_id":' || event_id || '}' FROM events WHERE user_id = 3""")
def pack_broadcast(t):
    return querypack.broadcast(t("events"), _PACK)


@query("SELECT 'brass' AS label, '{\"p_partkey\":' || p_partkey || '}' AS result FROM part WHERE p_type LIKE '%BRASS%' UNION ALL SELECT 'tin', '{\"p_partkey\":' || p_partkey || '}' FROM part WHERE p_type LIKE '%TIN%' AND p_size > 20")
def pack_indexed(t):
    pack = [querypack.PackQuery("brass", "part", "p_type LIKE '%BRASS%'", ("p_partkey",)), querypack.PackQuery("tin", "part", "p_type LIKE '%TIN%' AND p_size > 20", ("p_partkey",))]
    return querypack.broadcast(t("part"), pack, prefilter="p_type")


@query("""WITH e AS (SELECT *, max((event_type = 'error')::INT) OVER (w ROWS BETWEEN 0 PRECEDING AND 1 FOLLOWING) AS c1, max((value > 90)::INT) OVER (w ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING) AS c2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'errors' AS label, '{"event_id":' || event_id || '}' AS result, event_type = 'error' AS is_match FROM e WHERE c1 = 1 UNION ALL SELECT 'high', '{"event_id":' || event_id || '}', coalesce(value > 90, false) FROM e WHERE c2 = 1""")
def pack_context(t):
    pack = [querypack.PackQuery("errors", "events", "event_type = 'error'", ("event_id",), before=1), querypack.PackQuery("high", "events", "value > 90", ("event_id",), after=1)]
    return querypack.broadcast_context(t("events"), pack, ["user_id"], ["ts", "event_id"])


@query(ORACLE["vector_top_k"])
def vector_ivf_probe(t):
    """All cells probed: the same as brute force."""
    e = t("embeddings")
    centres = vectors.kmeans(e, 4, 2)
    near = vectors.ivf_probe(vectors.ivf_cells(e, centres), centres, _query_vector(t), 10, 4, "cosine")
    return near.select("vec_id", F.round("distance", 5).alias("distance"))


@query("SELECT count(*)::BIGINT AS n FROM embeddings")
def vector_ivf_census(t):
    e = t("embeddings")
    return vectors.ivf_census(vectors.ivf_cells(e, vectors.kmeans(e, 4, 2))).agg(F.sum("n").alias("n"))


# --- search and text ---------------------------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda x: x <> '')) AS term FROM documents), dl AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY doc_id),
h AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('the', 'nter') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term), a AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)
SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM h JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN a GROUP BY doc_id HAVING count(*) = 2""")
def search_bm25(t):
    index = lineage.materialize(search.inverted_index(t("documents"), "doc_id", "text"))
    return search.search(index, must=["the", "nter"]).select("id", F.round("score", 6).alias("score"))


@query(ORACLE["search_bm25"])
def search_scan(t):
    return search.scan_search(t("documents"), "doc_id", "text", ["the", "nter"]).select("id", F.round("score", 6).alias("score"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a\\s')) AS links FROM pages")
def extract_fields(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"<a\s")).cast("long").alias("links"))


@query("SELECT page_id, 2 AS n, 'A' AS t, 'x' || page_id AS b, 'u' AS url, 'py' AS lang FROM pages")
def markdown_functions(t):
    text = F.concat(F.lit("# A\nx"), F.col("page_id").cast("string"), F.lit("\n## B\n[l](u)\n```py\ncode\n```\n"))
    s = extract.md_sections(text)
    return t("pages").select("page_id", F.size(s).alias("n"), s[0]["title"].alias("t"), s[0]["body"].alias("b"), extract.md_links(text)[0]["url"].alias("url"), extract.md_code(text)[0]["lang"].alias("lang"))


# --- more of the surface: sources and sinks, cursors, conversions ---------------------------------------


def _folder(df: DataFrame) -> str:
    return f"{lineage.shared_dir(df.sparkSession)}/nestfold-{uuid.uuid4().hex}"


def _nation(t) -> DataFrame:
    return t("nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def roundtrip_jsonl(t):
    path = _folder(df := _nation(t)) + ".jsonl"
    catalog.insert_into(df, path)
    return readers.read_jsonl(df.sparkSession, path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 5")
def roundtrip_parquet_append(t):
    path = _folder(df := _nation(t)) + ".parquet"
    catalog.insert_into(df, path, "overwrite")
    catalog.insert_into(df.filter("n_nationkey < 5"), path, "append")
    return readers.read_parquet(df.sparkSession, path)


@query("SELECT n_nationkey::DOUBLE AS k, n_name AS name, 'number' AS kind FROM nation")
def roundtrip_csv_cells(t):
    path = _folder(df := _nation(t)) + ".csv"
    catalog.insert_into(df, path)
    got = readers.read_csv(df.sparkSession, path, typed=True, multiline=True)
    return got.select(variants.number(F.col("n_nationkey")).alias("k"), variants.string(F.col("n_name")).alias("name"), variants.kind(F.col("n_regionkey")).alias("kind"))


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def roundtrip_yaml(t):
    path = _folder(df := _nation(t))
    df.select(F.format_string("- k: %d\n  name: %s", "n_nationkey", "n_name")).write.text(path)
    v = F.col("value")
    return readers.read_yaml(df.sparkSession, path + "/part-*").select(F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.name", "string").alias("name"))


@query("SELECT 'nations' AS title, count(*) AS n FROM nation")
def roundtrip_toml(t):
    path = _folder(df := _nation(t))
    lines = df.agg(F.array_join(F.sort_array(F.collect_list("n_nationkey")).cast("array<string>"), ", ").alias("ks")).select(F.format_string("title = \"nations\"\nkeys = [%s]", "ks"))
    lines.coalesce(1).write.text(path)
    v = F.col("value")
    return readers.read_toml(df.sparkSession, path + "/part-*").select(F.try_variant_get(v, "$.title", "string").alias("title"), F.size(F.try_variant_get(v, "$.keys", "array<int>")).cast("long").alias("n"))


@query("SELECT event_id::VARCHAR AS user, 200 + (event_id % 5)::INT AS status, epoch_us(ts) // 1000000 * 1000 AS _ts FROM events")
def extract_access_log(t):
    e = t("events")
    path = _folder(e)
    stamp = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    e.select(F.format_string('1.2.3.4 - %d [%s +0000] "GET /x HTTP/1.1" %d 10', "event_id", stamp, (200 + F.col("event_id") % 5))).write.text(path)
    return extract.extract(e.sparkSession, path, extract.APACHE_ACCESS).select("user", "status", "_ts")


@query("SELECT coalesce(a.k, b.k) AS id, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS op FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 > 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 13 > 0) b ON a.k = b.k WHERE a.s IS DISTINCT FROM b.s")
def cursor_diff(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return cursors.diff(o.filter("k % 7 > 0"), o.filter("k % 13 > 0").withColumn("s", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("s"))), "k")


@query("SELECT event_id, event_type FROM events")
def cursor_append(t):
    e = t("events").select("event_id", "event_type")
    src, out = _folder(e), _folder(e)
    e.write.parquet(src)
    cursor = cursors.AppendCursor(e.sparkSession, src, e.schema, _folder(e), "parquet")
    cursor.advance(out)
    return cursor.advance(out)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streaming_counts(t):
    e = t("events").select("event_type", "event_id")
    src, name = _folder(e), f"w{uuid.uuid4().hex}"
    e.write.parquet(src)
    stream = e.sparkSession.readStream.schema(e.schema).parquet(src).groupBy("event_type").agg(F.count("*").alias("n"))
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(e)).trigger(availableNow=True).start().awaitTermination()
    return e.sparkSession.table(name)


@query("""SELECT 'seen' AS label, '{"label":"big","n":' || count(*) || '}' AS result FROM orders WHERE o_totalprice > 150000""")
def pack_compose(t):
    first = querypack.QueryPack([querypack.PackQuery("big", "orders", "o_totalprice > 150000", ("o_orderkey",))])
    second = querypack.QueryPack([querypack.PackQuery("seen", "", "", (), text="SELECT label, count(*) AS n FROM {first} GROUP BY label")])
    o = t("orders")
    return querypack.compose(o.sparkSession, {"first": (first, []), "second": (second, ["first"])}, {"orders": o})["second"]


@query("SELECT doc_id, TRY_CAST(s AS DOUBLE) AS n, s <> '' AS b FROM (SELECT doc_id, regexp_extract(text, '[0-9]+[.]?[0-9]*') AS s FROM documents)")
def fn_conversions(t):
    s = F.col("s")
    return t("documents").select("doc_id", F.regexp_extract("text", "[0-9]+[.]?[0-9]*", 0).alias("s")).select("doc_id", scalar.to_number(s).alias("n"), scalar.to_boolean(s, "string").alias("b"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d') AS f, extract(month FROM ts)::BIGINT AS m, epoch_us(date_trunc('second', ts)) // 1000 AS ms FROM events")
def fn_date_strings(t):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t("events").select("event_id", dates.date_format_str(text, "yyyy/MM/dd").alias("f"), dates.date_part_str(text, "month").alias("m"), dates.str_to_millis(text).alias("ms"))


@query("""SELECT p_partkey, rtrim(rtrim((x + 0.00125)::VARCHAR, '0'), '.') AS a, rtrim(rtrim((x - y)::VARCHAR, '0'), '.') AS s, rtrim(rtrim((x * y)::VARCHAR, '0'), '.') AS m,
  CASE WHEN x > 1000 THEN 1 WHEN x < 1000 THEN -1 ELSE 0 END AS c, NULL::VARCHAR AS bad FROM (SELECT p_partkey, p_retailprice::DECIMAL(12, 2) AS x, p_partkey::DECIMAL(12, 0) * 0.0000001::DECIMAL(8, 7) AS y FROM part)""")
def fn_decimals(t):
    """Decimal texts of 2 to 7 places: exact sums, differences and products, trimmed; bad text gives NULL."""
    df = t("part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("x"), F.format_string("0.%07d", "p_partkey").alias("y"))
    registry.register_all(df.sparkSession)
    return df.sparkSession.sql("SELECT p_partkey, decimal_add(x, '0.00125') AS a, decimal_sub(x, y) AS s, decimal_mul(x, y) AS m, decimal_cmp(x, '1000') AS c, decimal_add('abc', x) AS bad FROM {p}", p=df)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN '{"k":' || o_orderkey || ',"c":' || o_custkey || '}' ELSE '{"c":' || o_custkey || '}' END AS doc FROM orders""")
def project_drops_missing(t):
    k = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey"))
    return t("orders").select("o_orderkey", F.to_json(F.struct(k.alias("k"), F.col("o_custkey").alias("c"))).alias("doc"))


same("agg_letting", "SELECT o_custkey, total, total / n AS mean FROM (SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS total, count(*) AS n FROM {orders} GROUP BY o_custkey) WHERE total > 100")
same("subquery_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c")


@query("SELECT c AS \"column\", true AS ok FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus')) v(c)")
def index_suggest(t):
    o = t("orders")
    exact = o.agg(*[F.count_distinct(c).alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")])
    found = catalog.suggest_indexes(o, ["o_orderkey", "o_custkey", "o_orderstatus"]).crossJoin(F.broadcast(exact))  # one row
    true = F.when(F.col("column") == "o_orderkey", F.col("o_orderkey")).when(F.col("column") == "o_custkey", F.col("o_custkey")).otherwise(F.col("o_orderstatus"))
    return found.select("column", (F.abs(F.col("distinct") - true) <= 0.15 * true).alias("ok"))


# --- the rest of the catalog -------------------------------------------------------------------------


@query("SELECT o.o_orderkey, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey), '') AS found FROM orders o LEFT JOIN customer ON c_custkey IN (o_custkey, -1) AND o_orderstatus = 'F' GROUP BY o.o_orderkey")
def nest_on_keys_left(t):
    keys = F.when(F.col("o_orderstatus") == "F", F.array(F.col("o_custkey"), F.lit(-1).cast("long")))
    n = joins.nest_on_keys(t("orders"), keys, t("customer").select("c_custkey"), "c_custkey", "cs", "o_orderkey", "left")
    return n.select("o_orderkey", F.array_join(F.transform("cs", lambda e: e["c_custkey"].cast("string")), ",").alias("found"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def fetch_by_keys(t):
    keys = t("orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(keys, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def temp_keyspace(t):
    o = t("orders")
    o.createOrReplaceTempView("nestfold_orders")
    engine = session.Engine(o.sparkSession)
    engine.sql("CREATE OR REPLACE TEMP KEYSPACE nestfold_big AS SELECT * FROM nestfold_orders WHERE o_totalprice > :least", {"least": 100000})
    return engine.sql("SELECT o_orderstatus, count(*) AS n FROM nestfold_big GROUP BY o_orderstatus")


@query("SELECT source, count(DISTINCT TRY_CAST(s AS DOUBLE)) AS n FROM (SELECT source, regexp_extract(text, '[0-9]+') AS s FROM documents) GROUP BY source")
def agg_countn_distinct(t):
    return t("documents").groupBy("source").agg(F.count_distinct(F.regexp_extract("text", "[0-9]+", 0).try_cast("double")).alias("n"))


@query("""SELECT p_partkey, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, ltrim(p_name, 'pb') AS lc, rtrim(p_name, 'er0') AS rc, lpad(p_brand, 12, ' ') AS lp, rpad(p_brand, 12, ' ') AS rp,
  array_to_string(list_filter(regexp_split_to_array(p_type, '\\s+'), lambda x: x <> ''), '/') AS sp, substr(p_name, 2, 3) AS s1, substr(p_name, 3) AS s2 FROM part""")
def fn_strings_more(t):
    n, b = F.col("p_name"), F.col("p_brand")
    made = {"lt": F.ltrim(F.concat(F.lit("  "), n)), "rt": F.rtrim(F.concat(n, F.lit("  "))), "lc": F.ltrim(n, F.lit("pb")), "rc": F.rtrim(n, F.lit("er0")), "lp": F.lpad(b, 12, " "), "rp": F.rpad(b, 12, " "),
        "sp": F.array_join(scalar.split(F.col("p_type")), "/"), "s1": scalar.substr1(n, 2, 3), "s2": scalar.substr0(n, 2)}
    return t("part").select("p_partkey", *[v.alias(k) for k, v in made.items()])


@query("""SELECT event_id, 'object' AS ty, 1 AS pl, 'k' AS names, true AS num, false AS arr, true AS atom, props AS canon FROM (SELECT event_id, json(props)::VARCHAR AS props FROM events)""")
def variant_types(t):
    v = variants.parse(F.col("props"))
    k = variants.field(v, "$.k")
    made = {"ty": variants.type_name(v), "pl": variants.poly_length(v), "names": F.array_join(objects.names(variants.as_map(v)), ","), "num": variants.is_number(k), "arr": variants.is_array(k), "atom": variants.is_atom(k), "canon": variants.canonical(v)}
    return t("events").select("event_id", *[c.alias(n) for n, c in made.items()])


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{"k":' || n_nationkey || ',"name":"' || n_name || '"}' ELSE '{"name":"' || n_name || '"}' END AS doc FROM nation""")
def variant_construct(t):
    made = variants.construct(name=F.col("n_name"), k=F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")))
    return t("nation").select("n_nationkey", variants.canonical(made).alias("doc"))


@query("SELECT val_type, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'number' WHEN event_id % 3 = 1 THEN 'string' ELSE 'null' END AS val_type FROM events) GROUP BY val_type")
def variant_group(t):
    """Values of mixed types grouped by their canonical text, then counted by type."""
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.lit('"s"')).otherwise(F.lit("null"))
    v = variants.parse(text)
    return t("events").groupBy(variants.kind(v).alias("val_type"), variants.canonical(v).alias("c")).agg(F.count("*").alias("m")).groupBy("val_type").agg(F.sum("m").alias("n"))


# --- benchmark shapes and the flagship ---------------------------------------------------------------

same("bench_count_filter", "SELECT count(*) AS n FROM {lineitem} WHERE l_quantity > 25")
same("bench_sort_limit", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
same("bench_expr_heavy", "SELECT round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax) + sqrt(l_quantity) * 2), 2) AS s FROM {lineitem}")
same("bench_join_group", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")


def _order_lines(t) -> DataFrame:
    """Orders with their lines nested."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return joins.nest(t("orders").select("o_orderkey", "o_custkey"), lines, [("o_orderkey", "l_orderkey")], "lines")


@query("SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def bench_unnest_count(t):
    return joins.unnest(_order_lines(t), F.col("lines"), "line").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY o_custkey")
def bench_unnest_filter_group(t):
    u = joins.unnest(_order_lines(t), F.col("lines"), "line").filter("line.l_quantity > 10")
    return u.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("line.l_quantity"), 2).alias("q"))


@query("SELECT o_orderkey, l_linenumber, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey ORDER BY l_quantity DESC, o_orderkey, l_linenumber LIMIT 50")
def bench_unnest_join_sort(t):
    u = joins.unnest(_order_lines(t), F.col("lines"), "line").select("o_orderkey", "line.*").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return u.orderBy(F.desc("l_quantity"), "o_orderkey", "l_linenumber").select("o_orderkey", "l_linenumber", "p_name").limit(50)


@query("""SELECT n_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, c_mktsegment ORDER BY revenue DESC, n_name, c_mktsegment LIMIT 10""")
def flagship(t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = joined.groupBy("n_name", "c_mktsegment").agg(F.round(F.sum(revenue), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))
    return out.orderBy(F.desc("revenue"), "n_name", "c_mktsegment").limit(10)

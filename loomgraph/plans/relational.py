"""Relational building blocks on the base tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query


@query("rel_j_projection", "SELECT upper(p_name) AS name, p_retailprice * 2 AS doubled, p_size % 3 AS kind FROM part WHERE p_size IN (1, 2, 3) AND p_name LIKE 'c%' AND NOT contains(p_type, 'Z')")
def projection(fx):
    return fx["part"].where(F.col("p_size").isin(1, 2, 3) & F.col("p_name").startswith("c") & ~F.col("p_type").contains("Z")).select(F.upper("p_name").alias("name"), (F.col("p_retailprice") * 2).alias("doubled"), (F.col("p_size") % 3).alias("kind"))


@query("rel_j_conditional", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS class, nullif(p_brand, 'Brand#1') AS brand FROM part")
def conditional(fx):
    size = F.col("p_size")
    return fx["part"].select("p_partkey", F.when(size < 10, "S").when(size < 30, "M").otherwise("L").alias("class"), F.nullif("p_brand", F.lit("Brand#1")).alias("brand"))


@query("rel_j_quantified", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_large, bool_or(o_orderstatus = 'F') AS any_final FROM orders GROUP BY o_custkey")
def quantified(fx):
    return fx["orders"].groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"))


@query("rel_k_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner(fx):
    return fx["nation"].join(fx["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("rel_k_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left(fx):
    by = fx["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return fx["customer"].select("c_custkey").join(by, "c_custkey", "left").fillna(0, ["n"])


@query("rel_k_left_semi", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def left_semi(fx):
    return fx["supplier"].select("s_suppkey").join(fx["lineitem"].where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")


@query("rel_k_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def left_anti(fx):
    return fx["customer"].select("c_custkey").join(fx["orders"].select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("rel_k_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_parts, b.n AS n_suppliers FROM (SELECT p_partkey % 700 AS k, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT s_suppkey * 3 AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full(fx):
    a = fx["part"].groupBy((F.col("p_partkey") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n_parts"))
    b = fx["supplier"].groupBy((F.col("s_suppkey") * 3).alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, "k", "full")


@query("rel_k_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join(fx):
    one = fx["supplier"].select("s_nationkey", F.col("s_suppkey").alias("a"))
    return one.join(one.withColumnRenamed("a", "b"), "s_nationkey").where("a < b").select("a", "b")


@query("rel_k_substring", "SELECT DISTINCT p_name, w FROM part, (VALUES ('red'), ('ring'), ('bolt')) v(w) WHERE contains(p_name, w)")
def substring(fx):
    words = fx.spark.createDataFrame([("red",), ("ring",), ("bolt",)], "w string")
    return fx["part"].select("p_name").distinct().join(F.broadcast(words), F.col("p_name").contains(F.col("w")))  # three words


@query("rel_k_set_overlap", "SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey")
def set_overlap(fx):
    one = fx["lineitem"].select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("a"))
    return one.join(one.withColumnRenamed("a", "b"), ["l_partkey", "l_suppkey"]).where("a < b").select("a", "b").distinct()


@query("rel_k_priority", "SELECT p_partkey, coalesce(arg_min(s_suppkey, pr), -1) AS s FROM part LEFT JOIN (SELECT s_suppkey, s_suppkey AS k, 0 AS pr FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_suppkey * 2, 1 FROM supplier) ON k = p_partkey GROUP BY p_partkey")
def priority(fx):
    s = fx["supplier"].select("s_suppkey")
    keys = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_suppkey").alias("p_partkey"), F.lit(0).alias("pr")).unionByName(s.select("s_suppkey", (F.col("s_suppkey") * 2).alias("p_partkey"), F.lit(1).alias("pr")))
    best = keys.groupBy("p_partkey").agg(F.min_by("s_suppkey", "pr").alias("s"))
    return fx["part"].select("p_partkey").join(best, "p_partkey", "left").fillna(-1, ["s"])


@query("rel_l_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS mean_price, min(l_discount) AS least, max(l_tax) AS most FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def basic(fx):
    rows = fx["lineitem"].where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 2).alias("mean_price"), F.min("l_discount").alias("least"), F.max("l_tax").alias("most"))


@query("rel_l_conditional", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderpriority")
def conditional_count(fx):
    return fx["orders"].groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_distinct("o_custkey").alias("n_customers"))


@query("rel_l_first_last", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def first_last(fx):
    return fx["orders"].groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("first"), F.max_by("o_orderstatus", "o_orderkey").alias("last"))


@query("rel_l_string_agg", "SELECT n_regionkey, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg(fx):
    return fx["nation"].groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ";").alias("names"))


@query("rel_l_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())")
def grouping_sets(fx):
    return fx["customer"].groupingSets([[F.col("c_mktsegment"), F.col("c_nationkey")], [F.col("c_mktsegment")], []], "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("rel_l_pivot", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS n_{s.lower()}" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def pivot(fx):
    wide = fx["orders"].groupBy("o_orderpriority").pivot("o_orderstatus", list("FOP")).agg(F.count(F.lit(1)))
    return wide.fillna(0).select("o_orderpriority", *[F.col(s).alias(f"n_{s.lower()}") for s in "FOP"])


@query("rel_l_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def having(fx):
    return fx["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")


@query("rel_m_row_number", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders QUALIFY r <= 3")
def row_number(fx):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return fx["orders"].select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("r")).where("r <= 3")


@query("rel_m_cumulative", "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running FROM orders")
def cumulative(fx):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return fx["orders"].select("o_custkey", "o_orderkey", F.count(F.lit(1)).over(w).alias("running"))


@query("rel_m_tiers", "SELECT s_suppkey, CASE WHEN r <= 3 THEN 'A' WHEN r <= 6 THEN 'B' ELSE 'C' END AS tier FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)")
def tiers(fx):
    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return fx["supplier"].select("s_suppkey", r.alias("r")).select("s_suppkey", F.when(F.col("r") <= 3, "A").when(F.col("r") <= 6, "B").otherwise("C").alias("tier"))


@query("rel_n_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(fx):
    return fx["orders"].select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("rel_n_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier")
def union(fx):
    return fx["customer"].where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).union(fx["supplier"].select("s_nationkey")).distinct()


@query("rel_n_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def intersect(fx):
    return fx["orders"].select(F.col("o_custkey").alias("k")).intersect(fx["customer"].where("c_nationkey < 5").select("c_custkey"))


@query("rel_n_except_all", "SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber <= 2 EXCEPT ALL SELECT o_orderkey FROM orders")
def except_all(fx):
    return fx["lineitem"].where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k")).exceptAll(fx["orders"].select("o_orderkey"))


@query("rel_o_strings", "SELECT p_partkey, replace(p_name, ' ', '_') AS snake, substr(p_name, 1, 3) AS head, length(p_name) AS n, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, string_split(p_name, ' ')[1] AS first_word FROM part")
def strings(fx):
    return fx["part"].select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("snake"), F.substring("p_name", 1, 3).alias("head"), F.length("p_name").alias("n"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.split("p_name", " ")[0].alias("first_word"))


@query("rel_o_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_value(fx):
    return fx["events"].select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("rel_o_arrays", "SELECT l_orderkey, len(list_distinct(list(l_suppkey))) AS n, list_max(list(l_quantity)) AS most FROM lineitem GROUP BY l_orderkey")
def arrays(fx):
    by = fx["lineitem"].groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("s"), F.collect_list("l_quantity").alias("q"))
    return by.select("l_orderkey", F.size(F.array_distinct("s")).alias("n"), F.array_max("q").alias("most"))


@query("rel_o_math", "SELECT l_orderkey, l_linenumber, least(l_quantity, 20) AS low, greatest(l_quantity, 20) AS high, CAST(floor(l_extendedprice / 7) AS BIGINT) AS whole FROM lineitem WHERE l_linenumber = 3")
def math(fx):
    return fx["lineitem"].where("l_linenumber = 3").select("l_orderkey", "l_linenumber", F.least("l_quantity", F.lit(20.0)).alias("low"), F.greatest("l_quantity", F.lit(20.0)).alias("high"), F.floor(F.col("l_extendedprice") / 7).cast("bigint").alias("whole"))


@query("rel_p_windows", "SELECT status, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(avg(runtime_sec), 3) AS mean_sec FROM fx_runs GROUP BY 1, 2")
def windows(fx):
    """The batch form of the windowed averages over the run feed."""
    from loomgraph.streaming.runs import runtime_windows

    return runtime_windows(fx["fx_runs"]).select("status", "start", "n", F.round("mean_sec", 3).alias("mean_sec"))


@query("rel_p_streamed_windows", "SELECT status, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(avg(runtime_sec), 3) AS mean_sec FROM fx_runs GROUP BY 1, 2")
def streamed_windows(fx):
    """The same over a stream that reads the whole table and stops."""
    from loomgraph.streaming.runs import streamed

    return streamed(fx.spark, fx.sf_dir).select("status", "start", "n", F.round("mean_sec", 3).alias("mean_sec"))


@query("rel_p_sessions", """
WITH e AS (SELECT user_id AS job, event_type AS status, epoch_us(ts) // 1000 AS ms, event_id AS id, value FROM events),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY job, status ORDER BY ms, id) <= 43200000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY job, status ORDER BY ms, id) AS session FROM g)
SELECT job, status, min(ms) AS started, max(ms) AS ended, count(*) AS n, arg_max(id, CAST(ms AS HUGEINT) * 10000000000 + id) AS last_id, arg_max(value, CAST(ms AS HUGEINT) * 10000000000 + id) AS last_value FROM s GROUP BY job, status, session
HAVING max(ms) + 43200000 <= (SELECT max(ms) - 86400000 FROM e)
""")
def sessions(fx):
    """Sessions of runs of each pair that are closed when a stream has read the whole table, with their latest run."""
    from loomgraph.streaming.runs import RUNS
    from loomgraph.streaming.sessions import streamed_sessions

    feed = fx.spark.readStream.schema(RUNS).parquet(f"{fx.sf_dir}/events.parquet*")
    runs = feed.select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")
    return streamed_sessions(fx.spark, runs, ["job", "status"], 43_200_000, "1 day")


@query("rel_k_fan_out", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000")
def fan_out(fx):
    """A row for each match, and one for rows without."""
    large = fx["orders"].where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return fx["customer"].select("c_custkey").join(large, "c_custkey", "left")


@query("rel_k_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross(fx):
    """Every pair of two configured lists, of 5 and 25 rows."""
    return fx["region"].select("r_name").crossJoin(F.broadcast(fx["nation"].select("n_name")))


@query("rel_l_ordered_collect", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY o_custkey")
def ordered_collect(fx):
    """Distinct values in the order of their first rows; the values are distinct before they are gathered."""
    first = fx["orders"].groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    by = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority"))).alias("p"))
    return by.select("o_custkey", F.array_join(F.transform("p", lambda x: x["o_orderpriority"]), ",").alias("priorities"))


@query("rel_m_nesting", "SELECT l_orderkey, l_linenumber, CAST(sum(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM lineitem")
def nesting(fx):
    """Running depth: openings less closings up to each row."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return fx["lineitem"].select("l_orderkey", "l_linenumber", F.sum(step).over(w).alias("depth"))


@query("rel_o_map", "SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' ELSE 'other' END AS side, CAST(2 AS INTEGER) AS n_keys FROM nation")
def maps(fx):
    """A lookup in a map, with a default."""
    sides = F.create_map(F.lit(0), F.lit("south"), F.lit(1), F.lit("west"))
    return fx["nation"].select("n_nationkey", "n_name", F.coalesce(F.try_element_at(sides, F.col("n_regionkey").cast("int")), F.lit("other")).alias("side"), F.size(F.map_keys(sides)).alias("n_keys"))


@query("rel_o_dates", "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('month', ts), '%Y-%m-%d') AS first FROM events")
def dates(fx):
    return fx["events"].select("event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("first"))

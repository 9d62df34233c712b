"""Relational primitives as queries on the star-schema tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.sources import tables

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


@query("SELECT l_orderkey, l_partkey AS part, l_quantity * l_extendedprice AS gross, 5 AS h3_res FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def s1_scan_project(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").filter(F.col("l_quantity").between(10, 20)).select("l_orderkey", F.col("l_partkey").alias("part"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("gross"), F.lit(5).alias("h3_res"))


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events WHERE (CASE WHEN event_type <> 'click' THEN event_type END) IS NOT NULL")
def p4_not_null(spark, sf_dir):
    kind = F.when(F.col("event_type") != "click", F.col("event_type"))
    return t(spark, sf_dir, "events").select("event_id", kind.alias("kind")).filter("kind is not null")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 45 OR p_retailprice < 950")
def p6_or_filter(spark, sf_dir):
    return t(spark, sf_dir, "part").filter((F.col("p_size") >= 45) | (F.col("p_retailprice") < 950)).select("p_partkey", "p_size", "p_retailprice")


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE
(o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 100000) OR (o_orderstatus = 'O' AND o_totalprice BETWEEN 50000 AND 200000) OR (o_orderstatus = 'P' AND o_totalprice >= 300000)""")
def p7_keyed_thresholds(spark, sf_dir):
    bounds = {"F": (1000, 100000), "O": (50000, 200000), "P": (300000, 10**12)}
    ok = F.lit(False)
    for status, (low, high) in bounds.items():
        ok = ok | ((F.col("o_orderstatus") == status) & F.col("o_totalprice").between(low, high))
    return t(spark, sf_dir, "orders").filter(ok).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT p_partkey, p_brand, p_type, p_name FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_brand NOT IN ('Brand#1', 'Brand#2') AND p_name LIKE 's%'")
def p8_in_like(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.filter(F.col("p_type").isin("ECONOMY", "STANDARD") & ~F.col("p_brand").isin("Brand#1", "Brand#2") & F.col("p_name").like("s%")).select("p_partkey", "p_brand", "p_type", "p_name")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def p10_point_lookup(spark, sf_dir):
    return t(spark, sf_dir, "customer").filter("c_custkey = 42").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events WHERE value > 100 GROUP BY user_id) WHERE list_contains(kinds, 'error') AND len(kinds) >= 3")
def p11_any_of_list(spark, sf_dir):
    kinds = t(spark, sf_dir, "events").filter("value > 100").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.filter(F.array_contains("kinds", "error") & (F.size("kinds") >= 3)).select("user_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS size_class,
l_discount / NULLIF(l_tax, 0) AS ratio, COALESCE(l_discount / NULLIF(l_tax, 0), -1) AS ratio_or FROM lineitem""")
def p14_case_coalesce_nullif(spark, sf_dir):
    ratio = F.col("l_discount") / F.nullif(F.col("l_tax"), F.lit(0.0))
    size = F.when(F.col("l_quantity") >= 40, "large").when(F.col("l_quantity") >= 20, "medium").otherwise("small")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", size.alias("size_class"), ratio.alias("ratio"), F.coalesce(ratio, F.lit(-1.0)).alias("ratio_or"))


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM (SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region)")
def s3_multi_file_union_by_name(spark, sf_dir):
    # a glob over files of different columns
    both = tables.parquet(spark, f"{sf_dir}/{{nation,region}}.parquet", merge=True)
    return both.select("n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name")


@query("SELECT COUNT(DISTINCT user_id) AS distinct_user_id FROM events")
def s12_distinct_probe(spark, sf_dir):
    return tables.distinct_count(t(spark, sf_dir, "events"), "user_id")


@query("SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def a2_count_distinct(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT l_returnflag, COUNT(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) AS big_parts,
COUNT(DISTINCT CASE WHEN l_quantity <= 40 THEN l_partkey END) AS small_parts FROM lineitem GROUP BY l_returnflag""")
def a3_filtered_distinct(spark, sf_dir):
    big = F.col("l_quantity") > 40
    once = t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.bool_or(big).alias("big"), F.bool_or(~big).alias("small"))
    return once.groupBy("l_returnflag").agg(F.count_if("big").alias("big_parts"), F.count_if("small").alias("small_parts"))


@query("SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(CASE WHEN value > 50 THEN 1 END) AS high FROM events GROUP BY user_id")
def a4_count_filter(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("high"))


@query("SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS total, MIN(l_quantity) AS least, MAX(l_quantity) AS most, ROUND(AVG(l_discount), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def a6_sum_min_max_avg(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem")
def a17_global(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT l_returnflag, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median FROM lineitem GROUP BY l_returnflag")
def a9_exact_median(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("median"))


@query("""SELECT user_id, MIN(event_type) AS top FROM (SELECT *, MAX(n) OVER (PARTITION BY user_id) AS most FROM
(SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL)) WHERE n = most GROUP BY user_id""")
def a10_mode(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("top"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id")
def a12_sorted_distinct_list(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY event_id), ',') AS path FROM events WHERE value > 60 GROUP BY user_id")
def a13_ordered_array(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return t(spark, sf_dir, "events").filter("value > 60").groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda p: p["event_type"]), ",").alias("path"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def a14_first_by(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


@query("SELECT user_id, BOOL_OR(value > 300) AS any_high, BOOL_AND(value > 0) AS all_positive FROM events GROUP BY user_id")
def a15_bool_or(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 300).alias("any_high"), F.bool_and(F.col("value") > 0).alias("all_positive"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def a16_distinct(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("""SELECT user_id, ROUND(SUM(total), 4) AS total, CAST(SUM(n) AS BIGINT) AS n FROM
(SELECT user_id, CAST(ts AS DATE) AS day, SUM(value) AS total, COUNT(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def a18_partial_final(spark, sf_dir):
    daily = t(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return daily.groupBy("user_id").agg(F.round(F.sum("total"), 4).alias("total"), F.sum("n").alias("n"))


@query("SELECT c.c_custkey, c.c_name, c.c_nationkey, COUNT(*) AS orders FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name, c.c_nationkey")
def a19_group_by_key(spark, sf_dir):
    counts = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return t(spark, sf_dir, "customer").join(counts, "c_custkey").select("c_custkey", "c_name", "c_nationkey", "orders")


@query("SELECT CAST(FLOOR(value / 50) AS BIGINT) AS bin, COUNT(*) AS n FROM events GROUP BY 1")
def a20_group_by_expression(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.floor(F.col("value") / 50).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT event_id, LAG(event_type) OVER w AS prev_type, epoch_us(ts) - LAG(epoch_us(ts)) OVER w AS gap_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def w1_lag(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.lag("event_type").over(w).alias("prev_type"), (F.col("us") - F.lag("us").over(w)).alias("gap_us"))


@query("SELECT event_id, CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS BIGINT) AS high_so_far FROM events")
def w3_running_sum_range(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("date"))
    return t(spark, sf_dir, "events").select("event_id", F.sum((F.col("value") > 50).cast("int")).over(w).alias("high_so_far"))


@query("SELECT n_nationkey, CAST(SUM(n_regionkey) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM nation")
def w4_running_sum_rows(spark, sf_dir):
    w = Window.orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf_dir, "nation").select("n_nationkey", F.sum("n_regionkey").over(w).alias("running"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS s FROM events),
g AS (SELECT *, s - LAG(s) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS gap FROM e)
SELECT event_id, CAST(SUM(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS BIGINT) AS group_id FROM g""")
def w5_w6_gap_groups(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    e = t(spark, sf_dir, "events").withColumn("s", epoch("ts")).withColumn("gap", F.col("s") - F.lag("s").over(w))
    return e.select("event_id", F.sum((F.col("gap").isNull() | (F.col("gap") > 86400)).cast("int")).over(w).alias("group_id"))


@query("SELECT o.o_orderkey, l.l_linenumber, l.l_quantity, o.o_orderpriority FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'P'")
def j1_inner(spark, sf_dir):
    o = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return t(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity", "o_orderpriority")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j2_semi(spark, sf_dir):
    big = t(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return t(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_regionkey / total AS share FROM nation CROSS JOIN (SELECT CAST(SUM(n_regionkey) AS DOUBLE) AS total FROM nation)")
def j3_cross_one_row(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    one = n.agg(F.sum("n_regionkey").cast("double").alias("total"))  # one row by construction
    return n.crossJoin(F.broadcast(one)).select("n_nationkey", (F.col("n_regionkey") / F.col("total")).alias("share"))


@query("""WITH a AS (SELECT l_partkey AS k, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, COUNT(*) AS m FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT COALESCE(a.k, b.k) AS k, COALESCE(n, 0) AS n, COALESCE(m, 0) AS m FROM a FULL OUTER JOIN b ON a.k = b.k""")
def j5_full_outer(spark, sf_dir):
    # both sides are reduced by the join's key first, so the join reuses their partitioning
    line = t(spark, sf_dir, "lineitem")
    count = lambda rows, key, name: rows.groupBy(F.col("l_partkey").alias(key)).agg(F.count("*").alias(name))
    a, b = count(line.filter("l_returnflag = 'R'"), "ka", "n"), count(line.filter("l_quantity > 45"), "kb", "m")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias("k"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def j6_left(spark, sf_dir):
    o = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey, (SELECT MIN(o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS first_priority FROM customer""")
def j8_correlated(spark, sf_dir):
    t(spark, sf_dir, "orders").createOrReplaceTempView("j8_orders")
    t(spark, sf_dir, "customer").createOrReplaceTempView("j8_customer")
    return spark.sql("SELECT c_custkey, (SELECT MIN(o_orderpriority) FROM j8_orders WHERE o_custkey = c_custkey) AS first_priority FROM j8_customer")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def o5_topk_offset(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u3_union_distinct(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(t(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""SELECT p_partkey, GREATEST(p_size, 25) AS hi, LEAST(p_size, 25) AS lo, CAST(CEIL(p_retailprice / 7) AS BIGINT) AS up, CAST(FLOOR(p_retailprice / 7) AS BIGINT) AS down,
ROUND(p_retailprice / 3, 2) AS third, ROUND(ASIN(SQRT(POWER(SIN(RADIANS(p_size)), 2) * COS(RADIANS(p_size / 2)))), 6) AS angle, p_size / 4 AS quarter FROM part""")
def f_math(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    angle = F.asin(F.sqrt(F.pow(F.sin(F.radians(size)), 2) * F.cos(F.radians(size / 2))))
    return t(spark, sf_dir, "part").select("p_partkey", F.greatest(size, F.lit(25)).alias("hi"), F.least(size, F.lit(25)).alias("lo"), F.ceil(price / 7).alias("up"), F.floor(price / 7).alias("down"), F.round(price / 3, 2).alias("third"), F.round(angle, 6).alias("angle"), (size / 4).alias("quarter"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) || '_' || CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS day, TRY_CAST(event_type AS INTEGER) AS not_a_number,
'https://map.example/?user=' || CAST(user_id AS VARCHAR) || '&day=' || strftime(ts, '%Y-%m-%d') AS url FROM events""")
def f_string_date(spark, sf_dir):
    day, user = F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string")
    return t(spark, sf_dir, "events").select("event_id", F.concat_ws("_", user, F.col("event_id").cast("string")).alias("id"), day.alias("day"), F.col("event_type").try_cast("int").alias("not_a_number"), F.concat(F.lit("https://map.example/?user="), user, F.lit("&day="), day).alias("url"))


@query("""WITH l AS (SELECT user_id, list(CASE WHEN event_type <> 'click' THEN event_type END ORDER BY event_id) AS kinds, list(value ORDER BY event_id) AS vs FROM events GROUP BY user_id)
SELECT user_id, len(list_filter(vs, lambda v: v > 50)) AS high, vs[1] AS first_value, vs[5] AS fifth, vs[-1] AS last_value, vs[5000] AS missing,
array_to_string(list_sort(list_distinct(kinds)), ',') AS kinds, ROUND(list_sum(list_transform(vs, lambda v: v * 2)), 4) AS doubled FROM l""")
def f_hof_list(spark, sf_dir):
    kind = F.when(F.col("event_type") != "click", F.col("event_type"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value", kind.alias("kind"))))
    users = t(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("r"))
    vs, kinds = F.transform("r", lambda x: x["value"]), F.array_compact(F.transform("r", lambda x: x["kind"]))
    doubled = F.aggregate(F.transform("vs", lambda v: v * 2), F.lit(0.0), lambda a, v: a + v)
    at = lambda i: F.try_element_at("vs", F.lit(i))
    return users.select("user_id", vs.alias("vs"), kinds.alias("ks")).select("user_id", F.size(F.filter("vs", lambda v: v > 50)).cast("long").alias("high"), at(1).alias("first_value"), at(5).alias("fifth"), at(-1).alias("last_value"), at(5000).alias("missing"), F.array_join(F.array_sort(F.array_distinct("ks")), ",").alias("kinds"), F.round(doubled, 4).alias("doubled"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY ALL)
SELECT user_id, array_to_string(list_sort(list_distinct(flatten(list(kinds)))), ',') AS kinds, len(flatten(list(kinds))) AS votes FROM d GROUP BY user_id""")
def f_flatten(spark, sf_dir):
    daily = t(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.collect_set("event_type").alias("kinds"))
    lists = daily.groupBy("user_id").agg(F.flatten(F.collect_list("kinds")).alias("all"))
    return lists.select("user_id", F.array_join(F.array_sort(F.array_distinct("all")), ",").alias("kinds"), F.size("all").cast("long").alias("votes"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_object('id', event_id, 'type', event_type, 'missing', NULL)::VARCHAR AS js FROM events""")
def f_json_object(spark, sf_dir):
    js = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("missing")), {"ignoreNullFields": "false"})
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), js.alias("js"))


@query("SELECT user_id, unnest(kinds) AS kind FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)")
def f_unnest(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds")).select("user_id", F.explode("kinds").alias("kind"))

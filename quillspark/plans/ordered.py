"""Queries of ordered analytics on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered as o
from ..sources.tables import load

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query("""
WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM orders),
l AS (SELECT o_custkey AS c, l_shipdate, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey AS cust, s.o_orderkey AS owner, count(c)::BIGINT AS n, coalesce(sum(l_quantity::DECIMAL(18,2)), 0)::DOUBLE AS qty
FROM s LEFT JOIN l ON c = o_custkey AND l_shipdate >= o_orderdate AND (e IS NULL OR l_shipdate < e) GROUP BY 1, 2""")
def span_assign(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    spans = o.span_lead(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    points = load(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", "l_shipdate", "l_quantity")
    owned = o.span_assign(spans, points, "o_custkey", "o_orderdate", "span_end", "l_shipdate").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))
    return spans.join(owned, "o_orderkey", "left").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("owner"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("qty"))


@query("""SELECT o_orderkey, o_custkey, o_orderdate::DATE::VARCHAR AS start_date, (min(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING))::DATE::VARCHAR AS end_date FROM orders""")
def span_lead(spark, d):
    spans = o.next_distinct(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate")
    return spans.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("start_date"), F.col("span_end").cast("date").cast("string").alias("end_date"))


@query("""
SELECT o_orderkey, d::VARCHAR AS first_day, greatest(coalesce(lead(d) OVER w - 1, DATE '2002-12-31'), d)::VARCHAR AS last_day,
  coalesce(lead(d) OVER w - 1 < d + 30, false) AS short FROM (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey)""")
def implicit_end(spark, d):
    days = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    ends = o.span_lead(days, ["o_custkey"], "d", ["o_orderkey"]).withColumn("e", F.date_sub("span_end", 1))
    return ends.select("o_orderkey", F.col("d").cast("string").alias("first_day"), F.greatest(F.coalesce("e", F.lit("2002-12-31").cast("date")), F.col("d")).cast("string").alias("last_day"), F.coalesce(F.col("e") < F.date_add("d", 30), F.lit(False)).alias("short"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderpriority, date_diff('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS len, o_totalprice FROM orders)
SELECT o_orderkey, len::BIGINT AS len, CASE WHEN len < 30 AND o_totalprice < 50000 THEN 'short,small' WHEN len < 30 THEN 'short' ELSE 'small' END AS reasons FROM s WHERE len < 30 OR o_totalprice < 50000""")
def suspect_spans(spark, d):
    s = o.span_lead(load(spark, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).withColumn("len", F.datediff("span_end", "o_orderdate"))
    reasons = F.array_compact(F.array(F.when(F.col("len") < 30, "short"), F.when(F.col("o_totalprice") < 50000, "small")))
    return s.withColumn("r", reasons).filter(F.size("r") > 0).select("o_orderkey", F.col("len").cast("long").alias("len"), F.array_join("r", ",").alias("reasons"))


@query("""
WITH s AS (SELECT DISTINCT l_suppkey, l_partkey AS a, l_partkey + l_linenumber AS b FROM lineitem),
p AS (SELECT l_suppkey, a, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s)
SELECT l_suppkey, (e + 1)::BIGINT AS gap_first, (a - 1)::BIGINT AS gap_last FROM p WHERE a > e + 1""")
def range_gaps(spark, d):
    s = load(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("a"), F.expr("l_partkey + l_linenumber").alias("b")).distinct()
    return o.range_gaps(s, ["l_suppkey"], "a", "b")


@query("""SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS delta FROM events QUALIFY delta <> 0""")
def adjacent_delta(spark, d):
    w = o.by(["user_id"], "ts", "event_id")
    return load(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") - F.lag("value").over(w), 4).alias("delta")).filter("delta <> 0")


@query("""
SELECT user_id, min_by(event_id, (ts, event_id)) AS offender, count(*)::BIGINT AS n FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE value <= p GROUP BY user_id""")
def order_violation(spark, d):
    w = o.by(["user_id"], "ts", "event_id")
    bad = load(spark, d, "events").withColumn("p", F.lag("value").over(w)).filter("value <= p")
    return bad.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("offender"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT user_id, round(avg(CASE WHEN value > p THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY user_id""")
def increasing_fraction(spark, d):
    w = o.by(["user_id"], "ts", "event_id")
    return load(spark, d, "events").withColumn("p", F.lag("value").over(w)).filter("p is not null").groupBy("user_id").agg(F.round(F.avg(F.when(F.col("value") > F.col("p"), 1.0).otherwise(0.0)), 6).alias("share"))


@query("""
WITH i AS (SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
  FROM (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)),
k AS (SELECT DISTINCT user_id, g, event_type FROM i)
SELECT i.event_id, a.event_type AS before, b.event_type AS after FROM i LEFT JOIN k a ON a.user_id = i.user_id AND a.g = i.g - 1 LEFT JOIN k b ON b.user_id = i.user_id AND b.g = i.g + 1""")
def prev_next_distinct(spark, d):
    i = o.islands(load(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    k = i.select("user_id", "island", "event_type").distinct()
    w = o.by(["user_id"], "island")
    k = k.withColumn("before", F.lag("event_type").over(w)).withColumn("after", F.lead("event_type").over(w)).drop("event_type")
    return i.join(k, ["user_id", "island"]).select("event_id", "before", "after")


@query("""
SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), lambda x: x <> event_type))), ',') AS near FROM events""")
def centered_frame(spark, d):
    near = F.collect_list("event_type").over(o.by(["user_id"], "ts", "event_id").rowsBetween(-3, 3))
    e = load(spark, d, "events").withColumn("near", near)
    return e.select("event_id", F.array_join(F.array_sort(F.array_distinct(F.filter("near", lambda x: x != F.col("event_type")))), ",").alias("near"))


@query("""
WITH i AS (SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, event_type, min(event_id) AS first_event, count(*)::BIGINT AS n FROM i GROUP BY user_id, g, event_type HAVING count(*) >= 3""")
def islands_min_run(spark, d):
    i = o.islands(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return i.groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")).filter("n >= 3").drop("island")


@query("""
WITH s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, g::BIGINT AS session, count(*)::BIGINT AS n, min(event_id) AS first_event, round(sum(value::DECIMAL(18,2))::DOUBLE, 2) AS total FROM s GROUP BY user_id, g""")
def sessionize(spark, d):
    s = o.sessions(load(spark, d, "events"), ["user_id"], "ts", ["event_id"], 1800)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("""
WITH i AS (SELECT *, sum(CASE WHEN o_orderstatus IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS g
  FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders))
SELECT o_custkey, o_orderstatus, g::BIGINT AS grp, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM i GROUP BY o_custkey, o_orderstatus, g""")
def consecutive_groups(spark, d):
    i = o.islands(load(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "grp")
    rows = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return i.groupBy("o_custkey", "o_orderstatus", "grp").agg(rows.alias("r")).select("o_custkey", "o_orderstatus", "grp", F.array_join(F.transform("r", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("""
WITH i AS (SELECT *, sum(CASE WHEN l_returnflag IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS g
  FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem))
SELECT l_orderkey, string_agg(l_returnflag || n, '' ORDER BY g) AS runs FROM (SELECT l_orderkey, g, l_returnflag, count(*) AS n FROM i GROUP BY 1, 2, 3) GROUP BY l_orderkey""")
def run_length(spark, d):
    i = o.islands(load(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag")
    runs = i.groupBy("l_orderkey", "island", "l_returnflag").count()
    return runs.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("island", F.concat("l_returnflag", F.col("count").cast("string")).alias("t")))).alias("r")).select("l_orderkey", F.array_join(F.col("r.t"), "").alias("runs"))


@query("""SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderstatus) > 1 THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) END::BIGINT AS occurrence FROM orders""")
def number_repeats(spark, d):
    return o.number_repeats(load(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("occurrence").cast("long").alias("occurrence"))


@query("""
SELECT o_custkey, o_orderkey, running::DOUBLE AS running FROM (SELECT *, sum(o_totalprice::DECIMAL(18,2)) OVER w AS running, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE running <= 500000 OR n = 1""")
def running_budget(spark, d):
    orders = load(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return o.running_budget(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "price", 500000).select("o_custkey", "o_orderkey", F.col("running").cast("double").alias("running"))


@query("""SELECT o_orderkey, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row, n::BIGINT AS n
FROM (SELECT o_orderkey, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def running_offset(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(n, "o_orderkey", "left").fillna(0, ["n"])
    w = o.by(["o_custkey"], "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("o_orderkey", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first_row"), "n")


@query("""
SELECT o_orderkey, r = 1 AS winner, CASE WHEN r > 1 THEN 'kept ' || k END AS note FROM (SELECT o_orderkey, row_number() OVER w AS r, first_value(o_orderkey) OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey))""")
def winner_demote(spark, d):
    w = o.by(["o_custkey", "o_orderstatus"], F.desc("o_totalprice"), "o_orderkey")
    r = load(spark, d, "orders").withColumn("r", F.row_number().over(w)).withColumn("k", F.first("o_orderkey").over(w))
    return r.select("o_orderkey", (F.col("r") == 1).alias("winner"), F.when(F.col("r") > 1, F.concat(F.lit("kept "), F.col("k").cast("string"))).alias("note"))


@query("""SELECT user_id, event_id, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS place FROM events) WHERE place <= 4""")
def topk_group(spark, d):
    return o.top_k(load(spark, d, "events"), ["user_id"], [F.desc_nulls_last("value"), F.asc("event_id")], 4).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("""
WITH e AS (SELECT *, sum(CASE event_type WHEN 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events WHERE event_type IN ('view', 'purchase')),
s AS (SELECT user_id, g, min(event_id) FILTER (event_type = 'view') AS start_id, min_by(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS stop_id FROM e GROUP BY user_id, g)
SELECT user_id, start_id, stop_id, CASE WHEN start_id IS NULL THEN 'unmatched stop' WHEN stop_id IS NULL THEN 'open' ELSE 'paired' END AS state FROM s""")
def pair_start_stop(spark, d):
    e = load(spark, d, "events").filter("event_type in ('view', 'purchase')")
    g = e.withColumn("g", F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).over(o.by(["user_id"], "ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    s = g.groupBy("user_id", "g").agg(F.min(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("start_id"), F.min(stop)["event_id"].alias("stop_id"))
    return s.select("user_id", "start_id", "stop_id", F.when(F.col("start_id").isNull(), "unmatched stop").when(F.col("stop_id").isNull(), "open").otherwise("paired").alias("state"))


@query("""
SELECT event_id, strftime((SELECT min(ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts >= e.ts), '%Y-%m-%d %H:%M:%S') AS next_purchase FROM events e WHERE event_type = 'click'""")
def asof_forward(spark, d):
    e = load(spark, d, "events")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("next_ts"))
    out = o.as_of_forward(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "next_ts", "next_purchase")
    return out.select("event_id", F.date_format(F.col("next_purchase"), "yyyy-MM-dd HH:mm:ss").alias("next_purchase"))


@query("""SELECT event_id, (SELECT max_by(x.event_id, (x.ts, x.event_id)) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view' AND x.ts <= e.ts) AS last_view FROM events e WHERE event_type = 'purchase'""")
def asof_backward(spark, d):
    e = load(spark, d, "events")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return o.as_of_backward(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "view_id", "last_view").select("event_id", "last_view")


@query("""
WITH l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT doc_id, i::BIGINT AS line_no, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l""")
def section_carry(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    heading = F.last(F.when(F.length("line") < 40, F.col("line")), ignorenulls=True).over(o.by(["doc_id"], "i").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), heading.alias("heading"))


@query("""SELECT user_id, min(gap)::BIGINT AS least_us, bool_or(gap < 60000000) AS close FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id""")
def min_gap(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    gaps = load(spark, d, "events").select("user_id", (us(F.col("ts")) - us(F.lag("ts").over(o.by(["user_id"], "ts", "event_id")))).alias("gap")).filter("gap is not null")
    return gaps.groupBy("user_id").agg(F.min("gap").alias("least_us"), F.bool_or(F.col("gap") < 60_000_000).alias("close"))

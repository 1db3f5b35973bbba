"""Queries of aggregations, sets and sorts on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grouped as g
from ..sources.tables import load

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def counted():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


@query("SELECT n_nationkey, n_name, count(s_suppkey)::BIGINT AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1, 2")
def zero_fill_count(spark, d):
    s = load(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return g.zero_filled(load(spark, d, "nation").select("n_nationkey", "n_name"), s, "n_nationkey")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS final, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS pending, count(*)::BIGINT AS total FROM orders GROUP BY 1""")
def conditional_counts(spark, d):
    s = F.col("o_orderstatus")
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("final"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("pending"), counted().alias("total"))


@query("""SELECT key, array_to_string(list(DISTINCT p_partkey ORDER BY p_partkey), ',') AS rows, count(DISTINCT p_partkey)::BIGINT AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS key FROM part) GROUP BY key""")
def inverted_index(spark, d):
    t = g.inverted(load(spark, d, "part"), F.split("p_name", " "), F.col("p_partkey"))
    return t.select("key", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"), "n")


@query("""
WITH p AS (SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_type LIKE 'ECON%' THEN 'economy' ELSE 'other' END AS section, p_brand, p_partkey FROM part)
SELECT section, p_brand, count(*)::BIGINT AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS parts FROM p GROUP BY 1, 2""")
def two_level_group(spark, d):
    section = F.when(F.col("p_size") < 10, "small").when(F.col("p_type").startswith("ECON"), "economy").otherwise("other")
    t = load(spark, d, "part").groupBy(section.alias("section"), "p_brand").agg(counted().alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("p"))
    return t.select("section", "p_brand", "n", F.array_join(F.col("p").cast("array<string>"), ",").alias("parts"))


@query("""
WITH v AS (SELECT l_suppkey, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY l_suppkey) AS t FROM v)
SELECT l_suppkey, v::BIGINT AS l_linenumber, n::BIGINT AS votes, round(n / t, 6) AS share, (t - n)::BIGINT AS disagree FROM r WHERE k = 1""")
def mode_vote(spark, d):
    t = g.mode_vote(load(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber")
    return t.select("l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "votes", F.round("share", 6).alias("share"), "disagree")


@query("""SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS single, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY 1""")
def single_value_guard(spark, d):
    one = F.min("l_returnflag") == F.max("l_returnflag")
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(one.alias("single"), F.when(one, F.min("l_returnflag")).alias("flag"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, d):
    return g.duplicates(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, min_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1, 2")
def keep_first(spark, d):
    return g.keep_first(load(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query("""SELECT coalesce(o_orderpriority, '(all)') AS priority, coalesce(o_orderstatus, '(all)') AS status, count(*)::BIGINT AS total, count(*) FILTER (o_totalprice > 100000)::BIGINT AS matched FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def coverage_rollup(spark, d):
    t = load(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(counted().alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("matched"))
    return t.select(F.coalesce("o_orderpriority", F.lit("(all)")).alias("priority"), F.coalesce("o_orderstatus", F.lit("(all)")).alias("status"), "total", "matched")


@query("""SELECT coalesce(l_returnflag, '(all)') AS flag, coalesce(l_linestatus, '(all)') AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def coverage_cube(spark, d):
    t = load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(counted().alias("n"))
    return t.select(F.coalesce("l_returnflag", F.lit("(all)")).alias("flag"), F.coalesce("l_linestatus", F.lit("(all)")).alias("status"), "n")


@query("""SELECT l_orderkey, CASE WHEN bool_and(v IS NOT NULL) THEN min(v) END::BIGINT AS lo, CASE WHEN bool_and(v IS NOT NULL) THEN max(v) END::BIGINT AS hi FROM (SELECT l_orderkey, CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END AS v FROM lineitem) GROUP BY 1""")
def span_agg(spark, d):
    v = load(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("v"))
    whole = F.bool_and(F.col("v").isNotNull())
    return v.groupBy("l_orderkey").agg(F.when(whole, F.min("v")).alias("lo"), F.when(whole, F.max("v")).alias("hi"))


@query("""SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'O') THEN 'hidden' WHEN bool_or(l_returnflag = 'R') THEN 'chant' ELSE 'voice' END AS role FROM lineitem GROUP BY 1""")
def bool_and_role(spark, d):
    role = F.when(F.bool_and(F.col("l_linestatus") == "O"), "hidden").when(F.bool_or(F.col("l_returnflag") == "R"), "chant").otherwise("voice")
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(role.alias("role"))


@query("""SELECT user_id, count(*)::BIGINT AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 3""")
def recent_groups(spark, d):
    # the limit is the feature: the three newest groups
    t = load(spark, d, "events").groupBy("user_id").agg(counted().alias("n"), F.max("ts").alias("ts")).orderBy(F.desc("ts"), "user_id").limit(3)
    return t.select("user_id", "n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("""SELECT o_orderstatus, o_orderdate::DATE::VARCHAR AS batch, count(*)::BIGINT AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1, 2""")
def queue_groups(spark, d):
    t = load(spark, d, "orders").groupBy("o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("batch")).agg(counted().alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return t.select("o_orderstatus", "batch", "n", F.array_join(F.col("k").cast("array<string>"), ",").alias("keys"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING)::BIGINT AS recent FROM events""")
def trailing_count(spark, d):
    e = load(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, -1)).alias("recent"))


@query("""
WITH o AS (SELECT o_orderstatus || '|' || o_orderpriority AS opt, min(o_orderkey) AS first FROM orders GROUP BY 1), i AS (SELECT opt, row_number() OVER (ORDER BY first) AS id FROM o)
SELECT id::BIGINT AS id, o_orderdate::DATE::VARCHAR AS day, count(*)::BIGINT AS n FROM orders JOIN i ON opt = o_orderstatus || '|' || o_orderpriority GROUP BY 1, 2""")
def group_dates(spark, d):
    orders = load(spark, d, "orders").withColumn("opt", F.concat_ws("|", "o_orderstatus", "o_orderpriority"))
    # the options are a few combinations of two short code lists; only their ids are numbered in one task
    ids = orders.groupBy("opt").agg(F.min("o_orderkey").alias("first")).withColumn("id", F.row_number().over(Window.orderBy("first")).cast("long"))
    return orders.groupBy("opt", F.col("o_orderdate").cast("date").cast("string").alias("day")).agg(counted().alias("n")).join(ids, "opt").select("id", "day", "n")


@query("""SELECT p_brand, array_to_string(list(DISTINCT p_type ORDER BY p_type), ',') AS types FROM part GROUP BY 1""")
def group_collect(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("""SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1""")
def percentile_disc(spark, d):
    """Exact nearest-rank percentiles from counts, by cells first."""
    return g.percentiles(load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95})


@query("""SELECT 'customer' AS kind, count(*)::BIGINT AS n, count(*) FILTER (c_acctbal < 0)::BIGINT AS flagged FROM customer UNION ALL SELECT 'supplier', count(*), count(*) FILTER (s_acctbal < 0) FROM supplier UNION ALL SELECT 'order', count(*), count(*) FILTER (o_orderstatus = 'P') FROM orders""")
def kind_counts(spark, d):
    one = lambda t, kind, flag: load(spark, d, t).agg(counted().alias("n"), F.count_if(F.expr(flag)).alias("flagged")).select(F.lit(kind).alias("kind"), "n", "flagged")
    return one("customer", "customer", "c_acctbal < 0").unionByName(one("supplier", "supplier", "s_acctbal < 0")).unionByName(one("orders", "order", "o_orderstatus = 'P'"))


@query("""SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def latest_by_key(spark, d):
    at = F.struct("ts", "event_id")
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("value", at).alias("value"))


@query("""SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' ELSE 'N' END AS worst FROM lineitem GROUP BY 1""")
def worst_status(spark, d):
    return g.worst_status(load(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", ["R", "A", "N"])


@query("""SELECT o_custkey, o_orderpriority, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_key FROM orders GROUP BY 1, 2""")
def merge_variants(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("years"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, 'big' AS feature FROM lineitem WHERE l_quantity > 48 UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 'cut' FROM lineitem WHERE l_discount >= 0.1 UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 'taxed' FROM lineitem WHERE l_tax >= 0.08""")
def feature_rows(spark, d):
    """One pass over the table: an array of the features that hold, exploded."""
    of = F.array_compact(F.array(F.when(F.col("l_quantity") > 48, "big"), F.when(F.col("l_discount") >= 0.1, "cut"), F.when(F.col("l_tax") >= 0.08, "taxed")))
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.explode(of).alias("feature"))


@query("""SELECT o_orderpriority, o_orderkey, turn::BIGINT AS turn FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey) AS turn FROM orders) WHERE turn <= 5""")
def strata_sample(spark, d):
    return g.strata_sample(load(spark, d, "orders"), "o_orderpriority", F.col("o_orderkey"), 5).select("o_orderpriority", "o_orderkey", F.col("turn").cast("long").alias("turn"))


@query("""SELECT o_orderkey FROM orders ORDER BY sha256('7:' || o_orderkey), o_orderkey LIMIT 50""")
def seeded_sample(spark, d):
    return load(spark, d, "orders").select("o_orderkey").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string")), 256), "o_orderkey").limit(50)


# ---- sets ----


@query("""(SELECT 'extra' AS side, k, count(*)::BIGINT AS n FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY k)
UNION ALL (SELECT 'missing', k, count(*) FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY k)""")
def except_all(spark, d):
    """Multiset difference both ways by one aggregate of signed counts: no row is repeated."""
    l = load(spark, d, "lineitem").filter("l_returnflag in ('R', 'A')").groupBy(F.col("l_partkey").alias("k")).agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(-1)).alias("x")).filter("x <> 0")
    return l.select(F.when(F.col("x") > 0, "extra").otherwise("missing").alias("side"), "k", F.abs("x").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END IS NOT DISTINCT FROM o_orderstatus AS current FROM orders WHERE o_orderkey % 3 = 0""")
def current_lapsed(spark, d):
    """Confirmations (rule-made) are current while the value that they saw is the base's value."""
    base = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    seen = base.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("seen"))
    return seen.join(base, "o_orderkey").select("o_orderkey", F.col("seen").eqNullSafe(F.col("o_orderstatus")).alias("current"))


@query("""SELECT o_orderkey, o_orderstatus AS value FROM orders WHERE o_orderkey % 97 = 0 AND o_orderstatus = 'F'""")
def noop_rows(spark, d):
    base = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value"))
    overlay = load(spark, d, "orders").filter("o_orderkey % 97 = 0").select("o_orderkey", F.lit("F").alias("value"))
    return overlay.intersect(base)


@query("""SELECT count(*)::BIGINT AS missing, count(*) = 0 AS superset FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def superset_gate(spark, d):
    a = load(spark, d, "lineitem").filter("l_quantity > 25").select("l_suppkey").distinct()
    missing = a.join(load(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_anti")
    return missing.agg(counted().alias("missing"), (counted() == 0).alias("superset"))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def union_distinct(spark, d):
    return load(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("k")).union(load(spark, d, "part").filter("p_size < 5").select("p_partkey")).distinct()


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set_except(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(load(spark, d, "lineitem").filter("l_quantity > 40").select("l_partkey").distinct()).distinct()


@query("""SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY pos, l_partkey) AS parts FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark, d):
    first = load(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("pos"))
    return first.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "l_partkey"))).alias("r")).select("l_orderkey", F.array_join(F.col("r.l_partkey").cast("array<string>"), ",").alias("parts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN n >= 3 WHEN o_orderstatus = 'O' THEN n >= 1 ELSE false END AS settled FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def settled_items(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") != "R").alias("n"))
    settled = F.when(F.col("o_orderstatus") == "F", F.col("n") >= 3).when(F.col("o_orderstatus") == "O", F.col("n") >= 1).otherwise(False)
    return load(spark, d, "orders").join(n, "o_orderkey").select("o_orderkey", settled.alias("settled"))


@query("""SELECT o_orderkey, 'review' AS kind FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0) UNION ALL SELECT o_orderkey, 'suspect' FROM orders WHERE o_totalprice > 490000""")
def review_residual(spark, d):
    orders = load(spark, d, "orders")
    confirmed = orders.filter("o_orderkey % 7 = 0").select("o_orderkey")
    review = orders.filter("o_orderstatus = 'P'").select("o_orderkey").join(confirmed, "o_orderkey", "left_anti").withColumn("kind", F.lit("review"))
    return review.unionByName(orders.filter("o_totalprice > 490000").select("o_orderkey", F.lit("suspect").alias("kind")))


# ---- sorts and limits; places are columns ----


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority[1:1]::INT, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey)::BIGINT AS place FROM orders""")
def custom_sort(spark, d):
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    w = Window.partitionBy("o_custkey").orderBy(F.regexp_extract("o_orderpriority", r"^(\d)", 1).cast("int"), rank, "o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (CASE WHEN (month(o_orderdate), day(o_orderdate)) >= (11, 29) THEN 0 ELSE month(o_orderdate) END), day(o_orderdate), o_orderkey)::BIGINT AS place FROM orders""")
def wrap_sort(spark, d):
    m, day = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    wrapped = F.when((m == 12) | ((m == 11) & (day >= 29)), 0).otherwise(m)
    return load(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(wrapped, day, "o_orderkey")).cast("long").alias("place"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY list_position(['SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'STANDARD', 'PROMO'], p_type) NULLS FIRST, p_partkey)::BIGINT AS place FROM part""")
def enum_sort(spark, d):
    order = F.nullif(F.array_position(F.array(*map(F.lit, ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO"])), F.col("p_type")), F.lit(0))
    return load(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(order.asc_nulls_first(), "p_partkey")).cast("long").alias("place"))


@query("""
WITH own AS (SELECT l_orderkey, l_linenumber AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT DISTINCT l_orderkey, l_linenumber AS rank FROM lineitem WHERE l_returnflag = 'R')
SELECT b.l_orderkey, b.rank::BIGINT AS rank, min(pos)::BIGINT AS before_pos FROM b LEFT JOIN own ON own.l_orderkey = b.l_orderkey AND own.rank > b.rank GROUP BY 1, 2""")
def merge_insert(spark, d):
    l = load(spark, d, "lineitem")
    own = l.filter("l_returnflag <> 'R'").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).select("l_orderkey", F.col("l_linenumber").alias("own_rank"), "pos")
    b = l.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("rank")).distinct()
    return b.join(own, "l_orderkey", "left").groupBy("l_orderkey", "rank").agg(F.min(F.when(F.col("own_rank") > F.col("rank"), F.col("pos"))).cast("long").alias("before_pos"))


@query("""SELECT o_orderkey, source, row_number() OVER (PARTITION BY day ORDER BY source, o_orderkey)::BIGINT AS place FROM (SELECT o_orderkey, 'I' AS source, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'II', o_orderdate::DATE + 1 FROM orders WHERE o_orderstatus = 'O')""")
def union_sort(spark, d):
    orders = load(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    both = orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("I").alias("source"), "day").unionByName(orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("II").alias("source"), F.date_add("day", 1).alias("day")))
    return both.select("o_orderkey", "source", F.row_number().over(Window.partitionBy("day").orderBy("source", "o_orderkey")).cast("long").alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_slice(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def queue_page(spark, d):
    return load(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey")

"""Queries of joins on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as m
from ..sources.tables import load

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query("SELECT l_orderkey, o_custkey, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def equi_join(spark, d):
    # lines are counted before the join: it carries a row an order
    n = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("l_orderkey", "o_custkey", "n")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def broadcast_join(spark, d):
    # nation and region are the fixed dimensions of the schema: 25 and 5 rows at every scale
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    dim = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return load(spark, d, "customer").join(F.broadcast(dim), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join(spark, d):
    big = load(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join(spark, d):
    return load(spark, d, "orders").join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""
WITH p AS (SELECT c_custkey AS cust, c_acctbal AS v FROM customer WHERE c_acctbal > 5000), s AS (SELECT o_custkey AS cust, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT cust, v, 'primary' AS source FROM p UNION ALL SELECT cust, v, 'secondary' FROM s WHERE cust NOT IN (SELECT cust FROM p)""")
def fill_missing(spark, d):
    p = load(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("v"), F.lit("primary").alias("source"))
    s = load(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("cust")).agg(F.max("o_totalprice").alias("v"))
    return p.unionByName(s.join(p, "cust", "left_anti").withColumn("source", F.lit("secondary")))


@query("SELECT o_orderkey FROM orders a WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')")
def exists_filter(spark, d):
    orders = load(spark, d, "orders")
    return orders.filter("o_orderstatus = 'O'").join(orders.filter("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT o_orderkey, (SELECT min(o_orderkey) FROM orders b WHERE b.o_custkey IS NOT DISTINCT FROM a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus = 'O') AS twin FROM orders a")
def correlated_twin(spark, d):
    orders = load(spark, d, "orders")
    least = orders.filter("o_orderstatus = 'O'").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("twin"))
    a, b = orders.alias("a"), least.alias("b")
    return a.join(b, F.col("a.o_custkey").eqNullSafe(F.col("b.o_custkey")) & (F.col("a.o_orderpriority") == F.col("b.o_orderpriority")), "left").select("o_orderkey", "twin")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_quantity > 45)
SELECT a.k AS k, count(DISTINCT b.k)::BIGINT AS others FROM s a JOIN s b ON a.p = b.p AND a.k <> b.k GROUP BY 1""")
def overlap_join(spark, d):
    s = load(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p")).distinct()
    b = s.withColumnRenamed("k", "o")
    return s.join(b, "p").filter("k <> o").select("k", "o").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("others"))


@query("SELECT o_orderkey, o_orderstatus AS stated, derived FROM orders JOIN (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS derived FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> derived")
def disagreements(spark, d):
    derived = F.when(F.bool_and(F.col("l_linestatus") == "F"), "F").when(F.bool_and(F.col("l_linestatus") == "O"), "O").otherwise("P")
    l = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(derived.alias("derived"))
    return load(spark, d, "orders").join(l, "o_orderkey").filter("o_orderstatus <> derived").select("o_orderkey", F.col("o_orderstatus").alias("stated"), "derived")


@query("""
WITH a AS (SELECT doc_id, quality AS v FROM labels), b AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS v FROM documents)
SELECT doc_id, a.v AS left_value, b.v AS right_value, CASE WHEN a.v IS NULL THEN 'right' WHEN b.v IS NULL THEN 'left' WHEN a.v = b.v THEN 'agree' ELSE 'disagree' END AS status FROM a FULL JOIN b USING (doc_id)""")
def dual_source_all(spark, d):
    """Two sources of a value by document: which has it, and whether they agree."""
    a = load(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    b = load(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("v"))
    return m.reconciled(a, b, ["doc_id"], "v")


CHANGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 101 <> 0"


def changed_orders(orders):
    status = F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus"))
    priority = F.when(F.col("o_orderkey") % 89 == 0, "9-NEW").otherwise(F.col("o_orderpriority"))
    return orders.filter("o_orderkey % 101 <> 0").select("o_orderkey", status.alias("o_orderstatus"), priority.alias("o_orderpriority"))


@query(f"""
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 103 <> 0), b AS ({CHANGED})
SELECT o_orderkey, CASE WHEN b.o_orderstatus IS NULL THEN 'missing' WHEN a.o_orderstatus IS NULL THEN 'extra' WHEN a.o_orderstatus <> b.o_orderstatus OR a.o_orderpriority <> b.o_orderpriority THEN 'changed' ELSE 'equal' END AS state,
  CASE WHEN a.o_orderstatus <> b.o_orderstatus AND a.o_orderpriority <> b.o_orderpriority THEN 'o_orderstatus,o_orderpriority' WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' WHEN a.o_orderpriority <> b.o_orderpriority THEN 'o_orderpriority' ELSE '' END AS fields
FROM a FULL JOIN b USING (o_orderkey)""")
def diff_full_outer(spark, d):
    orders = load(spark, d, "orders")
    return m.aligned(orders.filter("o_orderkey % 103 <> 0"), changed_orders(orders), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(f"""
WITH b AS ({CHANGED})
SELECT o_orderkey, 'o_orderstatus' AS field, a.o_orderstatus AS was, b.o_orderstatus AS now FROM orders a JOIN b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus
UNION ALL SELECT o_orderkey, 'o_orderpriority', a.o_orderpriority, b.o_orderpriority FROM orders a JOIN b USING (o_orderkey) WHERE a.o_orderpriority <> b.o_orderpriority""")
def stale_fields(spark, d):
    orders = load(spark, d, "orders")
    return m.changed_fields(orders, changed_orders(orders), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT p_partkey, count(*) FILTER (l_returnflag = 'R')::BIGINT AS returned, count(l_partkey)::BIGINT AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_discount > 0.05 GROUP BY 1")
def evidence_counts(spark, d):
    n = load(spark, d, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("n"))
    return load(spark, d, "part").select("p_partkey").join(n, "p_partkey", "left").fillna(0)


PRICE_BANDS = "SELECT i AS band, i * 20000 AS lo, i * 20000 + 24999 AS hi FROM (SELECT unnest(range(0, 26)) AS i)"


def price_bands(spark):
    return spark.range(26).select(F.col("id").alias("band"), (F.col("id") * 20000).alias("lo"), (F.col("id") * 20000 + 24999).alias("hi"))


@query(f"""
WITH b AS ({PRICE_BANDS}), p AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders)
SELECT o_orderkey, band::BIGINT AS band FROM p JOIN b ON v BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY v = lo DESC, band) = 1""")
def range_join_prefer(spark, d):
    points = load(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("at"))
    both = m.range_join(points, price_bands(spark), "at", "lo", "hi", 20000)
    return m.first_of(both, ["o_orderkey"], F.desc(F.col("at") == F.col("lo")), "band").select("o_orderkey", "band")


@query("""
WITH seg AS (SELECT s_nationkey AS k, s_suppkey * 2000 AS lo, s_suppkey * 2000 + 1499 AS hi, s_suppkey AS off FROM supplier)
SELECT c_custkey, off, (c_custkey * 37 - lo)::BIGINT AS place FROM customer JOIN seg ON k = c_nationkey AND c_custkey * 37 BETWEEN lo AND hi""")
def interval_join(spark, d):
    seg = load(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") * 2000).alias("lo"), (F.col("s_suppkey") * 2000 + 1499).alias("hi"), F.col("s_suppkey").alias("off"))
    points = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_custkey") * 37).alias("at"))
    return m.range_join(points, seg, "at", "lo", "hi", 2000, on=["k"]).select("c_custkey", "off", (F.col("at") - F.col("lo")).alias("place"))


@query("""
SELECT c_custkey, s_suppkey AS nearest FROM customer JOIN supplier ON s_nationkey = c_nationkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal::DECIMAL(18,2) - s_acctbal::DECIMAL(18,2)), s_suppkey) = 1""")
def nearest_join(spark, d):
    """The nearest value on either side, by two running windows over the union, one a direction: no pair of rows is made, and each row is looked at once. Where no gap is known, the least key."""
    from pyspark.sql import Window

    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").cast("decimal(18,2)").alias("at"), "c_custkey")
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k"), F.col("s_acctbal").cast("decimal(18,2)").alias("at")).agg(F.min("s_suppkey").alias("sup"))
    both = c.withColumn("sup", F.lit(None).cast("long")).unionByName(s, allowMissingColumns=True)
    found = F.last(F.when(F.col("sup").isNotNull() & F.col("at").isNotNull(), F.struct(F.col("at").alias("v"), F.col("sup").alias("id"))), ignorenulls=True)
    running = lambda order: Window.partitionBy("k").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    r = both.withColumn("lo", found.over(running(F.asc("at")))).withColumn("hi", found.over(running(F.desc("at")))).withColumn("any", F.min("sup").over(Window.partitionBy("k"))).filter("c_custkey is not null")
    gap = lambda s: F.struct(F.abs(F.col(f"{s}.v") - F.col("at")).alias("gap"), F.col(f"{s}.id").alias("id"))
    near = lambda s: F.when(F.col(s).isNotNull() & F.col("at").isNotNull(), gap(s))
    pick = F.array_min(F.array_compact(F.array(near("lo"), near("hi"))))
    return r.select("c_custkey", F.coalesce(pick["id"], "any").alias("nearest")).filter("nearest is not null")


@query("""
WITH p AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id) AS best FROM events)
SELECT user_id, event_id FROM p WHERE round(value, 2) >= round(best - 5.0, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def near_best(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", F.round("value", 2).cast("decimal(18,2)").alias("value"))
    return m.near_best(e, ["user_id"], "value", 5, "event_id").select("user_id", "event_id")


@query("""
WITH b AS (SELECT o_custkey AS k, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e, o_orderkey FROM orders)
SELECT o_orderkey, count(*)::BIGINT AS inside FROM b JOIN (SELECT o_custkey AS c, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) ON c = k AND l_shipdate > a + INTERVAL 10 DAY AND l_shipdate < e - INTERVAL 10 DAY GROUP BY 1""")
def gap_join(spark, d):
    """Points that lie between two neighbours, at least ten days from either."""
    from ..operators.ordered import count_between, span_lead

    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    b = span_lead(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", F.expr("o_orderdate + interval 10 days").alias("low"), F.expr("span_end - interval 10 days").alias("high"))
    ships = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_custkey", "l_shipdate")
    return count_between(b, ships, "o_custkey", "low", "high", "l_shipdate", "inside").filter("inside > 0").select("o_orderkey", "inside")


@query("""
SELECT a.o_orderkey, count(*)::BIGINT AS spanning FROM orders a JOIN (SELECT o_custkey, o_orderdate AS lo, o_orderdate + INTERVAL 180 DAY AS hi, o_orderkey AS k FROM orders) b ON a.o_custkey = b.o_custkey AND a.o_orderdate > lo AND a.o_orderdate < hi GROUP BY 1""")
def stab_query(spark, d):
    """How many intervals hold a point strictly inside: starts before it less ends at or before it, counted by two range windows, without pairs."""
    from pyspark.sql import Window

    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("t"))
    w = Window.partitionBy("o_custkey").orderBy("t").rangeBetween(-179, -1)
    return o.withColumn("spanning", F.count(F.lit(1)).over(w)).filter("spanning > 0").select("o_orderkey", "spanning")


@query("""
WITH c AS (SELECT o_orderkey, 1 AS tier, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 48
  UNION ALL SELECT o_orderkey, 2, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_discount >= 0.09
  UNION ALL SELECT o_orderkey, 3, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, min(tier)::BIGINT AS tier, min(p) FILTER (tier = t) AS pick FROM (SELECT *, min(tier) OVER (PARTITION BY o_orderkey) AS t FROM c) WHERE tier = t GROUP BY 1""")
def tier_fallback(spark, d):
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p"), "l_quantity", "l_discount")
    pick = lambda x: x.select("o_orderkey", "p")
    rows = m.tiered([pick(l.filter("l_quantity > 48")), pick(l.filter("l_discount >= 0.09")), pick(l)], ["o_orderkey"])
    return rows.groupBy("o_orderkey").agg(F.min("tier").cast("long").alias("tier"), F.min("p").alias("pick"))


@query("SELECT p_partkey, s_suppkey, n::BIGINT AS n_candidates, n = 1 AS accepted FROM (SELECT p_partkey, s_suppkey, count(*) OVER (PARTITION BY p_partkey) AS n FROM (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey FROM lineitem WHERE l_quantity > 49))")
def unique_or_queue(spark, d):
    c = load(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    return m.unique_or_queue(c, ["p_partkey"])


@query("""SELECT o_orderkey, l_linenumber::BIGINT AS line, l_orderkey IS NOT NULL AS anchored FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_orderkey = o_orderkey""")
def anchor_join(spark, d):
    l = load(spark, d, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").cast("long").alias("line"))
    return load(spark, d, "orders").select("o_orderkey").join(l, "o_orderkey", "left").withColumn("anchored", F.col("line").isNotNull())


@query("""
SELECT c_custkey, s_suppkey AS lender FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > 2000
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey % 7 = c_custkey % 7 DESC, s_suppkey % 3, s_acctbal DESC, s_suppkey) = 1""")
def ranked_lender(spark, d):
    """Candidates are ranked within the few suppliers of a nation and the seven remainders first, so each customer meets one row."""
    from pyspark.sql import Window

    s = load(spark, d, "supplier").filter("s_acctbal > 2000")
    order = [F.col("s_suppkey") % 3, F.desc("s_acctbal"), F.col("s_suppkey")]
    own = m.first_of(s.withColumn("r", F.col("s_suppkey") % 7), ["s_nationkey", "r"], *order).select("s_nationkey", "r", F.col("s_suppkey").alias("own"))
    any_ = m.first_of(s, ["s_nationkey"], *order).select("s_nationkey", F.col("s_suppkey").alias("other"))
    c = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"), (F.col("c_custkey") % 7).alias("r"))
    return c.join(own, ["s_nationkey", "r"], "left").join(any_, "s_nationkey", "left").select("c_custkey", F.coalesce("own", "other").alias("lender"))


@query("""
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'no lines' WHEN returned THEN 'returned' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 10000 THEN 'small' END AS reason
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def exclusion_reason(spark, d):
    l = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    reason = F.when(F.col("n").isNull(), "no lines").when(F.col("returned"), "returned").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") < 10000, "small")
    return load(spark, d, "orders").join(l, "o_orderkey", "left").select("o_orderkey", reason.alias("reason"))


@query("""SELECT l_orderkey, bool_and(l_quantity <= 45 AND l_discount < 0.1) AS eligible, count(*) FILTER (NOT (l_quantity <= 45 AND l_discount < 0.1))::BIGINT AS blocking FROM lineitem GROUP BY 1""")
def eligible_flag(spark, d):
    ok = (F.col("l_quantity") <= 45) & (F.col("l_discount") < 0.1)
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(ok).alias("eligible"), F.count_if(~ok).alias("blocking"))


@query("""SELECT p_partkey, s_suppkey, s_acctbal > 0 AS publishable FROM part JOIN supplier ON p_partkey % 100 = s_suppkey WHERE p_size > 10""")
def curated_links(spark, d):
    p = load(spark, d, "part").filter("p_size > 10").select("p_partkey", (F.col("p_partkey") % 100).alias("s_suppkey"))
    return p.join(load(spark, d, "supplier"), "s_suppkey").select("p_partkey", "s_suppkey", (F.col("s_acctbal") > 0).alias("publishable"))


@query("SELECT o_orderkey, n_name, coalesce(s.label, 'unknown') AS label FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (VALUES ('F', 'final'), ('O', 'open')) s(k, label) ON k = o_orderstatus")
def dim_lookup(spark, d):
    label = F.coalesce(F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "open"), F.lit("unknown"))
    c = load(spark, d, "customer").join(F.broadcast(load(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return load(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "n_name", label.alias("label"))


@query("""
WITH c AS (SELECT DISTINCT i.l_orderkey AS k, unnest(range(i.l_linenumber, i.l_linenumber + i.l_quantity::INT // 10 + 1)) AS cell FROM lineitem i)
SELECT k, count(*)::BIGINT AS cells, min(cell)::BIGINT AS lo, max(cell)::BIGINT AS hi FROM c GROUP BY 1""")
def interval_split(spark, d):
    """Intervals split at whole numbers, one row a cell, counted once."""
    cells = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.explode(F.sequence("l_linenumber", F.expr("l_linenumber + cast(l_quantity as int) div 10"))).alias("cell")).distinct()
    return cells.groupBy("k").agg(F.count(F.lit(1)).alias("cells"), F.min("cell").cast("long").alias("lo"), F.max("cell").cast("long").alias("hi"))


@query("""
SELECT l_orderkey, count(*)::BIGINT AS inside FROM lineitem JOIN (SELECT unnest(range(0, 5)) AS b) ON l_quantity >= b * 10 + 2 AND l_quantity < b * 10 + 8 AND l_extendedprice >= 20000 GROUP BY 1""")
def box_clip(spark, d):
    """Points inside any of a row of boxes, by arithmetic on the cell instead of a join."""
    at = F.col("l_quantity") - 10 * F.floor(F.col("l_quantity") / 10)
    inside = (at >= 2) & (at < 8) & (F.col("l_quantity") < 50) & (F.col("l_extendedprice") >= 20000)
    return load(spark, d, "lineitem").filter(inside).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("inside"))

"""Queries of overlays, graphs and stateful rules on the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import overlay as ov
from ..operators import state as st
from ..sources.tables import load

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


OVERLAY = "SELECT o_orderkey, CASE WHEN o_orderkey % 194 = 0 THEN 'stale' ELSE o_orderstatus END AS was, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'X' END AS value FROM orders WHERE o_orderkey % 97 = 0"


def corrections(orders):
    """Rule-made corrections: every 97th order, some stale, some without effect."""
    k = F.col("o_orderkey")
    return orders.filter(k % 97 == 0).select("o_orderkey", F.when(k % 194 == 0, "stale").otherwise(F.col("o_orderstatus")).alias("was"), F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("X").alias("value"))


@query(f"""WITH c AS ({OVERLAY})
SELECT o_orderkey, CASE WHEN was = o_orderstatus THEN value ELSE o_orderstatus END AS o_orderstatus, CASE WHEN was IS NULL THEN 'untouched' WHEN was <> o_orderstatus THEN 'stale' WHEN value = o_orderstatus THEN 'noop' ELSE 'applied' END AS state
FROM orders LEFT JOIN c USING (o_orderkey)""")
def overlay_apply(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return ov.apply_overlay(orders, corrections(orders), "o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, 'o_orderstatus' AS field, 'X' AS value FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', '1-URGENT' FROM orders WHERE o_orderkey % 89 = 0 AND o_orderpriority <> '1-URGENT'""")
def overlay_dispatch(spark, d):
    """Long-format overlay rows by field from one registry of (applies, value) pairs, in one pass."""
    registry = {"o_orderstatus": (F.col("o_orderkey") % 97 == 0, F.lit("X")), "o_orderpriority": ((F.col("o_orderkey") % 89 == 0) & (F.col("o_orderpriority") != "1-URGENT"), F.lit("1-URGENT"))}
    rows = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(f).alias("field"), v.alias("value"))) for f, (c, v) in registry.items())))
    return load(spark, d, "orders").select("o_orderkey", F.explode(rows).alias("r")).select("o_orderkey", "r.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_orderkey % 100 = 0")
def upsert_batch(spark, d):
    base = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    hit = base.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("new").alias("v"))
    return ov.upsert(base, hit.unionByName(base.filter("o_orderkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("new").alias("v"))), ["o_orderkey"])


@query("SELECT coalesce(n.s_suppkey, s.s_suppkey) AS s_suppkey, coalesce(n.v, s.s_name) AS v FROM supplier s FULL JOIN (SELECT s_suppkey * 2 AS s_suppkey, 'page ' || s_suppkey AS v FROM supplier WHERE s_suppkey % 3 = 0) n ON n.s_suppkey = s.s_suppkey")
def upsert_keep(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("old"))
    n = s.filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.concat(F.lit("page "), F.col("s_suppkey").cast("string")).alias("new"))
    return s.join(n, "s_suppkey", "full_outer").select("s_suppkey", F.coalesce("new", "old").alias("v"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_type) AS v FROM part")
def carry_over(spark, d):
    p = load(spark, d, "part")
    new = p.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("v"))
    return ov.carry_over(new, p.select("p_partkey", F.col("p_type").alias("v")), "p_partkey", "v")


@query("SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'P', o_orderkey + 1000000 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0")
def partition_replace(spark, d):
    base = load(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    new = base.filter("o_orderstatus = 'P' and o_orderkey % 2 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000)
    return ov.upsert(base, new, ["o_orderstatus"])


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def insert_absent(spark, d):
    base = load(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("k"))
    return ov.insert_absent(base, load(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct(), ["k"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN 'other' WHEN l.k IS NOT NULL THEN 'named' WHEN o_orderdate > DATE '1998-01-01' THEN 'recent' ELSE 'delete' END AS plan FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) l ON k = o_orderkey")
def prune_plan(spark, d):
    keep = load(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("keep", F.lit(True))
    plan = F.when(F.col("o_orderkey") % 10 == 9, "other").when(F.col("keep"), "named").when(F.col("o_orderdate").cast("date") > F.lit("1998-01-01").cast("date"), "recent").otherwise("delete")
    return load(spark, d, "orders").join(keep, "o_orderkey", "left").select("o_orderkey", plan.alias("plan"))


@query("SELECT o_orderkey FROM orders WHERE sha256('v' || o_orderkey || chr(31) || 'v' || o_orderstatus) <> sha256('v' || o_orderkey || chr(31) || 'v' || CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END)")
def stale_outputs(spark, d):
    o = load(spark, d, "orders")
    now = F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus"))
    return o.filter(ov.content_hash("o_orderkey", "o_orderstatus") != ov.content_hash(F.col("o_orderkey"), now)).select("o_orderkey")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_sha(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS line FROM orders""")
def canonical_json(spark, d):
    # fields in sorted order
    return load(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))).alias("line"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size >= 5 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def semi_export(spark, d):
    wanted = load(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, d, "part").filter("p_size >= 5").join(wanted, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'editor' ELSE 'reader' END AS by, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::BIGINT AS place FROM orders")
def public_log(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 5 == 0, "editor").otherwise("reader").alias("by"), F.row_number().over(w).cast("long").alias("place"))


@query("SELECT 'c' AS source, c_custkey AS id, c_name AS name, c_mktsegment AS extra FROM customer UNION ALL SELECT 's', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'p', p_partkey, p_name, p_type FROM part")
def union_sources(spark, d):
    c = load(spark, d, "customer").select(F.lit("c").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("extra"))
    s = load(spark, d, "supplier").select(F.lit("s").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p = load(spark, d, "part").select(F.lit("p").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("extra"))
    return c.unionByName(s, allowMissingColumns=True).unionByName(p)


@query("SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-p' || p_partkey END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def slug_dedupe(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return p.withColumn("n", n).select("p_partkey", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-p"), F.col("p_partkey").cast("string"))).alias("slug"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'old schema' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'bad enum' ELSE 'ok' END AS gate FROM orders")
def schema_gate(spark, d):
    gate = F.when(F.col("o_orderkey") % 11 == 0, "old schema").when(~F.col("o_orderstatus").isin("F", "O"), "bad enum").otherwise("ok")
    return load(spark, d, "orders").select("o_orderkey", gate.alias("gate"))


RULES = {"positive price": "o_totalprice > 5000", "known status": "o_orderstatus in ('F', 'O')", "dated": "o_orderkey % 500 <> 1"}


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS rule FROM orders WHERE NOT ({c})" for n, c in RULES.items()))
def constraint_report(spark, d):
    return ov.constraints(load(spark, d, "orders"), "o_orderkey", {n: F.expr(c) for n, c in RULES.items()})


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) = 5 AS complete, bool_or(o_orderstatus = 'P') AND NOT bool_or(o_orderstatus = 'F') AS odd FROM orders GROUP BY 1")
def sibling_rule(spark, d):
    s = F.col("o_orderstatus")
    return load(spark, d, "orders").groupBy("o_custkey").agg((F.size(F.collect_set("o_orderpriority")) == 5).alias("complete"), (F.bool_or(s == "P") & ~F.bool_or(s == "F")).alias("odd"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'same' ELSE 'conflict' END WHEN o_orderkey % 2 = 0 THEN 'ours' WHEN o_orderkey % 3 = 0 THEN 'theirs' ELSE 'unchanged' END AS state FROM orders""")
def three_way_sync(spark, d):
    k, base = F.col("o_orderkey"), F.col("o_orderstatus")
    ours = F.when(k % 2 == 0, F.when(k % 5 == 0, "both").otherwise("mine")).otherwise(base)
    theirs = F.when(k % 3 == 0, F.when(k % 5 == 0, "both").otherwise("yours")).otherwise(base)
    return load(spark, d, "orders").select("o_orderkey", ov.three_way(ours, base, theirs).alias("state"))


@query("SELECT o_custkey, string_agg(CASE WHEN o_orderkey % 4 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
def array_replace(spark, d):
    rows = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("r"))
    new = F.transform("r", lambda x: F.when(x["o_orderkey"] % 4 == 0, F.concat(F.lit("x"), x["o_orderkey"].cast("string"))).otherwise(x["o_orderkey"].cast("string")))
    return rows.select("o_custkey", F.array_join(new, ",").alias("keys"))


@query("SELECT o_custkey, bool_and(coalesce(o_orderkey > p, true)) AS increasing, count(*) BETWEEN 1 AND 15 AS sized FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) GROUP BY 1")
def array_validate(spark, d):
    a = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("r")).select("o_custkey", F.col("r.o_orderkey").alias("k"))
    rising = F.forall(F.sequence(F.lit(0), F.size("k") - 1), lambda i: (i == 0) | (F.get("k", i) > F.get("k", F.greatest(i - 1, F.lit(0)))))
    return a.select("o_custkey", rising.alias("increasing"), F.size("k").between(1, 15).alias("sized"))


@query("SELECT l_orderkey, sum(n)::BIGINT AS total, string_agg(part, '' ORDER BY l_linenumber) AS slices FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, substring('abcdefghij', 1 + (min(l_partkey) % 5)::INT, least(count(*), 3)::INT) AS part FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def compose_slices(spark, d):
    s = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("p"))
    part = F.substring(F.lit("abcdefghij"), (F.col("p") % 5 + 1).cast("int"), F.least("n", F.lit(3)).cast("int"))
    return s.withColumn("part", part).groupBy("l_orderkey").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("l_linenumber", "part"))).alias("r")).select("l_orderkey", "total", F.array_join(F.col("r.part"), "").alias("slices"))


# ---- graphs: an order's key leads to others by arithmetic ----

EDGES = "SELECT o_orderkey AS src, (o_orderkey * 7 + 3) % 15000 AS dst FROM orders WHERE o_orderkey % 4 <> 0 UNION SELECT o_orderkey, o_orderkey // 2 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey > 0"


def edges(spark, d):
    o = load(spark, d, "orders")
    return o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("src"), F.expr("(o_orderkey * 7 + 3) % 15000").alias("dst")).union(o.filter("o_orderkey % 5 = 0 and o_orderkey > 0").selectExpr("o_orderkey", "o_orderkey div 2")).distinct()


@query(f"""WITH RECURSIVE e AS ({EDGES}), r(node) AS (SELECT 1::BIGINT UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r""")
def graph_reach(spark, d):
    return gr.reach(edges(spark, d), spark.createDataFrame([(1,)], "node long")).select("node")


@query(f"""WITH RECURSIVE e AS ({EDGES}), r(node, hop) AS (SELECT 10::BIGINT, 0 UNION SELECT dst, hop + 1 FROM r JOIN e ON src = node WHERE hop < 6) SELECT node, min(hop)::BIGINT AS hop FROM r GROUP BY 1""")
def hop_limit(spark, d):
    return gr.reach(edges(spark, d), spark.createDataFrame([(10,)], "node long"), hops=6).select("node", F.col("hop").cast("long").alias("hop"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey // 2 AS parent, CASE WHEN p_size % 3 = 0 THEN p_brand END AS v FROM part), r(k, here, depth, v) AS (SELECT k, k, 0, v FROM p UNION ALL SELECT r.k, p.k, depth + 1, p.v FROM r JOIN p ON p.k = r.here // 2 WHERE r.v IS NULL AND r.here > 0)
SELECT k, max(v) AS v FROM r GROUP BY 1""")
def inherit_chain(spark, d):
    """Nearest value along the parent chain: keys halve, so a fixed number of rounds reaches the root of any 64-bit key; rounds end when none is open, or at a parent that is nowhere.
    Each round is written once, and no side is sent to the driver."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("v"))
    own = gr._cut(p.select(F.col("k").alias("at"), F.col("v").alias("av"), F.lit(True).alias("there")))
    done = [p.filter("v is not null or k <= 0 or k is null")]
    open_ = p.filter("v is null and k > 0").select("k", F.expr("k div 2").alias("at"))
    for _ in range(64):
        found = gr._cut(open_.hint("merge").join(own, "at", "left"))
        ends = "av is not null or at = 0 or there is null"
        done.append(found.filter(ends).select("k", F.col("av").alias("v")))
        open_ = found.filter(f"not ({ends})").select("k", F.expr("at div 2").alias("at"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


@query()
def recursive_expand_all(spark, d):
    """Every pair joined by three edges at most."""
    return gr.closure(edges(spark, d), 3).select("src", "dst", F.col("hop").cast("long").alias("hop"))


@query(f"""WITH e AS ({EDGES}) SELECT src, dst, 'dangling' AS problem FROM e WHERE dst NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT src, dst, 'one way' FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)""")
def edge_integrity(spark, d):
    nodes = load(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("node"))
    return gr.integrity(edges(spark, d), nodes)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'alias' WHEN o_orderkey % 5 = 0 THEN 'seed' WHEN o_orderkey % 7 = 0 THEN 'owner' ELSE 'new' END AS bound FROM orders""")
def staged_bind(spark, d):
    """Each pass binds what the passes before left: three anti-joined stages over key tables."""
    rows = load(spark, d, "orders").select("o_orderkey")
    out = None
    for name, n in (("alias", 3), ("seed", 5), ("owner", 7)):
        keys = load(spark, d, "orders").filter(F.col("o_orderkey") % n == 0).select("o_orderkey")
        hit = rows.join(keys, "o_orderkey", "left_semi").withColumn("bound", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
        rows = rows.join(keys, "o_orderkey", "left_anti")
    return out.unionByName(rows.withColumn("bound", F.lit("new")))


@query("SELECT p_partkey, 'id-' || left(sha256('part:' || p_partkey), 12) AS id FROM part WHERE p_partkey % 4 <> 0")
def id_allocate(spark, d):
    known = load(spark, d, "part").filter("p_partkey % 4 = 0").select("p_partkey")
    new = ov.insert_absent(known, load(spark, d, "part").select("p_partkey"), ["p_partkey"])
    return new.select("p_partkey", F.concat(F.lit("id-"), F.substring(F.sha2(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), 256), 1, 12)).alias("id"))


# ---- state ----


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, event_id, n, s, true AS granted, s + 1800 AS until FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.s, e.s >= r.until, CASE WHEN e.s >= r.until THEN e.s + 1800 ELSE r.until END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, granted FROM r""")
def lease_replay(spark, d):
    e = load(spark, d, "events").filter("event_type = 'click'").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return st.leases(e, "user_id", "s", "event_id", 1800)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, 'granted' AS outcome, s + 1800 AS until, [s] AS g FROM e WHERE n = 1 UNION ALL
  SELECT user_id, event_id, n, outcome, CASE WHEN outcome = 'granted' THEN s + 1800 ELSE until END, CASE WHEN outcome = 'granted' THEN list_append(g, s) ELSE g END
  FROM (SELECT e.user_id, e.event_id, e.n, e.s, r.until, r.g, CASE WHEN e.s < r.until THEN 'active' WHEN len(list_filter(r.g, lambda x: x > e.s - 86400)) >= 3 THEN 'rate' ELSE 'granted' END AS outcome FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, outcome FROM r""")
def lease_limits(spark, d):
    """Leases of half an hour, one at a time and three a day."""
    e = load(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return st.lease_decisions(e, "user_id", "s", "event_id", 1800, 3, 86400)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS accepted, [s] AS landed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, len(list_filter(r.landed, lambda x: x >= e.s - 14400)) < 2,
  CASE WHEN len(list_filter(r.landed, lambda x: x >= e.s - 14400)) < 2 THEN list_append(list_filter(r.landed, lambda x: x >= e.s - 14400), e.s) ELSE r.landed END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, accepted FROM r""")
def rate_limit(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return st.rate_limit(e, "user_id", "s", "event_id", 2, 14400)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'new' AS status, 0::BIGINT AS landed FROM events UNION ALL SELECT e.user_id, e.n, CASE WHEN m = 'view' AND status = 'new' THEN 'seen' WHEN m = 'click' AND status = 'seen' THEN 'open' WHEN m = 'purchase' AND status = 'open' THEN 'done' WHEN m = 'error' AND status = 'open' THEN 'new' ELSE status END,
  landed + CASE WHEN (m, status) IN (('view', 'new'), ('click', 'seen'), ('purchase', 'open'), ('error', 'open')) THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, arg_max(status, n) AS status, max(landed) AS landed FROM r GROUP BY 1""")
def status_fold(spark, d):
    moves = {"view": ("new", "seen"), "click": ("seen", "open"), "purchase": ("open", "done"), "error": ("open", "new")}
    return st.status_moves(load(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", moves, "new")


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
r AS (SELECT k, n, q AS used, 1 AS page FROM l WHERE n = 1 UNION ALL SELECT l.k, l.n, CASE WHEN r.used > 0 AND r.used + l.q > 60 THEN l.q ELSE r.used + l.q END, CASE WHEN r.used > 0 AND r.used + l.q > 60 THEN r.page + 1 ELSE r.page END FROM r JOIN l ON l.k = r.k AND l.n = r.n + 1)
SELECT k AS l_orderkey, max(page)::BIGINT AS pages FROM r GROUP BY 1""")
def greedy_pages(spark, d):
    l = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return st.greedy_fill(l, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", 60.0).groupBy("l_orderkey").agg(F.max("page").alias("pages"))


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT DISTINCT conv_id, NULL::BIGINT AS turn, NULL::VARCHAR AS role, 0::BIGINT AS n, 'start' AS state FROM conversations UNION ALL
  SELECT e.conv_id, e.turn, e.role, e.n, CASE WHEN state = 'start' AND e.role = 'user' THEN 'asked' WHEN state = 'asked' AND e.role = 'assistant' THEN 'answered' WHEN state = 'answered' AND e.role = 'user' THEN 'asked' ELSE state END FROM r JOIN e ON e.conv_id = r.conv_id AND e.n = r.n + 1)
SELECT conv_id, turn, role, state FROM r WHERE n > 0""")
def automaton_fold(spark, d):
    table = {("start", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked", ("start", "system"): "start"}
    return st.automaton(load(spark, d, "conversations"), "conv_id", ["turn"], "role", table, "start")


@query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, length(text) AS long, len(regexp_extract_all(text, '[.?!]')) AS marks FROM conversations),
a AS (SELECT conv_id, max((marks, -place)) AS m FROM c GROUP BY 1), o AS (SELECT conv_id, 'opening' AS part, -m[2] AS place FROM a WHERE m[1] > 0),
b AS (SELECT c.conv_id, max((long, -c.place)) AS m FROM c LEFT JOIN o USING (conv_id) WHERE c.place >= coalesce(o.place + 1, 0) GROUP BY 1)
SELECT conv_id, part, place::BIGINT AS place FROM o UNION ALL SELECT conv_id, 'body', (-m[2])::BIGINT FROM b WHERE m[1] > 0""")
def ordered_placement(spark, d):
    c = load(spark, d, "conversations").withColumn("long", F.length("text")).withColumn("marks", F.regexp_count("text", F.lit("[.?!]")))
    return st.ordered_placement(c, "conv_id", ["turn"], {"opening": "marks", "body": "long"}, 1)


@query()
def monotone_fit(spark, d):
    s = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("page")).agg(F.sum("l_quantity").alias("score"))
    return st.monotone_fit(s, "l_orderkey", "l_linenumber", "page", "score")


@query("""SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id, count(*)::BIGINT - 1 AS dropped FROM events GROUP BY 1, 2""")
def dedupe_first(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND n > 0 THEN 'accepted' ELSE o_orderstatus END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def cascade_update(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("n"))
    return load(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & (F.col("n") > 0), "accepted").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, (event_id % 4) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, 1 AS revision, event_id AS holder FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.seen = r.revision % 4 THEN r.revision + 1 ELSE r.revision END, CASE WHEN e.seen = r.revision % 4 THEN e.event_id ELSE r.holder END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, max(revision)::BIGINT AS revision, arg_max(holder, n) AS holder FROM r GROUP BY 1""")
def versioned_upsert(spark, d):
    """Optimistic updates: one lands only where the revision that it saw is the current one; a fold over each user's ordered events."""
    e = load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("r"))
    zero = F.struct(F.lit(0).alias("revision"), F.lit(None).cast("long").alias("holder"))
    step = lambda s, x: F.when((s["revision"] == 0) | (x["event_id"] % 4 == s["revision"] % 4), F.struct((s["revision"] + 1).alias("revision"), x["event_id"].alias("holder"))).otherwise(s)
    return e.select("user_id", F.aggregate("r", zero, step).alias("s")).select("user_id", F.col("s.revision").cast("long").alias("revision"), F.col("s.holder").alias("holder"))


@query("""SELECT doc_id, sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)""")
def incremental_keys(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    done = docs.filter("doc_id % 10 = 0").select("digest")
    return docs.join(done, "digest", "left_anti").select("doc_id", "digest")


@query("""SELECT o_custkey, CASE WHEN bool_and(o_totalprice > 2000) THEN 'moved' ELSE 'rolled back' END AS state, CASE WHEN bool_and(o_totalprice > 2000) THEN count(*) ELSE 0 END::BIGINT AS n FROM orders GROUP BY 1""")
def batch_lifecycle(spark, d):
    whole = F.bool_and(F.col("o_totalprice") > 2000)
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.when(whole, "moved").otherwise("rolled back").alias("state"), F.when(whole, F.count(F.lit(1))).otherwise(0).alias("n"))


@query("""SELECT user_id, event_id, n = 1 AS frozen FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts)) AS n FROM events)""")
def append_only(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type", F.date_trunc("hour", "ts")))
    return load(spark, d, "events").select("user_id", "event_id", (n == 1).alias("frozen"))

"""Queries of layered corrections, spliced sections, chains and build orders, on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, layers, pages
from ..sources.tables import load

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# ---- corrections of runs: a customer is a volume, an order a piece, a line a system; returned lines begin parts ----

#: The rules of the file, in its order: of which orders, the new first and last system, and what the writer took for the old ones, each counted from the order's first and last.
RULES = [(3, (0, 1), (0, 0)), (4, (-1, 0), (0, 0)), (6, (0, 0), (0, 1)), (5, (1, 0), (0, 0)), (7, (0, 2), (0, 0))]
SQL_RULES = " UNION ALL ".join(f"SELECT v, p AS t, {k + 1}000000000 + p AS seq, a + {a} AS a, b + {b} AS b, a + {wa} AS wa, b + {wb} AS wb FROM r WHERE p % {n} = 0" for k, (n, (a, b), (wa, wb)) in enumerate(RULES))
SQL_SYSTEMS = f"SELECT o_custkey AS v, o_orderkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, {', '.join(LINE)}) AS s, l_returnflag = 'A' AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(f"""WITH RECURSIVE s AS MATERIALIZED ({SQL_SYSTEMS}), b AS MATERIALIZED (SELECT v, list(p ORDER BY s) AS owner, list(part ORDER BY s) AS parts FROM s GROUP BY v),
r AS (SELECT v, p, min(s) AS a, max(s) AS b FROM s GROUP BY v, p), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY v ORDER BY seq) AS n FROM ({SQL_RULES})),
x AS (SELECT v, 0::BIGINT AS n, owner, NULL::BIGINT AS seq, NULL::VARCHAR AS problem FROM b UNION ALL
  SELECT v, n, CASE WHEN problem IS NULL THEN list_transform(range(1, len(owner) + 1), lambda i: CASE WHEN i BETWEEN a AND b THEN t WHEN owner[i] = t THEN NULL ELSE owner[i] END) ELSE owner END, seq, problem FROM (
    SELECT x.v, e.n, e.seq, e.t, e.a, e.b, x.owner, CASE WHEN NOT (a >= 1 AND a <= e.b AND e.b <= len(x.owner)) THEN '{layers.NO_RUN}'
      WHEN list_position(x.owner, t) IS DISTINCT FROM wa OR len(x.owner) + 1 - list_position(list_reverse(x.owner), t) IS DISTINCT FROM wb THEN '{layers.STALE}'
      WHEN len(list_filter(range(1, len(x.owner) + 1), lambda i: x.owner[i] = t AND parts[i] AND NOT (i BETWEEN a AND e.b))) > 0 THEN '{layers.LEAVES}'
      WHEN len(list_filter(list_distinct(x.owner[a : e.b]), lambda o: o <> t AND NOT list_contains(x.owner[1 : a - 1], o) AND NOT list_contains(x.owner[e.b + 1 :], o))) > 0 THEN '{layers.WHOLE}'
      WHEN len(list_filter(list_distinct(x.owner[a : e.b]), lambda o: o <> t AND list_contains(x.owner[1 : a - 1], o) AND list_contains(x.owner[e.b + 1 :], o))) > 0 THEN '{layers.SPLITS}'
      WHEN len(list_filter(range(a, e.b + 1), lambda i: x.owner[i] <> t AND parts[i])) > 0 THEN '{layers.TAKES}' END AS problem
    FROM x JOIN e ON e.v = x.v AND e.n = x.n + 1 JOIN b ON b.v = x.v)),
f AS (SELECT v, unnest(range(1, len(o) + 1)) AS s, unnest(o) AS p FROM (SELECT v, arg_max(owner, n) AS o FROM x GROUP BY v))
SELECT seq, problem, NULL::BIGINT AS piece, NULL::BIGINT AS first, NULL::BIGINT AS last FROM x WHERE n > 0 UNION ALL SELECT NULL, NULL, p, min(s), max(s) FROM f WHERE p IS NOT NULL GROUP BY v, p""")
def overlay_runs(spark, d):
    """Corrections of runs in file order, each against what its predecessors left: what became of each, and the runs afterwards."""
    lines = load(spark, d, "orders").select("o_custkey", "o_orderkey").join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", *LINE), "o_orderkey")
    system = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", *LINE)).cast("long")
    systems = graph._cut(lines.select(F.col("o_custkey").alias("volume"), system.alias("system"), F.col("o_orderkey").alias("piece"), (F.col("l_returnflag") == "A").alias("part")))
    runs = systems.groupBy("volume", "piece").agg(F.min("system").alias("x"), F.max("system").alias("y"))
    rule = lambda k, n, new, was: F.when(F.col("piece") % n == 0, F.struct((F.lit((k + 1) * 1_000_000_000) + F.col("piece")).alias("seq"), *((F.col(c) + i).cast("long").alias(name) for name, c, i in (("a", "x", new[0]), ("b", "y", new[1]), ("was_a", "x", was[0]), ("was_b", "y", was[1])))))
    entries = runs.select("volume", F.col("piece").alias("target"), F.explode(F.array_compact(F.array(*(rule(k, *r) for k, r in enumerate(RULES))))).alias("e")).select("volume", "target", "e.*")
    owner, told = layers.apply_runs(systems.drop("part"), systems.filter("part").select("volume", "system"), entries)
    after = owner.filter("piece IS NOT NULL").groupBy("volume", "piece").agg(F.min("system").alias("first"), F.max("system").alias("last")).drop("volume")
    return told.unionByName(after, allowMissingColumns=True).select("seq", "problem", "piece", "first", "last")


SQL_BATCH = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 49 THEN 'stale' ELSE o_orderstatus END AS was, o_orderkey // 2 * 2 AS target FROM orders WHERE o_totalprice > 150000"


@query(f"""WITH f AS (SELECT o_orderkey AS target, o_orderstatus AS now FROM orders), e AS ({SQL_BATCH}),
j AS (SELECT o_orderkey AS seq, CASE WHEN min(o_orderkey) OVER (PARTITION BY target) <> o_orderkey THEN 'corrected already by e' || min(o_orderkey) OVER (PARTITION BY target) WHEN now IS NULL THEN 'unknown target' WHEN was <> now THEN 'stale' END AS problem FROM e LEFT JOIN f USING (target))
SELECT seq::BIGINT AS seq, problem FROM j""")
def overlay_values(spark, d):
    """Corrections of single values: each order of a high price corrects the status of itself or the one before; second ones and stale ones are told."""
    o = load(spark, d, "orders")
    fields = o.select(F.col("o_orderkey").alias("target"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))
    k = F.col("o_orderkey")
    entries = o.filter("o_totalprice > 150000").select(k.alias("seq"), F.concat(F.lit("e"), k.cast("string")).alias("id"), F.expr("o_orderkey div 2 * 2").alias("target"), F.lit("status").alias("field"), F.when(k % 50 == 49, "stale").otherwise(F.col("o_orderstatus")).alias("was"), F.lit("X").alias("value"))
    return layers.judge_values(fields, entries).select("seq", "problem")


# ---- graphs ----

SQL_INCLUDES = f"SELECT l_orderkey AS section, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) AS n, 'p' || l_partkey AS text, CASE WHEN l_orderkey % 997 = 5 AND l_linenumber = 1 THEN -1 WHEN l_orderkey % 499 = 100 AND l_linenumber = 3 THEN l_orderkey * 2 WHEN l_orderkey >= 64 AND l_linenumber = 2 THEN l_orderkey // 2 END AS target FROM lineitem"


@query(f"""WITH RECURSIVE l AS MATERIALIZED ({SQL_INCLUDES}), p(section, dst) AS (SELECT section, target FROM l WHERE target IS NOT NULL UNION SELECT p.section, l.target FROM p JOIN l ON l.section = p.dst WHERE l.target IS NOT NULL),
bad AS (SELECT section AS dst, 'loop' AS problem FROM p WHERE section = dst UNION SELECT dst, 'missing' FROM p WHERE dst NOT IN (SELECT section FROM l)), w AS MATERIALIZED (SELECT section, min(problem) AS problem FROM p JOIN bad USING (dst) GROUP BY section),
x AS (SELECT section AS root, [n] AS path, section AS source, n, text, target FROM l WHERE section NOT IN (SELECT section FROM w) UNION ALL SELECT root, list_append(path, l.n), l.section, l.n, l.text, l.target FROM x JOIN l ON l.section = x.target)
SELECT root AS section, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place, source, n, text, NULL AS problem FROM x WHERE target IS NULL UNION ALL SELECT section, NULL, NULL, NULL, NULL, problem FROM w""")
def include_expand(spark, d):
    """An order's lines with the lines of the orders that it includes in their places, to any depth; orders that include themselves in the end, or one that is nowhere, are told."""
    l, k = load(spark, d, "lineitem"), F.col("l_orderkey")
    target = F.when((k % 997 == 5) & (F.col("l_linenumber") == 1), -1).when((k % 499 == 100) & (F.col("l_linenumber") == 3), k * 2).when((k >= 64) & (F.col("l_linenumber") == 2), F.expr("l_orderkey div 2"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)).cast("long")
    lines, problems = graph.expand(l.select(k.alias("section"), n.alias("n"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), target.cast("long").alias("target")))
    return lines.unionByName(problems, allowMissingColumns=True)


SQL_NEEDS = "SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_size > 5 UNION ALL SELECT p_partkey // 9, p_partkey FROM part WHERE p_size = 50)"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({SQL_NEEDS}), p(src, dst) AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON e.src = p.dst),
c AS MATERIALIZED (SELECT node, least(node, min(x)) AS component FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN (SELECT a.src AS n, a.dst AS x FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src) ON n = node GROUP BY node),
d AS MATERIALIZED (SELECT DISTINCT a.component AS a, b.component AS b FROM e JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.component <> b.component),
y(part, depth) AS (SELECT DISTINCT component, 0 FROM c UNION SELECT d.b, depth + 1 FROM y JOIN d ON d.a = y.part)
SELECT node, component, (SELECT max(depth) FROM y WHERE part = component)::BIGINT AS layer FROM c""")
def build_order(spark, d):
    """In which order parts can be built that need one another, with the cycles that are built at once."""
    p = load(spark, d, "part")
    edges = p.filter("p_size > 5").selectExpr("p_partkey as src", "p_partkey div 3 as dst").unionByName(p.filter("p_size = 50").selectExpr("p_partkey div 9 as src", "p_partkey as dst"))
    return graph.build_order(edges).select("node", "component", F.col("layer").cast("long").alias("layer"))


SQL_CHAIN = """WITH RECURSIVE l AS MATERIALIZED (SELECT p_partkey AS src, {dst} AS dst FROM part WHERE p_size > 3), r(node, here) AS (SELECT src, dst FROM l UNION SELECT node, dst FROM r JOIN l ON src = here),
e AS (SELECT node, max(here) FILTER (here NOT IN (SELECT src FROM l)) AS last, count(*) AS n FROM r GROUP BY node)
SELECT node, last AS "end", CASE WHEN last IS NOT NULL THEN n END::BIGINT AS n, CASE WHEN last IS NULL THEN 'loop' ELSE 'end' END AS state FROM e"""


@query(SQL_CHAIN.format(dst="(p_partkey * 7 + 3) % (SELECT count(*) + 10 FROM part)"))
def chain_states(spark, d):
    """Chains of links of any length with how each ends: at a key without a link, or never."""
    p = load(spark, d, "part")
    size = p.count() + 10
    return graph.chains(p.filter("p_size > 3").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % size).alias("dst"))).select("node", "end", "n", "state")


@query(SQL_CHAIN.format(dst="p_partkey // 3"))
def recursive_chain(spark, d):
    return graph.chains(load(spark, d, "part").filter("p_size > 3").selectExpr("p_partkey as src", "p_partkey div 3 as dst")).select("node", "end", "n", "state")


# ---- pages ----


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, {', '.join(LINE)}) AS n, l_quantity::DECIMAL(18,2) AS q, l_linenumber = 5 AS f FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT k, n, q::DECIMAL(18,2) AS used, 1 AS c, 1::BIGINT AS page, 49 AS room, CASE WHEN q > 49 THEN 0 END::BIGINT AS tall FROM l WHERE n = 1 UNION ALL
  SELECT k, n, CASE WHEN begins THEN q ELSE used + 2.5 + q END::DECIMAL(18,2), CASE WHEN begins THEN 1 ELSE c + 1 END, CASE WHEN begins THEN page + 1 ELSE page END, CASE WHEN begins THEN 100 ELSE room END, CASE WHEN begins AND q > 100 THEN n - 1 END
  FROM (SELECT l.k, l.n, l.q, used, c, page, room, c >= 6 OR used + 2.5 + l.q > room OR l.f AS begins FROM r JOIN l ON l.k = r.k AND l.n = r.n + 1))
SELECT k AS o_custkey, n::BIGINT AS n, CASE WHEN min(tall) OVER (PARTITION BY k) IS NULL THEN page END AS page, min(tall) OVER (PARTITION BY k) AS too_tall FROM r""")
def page_fill(spark, d):
    """A customer's lines on pages: a small first page, at most six lines a page, a gap between lines, breaks before fifth lines; a first line too tall for its page stops all."""
    lines = load(spark, d, "orders").select("o_custkey", "o_orderkey").join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", *LINE), "o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", *LINE)).cast("long")
    df = lines.select("o_custkey", n.alias("n"), F.col("l_quantity").cast("double").alias("height"), (F.col("l_linenumber") == 5).alias("forced"))
    return pages.paginate(df, "o_custkey", ["n"], "height", 100.0, 49.0, 2.5, 6, "forced").select("o_custkey", "n", "page", "too_tall")

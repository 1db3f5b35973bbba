"""Queries of scored and tiered matches, citations, key rules and edits on the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as t
from ..operators import matching as m
from ..operators.ordered import by
from ..sources.tables import load

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


NAMES = "(SELECT DISTINCT p_name AS {0}, split_part(p_name, ' ', 2) AS k FROM part)"


def names(spark, d, name):
    return load(spark, d, "part").select(F.col("p_name").alias(name), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("k")).distinct()


def scored(spark, d):
    """Pairs of names with one second word: score is the similarity less a penalty for another first letter."""
    pairs = names(spark, d, "a").join(names(spark, d, "b"), "k").filter("a <> b")
    penalty = F.when(F.substring("a", 1, 1) == F.substring("b", 1, 1), 0.0).otherwise(0.1)
    return pairs.select("a", "b", F.round(t.similarity(F.col("a"), F.col("b")) - penalty, 6).alias("score"))


SCORED = f"SELECT a, b, round(1.0 - levenshtein(a, b) / greatest(length(a), length(b)) - CASE WHEN a[1:1] = b[1:1] THEN 0 ELSE 0.1 END, 6) AS score FROM {NAMES.format('a')} x JOIN {NAMES.format('b')} y ON x.k = y.k AND a <> b"


@query(f"SELECT a, b, score FROM ({SCORED}) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1")
def scored_match(spark, d):
    return m.first_of(scored(spark, d), ["a"], F.desc("score"), "b")


@query(f"SELECT a, b, CASE WHEN score >= 0.7 THEN 1 WHEN score >= 0.55 AND a[1:1] = b[1:1] THEN 2 ELSE 3 END::BIGINT AS tier FROM ({SCORED}) QUALIFY row_number() OVER (PARTITION BY a ORDER BY CASE WHEN score >= 0.7 THEN 1 WHEN score >= 0.55 AND a[1:1] = b[1:1] THEN 2 ELSE 3 END, score DESC, b) = 1")
def tiered_match(spark, d):
    tier = F.when(F.col("score") >= 0.7, 1).when((F.col("score") >= 0.55) & (F.substring("a", 1, 1) == F.substring("b", 1, 1)), 2).otherwise(3)
    return m.first_of(scored(spark, d).withColumn("tier", tier.cast("long")), ["a"], "tier", F.desc("score"), "b").select("a", "b", "tier")


@query(f"SELECT a, b, CASE WHEN score >= 0.7 AND coalesce(score - nxt, 1) >= 0.05 THEN 'matched' WHEN score >= 0.5 THEN 'proposed' ELSE 'broken' END AS decision FROM (SELECT *, lead(score) OVER (PARTITION BY a ORDER BY score DESC, b) AS nxt, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM ({SCORED})) WHERE n = 1")
def decision_margin(spark, d):
    w = by(["a"], F.desc("score"), "b")
    r = scored(spark, d).withColumn("nxt", F.lead("score").over(w)).withColumn("n", F.row_number().over(w)).filter("n = 1")
    clear = (F.col("score") >= 0.7) & (F.round(F.coalesce(F.col("score") - F.col("nxt"), F.lit(1.0)), 12) >= 0.05)
    return r.select("a", "b", F.when(clear, "matched").when(F.col("score") >= 0.5, "proposed").otherwise("broken").alias("decision"))


@query()
def block_ratio(spark, d):
    pairs = names(spark, d, "a").join(names(spark, d, "b"), "k").filter("a <> b")
    return pairs.select("a", "b", sim.block_ratio("a", "b").alias("ratio"), sim.word_match("a", "b").alias("words"), sim.difference_kind("a", "b").alias("kind"))


@query(r"""SELECT doc_id, pos::BIGINT AS pos, m AS citation FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ \d+')) AS m, unnest(range(0, len(regexp_extract_all(text, '[A-Z][a-z]+ \d+')))) AS pos FROM documents)""")
def citation_list(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+ \d+"), F.lit(0))).alias("pos", "citation")).withColumn("pos", F.col("pos").cast("long"))


@query(r"""SELECT s_suppkey, CASE regexp_extract(c, 'Pars ([IVl1]+)', 1) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'l' THEN 1 WHEN 'IV' THEN 4 END::BIGINT AS volume, TRY_CAST(translate(regexp_extract(c, 'p\. ?([0-9OIl]+)', 1), 'OIl', '011') AS BIGINT) AS page
FROM (SELECT s_suppkey, 'Pars ' || CASE s_suppkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'l' ELSE 'IV' END || ', p. ' || replace(s_suppkey::VARCHAR, '0', 'O') AS c FROM supplier)""")
def parse_citation(spark, d):
    """Citations with scanning damage, made by rule: the volume by a map, the page after its letters are repaired."""
    k = F.col("s_suppkey")
    part = F.when(k % 4 == 0, "I").when(k % 4 == 1, "II").when(k % 4 == 2, "l").otherwise("IV")
    c = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Pars "), part, F.lit(", p. "), F.replace(k.cast("string"), F.lit("0"), F.lit("O"))).alias("c"))
    volume = F.element_at(F.create_map(*map(F.lit, ["I", 1, "II", 2, "l", 1, "IV", 4])), F.regexp_extract("c", "Pars ([IVl1]+)", 1))
    return c.select("s_suppkey", volume.cast("long").alias("volume"), F.translate(F.regexp_extract("c", r"p\. ?([0-9OIl]+)", 1), "OIl", "011").try_cast("long").alias("page"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'promo' ELSE lower(replace(p_brand, '#', '-')) END || ':' || lower(split_part(p_name, ' ', 1)) AS key FROM part")
def key_rules(spark, d):
    head = F.when(F.col("p_type") == "PROMO", "promo").otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
    return load(spark, d, "part").select("p_partkey", F.concat(head, F.lit(":"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("key"))


def parsed_dates(o):
    """Dates written as damaged day and month names, parsed by a repaired day and the month's first three letters."""
    months = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    written = F.concat(F.translate(F.dayofmonth("o_orderdate").cast("string"), "10", "lO"), F.lit(". "), F.date_format("o_orderdate", "MMMM"))
    month = F.array_position(F.array(*map(F.lit, months)), F.lower(F.substring(F.split_part("w", F.lit(" "), F.lit(2)), 1, 3)))
    day = F.translate(F.split_part("w", F.lit("."), F.lit(1)), "lO", "10").try_cast("int")
    return o.select("o_orderkey", F.year("o_orderdate").alias("y"), written.alias("w")).select("o_orderkey", F.make_date("y", month.cast("int"), day).cast("string").alias("day"))


@query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders""")
def fuzzy_date_all(spark, d):
    """The date of every order, from its damaged day and month name and its year."""
    return parsed_dates(load(spark, d, "orders"))


@query("""SELECT user_id, event_type, min(event_id) AS first_event, count(*)::BIGINT AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 2) AS total FROM (SELECT *, sum(CASE WHEN event_type = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, event_type, g HAVING count(*) > 1""")
def tie_merge(spark, d):
    """Adjacent rows of one kind merge into the first, with their summed value."""
    from ..operators.ordered import islands

    i = islands(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return i.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total")).filter("n > 1").drop("island")


@query("""SELECT o_custkey, array_to_string(list_concat(k[1:1], [-1], k[2:]), ',') AS keys FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders GROUP BY 1)""")
def array_edit(spark, d):
    a = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("r")).select("o_custkey", F.col("r.o_orderkey").alias("k"))
    return a.select("o_custkey", F.array_join(F.array_insert("k", 2, F.lit(-1).cast("long")).cast("array<string>"), ",").alias("keys"))


@query("""SELECT s_suppkey, coalesce(TRY_CAST(q AS DATE)::VARCHAR, 'key ' || q) AS target FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '1998-0' || (s_suppkey % 9 + 1) || '-30' ELSE s_name END AS q FROM supplier)""")
def date_or_key(spark, d):
    q = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("1998-0"), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit("-30"))).otherwise(F.col("s_name"))
    return load(spark, d, "supplier").select("s_suppkey", q.alias("q")).select("s_suppkey", F.coalesce(F.expr("try_to_date(q, 'yyyy-MM-dd')").cast("string"), F.concat(F.lit("key "), "q")).alias("target"))


@query("""SELECT o_orderkey, o_orderkey % 89 = 0 AS refused FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0""")
def allowed_changes(spark, d):
    """Rows that differ from the base: only changes of the status are allowed."""
    base = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    k = F.col("o_orderkey")
    new = base.select("o_orderkey", F.when(k % 97 == 0, "X").otherwise(F.col("s")).alias("s2"), F.when(k % 89 == 0, "9-NEW").otherwise(F.col("p")).alias("p2"))
    return base.join(new, "o_orderkey").filter("s <> s2 or p <> p2").select("o_orderkey", (F.col("p") != F.col("p2")).alias("refused"))


@query("""SELECT o_custkey, string_agg(x, ',' ORDER BY x) AS marks FROM (SELECT DISTINCT o_custkey, o_orderpriority AS x FROM orders UNION SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY 1""")
def union_dedupe_sort(spark, d):
    """Two value columns as one set in one pass: an array exploded, collected as a set."""
    return load(spark, d, "orders").select("o_custkey", F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("x")).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("marks"))


@query("""SELECT l_orderkey, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f, l_partkey)::BIGINT AS id FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2)""")
def canonical_ids(spark, d):
    """Ids renamed by first appearance."""
    first = load(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("f"))
    return first.select("l_orderkey", "l_partkey", F.dense_rank().over(by(["l_orderkey"], "f", "l_partkey")).cast("long").alias("id"))


@query("SELECT o_orderkey, true AS same FROM orders")
def json_roundtrip(spark, d):
    row = F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")
    back = F.from_json(F.to_json(row), "o_orderkey long, o_orderstatus string, o_orderpriority string")
    return load(spark, d, "orders").select("o_orderkey", (back == row).alias("same"))


@query("""SELECT page_id, path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS state FROM (SELECT page_id, split_part(url, '?', 1) AS path, length(html) AS a FROM pages WHERE page_id % 11 <> 0) FULL JOIN (SELECT page_id, split_part(url, '?', 1) AS path, length(html) + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS b FROM pages WHERE page_id % 13 <> 0) USING (page_id, path) WHERE a IS DISTINCT FROM b""")
def tree_diff(spark, d):
    p = load(spark, d, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("path"), F.length("html").alias("n"))
    a = p.filter("page_id % 11 <> 0").withColumnRenamed("n", "a")
    b = p.filter("page_id % 13 <> 0").select("page_id", "path", (F.col("n") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)).alias("b"))
    both = a.join(b, ["page_id", "path"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("page_id", "path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("state"))


@query("""SELECT o_orderkey, o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM orders""")
def evidence_resolve(spark, d):
    """The running floor that verified rows set for those after them."""
    w = by(["o_custkey"], "o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).over(w).alias("floor"))

"""Queries of nested literals, scores, staged bindings, approvals, borrowed parts and nested validation on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import literals
from ..operators import binding, scores
from ..sources.tables import load

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT event_id, '{"f":null,"k":' || (props::JSON ->> 'k') || ',"list":[1,"it''s \\"' || event_type || '\\""],"ok":true}' AS json, '"k": ' || (props::JSON ->> 'k') AS block FROM events""")
def nested_literals(spark, d):
    """Object literals with bare keys, comments, trailing commas and functions, as JSON; and the block between the outermost braces of a text."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit("{k: "), k, F.lit(", /* c */ 'list': [1, 'it\\'s \""), "event_type", F.lit("\"',], f: function (a) { return [a, {}]; }, ok: true // end\n}"))
    blocks = literals.balanced_blocks(F.concat(F.lit("% {a}\n\\{ x"), "props", F.lit("{")))
    return load(spark, d, "events").select("event_id", literals.object_literal(text).alias("json"), F.get(blocks, F.lit(0)).alias("block"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem WHERE l_orderkey % 10 <> 0)
SELECT l_orderkey, l_linenumber::VARCHAR AS measure, i::BIGINT AS place, ['c', 'd', 'e', 'f', 'g', 'a', 'b'][(l_suppkey % 7 + 1)::INT] || '4' AS pitch, CASE l_returnflag WHEN 'N' THEN '1/6' WHEN 'R' THEN '3/8' ELSE '1/4' END AS length, NULL AS error FROM l
UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL::BIGINT, NULL, NULL, 'declares entities' FROM lineitem WHERE l_orderkey % 10 = 0""")
def score_scan(spark, d):
    """Scores in XML, one an order: measures by line number, tuplets for one flag and dots for another; some are refused."""
    pitch = F.element_at(F.array(*map(F.lit, "cdefgab")), (F.col("l_suppkey") % 7 + 1).cast("int"))
    plain = F.concat(F.lit('<note pname="'), pitch, F.lit('" oct="4" dur="4"'))
    flag = F.col("l_returnflag")
    note = F.when(flag == "N", F.concat(F.lit('<tuplet num="3" numbase="2"><beam>'), plain, F.lit("/></beam></tuplet>"))).when(flag == "R", F.concat(plain, F.lit(' dots="1"/>'))).otherwise(F.concat(plain, F.lit("/>")))
    l = load(spark, d, "lineitem").withColumn("note", note)
    measures = l.groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "note"))), lambda x: x["note"]), "").alias("m"))
    measure = F.concat(F.lit('<measure n="'), F.col("l_linenumber").cast("string"), F.lit('"><staff><layer n="1">'), "m", F.lit("</layer></staff></measure>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", measure.alias("x")))), lambda x: x["x"]), "")
    docs = measures.groupBy("l_orderkey").agg(F.concat(F.when(F.col("l_orderkey") % 10 == 0, "<!DOCTYPE x>").otherwise(""), F.lit('<mei xmlns="urn:x">'), body, F.lit("</mei>")).alias("xml"))
    e = scores.score_events(docs, "l_orderkey", "xml")
    return e.select("l_orderkey", "measure", "place", "pitch", F.concat(F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string")).alias("length"), "error")


@query("""WITH w AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_name || p_size END AS alias, p_brand || '/' || p_size AS seed, p_type || p_retailprice AS owner FROM part),
e AS (SELECT 'id' || lpad(key::VARCHAR, 9, '0') AS id, CASE WHEN key % 2 = 0 THEN alias END AS alias, seed || CASE WHEN key % 5 = 0 THEN 'x' ELSE '' END AS seed, owner FROM w WHERE key % 4 <> 1),
s1 AS (SELECT alias, count(*) AS n, min(id) AS id FROM e WHERE alias IS NOT NULL GROUP BY 1), j1 AS (SELECT w.*, s1.n, s1.id, count(*) OVER (PARTITION BY w.alias) AS r FROM w LEFT JOIN s1 USING (alias)),
d1 AS (SELECT key, CASE WHEN n = 1 AND r = 1 THEN id END AS id, 'alias' AS stage, CASE WHEN n > 1 THEN 'ambiguous' WHEN r > 1 THEN 'claimed twice' END AS error FROM j1 WHERE id IS NOT NULL), l1 AS (SELECT key, alias, seed, owner FROM j1 WHERE id IS NULL), e1 AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM d1 WHERE id IS NOT NULL)),
s2 AS (SELECT seed, count(*) AS n, min(id) AS id FROM e1 GROUP BY 1), j2 AS (SELECT l1.*, s2.n, s2.id, count(*) OVER (PARTITION BY l1.seed) AS r FROM l1 LEFT JOIN s2 USING (seed)),
d2 AS (SELECT key, CASE WHEN n = 1 AND r = 1 THEN id END AS id, 'seed' AS stage, CASE WHEN n > 1 THEN 'ambiguous' WHEN r > 1 THEN 'claimed twice' END AS error FROM j2 WHERE id IS NOT NULL), l2 AS (SELECT key, alias, seed, owner FROM j2 WHERE id IS NULL), e2 AS (SELECT * FROM e1 WHERE id NOT IN (SELECT id FROM d2 WHERE id IS NOT NULL)),
s3 AS (SELECT owner, count(*) AS n, min(id) AS id FROM e2 GROUP BY 1), j3 AS (SELECT l2.*, s3.n, s3.id, count(*) OVER (PARTITION BY l2.owner) AS r FROM l2 LEFT JOIN s3 USING (owner)),
d3 AS (SELECT key, CASE WHEN n = 1 AND r = 1 THEN id END AS id, 'owner' AS stage, CASE WHEN n > 1 THEN 'ambiguous' WHEN r > 1 THEN 'claimed twice' END AS error FROM j3 WHERE id IS NOT NULL)
SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT key, NULL, NULL, NULL FROM j3 WHERE id IS NULL""")
def staged_keys(spark, d):
    """Parts bound to the entries of an older ledger: by alias, then seed, then owner; ambiguous and doubly claimed keys are errors."""
    text = lambda *c: F.concat(*(F.col(x).cast("string") for x in c))
    w = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 3 == 0, text("p_name", "p_size")).alias("alias"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("seed"), text("p_type", "p_retailprice").alias("owner"))
    e = w.filter("key % 4 <> 1").select(F.concat(F.lit("id"), F.lpad(F.col("key").cast("string"), 9, "0")).alias("id"), F.when(F.col("key") % 2 == 0, F.col("alias")).alias("alias"), F.concat("seed", F.when(F.col("key") % 5 == 0, "x").otherwise("")).alias("seed"), "owner")
    return binding.bind(w, e, ["alias", "seed", "owner"]).select("key", "id", "stage", "error")


@query("""WITH i AS (SELECT o_orderkey AS k, sha256(o_orderstatus || o_custkey) AS digest FROM orders),
a AS (SELECT o_orderkey AS k, sha256(CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE o_orderstatus || o_custkey END) AS digest, o_orderkey AS t, 'e' || (o_orderkey % 3) AS who, CASE WHEN o_orderkey % 14 = 0 THEN 'revoked' ELSE 'approved' END AS verdict FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT digest, arg_min(who, (t, who)) AS who FROM a WHERE verdict = 'approved' GROUP BY 1), b AS (SELECT DISTINCT k, true AS earlier FROM a WHERE verdict = 'approved'),
j AS (SELECT i.k, a.verdict, a.who, s.who AS other, earlier FROM i LEFT JOIN a ON a.k = i.k AND a.digest = i.digest LEFT JOIN s ON s.digest = i.digest LEFT JOIN b ON b.k = i.k),
r AS (SELECT *, CASE WHEN verdict = 'approved' THEN 'current' WHEN verdict = 'revoked' THEN 'revoked' WHEN other IS NOT NULL THEN 'carried' WHEN earlier THEN 'lapsed' ELSE 'open' END AS state FROM j)
SELECT k, state, CASE state WHEN 'current' THEN who WHEN 'carried' THEN other END AS "by" FROM r""")
def approval_currency(spark, d):
    """Approvals hold for the digest that they were given for: current, revoked, carried over from an equal one, lapsed, or open."""
    o = load(spark, d, "orders")
    digest = F.concat("o_orderstatus", F.col("o_custkey").cast("string"))
    k = F.col("o_orderkey")
    items = o.select(k.alias("k"), F.sha2(digest, 256).alias("digest"))
    given = o.filter(k % 2 == 0).select(k.alias("k"), F.sha2(F.when(k % 5 == 0, "old").otherwise(digest), 256).alias("digest"), k.alias("at"), F.concat(F.lit("e"), (k % 3).cast("string")).alias("by"), F.when(k % 14 == 0, "revoked").otherwise("approved").alias("verdict"))
    return binding.approval_states(items, given, "k")


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t, l_partkey AS v, CASE WHEN l_returnflag = 'R' THEN l_orderkey - 1 WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN -5 END AS lender FROM lineitem),
n AS (SELECT k AS lender, count(*) AS n FROM l WHERE lender IS NULL GROUP BY 1), p AS (SELECT l.*, n, sum(coalesce(n, 1)) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l LEFT JOIN n USING (lender)),
o AS (SELECT k AS lender, row_number() OVER (PARTITION BY k ORDER BY t) AS i, v FROM l WHERE lender IS NULL)
SELECT k, (coalesce(b, 0) + 1)::BIGINT AS place, v AS value, CASE WHEN lender IS NULL THEN 'own' ELSE 'unresolved' END AS source FROM p WHERE n IS NULL
UNION ALL SELECT p.k, (coalesce(b, 0) + i)::BIGINT, o.v, 'borrowed' FROM p JOIN o USING (lender) WHERE n IS NOT NULL""")
def borrowed_parts(spark, d):
    """Lines of an order that borrow the lines of the order before, put in their places and numbered anew."""
    flag = F.col("l_returnflag")
    lender = F.when(flag == "R", F.col("l_orderkey") - 1).when((flag == "A") & (F.col("l_linenumber") == 1), F.lit(-5).cast("long"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("at"), F.col("l_partkey").alias("value"), lender.alias("lender"))
    out = binding.with_borrowed(l, l.filter("lender is null").select("k", "at", "value"), "k", ["at"], "lender")
    return out.select("k", F.col("place").cast("long").alias("place"), "value", "source")


@query("""SELECT o_orderkey, n, CASE WHEN kind = 'ibid' THEN last_value(vol IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) ELSE vol END AS volume, page::BIGINT AS page
FROM (SELECT o_orderkey, o_custkey, unnest([1, 2])::BIGINT AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'ibid' ELSE 'cite' END AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'II' ELSE 'IV' END END AS vol, o_orderkey % 400 + unnest([0, 7]) AS page FROM orders)
QUALIFY true""")
def citations_carried(spark, d):
    """All citations of a text; `ibid.` has the volume of the last full one of the same customer."""
    k = F.col("o_orderkey")
    head = F.when(k % 3 == 0, "ibid.").otherwise(F.concat(F.lit("Pars "), F.when(k % 2 == 0, "II").otherwise("IV")))
    text = F.concat(F.lit("see "), head, F.lit(", p. "), (k % 400).cast("string"), F.lit("; also "), head, F.lit(", p."), (k % 400 + 7).cast("string"), F.lit("."))
    c = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.posexplode(F.regexp_extract_all(text, F.lit(r"(?:Pars [IVX]+|ibid\.), p\. ?\d+"), F.lit(0))).alias("at", "cite"))
    volume = F.nullif(F.regexp_extract("cite", "Pars ([IVX]+)", 1), F.lit(""))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "at").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("o_orderkey", (F.col("at") + 1).cast("long").alias("n"), F.last(volume, ignorenulls=True).over(w).alias("volume"), F.regexp_extract("cite", r"(\d+)$", 1).cast("long").alias("page"))


KINDS = {"fixed": ["month", "day"], "moved": ["offset"], "weekly": ["week", "day"]}


@query("""WITH r AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'moved' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'weekly' ELSE 'odd' END END AS kind, (o_orderkey % 14)::INT AS month, (o_orderkey % 33)::INT AS day, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 500)::INT END AS off, (o_orderkey % 40)::INT AS week FROM orders),
e AS (SELECT k, kind, CASE WHEN kind = 'odd' THEN 'unknown kind' END AS a, CASE WHEN kind = 'fixed' AND month NOT BETWEEN 1 AND 12 THEN 'month' END AS b, CASE WHEN kind = 'fixed' AND day NOT BETWEEN 1 AND 31 OR kind = 'weekly' AND day NOT BETWEEN 1 AND 7 THEN 'day' END AS c, CASE WHEN kind = 'moved' AND (off IS NULL OR off NOT BETWEEN 0 AND 366) THEN 'offset' END AS d, CASE WHEN kind = 'weekly' AND week NOT BETWEEN 1 AND 34 THEN 'week' END AS w FROM r),
f AS (SELECT k, kind, array_to_string(list_filter([a, b, c, d, w], lambda x: x IS NOT NULL), ',') AS errors FROM e)
SELECT k, kind, errors, count(*) FILTER (errors = '') OVER (PARTITION BY kind)::BIGINT AS covered FROM f""")
def nested_rules(spark, d):
    """Occasion documents as JSON: rules by kind with the ranges of their fields, all errors at once, and how many sound ones each kind has."""
    k = F.col("o_orderkey")
    s = F.col("o_orderstatus")
    kind = F.when(s == "F", "fixed").when(s == "O", "moved").when(k % 2 == 0, "weekly").otherwise("odd")
    rule = F.struct(kind.alias("kind"), (k % 14).alias("month"), (k % 33).alias("day"), F.when(k % 7 != 0, k % 500).alias("offset"), (k % 40).alias("week"))
    doc = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_json(F.struct(rule.alias("rule"))).alias("doc"))
    r = doc.select("k", F.from_json("doc", "rule struct<kind: string, month: int, day: int, offset: int, week: int>").alias("d")).select("k", "d.rule.*")
    out = lambda c, lo, hi: F.col(c).isNull() | ~F.col(c).between(lo, hi)
    is_ = lambda x: F.col("kind") == x
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS), "unknown kind"),
            F.when(is_("fixed") & out("month", 1, 12), "month"),
            F.when(is_("fixed") & out("day", 1, 31) | is_("weekly") & out("day", 1, 7), "day"),
            F.when(is_("moved") & out("offset", 0, 366), "offset"),
            F.when(is_("weekly") & out("week", 1, 34), "week"),
        )
    )
    judged = r.select("k", "kind", F.array_join(errors, ",").alias("errors"))
    # kinds are a few: counted, then joined back
    sound = judged.groupBy("kind").agg(F.count_if(F.col("errors") == "").alias("covered"))
    return judged.join(F.broadcast(sound), "kind").select("k", "kind", "errors", "covered")

"""Queries of catalogue rules at full size: folding, vocabularies, trees, exact fractions, ledgers, notation, page tables and scans, on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import folding as fo
from ..functions import notation
from ..functions import rationals as q
from ..functions import similarity as sim
from ..functions import text as t
from ..operators import alignment, eventlog, graph, ledger, trees, vocabulary
from ..sources import files
from ..sources.tables import load

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ---- texts ----


@query("SELECT doc_id, sha256(strip_accents(lower(replace(replace(replace(replace(text, 'æ', 'ae'), 'Æ', 'ae'), 'œ', 'oe'), 'Œ', 'oe')))) AS folded FROM documents")
def fold_nfkd(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(fo.fold_nfkd(F.col("text")), 256).alias("folded"))


#: What headings end in, by key: damaged numerals, ordinals, stopwords, and words that are none of these.
ENDINGS = ["Ill", "Vil", "IV.", "prima", "et de", "|x b", "lilac1", "Feria tertia"]
HEADINGS = f"(SELECT p_partkey, p_name || ' ' || {ENDINGS}[(p_partkey % {len(ENDINGS)} + 1)::INT] AS h FROM part)"


def headings(spark, d):
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), ending).alias("h"))



def sql_numeral(w: str) -> str:
    return f"({w} <> '' AND regexp_matches({w}, '{fo.NUMERAL}'))"


def sql_words(h: str) -> str:
    clean = f"translate(w, '{fo.DAMAGED}', '{fo.MENDED}')"
    mended = f"CASE WHEN length(w) <= 5 AND regexp_matches(w, '^[ivxl1|!/]+$') AND regexp_matches(w, '[ivx]') AND {sql_numeral(clean)} THEN {clean} ELSE w END"
    ordinals = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fo.ORDINALS.items())
    steps = [f"regexp_extract_all(lower({h}), '[a-z1|!/]+')"]
    steps.append(f"list_transform({steps[-1]}, lambda w: {mended})")
    steps.append(f"list_transform({steps[-1]}, lambda w: CASE WHEN {sql_numeral('w')} THEN w ELSE regexp_replace(w, '[1|!/]', '', 'g') END)")
    steps.append(f"list_transform({steps[-1]}, lambda w: CASE w {ordinals} ELSE w END)")
    stop = ", ".join(f"'{w}'" for w in fo.STOPWORDS)
    return f"list_sort(list_distinct(list_filter({steps[-1]}, lambda w: w NOT IN ({stop}) AND (length(w) > 1 OR {sql_numeral('w')}))))"


@query(f"SELECT p_partkey, array_to_string({sql_words('h')}, ' ') AS words FROM {HEADINGS}")
def heading_words(spark, d):
    return headings(spark, d).select("p_partkey", F.array_join(fo.heading_words(F.lower("h")), " ").alias("words"))


@query("SELECT p_partkey, list_min(list_transform(range(1, length(p_name) + 1), lambda i: levenshtein(substring(p_name, i, 6), 'widget')))::BIGINT AS distance FROM part")
def sliding_lev_all(spark, d):
    """As sliding_lev, from every start."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("p_name"), F.lit(1)))
    least = F.array_min(F.transform(starts, lambda i: F.levenshtein(F.substring("p_name", i, F.lit(6)), F.lit("widget"))))
    return load(spark, d, "part").select("p_partkey", least.cast("long").alias("distance"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 4 AND 39 AND contains(n, 'i') AND length(n) <= 5 THEN p_size WHEN p_size IN (40, 41, 42) THEN p_size - 29 WHEN p_size = 45 THEN 14 END::BIGINT AS n FROM (SELECT p_partkey, p_size, repeat('x', (p_size // 10)::INT) || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(p_size % 10 + 1)::INT] AS n FROM part)")
def roman_mended(spark, d):
    """Numerals as scanners read them, their i as l, mended and read. Those of l alone, of more than five letters or without an i stay as they are, and what they are
    is not told; an l for fifty is mended like any other, so forty reads as eleven."""
    damaged = F.translate(F.lower(t.to_roman(F.col("p_size"))), "i", "l")
    p = load(spark, d, "part").select("p_partkey", damaged.alias("w")).withColumn("m", fo.mended_numeral(F.col("w")))
    return p.select("p_partkey", F.when(F.col("m") != F.col("w"), t.roman_value(F.upper("m"))).cast("long").alias("n"))


# ---- vocabularies: the callback is any function of two strings ----


def lev_score(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return round(1.0 - row[-1] / max(len(a), len(b), 1), 6)


@query("""SELECT c_custkey, CASE WHEN score >= 0.3 THEN n_nationkey END AS n_nationkey, score FROM (SELECT c_custkey, n_nationkey, round(1.0 - levenshtein(m, n_name) / greatest(length(m), length(n_name)), 6) AS score FROM (SELECT c_custkey, c_mktsegment AS m FROM customer), nation)
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, n_nationkey) = 1""")
def udf_surface(spark, d):
    """A Python callback as the score of a vocabulary match: each distinct title is scored once against the nations, block by block. A best score below 0.3 is told without a nation."""
    c, n = load(spark, d, "customer").select("c_custkey", "c_mktsegment"), load(spark, d, "nation")
    pairs = vocabulary.called_pairs(c.select(F.col("c_mktsegment").alias("s")), n.select(F.col("n_name").alias("s")), lev_score)
    best = vocabulary.best_entries(c, n, "c_mktsegment", "n_nationkey", "n_name", pairs)
    return best.select("c_custkey", F.when(F.col("score") >= 0.3, F.col("n_nationkey")).alias("n_nationkey"), "score")


@query()
def vocabulary_match(spark, d):
    """Headings against the table of part names, numerals and damaged words and all. Each distinct heading is read and matched once."""
    words = lambda c: fo.heading_words(F.lower(c))
    rows = headings(spark, d)
    titles = graph._cut(rows.select(F.col("h").alias("heading")).distinct().select("heading", words("heading").alias("words")))
    entries = graph._cut(load(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("key")).select("key", words("p_name").alias("words")))
    joined = lambda df: df.withColumn("title", F.array_join("words", " "))
    pairs = vocabulary.title_pairs(titles, entries, 0.6)
    best = graph._cut(vocabulary.best_entries(joined(titles), joined(entries), "title", "key", "title", pairs).select("heading", "key", "score"))
    return rows.join(best, F.col("h").eqNullSafe(F.col("heading")), "left").select("p_partkey", "key", "score")


@query()
def running_head(spark, d):
    """Running heads against a vocabulary: a ratio, or a bonus where the head or the entry lies whole in the other."""
    heads = headings(spark, d).select("p_partkey", t.condense(F.col("h")).alias("head"))
    entries = load(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("key")).select("key", t.condense(F.col("p_name")).alias("name"))
    pairs = vocabulary.head_pairs(heads.select(F.col("head").alias("s")), entries.select(F.col("name").alias("s")))
    return vocabulary.best_entries(heads, entries, "head", "key", "name", pairs).select("p_partkey", "key", "score")


@query()
def sequence_scores(spark, d):
    """How much of an order's row of suppliers the customer's next order has, by the steps between them; and what share of its name's letters."""
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r")).select(F.col("l_orderkey").alias("o_orderkey"), F.transform("r", lambda x: x["l_suppkey"].cast("int")).alias("steps"))
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(lines, "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    both = o.withColumn("next", F.lead("steps").over(w)).withColumn("next_name", F.lead("o_orderpriority").over(w)).filter("next is not null")
    return both.select("o_orderkey", sim.sequence_share("steps", "next").alias("melody"), sim.text_share("o_orderpriority", "next_name").alias("words"), sim.lies_inside("o_orderpriority", "next_name").alias("inside"))


# ---- trees ----

LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem"


def order_documents(spark, d, status, quantity):
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", quantity.cast("int").alias("qty"))))
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(order.alias("r"))
    o = load(spark, d, "orders").join(lines, "o_orderkey", "left")
    items = F.transform(F.coalesce("r", F.array()), lambda x: F.struct(x["l_partkey"].alias("part/key"), x["qty"].alias("qty")))
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), status.alias("status"), items.alias("lines"))).alias("doc"))


@query(f"""WITH l AS ({LINES})
SELECT o_orderkey, '/key' AS pointer, o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT o_orderkey, '/status', '"' || o_orderstatus || '"' FROM orders
UNION ALL SELECT o_orderkey, '/lines', '[]' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, '/lines/' || i || '/part~1key', l_partkey::VARCHAR FROM l UNION ALL SELECT l_orderkey, '/lines/' || i || '/qty', l_quantity::INT::VARCHAR FROM l""")
def json_leaves(spark, d):
    return trees.leaves(order_documents(spark, d, F.col("o_orderstatus"), F.col("l_quantity")), "o_orderkey", "doc")


@query(f"""WITH l AS ({LINES})
SELECT o_orderkey, '/status' AS pointer, CASE WHEN o_orderkey % 89 = 0 THEN 'removed' ELSE 'changed' END AS state, '"' || o_orderstatus || '"' AS was, CASE WHEN o_orderkey % 89 <> 0 THEN '"X"' END AS now FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0
UNION ALL SELECT l_orderkey, '/lines/' || i || '/qty', 'changed', l_quantity::INT::VARCHAR, (l_quantity::INT + 1)::VARCHAR FROM l WHERE l_linenumber = 1 AND l_orderkey % 5 = 0""")
def tree_diff_deep(spark, d):
    k = F.col("o_orderkey")
    # a null field is none in JSON
    status = F.when(k % 89 == 0, None).when(k % 97 == 0, "X").otherwise(F.col("o_orderstatus"))
    more = F.col("l_quantity") + F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 == 0), 1).otherwise(0)
    return trees.tree_diff(order_documents(spark, d, F.col("o_orderstatus"), F.col("l_quantity")), order_documents(spark, d, status, more), "o_orderkey", "doc")


# ---- event logs ----

GCD = "(s // gcd(s, 840)) || CASE WHEN 840 // gcd(s, 840) = 1 THEN '' ELSE '/' || (840 // gcd(s, 840)) END"


@query(f"""WITH l AS ({LINES}), b AS (SELECT *, l_suppkey % 3 AS pitch, l_returnflag = 'N' AS tied, lag(l_suppkey % 3) OVER w AS p, lag(l_returnflag = 'N') OVER w AS g FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
e AS (SELECT *, sum(CASE WHEN g AND p = pitch THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS event FROM b),
s AS (SELECT l_orderkey, event, min(l_linenumber)::BIGINT AS first_line, any_value(pitch)::BIGINT AS pitch, sum(840 // l_linenumber)::BIGINT AS s, count(*)::BIGINT AS notes, arg_max(tied, i) AS dangling FROM e GROUP BY 1, 2)
SELECT l_orderkey, first_line, pitch, {GCD} AS total, notes, dangling FROM s""")
def tie_fractions(spark, d):
    """Notes of a voice: a tied note goes on in the next of its pitch; lengths of 1 / line number are summed exactly."""
    notes = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_suppkey") % 3).alias("pitch"), (F.col("l_returnflag") == "N").alias("tied"), q.fraction(F.lit(1), F.col("l_linenumber")).alias("length"))
    e = eventlog.merge_ties(notes, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "pitch", "length", "tied")
    return e.select("l_orderkey", F.col("first.l_linenumber").cast("long").alias("first_line"), "pitch", q.written(F.col("total")).alias("total"), F.col("notes").cast("long").alias("notes"), "dangling")


@query("""WITH e AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS d, least(l_partkey // (40 * l_linenumber) + 1, 8) AS n FROM lineitem),
r AS (SELECT *, l_partkey - 40 * d * (n - 1) AS a FROM e)
SELECT l_orderkey, l_partkey, l_suppkey, d::BIGINT AS line, n::BIGINT AS measure, (a // greatest(gcd(a, d), 1)) || CASE WHEN d // greatest(gcd(a, d), 1) = 1 THEN '' ELSE '/' || (d // greatest(gcd(a, d), 1)) END AS place FROM r""")
def measure_places(spark, d):
    """Onsets of part key / line number in measures of forty: the last measure line at or before each, and the exact place in it."""
    l = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), q.fraction(F.col("l_partkey"), F.col("l_linenumber")).alias("onset"))
    lines = l.select("l_orderkey").distinct().withColumn("measure", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("at", q.fraction((F.col("measure") - 1) * 40, F.lit(1)))
    placed = eventlog.in_measures(l, ["l_orderkey"], lines, "onset", "at", "measure")
    return placed.select("l_orderkey", "l_partkey", "l_suppkey", "line", F.col("measure").cast("long").alias("measure"), q.written(F.col("place")).alias("place"))


# ---- ledger ----


@query("""WITH w AS (SELECT p_partkey::VARCHAR AS seed, p_size, p_partkey % 50 = 49 AS shared, count(*) FILTER (p_partkey % 50 = 49) OVER () AS rivals FROM part),
a AS (SELECT *, NOT (shared AND rivals > 1) AS allotted FROM w), m AS (SELECT *, count(*) FILTER (p_size = 2 AND allotted) OVER () AS halls FROM a)
SELECT seed, CASE WHEN p_size = 1 THEN 'moved ' || seed WHEN p_size = 2 AND halls = 1 THEN 'hall' WHEN shared THEN 'shared' ELSE 'place ' || seed END AS place, CASE WHEN p_size = 3 THEN 'retired' ELSE 'active' END AS state,
  (CASE WHEN p_size IN (1, 3) OR (p_size = 2 AND halls = 1) THEN 1 ELSE 0 END)::BIGINT AS changes, NULL AS refused FROM m WHERE allotted
UNION ALL SELECT seed, NULL, NULL, NULL, 'place is wanted twice' FROM m WHERE NOT allotted
UNION ALL SELECT seed, NULL, NULL, NULL, CASE WHEN NOT allotted THEN 'unknown' ELSE 'place is taken' END FROM m WHERE p_size = 2 AND (NOT allotted OR halls > 1)
UNION ALL SELECT seed, NULL, NULL, NULL, 'unknown' FROM m WHERE p_size IN (1, 3) AND NOT allotted
UNION ALL SELECT seed, NULL, NULL, NULL, 'no reason' FROM m WHERE p_size = 4""")
def ledger_round(spark, d):
    """Ids allotted in two goes, some rebound, some retired, and what is refused."""
    p = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("seed"), "p_size", "p_partkey")
    place = F.when(F.col("p_partkey") % 50 == 49, "shared").otherwise(F.concat(F.lit("place "), "seed"))
    wanted = p.select(F.lit("part").alias("kind"), "seed", place.alias("place"), "p_partkey")
    first, _ = ledger.allocate(spark.createDataFrame([], ledger.SCHEMA), wanted.filter("p_partkey % 4 = 0").drop("p_partkey"))
    book, no_place = ledger.allocate(graph._cut(first), wanted.drop("p_partkey"))
    book = graph._cut(book)  # each step reads the ledger several times
    moves = p.filter("p_size in (1, 2)").select(F.lit("part").alias("kind"), "seed", F.when(F.col("p_size") == 1, F.concat(F.lit("moved "), "seed")).otherwise("hall").alias("to"), F.lit("moved").alias("reason"))
    book, no_move = ledger.rebind(book, moves)
    book = graph._cut(book)
    gone = p.filter("p_size in (3, 4)").select(F.lit("part").alias("kind"), "seed", F.when(F.col("p_size") == 3, "gone").otherwise(" ").alias("reason"))
    book, no_end = ledger.retire(book, gone)
    refused = no_place.unionByName(no_move).unionByName(no_end).select("seed", "refused")
    return book.select("seed", "place", "state", F.size("history").cast("long").alias("changes"), F.lit(None).cast("string").alias("refused")).unionByName(refused, allowMissingColumns=True)


# ---- notation and pages ----


@query("""SELECT p_partkey, array_to_string([97 + p_partkey % 13 - x, 97 + (p_partkey + 3) % 13 - x, 97 + (p_partkey + 3) % 13 - x, 97 + p_size % 13 - x], ',') AS steps, '0,0,0,1' AS phrases, 'Domi ne' AS words, CASE WHEN p_partkey % 10 = 0 THEN 'accidental' ELSE '' END AS flags
FROM (SELECT *, [100, 102, 104, 106][(p_partkey % 4 + 1)::INT] - CASE WHEN p_size % 2 = 0 THEN 3 ELSE 0 END AS x FROM part)""")
def notation_read(spark, d):
    """Notation made from part keys: a clef, three syllables, one of them with two notes, a division, and a flat sign on every tenth."""
    letter = lambda n: F.char(F.lit(97) + n % 13)
    k = F.col("p_partkey")
    clef = F.concat(F.when(F.col("p_size") % 2 == 0, "f").otherwise("c"), (k % 4 + 1).cast("string"))
    text = F.concat(F.lit("name: x;\n%%\n("), clef, F.lit(") Do("), letter(k), F.lit(")mi("), F.when(k % 10 == 0, "ix").otherwise(""), letter(k + 3), F.lit("vv)  (::) <i>ne</i>("), letter(F.col("p_size")), F.lit(".)"))
    r = load(spark, d, "part").select("p_partkey", notation.read_notation(text).alias("r"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return r.select("p_partkey", joined("r.steps").alias("steps"), joined("r.phrases").alias("phrases"), "r.words", joined("r.flags").alias("flags"))


WORDS = "SELECT l_orderkey % 97 AS page, (l_partkey % 90)::DOUBLE AS x0, l_partkey % 90 + CASE WHEN l_linenumber = 7 THEN 60.0 ELSE 5.0 END AS x1, ((l_suppkey * 7 + l_linenumber) % 100)::DOUBLE AS y0, 'w' || l_partkey AS text FROM lineitem"


@query(f"""WITH w AS (SELECT *, CASE WHEN x1 - x0 > 50 THEN -1 ELSE least(floor((x0 + x1) / 2 / 100 * 2), 1) END AS c FROM ({WORDS})),
b AS (SELECT *, sum(CASE WHEN c = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, CASE WHEN c = -1 THEN 0 ELSE 1 END, x0, text ROWS UNBOUNDED PRECEDING) AS band FROM w),
l AS (SELECT *, sum(n) OVER (PARTITION BY page, band, c ORDER BY y0, x0, text ROWS UNBOUNDED PRECEDING) AS line FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page, band, c ORDER BY y0, x0, text) <= 1.5 THEN 0 ELSE 1 END AS n FROM b)),
r AS (SELECT page, band, c, line, string_agg(text, ' ' ORDER BY x0, text) AS text FROM l GROUP BY 1, 2, 3, 4),
s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY band, c, line) AS row, last_value(CASE WHEN c = -1 THEN text END IGNORE NULLS) OVER (ORDER BY page, band, c, line ROWS UNBOUNDED PRECEDING) AS section FROM r)
SELECT page, row::BIGINT AS row, c::INT AS column, section, text FROM s WHERE c <> -1""")
def page_table(spark, d):
    """Word boxes as rows of two columns, between headings that cross both and name the section."""
    k = lambda c: F.col(c).cast("double")
    l = load(spark, d, "lineitem").select((F.col("l_orderkey") % 97).alias("page"), (F.col("l_partkey") % 90).cast("double").alias("x0"), F.when(F.col("l_linenumber") == 7, 60.0).otherwise(5.0).alias("w"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 100).cast("double").alias("y0"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"))
    boxes = l.withColumn("x1", k("x0") + k("w")).withColumn("y1", k("y0") + 1).drop("w")
    return alignment.table_rows(boxes, "page", 2, F.lit(100.0), 1.5, F.col("column") == -1)


@query()
def align_texts(spark, d):
    """A customer's order priorities, as expected, aligned to what is printed: the same words in another case, by order date."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    printed = o.filter("o_orderkey % 3 <> 0").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("place"))
    return alignment.align(o, printed, "o_custkey", "o_orderkey", "o_orderpriority", "place", [lambda c: c, F.lower])


# ---- scans ----


@query("""WITH e AS (SELECT 'v' || (p_partkey % 3) AS volume, p_brand AS section, p_partkey, p_name AS label, p_size AS page, CASE WHEN p_size > 45 THEN 'checked' ELSE lower(replace(p_brand, '#', ' ')) END AS status, replace(p_name, ' ', '-') AS base FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY volume, base ORDER BY section, p_partkey) = 1 AS first FROM e), s AS (SELECT *, CASE WHEN first THEN base ELSE base || '-p' || page END AS slug FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY volume, slug ORDER BY first DESC, section, p_partkey) > 1 AS taken FROM s)
SELECT volume, section, label, page, CASE WHEN NOT taken THEN status END AS status, CASE WHEN NOT taken THEN slug END AS slug, CASE WHEN taken THEN 'slug is taken: ' || slug END AS reason FROM r""")
def nested_index(spark, d):
    """Index documents as JSON, one a volume: sections with entries, defaults, slugs mended once, and entries that are refused."""
    p = load(spark, d, "part").withColumn("volume", F.concat(F.lit("v"), (F.col("p_partkey") % 3).cast("string")))
    entry = F.struct("p_partkey", F.col("p_name").alias("label"), F.col("p_size").alias("page"), F.when(F.col("p_size") > 45, "checked").alias("status"))
    sections = p.groupBy("volume", "p_brand").agg(F.array_sort(F.collect_list(entry)).alias("e")).select("volume", F.struct(F.col("p_brand").alias("section"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("status"), F.col("e").alias("entries")).alias("s"))
    docs = sections.groupBy("volume").agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("doc"))
    schema = "array<struct<section: string, status: string, entries: array<struct<label: string, page: int, status: string>>>>"
    good, bad = files.index_entries(docs.select("volume", F.from_json("doc", schema).alias("sections")), "sections", t.slugify(F.col("label")))
    return good.unionByName(bad, allowMissingColumns=True)


@query(r"""SELECT s_suppkey::VARCHAR AS id, replace(s_name, '#', '''') || chr(10) || '''x\' AS a, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'NULL' END AS b, NULL AS error FROM supplier WHERE s_suppkey % 10 <> 0
UNION ALL SELECT NULL, NULL, NULL, '3 values wanted, 2 found' FROM supplier WHERE s_suppkey % 10 = 0""")
def dump_parse(spark, d):
    """INSERT statements, one a nation, with quotes, escapes, nulls and tuples of the wrong length, read back."""
    k = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("'"), F.replace("s_name", F.lit("#"), F.lit("\\'")), F.lit("\\n''x\\\\'"))
    row = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("("), k, F.lit(",'two')"))).otherwise(F.concat(F.lit("("), k, F.lit(", "), name, F.lit(","), F.when(F.col("s_suppkey") % 3 == 0, "NULL").otherwise("'NULL'"), F.lit(")")))
    statements = load(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("file")).agg(F.concat(F.lit("INSERT INTO `t` VALUES "), F.array_join(F.collect_list(row), ","), F.lit(";")).alias("value"))
    good, bad = files.parsed_inserts(statements, "t", ["id", "a", "b"])
    return good.unionByName(bad.select("error"), allowMissingColumns=True)


@query("""SELECT kind, error, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_linenumber = 6 THEN 'bad time' WHEN l_linenumber = 7 THEN 'unknown kind other' WHEN l_returnflag = 'R' THEN 'wrong number of columns' END AS error,
CASE WHEN l_linenumber = 6 OR l_returnflag = 'R' OR l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'note' ELSE 'rest' END AS kind FROM lineitem) GROUP BY 1, 2""")
def strict_scan(spark, d):
    """Tab-separated rows of kinds with a fixed number of columns, good ones counted by kind, refused ones by reason."""
    l = load(spark, d, "lineitem")
    onset = F.when(F.col("l_linenumber") == 6, "1/0").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("/4")))
    rest = F.when(F.col("l_linenumber") == 7, "other").when(F.col("l_returnflag") == "A", "note\tc\t8").when(F.col("l_returnflag") == "R", "note\tc").otherwise("rest")
    rest = F.when((F.col("l_linenumber") == 6), "rest").otherwise(rest)
    good, bad = files.parsed_rows(l.select(F.lit("f").alias("file"), F.col("l_orderkey").alias("at"), F.concat(onset, F.lit("\tL\t1\t"), rest).alias("line")), {"note": 2, "rest": 0})
    n = F.count(F.lit(1)).alias("n")
    return good.groupBy("kind").agg(n).unionByName(bad.groupBy("error").agg(n), allowMissingColumns=True)


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS base, CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*/)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+(/[^?#]*/)', 1) END AS folder,
  unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)\bhref\s*=\s*("[^"]*"|''[^'']*'')', 1), lambda h: regexp_replace(trim(h[2:-2]), '#.*$', '')))) AS h FROM pages),
r AS (SELECT DISTINCT page_id, base, CASE WHEN regexp_matches(h, '^[A-Za-z]+:') THEN h WHEN h LIKE '//%' THEN scheme || ':' || h WHEN h LIKE '/%' THEN base || h ELSE base || folder || h END AS link FROM p WHERE h <> '') SELECT page_id, link FROM r WHERE starts_with(link, base || '/')""")
def page_links_resolved(spark, d):
    """Internal links, resolved against the page's own address."""
    return files.page_links(load(spark, d, "pages").select("page_id", "url", "html"), "html", "url").select("page_id", "link")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || 'x' ELSE event_type END AS body FROM events")
def body_text(spark, d):
    """A body that is a JSON list of kinds and texts, a JSON string, or plain text."""
    e, k = F.col("event_type"), F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('[["tex","'), e, F.lit('"],["gabc","x"]]'))).when(k == 1, F.concat(F.lit('"'), e, F.lit('"'))).otherwise(e)
    return load(spark, d, "events").select("event_id", files.json_or_text(raw).alias("body"))


# ---- rules ----


#: Fixed rules: field, pattern, least and greatest value, the table's own.
RULES = [("balance", r"^-?\d+(\.\d+)?$", -500.0, 9000.0), ("segment", "^[A-Z]+$", None, None), ("nation", r"^\d+$", 1.0, 20.0)]


@query(r"""WITH v AS (SELECT c_custkey, 'balance' AS field, c_acctbal::DECIMAL(18,2)::VARCHAR AS raw FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'colour', 'red' FROM customer WHERE c_custkey % 100 = 0)
SELECT c_custkey, field, CASE WHEN error IS NULL THEN CASE field WHEN 'nation' THEN ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'][raw::INT] ELSE raw END END AS value, error
FROM (SELECT *, CASE WHEN field = 'colour' THEN 'unknown field' WHEN field = 'segment' AND NOT regexp_matches(raw, '^[A-Z]+$') THEN 'bad form' WHEN field = 'balance' AND raw::DOUBLE NOT BETWEEN -500 AND 9000 OR field = 'nation' AND raw::INT NOT BETWEEN 1 AND 20 THEN 'out of range' END AS error FROM v)""")
def typed_rules(spark, d):
    """Long-format values judged by a table of rules, broadcast as it is a row a field; nations are written as numerals."""
    c = load(spark, d, "customer")
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("raw"))
    pairs = F.array(pair("balance", F.col("c_acctbal").cast("decimal(18,2)").cast("string")), pair("segment", F.col("c_mktsegment")), pair("nation", F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 100 == 0, pair("colour", F.lit("red"))))
    rules = spark.createDataFrame(RULES, "field string, form string, least double, most double")
    v = c.select("c_custkey", F.explode(F.array_compact(pairs)).alias("p")).select("c_custkey", "p.*").join(F.broadcast(rules), "field", "left")
    n = F.col("raw").try_cast("double")
    error = F.when(F.col("form").isNull(), "unknown field").when(~F.regexp("raw", F.col("form")), "bad form").when((n < F.col("least")) | (n > F.col("most")), "out of range")
    value = F.when(F.col("field") == "nation", t.to_roman(F.greatest(n, F.lit(1.0)).cast("int"))).otherwise(F.col("raw"))
    return v.withColumn("error", error).select("c_custkey", "field", F.when(F.col("error").isNull(), value).alias("value"), "error")


@query("""SELECT user_id, event_id, CASE WHEN n > 1 AND event_type = 'purchase' THEN 'frozen already' WHEN event_type = 'purchase' THEN 'frozen' WHEN n > 0 THEN 'refused' ELSE 'changed' END AS state
FROM (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)""")
def snapshot_guard(spark, d):
    """The first purchase freezes a user's draft: later changes are refused, and so is freezing it again."""
    n = F.count(F.when(F.col("event_type") == "purchase", 1)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    buys = F.col("event_type") == "purchase"
    return load(spark, d, "events").withColumn("n", n).select("user_id", "event_id", F.when(buys & (F.col("n") > 1), "frozen already").when(buys, "frozen").when(F.col("n") > 0, "refused").otherwise("changed").alias("state"))


@query("""WITH l AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS ours FROM documents WHERE doc_id % 11 <> 0), u AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '?' END ELSE '' END) AS theirs FROM documents WHERE doc_id % 13 <> 0), b AS (SELECT doc_id, sha256(text) AS base FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN ours IS NOT DISTINCT FROM theirs THEN CASE WHEN base IS NOT DISTINCT FROM ours THEN 'unchanged' ELSE 'same' END WHEN ours IS NOT DISTINCT FROM base THEN 'theirs' WHEN theirs IS NOT DISTINCT FROM base THEN 'ours' ELSE 'conflict' END AS state FROM l FULL JOIN u USING (doc_id) FULL JOIN b USING (doc_id)""")
def three_way_hashes(spark, d):
    """Three tables of content hashes, ours, theirs and recorded, joined by key; a missing row differs from any that is there."""
    docs = load(spark, d, "documents")
    k = F.col("doc_id")
    sha = lambda extra, keep, name: docs.filter(keep).select("doc_id", F.sha2(F.concat("text", extra), 256).alias(name))
    ours = sha(F.when(k % 7 == 0, "!").otherwise(""), k % 11 != 0, "ours")
    theirs = sha(F.when(k % 5 == 0, F.when(k % 2 == 0, "!").otherwise("?")).otherwise(""), k % 13 != 0, "theirs")
    both = ours.join(theirs, "doc_id", "full_outer").join(sha(F.lit(""), k % 3 != 0, "base"), "doc_id", "full_outer")
    o, b, u = F.col("ours"), F.col("base"), F.col("theirs")
    state = F.when(o.eqNullSafe(u), F.when(b.eqNullSafe(o), "unchanged").otherwise("same")).when(o.eqNullSafe(b), "theirs").when(u.eqNullSafe(b), "ours").otherwise("conflict")
    return both.select("doc_id", state.alias("state"))


# ---- damaged dates, citations and features ----

MONTHS = ["ianuarii", "februarii", "martii", "aprilis", "maii", "iunii", "iulii", "augusti", "septembris", "octobris", "novembris", "decembris"]
#: How the test dates are damaged, by key: letters of the month and of the day.
SQL_DATED = f"""SELECT o_orderkey, 'In festo, die ' || translate(day(o_orderdate)::VARCHAR, '105', 'lOS') || '. ' || CASE o_orderkey % 4 WHEN 0 THEN m WHEN 1 THEN replace(m, 'i', 'l') WHEN 2 THEN m[1:4] || 'x' || m[6:] ELSE 'xx' || m[3:] END AS w
FROM (SELECT *, {MONTHS}[month(o_orderdate)] AS m FROM orders)"""


@query(f"""WITH d AS ({SQL_DATED}), s AS (SELECT o_orderkey, w, TRY_CAST(translate(regexp_extract(w, 'die ([0-9lOSI|]{{1,2}})[.,]? ([a-z]+)', 1), 'lI|OS', '11105') AS INT) AS day, regexp_extract(w, 'die ([0-9lOSI|]{{1,2}})[.,]? ([a-z]+)', 2) AS m FROM d),
g AS (SELECT *, list_transform(range(1, 13), lambda i: levenshtein(m, {MONTHS}[i])) AS gaps FROM s), b AS (SELECT *, list_min(gaps) AS least FROM g)
SELECT o_orderkey, day::BIGINT AS day, CASE WHEN least <= 2 AND len(list_filter(gaps, lambda x: x = least)) = 1 THEN list_position(gaps, least) END::BIGINT AS month FROM b""")
def fuzzy_days(spark, d):
    """Feast dates as scanners read them: the day's letters mended, the month the only nearest one within two edits."""
    k, day = F.col("o_orderkey") % 4, F.dayofmonth("o_orderdate").cast("string")
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("o_orderdate"))
    spoilt = F.when(k == 0, name).when(k == 1, F.replace(name, F.lit("i"), F.lit("l"))).when(k == 2, F.concat(F.substring(name, 1, 4), F.lit("x"), F.substring(name, 6, 99))).otherwise(F.concat(F.lit("xx"), F.substring(name, 3, 99)))
    w = load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("In festo, die "), F.translate(day, "105", "lOS"), F.lit(". "), spoilt).alias("w"))
    part = lambda i: F.regexp_extract("w", r"die ([0-9lOSI|]{1,2})[.,]? ([a-z]+)", i)
    read = w.select("o_orderkey", F.translate(part(1), "lI|OS", "11105").try_cast("int").alias("day"), part(2).alias("m"))
    gaps = read.withColumn("gaps", F.array(*(F.levenshtein("m", F.lit(x)) for x in MONTHS))).withColumn("least", F.array_min("gaps"))
    alone = (F.col("least") <= 2) & (F.size(F.filter("gaps", lambda x: x == F.col("least"))) == 1)
    return gaps.select("o_orderkey", F.col("day").cast("long").alias("day"), F.when(alone, F.array_position("gaps", F.col("least"))).alias("month"))


NUMERALS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]


@query(rf"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'ut supra, p. ' || p_size ELSE 'Ut in Pars ' || CASE WHEN p_partkey % 2 = 0 THEN translate({NUMERALS}[p_size % 12 + 1], 'i', 'l') ELSE upper({NUMERALS}[p_size % 12 + 1]) END || ', p. ' || translate((p_partkey % 500)::VARCHAR, '01', 'Ol') || CASE WHEN p_partkey % 5 = 0 THEN '; Pars II, p. 3' ELSE '' END END AS w FROM part),
n AS (SELECT p_partkey, regexp_extract(lower(w), 'pars ([ivxl1|!/]+)[,.]', 1) AS v, regexp_extract(w, 'p\. ?([0-9OlI]+)', 1) AS p, regexp_matches(lower(w), 'pars [ivxl1|!/]+[,.]') AS other FROM r),
m AS (SELECT *, translate(v, 'l1|!/', 'iiiii') AS c FROM n)
SELECT p_partkey, CASE WHEN other THEN list_position({NUMERALS}, CASE WHEN length(v) <= 5 AND regexp_matches(v, '[ivx]') AND regexp_matches(c, '{fo.NUMERAL}') THEN c ELSE v END) END::BIGINT AS volume, TRY_CAST(translate(p, 'OlI', '011') AS BIGINT) AS page, NOT other AS local FROM m""")
def parse_references(spark, d):
    """References as scanners read them: the volume a mended numeral, the page its digits; a reference without a volume is local. Of several the first counts."""
    k, size = F.col("p_partkey"), F.col("p_size")
    numeral = F.element_at(F.array(*map(F.lit, NUMERALS)), (size % 12 + 1).cast("int"))
    full = F.concat(F.lit("Ut in Pars "), F.when(k % 2 == 0, F.translate(numeral, "i", "l")).otherwise(F.upper(numeral)), F.lit(", p. "), F.translate((k % 500).cast("string"), "01", "Ol"), F.when(k % 5 == 0, "; Pars II, p. 3").otherwise(""))
    w = load(spark, d, "part").select("p_partkey", F.when(k % 9 == 0, F.concat(F.lit("ut supra, p. "), size.cast("string"))).otherwise(full).alias("w"))
    n = w.select("p_partkey", F.regexp_extract(F.lower("w"), r"pars ([ivxl1|!/]+)[,.]", 1).alias("v"), F.regexp_extract("w", r"p\. ?([0-9OlI]+)", 1).alias("p"))
    volume = F.array_position(F.array(*map(F.lit, NUMERALS)), fo.mended_numeral(F.col("v")))
    return n.select("p_partkey", F.when(F.col("v") != "", F.nullif(volume, F.lit(0).cast("long"))).alias("volume"), F.translate("p", "OlI", "011").try_cast("long").alias("page"), (F.col("v") == "").alias("local"))


FEATURES = {"paragraphs": "<p[ >]", "links": "<a ", "scripts": "<script", "headings": "<h[1-6][ >]"}
KNOWN_TAGS = ["html", "head", "body", "title", "p", "a", "div", "h1"]
SQL_MASKED = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"


@query(f"""WITH m AS (SELECT page_id, {SQL_MASKED} AS h FROM pages), f AS (SELECT page_id, {', '.join(f"len(regexp_extract_all(h, '{r}'))::BIGINT AS {n}" for n, r in FEATURES.items())}, list_sort(list_distinct(list_filter(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1), lambda t: t NOT IN ({', '.join(f"'{t}'" for t in KNOWN_TAGS)})))) AS u FROM m)
SELECT page_id, {', '.join(FEATURES)}, array_to_string(u, ',') AS unknown, CASE WHEN scripts > 0 THEN 'review' WHEN len(u) > 3 THEN 'unknown' ELSE 'plain' END AS class FROM f UNION ALL SELECT -1, NULL, NULL, NULL, NULL, '', 'absent'""")
def audit_features(spark, d):
    """An audit of sources: comments masked, features counted, unknown tags listed, sources classed; a target without a source is absent."""
    masked = load(spark, d, "pages").select("page_id", F.regexp_replace("html", r"(?s)<!--.*?-->", "").alias("h"))
    tags = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("h", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)), lambda x: ~x.isin(*KNOWN_TAGS))))
    f = masked.select("page_id", *(F.regexp_count("h", F.lit(r)).cast("long").alias(n) for n, r in FEATURES.items()), tags.alias("u"))
    targets = load(spark, d, "pages").select("page_id").unionByName(spark.createDataFrame([(-1,)], "page_id long"))
    kind = F.when(F.col("scripts").isNull(), "absent").when(F.col("scripts") > 0, "review").when(F.size("u") > 3, "unknown").otherwise("plain")
    return targets.join(f, "page_id", "left").select("page_id", *FEATURES, F.coalesce(F.array_join("u", ","), F.lit("")).alias("unknown"), kind.alias("class"))


SQL_PAIRS = """SELECT s.s_suppkey, p.p_partkey, s.w AS a, p.w AS b FROM (SELECT s_suppkey, s_suppkey % 25 AS size, ['red widget', 'blue gear', 'small ring', 'green bolt'][(s_suppkey % 4 + 1)::INT] || CASE WHEN s_suppkey % 3 = 0 THEN ' romanus' ELSE '' END AS w FROM supplier) s JOIN (SELECT p_partkey, p_size % 25 AS size, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' romanus' ELSE '' END AS w FROM part) p USING (size)"""


@query(f"""WITH c AS ({SQL_PAIRS}), s AS (SELECT *, round(1.0 - levenshtein(a, b) / greatest(length(a), length(b)) - CASE WHEN a[1:1] = b[1:1] THEN 0 ELSE 0.1 END, 6) AS score FROM c WHERE contains(a, 'romanus') = contains(b, 'romanus'))
SELECT s_suppkey, p_partkey, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, p_partkey) = 1""")
def structural_match(spark, d):
    """The best candidate of each entry within its structural block, by a score with a penalty; one of another repertoire is vetoed, both ways."""
    s = F.element_at(F.array(*map(F.lit, ["red widget", "blue gear", "small ring", "green bolt"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    a = load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25).cast("int").alias("size"), F.concat(s, F.when(F.col("s_suppkey") % 3 == 0, " romanus").otherwise("")).alias("a"))
    b = load(spark, d, "part").select("p_partkey", (F.col("p_size") % 25).cast("int").alias("size"), F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, " romanus").otherwise("")).alias("b"))
    # the veto is part of the block, so vetoed pairs are never made
    own = lambda df, c: df.withColumn("foreign", F.contains(F.col(c), F.lit("romanus")))
    # of candidates with one text the first key stands for all
    kinds = own(b, "b").groupBy("size", "foreign", "b").agg(F.min("p_partkey").alias("p_partkey"))
    penalty = F.when(F.substring("a", 1, 1) == F.substring("b", 1, 1), 0.0).otherwise(0.1)
    scored = own(a, "a").join(kinds, ["size", "foreign"]).withColumn("score", F.round(t.similarity(F.col("a"), F.col("b")) - penalty, 6)).filter("score >= 0.3")
    best = scored.groupBy("s_suppkey").agg(F.max(F.struct("score", (-F.col("p_partkey")).alias("k"))).alias("m"))
    return best.select("s_suppkey", (-F.col("m.k")).alias("p_partkey"), F.col("m.score").alias("score"))

"""Reachability, chains and closures over edge tables, level by level: each round is a join, and what is known goes to a table or stays a frame."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a fresh local one only where none is set and the master is local."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    at = found.get() if found.isDefined() else spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    spark.sparkContext.setCheckpointDir(at) if not found.isDefined() else None
    return at.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again, so that the plan doesn't grow with the rounds and a lost executor costs a read."""
    spark, path = df.sparkSession, f"{_shared(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def _drop(df: DataFrame) -> None:
    """Deletes the table of a frame that _cut gave."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quill_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Hops that one round of reach takes: their joins are one job.
HOPS_A_ROUND = 4
#: Nodes of a level that may go to every task; parts of the known nodes before they are written as one.
MOST_BROADCAST, MOST_PARTS = 100_000, 16


def reach(edges: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """node, hop (the least number of edges from a start) of every node reached; a cycle ends as its nodes are known already.

    The edges are computed once. A round goes several hops on from the last level and is cut once; what it finds of known nodes goes, the rest is added to them as a table of its own.
    The last level was counted, and no level can have more nodes than the one before times the most edges of a node: levels that are few go to every task, so the edges stay where they
    are; joins of larger ones share their shuffles."""
    spark = edges.sparkSession
    edges = _cut(edges.select("src", F.col("dst").alias("node")).distinct())
    widest = edges.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    known = _cut(starts.select("node").distinct().withColumn("hop", F.lit(0)))
    done, frontier, size, parts = 0, known, known.count(), [known]
    while size and (hops is None or done < hops):
        levels, most = [frontier], size
        for hop in range(done + 1, done + 1 + (HOPS_A_ROUND if hops is None else min(HOPS_A_ROUND, hops - done))):
            last = levels[-1].select(F.col("node").alias("src"))
            levels.append((F.broadcast(last) if most <= MOST_BROADCAST else last).join(edges, "src").select("node").distinct().withColumn("hop", F.lit(hop)))
            most *= widest
        found = reduce(DataFrame.unionByName, levels[1:]).groupBy("node").agg(F.min("hop").alias("hop"))
        new = _cut(found.join(known.select("node"), "node", "left_anti"))
        done += len(levels) - 1
        frontier = new.filter(F.col("hop") == done)
        size, parts = frontier.count(), [*parts, new]
        known = spark.read.schema(known.schema).parquet(*(p._quill_path for p in parts))
        if len(parts) > MOST_PARTS:
            before, known = parts, _cut(known)
            parts, frontier = [known], known.filter(F.col("hop") == done)
            for part in before:
                _drop(part)
    return known


def chains(links: DataFrame) -> DataFrame:
    """node, end, n, state: where each node's only link (src, dst) leads in the end, after n steps; state is `end`, or `loop` with a null end and n where it comes to none.

    By pointer doubling: a round doubles the steps of every pointer, so chains of any length take logarithmically many. What still moves after as many steps as there are links goes
    round in a loop, or leads to one."""
    links = _cut(links.select("src", "dst").dropDuplicates(["src"]))
    total, size = links.count(), 1
    at = _cut(links.join(links.select(F.col("src").alias("dst"), F.lit(True).alias("goes_on")), "dst", "left").select("src", "dst", F.lit(1).cast("long").alias("n"), F.coalesce("goes_on", F.lit(False)).alias("goes_on")))
    while size < total and not at.filter("goes_on").isEmpty():
        # pointers at an end stay; the others take over where theirs has got to
        ahead = at.select(F.col("src").alias("dst"), F.col("dst").alias("further"), F.col("n").alias("more"), F.col("goes_on").alias("still"))
        moved = at.filter("goes_on").join(ahead, "dst").select("src", F.col("further").alias("dst"), (F.col("n") + F.col("more")).alias("n"), F.col("still").alias("goes_on"))
        before, at = at, _cut(at.filter("NOT goes_on").unionByName(moved))
        _drop(before)
        size *= 2
    ended = ~F.col("goes_on")
    return at.select(F.col("src").alias("node"), F.when(ended, F.col("dst")).alias("end"), F.when(ended, F.col("n")).alias("n"), F.when(ended, "end").otherwise("loop").alias("state"))


def doubled(edges: DataFrame) -> DataFrame:
    """src, dst: every pair that a path joins, in logarithmically many rounds: a round joins the paths so far with one another."""
    now = _cut(edges.select("src", "dst").distinct())
    n = now.count()
    while True:
        on = now.join(now.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        before, now = now, _cut(now.unionByName(on).distinct())
        _drop(before)
        grown = now.count()
        if grown == n:
            return now
        n = grown


def expand(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections with their includes spliced in, in printed order and to any depth: section, place (from 0), source, n, text; and the sections that can't be, with the problem.

    lines: section, n (its order), text, and target, a section to include in the line's place, else null. By doubling: in a round every include takes over what its target has become, so
    its depth doubles; a line's new place is that of its include, moved by the sizes before it. A section that includes itself in the end, one that is nowhere, and those that
    come to such a one are told (loop, missing) and left out."""
    lines = _cut(lines.select("section", "n", "text", "target"))
    edges = _cut(lines.filter("target IS NOT NULL").select(F.col("section").alias("src"), F.col("target").alias("dst")).distinct())
    missing = edges.join(lines.select(F.col("section").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")
    paths = doubled(edges)
    bad = paths.filter("src = dst").select(F.col("src").alias("dst"), F.lit("loop").alias("problem")).unionByName(missing.select("dst", F.lit("missing").alias("problem"))).distinct()
    problems = _cut(paths.join(bad, "dst").groupBy(F.col("src").alias("section")).agg(F.min("problem").alias("problem")))  # a loop before what is missing
    numbered = F.row_number().over(Window.partitionBy("section").orderBy("n")).cast("long") - 1
    body = _cut(lines.join(problems, "section", "left_anti").select("section", numbered.alias("place"), F.col("section").alias("source"), "n", "text", "target"))
    while not body.filter("target IS NOT NULL").isEmpty():
        sizes = body.groupBy(F.col("section").alias("target")).agg(F.count(F.lit(1)).alias("size"))
        before_it = F.sum(F.coalesce("size", F.lit(1))).over(Window.partitionBy("section").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        # lines that include nothing, which are most, meet no size
        sized = body.filter("target IS NOT NULL").join(sizes, "target", "left").unionByName(body.filter("target IS NULL"), allowMissingColumns=True)
        placed = sized.select("section", F.coalesce(before_it, F.lit(0)).cast("long").alias("place"), "source", "n", "text", "target")
        inner = body.select(F.col("section").alias("target"), F.col("place").alias("within"), F.col("source").alias("s"), F.col("n").alias("m"), F.col("text").alias("t"), F.col("target").alias("on"))
        spliced = placed.filter("target IS NOT NULL").join(inner, "target").select("section", (F.col("place") + F.col("within")).alias("place"), F.col("s").alias("source"), F.col("m").alias("n"), F.col("t").alias("text"), F.col("on").alias("target"))
        old, body = body, _cut(placed.filter("target IS NULL").unionByName(spliced))
        _drop(old)
    return body.drop("target"), problems


def _spread(value: DataFrame, edges: DataFrame, pick) -> DataFrame:
    """node, value: the least value that comes to each node along the edges (src, dst), within edges; rounds of hops until none changes."""
    while True:
        sent, now = value, value
        for _ in range(HOPS_A_ROUND):
            sent = sent.select(F.col("node").alias("src"), "value").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(pick("value").alias("value"))
            now = now.unionByName(sent)
        new = _cut(now.groupBy("node").agg(pick("value").alias("value")))
        changed = not new.join(value.withColumnRenamed("value", "was"), "node", "left").filter("NOT value <=> was").isEmpty()
        if value is not new and hasattr(value, "_quill_path"):
            _drop(value)
        value = new
        if not changed:
            return value


def components(edges: DataFrame) -> DataFrame:
    """node, component: the strongly connected components, each named by a node of it; nodes on no cycle are components of their own.

    Nodes without an edge in or out are trimmed away. Of what is left, each node takes the least node that leads to it; the nodes that also lead back to that node are its component.
    These go, and the rest is done again. Rounds go with the length of paths, several hops each."""
    left = _cut(edges.select("src", "dst").filter("src <> dst").distinct())
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    done = []
    while True:
        while True:  # trimming
            both = left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            kept = _cut(left.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"))
            same = kept.count() == left.count()
            _drop(left)
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        own = left.select(F.col("src").alias("node")).distinct().withColumn("value", F.col("node"))
        colour = _spread(own, left, F.min)
        within = left.join(colour.select(F.col("node").alias("src"), F.col("value").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("value").alias("d")), "dst").filter("c = d")
        back = _cut(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = _spread(colour.filter("node = value"), back, F.min)
        found = _cut(found.select("node", F.col("value").alias("component")))
        done.append(found)
        rest = left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
        before, left = left, _cut(rest)
        _drop(before)
    if not done:
        return ends.withColumn("component", F.col("node"))
    cycles = reduce(DataFrame.unionByName, done)
    return ends.join(cycles, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def build_order(edges: DataFrame) -> DataFrame:
    """node, component, layer: nodes of one layer need nothing of one another, and everything that a node needs (edges src to dst: dst needs src) has a lower layer, or is of its own
    component: a cycle is built at once. The layer is the longest path of components that leads to it; a round a layer."""
    parts = _cut(components(edges))
    c = lambda name, to: parts.select(F.col("node").alias(name), F.col("component").alias(to))
    between = _cut(edges.select("src", "dst").join(c("src", "a"), "src").join(c("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct())
    waits = _cut(parts.select(F.col("component").alias("b")).distinct().join(between.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n")))
    layers, layer = [], 0
    while not waits.isEmpty():
        ready = _cut(waits.filter("n = 0").select("b", F.lit(layer).alias("layer")))
        layers.append(ready)
        less = ready.select(F.col("b").alias("a")).join(between, "a").groupBy("b").agg(F.count(F.lit(1)).alias("less"))
        before, waits = waits, _cut(waits.filter("n > 0").join(less, "b", "left").select("b", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")))
        _drop(before)
        layer += 1
    return parts.join(reduce(DataFrame.unionByName, layers).withColumnRenamed("b", "component"), "component").select("node", "component", "layer")


def closure(edges: DataFrame, hops: int) -> DataFrame:
    """src, dst, hop: every pair joined by at most `hops` edges, with the least number."""
    paths = edges.select("src", "dst").distinct().withColumn("hop", F.lit(1))
    all_ = paths
    for hop in range(2, hops + 1):
        paths = paths.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct().withColumn("hop", F.lit(hop))
        all_ = all_.unionByName(paths)
    return all_.groupBy("src", "dst").agg(F.min("hop").alias("hop"))


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, or without the edge back: src, dst, problem."""
    e = edges.select("src", "dst").distinct()
    n = nodes.select("node").distinct()
    lost = e.join(n, e["dst"] == n["node"], "left_anti").withColumn("problem", F.lit("dangling"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return lost.unionByName(e.join(back, ["src", "dst"], "left_anti").withColumn("problem", F.lit("one way")))

"""Fix-point operators over directed graphs given as edge tables (f, t), many graphs side by side if ids tell them apart.

Every round renames both sides of its joins with fresh column names, and is checkpointed; the loops end
when a round adds nothing, at the latest after as many rounds as ``max_rounds``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.session import checkpointed


def _added(known: DataFrame, fresh: DataFrame, number: int) -> DataFrame:
    """Both together; each is stored already, so only every sixteenth round writes all again, to keep plans short."""
    both = known.unionAll(fresh)
    return checkpointed(both) if number % 16 == 0 else both


def distances(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(a, b, d): the least number of edges, at least 1, from a to b, for all b that a reaches.

    Semi-naive: each round extends only the pairs found in the round before, and keeps those not known
    yet. A pair (a, a) has the length of a's shortest cycle.
    """
    step = checkpointed(edges.select("f", "t").distinct())
    known = checkpointed(step.select(F.col("f").alias("a"), F.col("t").alias("b"), F.lit(1).alias("d")))
    fresh = known
    for d in range(2, max_rounds + 2):
        onward = fresh.toDF("x", "y", "z").join(step.toDF("p", "q"), F.col("y") == F.col("p")).select(F.col("x").alias("a2"), F.col("q").alias("b2")).distinct()
        old = known.select(F.col("a").alias("ka"), F.col("b").alias("kb"))
        fresh = checkpointed(onward.join(old, (F.col("a2") == F.col("ka")) & (F.col("b2") == F.col("kb")), "left_anti").select(F.col("a2").alias("a"), F.col("b2").alias("b"), F.lit(d).alias("d")))
        if fresh.isEmpty():
            return known
        known = _added(known, fresh, d)
    raise RuntimeError(f"paths are longer than {max_rounds}")


def _spread_least(labels: DataFrame, step: DataFrame, max_rounds: int) -> DataFrame:
    """labels(node, c) where each node has the least label of all nodes that reach it over step(f, t)."""
    fresh = labels
    for _ in range(max_rounds):
        sent = fresh.toDF("n", "l").join(step, F.col("n") == F.col("f")).groupBy("t").agg(F.min("l").alias("l"))
        met = labels.join(sent, F.col("node") == F.col("t"), "left").select("node", F.col("c").alias("old"), F.least("c", "l").alias("c"))
        met = checkpointed(met)
        labels, fresh = met.select("node", "c"), met.where("c < old").select("node", "c")
        if fresh.isEmpty():
            return labels
    raise RuntimeError(f"paths are longer than {max_rounds}")


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, scc, size): the smallest node that a node reaches and is reached from, or itself. nodes has ``node``.

    Each round draws an order of the nodes and colours each with the first that reaches it. What
    reaches its colour's node within the colour is a component; edges between colours and at found
    nodes go. Rows stay within nodes and edges: no pairs of nodes that reach each other are made.
    """
    open_ = checkpointed(nodes.select("node").distinct())
    step = checkpointed(edges.select("f", "t").where("f <> t").distinct())
    known = None
    for r in range(max_rounds):
        if open_.isEmpty():
            break
        labels = checkpointed(open_.select("node", F.struct(F.xxhash64(F.lit(r), "node"), "node").alias("c")))
        colours = _spread_least(labels, step, max_rounds)
        ends = step.join(colours.toDF("fn", "fc"), F.col("f") == F.col("fn")).join(colours.toDF("tn", "tc"), F.col("t") == F.col("tn"))
        step = checkpointed(ends.where("fc = tc").select("f", "t"))
        found = checkpointed(colours.where(F.col("c.node") == F.col("node")).select("node", F.col("node").alias("root")))
        fresh = found
        while True:
            back = step.join(fresh.toDF("x", "y"), F.col("t") == F.col("x")).select(F.col("f").alias("node"), F.col("y").alias("root")).distinct()
            fresh = checkpointed(back.join(found.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti"))
            if fresh.isEmpty():
                break
            found = checkpointed(found.unionAll(fresh))
        known = found if known is None else known.unionAll(found)
        gone = found.select(F.col("node").alias("g"))
        open_ = checkpointed(open_.join(gone, F.col("node") == F.col("g"), "left_anti"))
        step = checkpointed(step.join(gone, F.col("f") == F.col("g"), "left_anti").join(gone, F.col("t") == F.col("g"), "left_anti"))
    else:
        raise RuntimeError("components did not settle")
    if known is None:
        known = nodes.select("node", F.col("node").alias("root"))
    sizes = known.groupBy("root").agg(F.min("node").alias("scc"), F.count("*").alias("size")).withColumnRenamed("root", "s")
    return known.join(sizes, F.col("root") == F.col("s")).select("node", "scc", "size")


def cyclic_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """edges with ``is_cyclic``: both ends are in some component of more than one node, not necessarily the same."""
    cyclic = components.where("size > 1").select("node")
    out = edges.join(cyclic.toDF("cf"), F.col("f") == F.col("cf"), "left").join(cyclic.toDF("ct"), F.col("t") == F.col("ct"), "left")
    return out.withColumn("is_cyclic", F.col("cf").isNotNull() & F.col("ct").isNotNull()).drop("cf", "ct")


def topological_levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, level): the round in which all that points to a node has been taken away; null on and behind cycles.

    Dependents come before what they depend on. Edges are a set; a loop keeps its node from any level.
    """
    left = checkpointed(edges.select("f", "t").distinct())
    open_ = checkpointed(nodes.select("node").distinct())
    levels = None
    for level in range(max_rounds):
        targets = left.select(F.col("t").alias("tt")).distinct()
        free = checkpointed(open_.join(targets, F.col("node") == F.col("tt"), "left_anti").select(F.col("node"), F.lit(level).alias("level")))
        if free.isEmpty():
            break
        levels = free if levels is None else checkpointed(levels.unionAll(free))
        gone = free.select(F.col("node").alias("g"))
        open_ = checkpointed(open_.join(gone, F.col("node") == F.col("g"), "left_anti"))
        left = checkpointed(left.join(gone, F.col("f") == F.col("g"), "left_anti"))
    rest = open_.select("node", F.lit(None).cast("int").alias("level"))
    return rest if levels is None else levels.unionAll(rest)


def shortest_paths(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(a, b, d, path): of the shortest paths of each pair the lexicographically first, as an array of nodes."""
    step = checkpointed(edges.select("f", "t").where("f <> t").distinct())
    known = checkpointed(step.select(F.col("f").alias("a"), F.col("t").alias("b"), F.lit(1).alias("d"), F.array("f", "t").alias("path")))
    fresh = known
    for d in range(2, max_rounds + 2):
        onward = fresh.toDF("x", "y", "z", "w").join(step.toDF("p", "q"), F.col("y") == F.col("p")).where("q <> x")
        onward = onward.groupBy(F.col("x").alias("a2"), F.col("q").alias("b2")).agg(F.min(F.concat("w", F.array("q"))).alias("path"))
        old = known.select(F.col("a").alias("ka"), F.col("b").alias("kb"))
        fresh = checkpointed(
            onward.join(old, (F.col("a2") == F.col("ka")) & (F.col("b2") == F.col("kb")), "left_anti").select(F.col("a2").alias("a"), F.col("b2").alias("b"), F.lit(d).alias("d"), "path")
        )
        if fresh.isEmpty():
            return known
        known = _added(known, fresh, d)
    raise RuntimeError(f"paths are longer than {max_rounds}")


def indirect_cycles(paths: DataFrame) -> DataFrame:
    """(a, b, path): pairs a < b that reach each other, not both by one edge; the way there and back."""
    back = paths.select(F.col("a").alias("ba"), F.col("b").alias("bb"), F.col("d").alias("bd"), F.col("path").alias("bp"))
    both = paths.join(back, (F.col("a") == F.col("bb")) & (F.col("b") == F.col("ba"))).where("a < b and d + bd > 2")
    return both.select("a", "b", F.concat("path", F.slice("bp", 2, 1_000_000)).alias("path"))


def longest_path(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(position, node) of the longest chain of an acyclic graph: most edges, then lexicographically first.

    Cyclic graphs have none; condense their components first.
    """
    step = checkpointed(edges.select("f", "t").distinct())
    best = checkpointed(nodes.select(F.col("node"), F.lit(0).alias("d"), F.array("node").alias("path")))
    fresh = best
    for d in range(1, max_rounds + 1):
        onward = fresh.toDF("n", "e", "w").join(step.toDF("p", "q"), F.col("n") == F.col("p"))
        fresh = checkpointed(onward.groupBy(F.col("q").alias("node")).agg(F.min(F.concat("w", F.array("q"))).alias("path")).select("node", F.lit(d).alias("d"), "path"))
        if fresh.isEmpty():
            break
        best = fresh
    else:
        raise RuntimeError("the graph has a cycle, or a chain longer than max_rounds")
    first = best.agg(F.min("path").alias("path"))
    return first.select(F.posexplode("path").alias("position", "node"))


def min_label_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, label): the smallest node of each undirected component; links has (x, y)."""
    both = checkpointed(links.select("x", "y").unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpointed(nodes.select("node", F.col("node").alias("label")))
    for _ in range(max_rounds):
        seen = both.join(labels.toDF("n", "l"), F.col("y") == F.col("n")).groupBy("x").agg(F.min("l").alias("m"))
        new = labels.join(seen, F.col("node") == F.col("x"), "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # A label's own label is a shortcut over long chains.
        jump = new.select(F.col("node").alias("jn"), F.col("label").alias("jl"))
        new = checkpointed(new.join(jump, F.col("label") == F.col("jn"), "left").select("node", "old", F.least("label", "jl").alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")

"""Links between the members of posting lists: representatives first, then whatever they have not connected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import settle

#: Lists up to this length are compared pair by pair as rows, longer ones within tasks.
SHORT_LIST = 8
ORDERS = 2
#: Members of one block of a long list; each two blocks meet in a cell.
BLOCK = 2048
#: A class is crowded if it holds more than this share of the rows; there are at most 1 / CROWDED of them.
CROWDED = 0.001


def shared_postings(postings: DataFrame) -> DataFrame:
    """The postings (key, node, ...) of keys that occur under two nodes or more, stored.

    Keys are counted before the postings travel, and by far the most occur once. A key that repeats
    under one node only passes the count and is dropped by the second look at what is left.
    """
    again = postings.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"))
    often = settle(postings.join(again, F.col("key") == F.col("k")).drop("k").distinct())
    several = often.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
    return often.join(several, F.col("key") == F.col("k")).drop("k")


def representative_pairs(shared: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(node, at, rep, rep_at): each posting held against the smallest of its key's list under so many hash orders.

    Linear in the postings. Members of a list that meet only each other are left to its cells.
    Minima are aggregated before the shuffle, and the join by key is one that AQE can split.
    """
    least = [F.min(F.struct(F.xxhash64(F.lit(o), "node").alias("h"), F.col("node").alias("rep"), F.col("at").alias("rep_at"))).alias(f"r{o}") for o in range(orders)]
    lists = shared.groupBy("key").agg(*least)
    reps = lists.select(F.col("key").alias("k"), F.array_distinct(F.array(*[F.col(f"r{o}") for o in range(orders)])).alias("reps"))
    joined = shared.join(reps, F.col("key") == F.col("k")).select("node", "at", F.explode("reps").alias("r"))
    return joined.select("node", "at", "r.rep", "r.rep_at").where("node <> rep")


def with_sizes(shared: DataFrame) -> DataFrame:
    """shared with ``size``, the length of each posting's list."""
    sizes = shared.groupBy(F.col("key").alias("k")).agg(F.count("*").cast("int").alias("size"))
    return shared.join(sizes, F.col("key") == F.col("k")).drop("k")


def short_pairs(shared: DataFrame) -> DataFrame:
    """(node, at, rep, rep_at) of every two members of a list of at most SHORT_LIST; shared has ``size``."""
    short = shared.where(F.col("size") <= SHORT_LIST).select("key", "node", "at")
    other = short.select(F.col("key").alias("k"), F.col("node").alias("rep"), F.col("at").alias("rep_at"))
    return short.join(other, (F.col("key") == F.col("k")) & (F.col("node") < F.col("rep"))).select("node", "at", "rep", "rep_at")


def with_roots(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """shared with ``root``, the component of each node (itself without links), less the lists that lie in one component."""
    ends = roots.select(F.col("node").alias("__end"), "root")
    members = settle(shared.join(ends, F.col("node") == F.col("__end"), "left").withColumn("root", F.coalesce("root", "node")).drop("__end"))
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return members.join(mixed.select(F.col("key").alias("k")), F.col("key") == F.col("k")).drop("k")


def in_cells(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """members (with ``size``) once for each cell of their list, with ``c1``, ``c2`` (the cell) and ``blk`` (their own block).

    Every two members of a list meet: those of one block in the cell (blk, blk), those of two blocks
    in the cell of both. No list is too long, and no cell has more than about two blocks of members.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    cut = members.withColumn("blk", F.pmod(F.xxhash64(F.lit(5), "node"), blocks).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return cells.withColumns({"c1": F.least("blk", "other"), "c2": F.greatest("blk", "other")}).drop("other", "size")


def dealt(cells: DataFrame) -> DataFrame:
    """The rows of ``in_cells`` with those of a cell behind each other, for ``each_cell``."""
    return cells.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")


def each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    """The rows of each cell, one cell at a time, and None after each batch; only the last cell of a batch waits for more rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(c).to_numpy() for c in ("key", "c1", "c2")]
        new = np.zeros(batch.num_rows, bool)
        for x in marks:
            new[1:] |= x[1:] != x[:-1]
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            new[0] = any(last.column(c)[0].as_py() != x[0] for c, x in zip(("key", "c1", "c2"), marks))
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for k, (i, j) in enumerate(zip(cut, cut[1:])):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            if j > i:
                held.append(batch.slice(i, j - i))
        yield None
    if held:
        yield pa.Table.from_batches(held)
        yield None


def attach(rows: DataFrame, key: str, classes: DataFrame, class_key: str, n_rows: str, total: int) -> DataFrame:
    """rows with the columns of their class; every row's class must be there, under one row.

    ``n_rows`` of classes says how many rows a class has. Of the classes with more than CROWDED of the
    total there are at most 1 / CROWDED, so those are broadcast and their rows are not dealt by key;
    the others are joined by a shuffle in which no key is hot.
    """
    crowded = F.col(n_rows) > CROWDED * total
    names = [c for c in classes.columns if c not in (class_key, n_rows)]
    known = classes.withColumnRenamed(class_key, "__class")
    few = F.broadcast(known.where(crowded).select("__class", F.struct(*names).alias("__found")))
    met = rows.join(few, F.col(key) == F.col("__class"), "left").drop("__class")
    quick = met.where(F.col("__found").isNotNull()).select(*rows.columns, "__found.*")
    slow = met.where(F.col("__found").isNull()).drop("__found").join(known.where(~crowded).select("__class", *names), F.col(key) == F.col("__class")).drop("__class")
    return quick.unionByName(slow.select(*rows.columns, *names))

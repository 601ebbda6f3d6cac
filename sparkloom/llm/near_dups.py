"""Near-duplicates by word-shingle similarity, found through SimHash fingerprints and tables of distances to references.

Each text has a SimHash of its shingles and, stored beside it, the table of its distances to the reference
fingerprints (``simhash.pivot_table``). First the fingerprints are searched by distance, with the keys and
discards of ``simhash.fingerprint_links``: what differs in two bits at most is found whatever else it shares.
A similarity of 0.8 is about ten of 64 bits, farther than any key of distances reaches, so the search goes on
over views: each view fingerprints a small sample of the shingles, the ones that are smallest under the
view's hash, and two texts of Jaccard similarity s agree in a view with a probability of about s ** sample,
in one of all views with near certainty. Texts of few shingles also meet at the shingles that two similar
ones must share. Every candidate, however found, is discarded if a coordinate of the two distance tables
differs by more than MOST_BITS (then so do the fingerprints, by the triangle inequality), then if the
fingerprints do; the survivors are verified by the Jaccard similarity of their whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import settle, splitmix
from sparkloom.llm.graph import connected_components
from sparkloom.llm.linking import SHORT_LIST, dealt, each_cell, in_cells, representative_pairs, shared_postings, short_pairs, with_roots, with_sizes
from sparkloom.llm.simhash import PIVOTS, fingerprint_links, near_pivots, pivot_table, shingle_hashes, simhash

VIEWS = 16
SAMPLE = 4
#: A pair of which one text has no more shingles is found whatever its views say.
FEW = 32
#: Whole fingerprints of sets at a similarity of 0.8 differ in 9.7 bits on average, with a deviation of 2.9; in more
#: than this about once in a million pairs. Not asked of texts with FEW shingles or fewer.
MOST_BITS = 24
#: Fingerprints are searched by distance up to this many bits.
SEARCHED_BITS = 2
#: The smallest shingles of a member that are compared within the cells of long lists; texts of more are estimated there,
#: pass with a similarity less by a margin of six standard deviations, and are verified whole.
IN_CELL = 512
MARGIN = 0.11
_SEEDS = np.array([splitmix(100 + v) for v in range(VIEWS)], np.uint64)
_PIVOTS = np.array(PIVOTS, np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def words_digest(text: str | None) -> bytes:
    """Equal for texts of equal words (A-Z lower-cased, split by white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words))


def view_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of the SAMPLE smallest hashes of each view; none without shingles."""
    distinct = np.unique(hashes)
    if not len(distinct):
        return np.empty(0, np.int64)
    mixed = (distinct[None, :] ^ _SEEDS[:, None]) * _ODD
    mixed ^= mixed >> np.uint64(32)
    mixed *= _ODD
    if mixed.shape[1] > SAMPLE:
        mixed = np.partition(mixed, SAMPLE - 1, axis=1)[:, :SAMPLE]
    bits = np.unpackbits(np.ascontiguousarray(mixed).view(np.uint8).reshape(VIEWS, -1, 8), axis=2, bitorder="little")
    ones = bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > mixed.shape[1], axis=1, bitorder="little").view(np.int64).ravel()


def prefix(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest shingles, of which two sets of at least that similarity share one; none of sets too large for a partner of FEW."""
    distinct = np.unique(hashes)
    n = len(distinct)
    return distinct[: n - math.ceil(similarity * n - 1e-9) + 1 if n and similarity * n <= FEW + 1e-9 else 0].view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _sketches(df: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, cls, fp, n, fps, few): digest of the words, fingerprint and number of the distinct shingles, views, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            texts = part.column(1).to_pylist()
            hashes = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            lists = [pa.array([f(h).tolist() for h in hashes], pa.list_(pa.int64())) for f in (view_fingerprints, lambda h: prefix(h, similarity))]
            prints = pa.array(np.array([simhash(h) for h in hashes], np.uint64).view(np.int64))
            sizes = pa.array([len(h) for h in hashes], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(words_digest, texts), pa.binary()), prints, sizes, *lists], ["id", "cls", "fp", "n", "fps", "few"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, cls binary, fp bigint, n int, fps array<bigint>, few array<bigint>")


def _shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            texts = part.column(0).to_pylist()
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(map(words_digest, texts), pa.binary()), pa.array(sets, pa.binary())], ["c", "shingles"])

    return df.mapInArrow(run, "c binary, shingles binary")


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, 64):
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def _with_digest(df: DataFrame, text_column: str) -> DataFrame:
    at = df.columns.index(text_column)
    names = [*df.columns, "__cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            digests = pa.array(map(words_digest, part.column(at).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, digests], names=names)

    return df.mapInArrow(run, df.withColumn("__cls", F.lit(b"").cast("binary")).schema)


def _may_be_similar(similarity: float, x: Column, y: Column) -> Column:
    """Whether sets with the sketches x and y (n, fp and the distance table t0, t1) can be that similar."""
    small, large = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    tables = near_pivots(F.array(x["t0"], x["t1"]), F.array(y["t0"], y["t1"]), MOST_BITS)
    near = tables & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= MOST_BITS)
    return (small >= similarity * large - 1e-9) & ((small <= FEW) | near)


def _searched(sized: DataFrame) -> DataFrame:
    """(node, at, rep, rep_at) of classes whose fingerprints the distance tables find within SEARCHED_BITS; sized(node, at).

    Classes of one fingerprint meet its first class, and the first classes of two linked fingerprints meet.
    """
    first = settle(sized.groupBy(F.col("at.fp").alias("fp")).agg(F.min(F.struct("node", "at")).alias("one")))
    equal = sized.join(first, F.col("at.fp") == F.col("fp")).select("node", "at", F.col("one.node").alias("rep"), F.col("one.at").alias("rep_at")).where("node <> rep")
    links = fingerprint_links(first.select("fp"), SEARCHED_BITS)
    left = first.select(F.col("fp").alias("f"), F.col("one.node").alias("node"), F.col("one.at").alias("at"))
    right = first.select(F.col("fp").alias("g"), F.col("one.node").alias("rep"), F.col("one.at").alias("rep_at"))
    met = links.join(left, F.col("a") == F.col("f")).join(right, F.col("b") == F.col("g")).select("node", "at", "rep", "rep_at")
    return equal.unionByName(met)


def _cell_links(blk: np.ndarray, node: list[bytes], root: list[bytes], n: np.ndarray, fp: np.ndarray, sets: list[bytes], both: bool, similarity: float) -> list[tuple]:
    """(a, b, sure) among the members of a cell: enough sure links to connect what is similar, and all unsure ones.

    A member has its smallest IN_CELL shingles. If those are all, a pair's similarity is known; else it
    is estimated from the smallest of both, with a margin. ``both``: only members of different blocks meet.
    """
    m = len(node)
    own = [np.frombuffer(x, np.uint64) for x in sets]
    lengths = np.array([len(x) for x in own])
    whole = lengths == n
    fp = fp.view(np.uint64)
    tables = np.bitwise_count(fp[:, None] ^ _PIVOTS).astype(np.int8)
    label = np.unique(np.array(root, object), return_inverse=True)[1]
    # Which members have each shingle, as ranges of one array.
    shingles, at = np.unique(np.concatenate(own), return_inverse=True)
    owner = np.repeat(np.arange(m), lengths)[np.argsort(at, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(shingles)))))
    mine = np.split(at, np.cumsum(lengths)[:-1])
    out = []
    for x in range(m - 1):
        y = np.arange(x + 1, m)
        fit = (label[y] != label[x]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
        if both:
            fit &= blk[y] != blk[x]
        y = y[fit]
        # Discarded by the distance tables, then by the bits.
        few = np.minimum(n[x], n[y]) <= FEW
        y = y[few | (np.abs(tables[y] - tables[x]) <= MOST_BITS).all(axis=1)]
        y = y[(np.minimum(n[x], n[y]) <= FEW) | (np.bitwise_count(fp[y] ^ fp[x]) <= MOST_BITS)]
        if not len(y):
            continue
        lo, count = begin[mine[x]], begin[mine[x] + 1] - begin[mine[x]]
        met = owner[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        common = np.bincount(met, minlength=m)[y]
        sure = whole[x] & whole[y]
        linked = sure & (common >= similarity * (n[x] + n[y] - common))
        for i in np.flatnonzero(linked):
            if label[y[i]] != label[x]:
                label[label == label[y[i]]] = label[x]
                out.append((*sorted((node[x], node[y[i]])), True))
        for i in np.flatnonzero(~sure):
            # Of the smallest shingles of the union, the share that both have.
            u = np.union1d(own[x], own[y[i]])[:IN_CELL]
            if len(np.intersect1d(np.intersect1d(own[x], own[y[i]], True), u, True)) >= (similarity - MARGIN) * len(u):
                out.append((*sorted((node[x], node[y[i]])), False))
    return out


def _long_list_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure) between members of different components, all lists whole; what isn't similar is never written."""
    known = members.join(sets.select(F.col("c"), F.substring("shingles", 1, F.lit(8 * IN_CELL)).alias("shingles")), F.col("node") == F.col("c"))
    cells = in_cells(known).select("key", "c1", "c2", "blk", "node", "root", "n", "fp", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in each_cell(batches):
            if rows is not None:
                blk, n, fp = (rows.column(c).to_numpy() for c in ("blk", "n", "fp"))
                lists = [rows.column(c).to_pylist() for c in ("node", "root", "shingles")]
                found += _cell_links(blk, lists[0], lists[1], n, fp, lists[2], rows.column("c1")[0] != rows.column("c2")[0], similarity)
            elif found:
                a, b, sure = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sure, pa.bool_())], ["a", "b", "sure"])
                found = []

    return dealt(cells).mapInArrow(run, "a binary, b binary, sure boolean")


def near_duplicate_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(cls, n, least, keeper_id, keeper_cls): for each text's word digest its group's representative.

    Texts are linked if the Jaccard similarity of their word shingles is ``similarity`` or more; equal
    words are one text, so copies are never paired. Candidates are what the distance tables find near
    and what shares a view. Members of a short list meet pair by pair, those of
    a long one meet its representatives, and all that this hasn't connected is compared all with all
    within tasks. Texts of fewer words are
    one shingle. All texts without words are one group. keeper: the smallest id of the group, a null id last, ties by digest.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    sketches = settle(_sketches(rows, shingle, similarity))
    # All but the id are functions of cls, so any row's will do.
    nodes = settle(sketches.groupBy("cls").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "fps", "few")]))
    seen = nodes.select(F.col("cls").alias("node"), F.posexplode("fps").alias("view", "hash"))
    few = nodes.select(F.col("cls").alias("node"), F.lit(VIEWS).alias("view"), F.explode("few").alias("hash"))
    shared = shared_postings(seen.unionByName(few).select(F.xxhash64("view", "hash").alias("key"), "node"))
    # Texts without words have no postings: they are one class.
    tabled = nodes.select(F.col("cls").alias("c"), "fp", "n", pivot_table(F.col("fp")).alias("table"))
    sized = settle(tabled.select("c", "fp", "n", F.get("table", F.lit(0)).alias("t0"), F.get("table", F.lit(1)).alias("t1")))
    shared = settle(with_sizes(shared).join(sized, F.col("node") == F.col("c")).drop("c"))
    sketch = F.struct("fp", "n", "t0", "t1")
    placed = shared.withColumn("at", sketch)
    met = short_pairs(placed).unionByName(representative_pairs(placed.where(F.col("size") > SHORT_LIST)))
    met = met.unionByName(_searched(sized.where("n > 0").select(F.col("c").alias("node"), sketch.alias("at"))))
    near = _may_be_similar(similarity, F.col("at"), F.col("rep_at"))
    pairs = settle(met.where(near).select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct())

    def sets_of(classes: DataFrame) -> DataFrame:
        """(c, shingles) of the classes (cls), stored."""
        needed = classes.join(nodes.select("cls", "least"), "cls")
        texts = rows.join(needed.select(F.col("least").alias("l")).distinct(), F.col("id").eqNullSafe(F.col("l")), "left_semi").select("text")
        # Other texts under a needed id are computed too, and dropped by this aggregation and the joins with it.
        return settle(_shingle_sets(texts, shingle).groupBy("c").agg(F.first("shingles").alias("shingles")))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        left = sets.select(F.col("c").alias("ca"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("c").alias("cb"), F.col("shingles").alias("sb"))
        both = pairs.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb")).select("a", "b", "sa", "sb")
        return settle(_similar(both, similarity))

    links = verified(pairs)
    # What the representatives of long lists haven't connected: all against all of a list. Two of one component add nothing.
    members = settle(with_roots(shared.where(F.col("size") > SHORT_LIST), connected_components(links)))
    more = settle(_long_list_links(members, sets_of(members.select(F.col("node").alias("cls")).distinct()), similarity))
    links = links.unionAll(more.where("sure").select("a", "b"))
    left_over = settle(more.where("not sure").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    roots = connected_components(links.unionAll(verified(left_over)))
    rooted = nodes.select("cls", "least").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    rooted = settle(rooted)
    order = F.struct(F.col("least").isNull().alias("none"), "least", "cls")
    keepers = rooted.groupBy("root").agg(F.min(order).alias("keeper")).select(F.col("root").alias("r"), "keeper.least", F.col("keeper.cls").alias("keeper_cls")).withColumnRenamed("least", "keeper_id")
    counts = sketches.groupBy("id", "cls").agg(F.count("*").alias("n")).withColumnsRenamed({"id": "i", "cls": "c"})
    groups = rooted.join(keepers, F.col("root") == F.col("r")).select("cls", "least", "keeper_id", "keeper_cls")
    return groups.join(counts, F.col("least").eqNullSafe(F.col("i")) & (F.col("cls") == F.col("c")), "left").select("cls", "n", "least", "keeper_id", "keeper_cls")


def keep_representatives(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df of which one of each group of near-duplicates stays: that of the smallest id.

    A row that repeats under the smallest id stays once. Columns are those of df.
    """
    groups = near_duplicate_groups(df, id_column, text_column, shingle, similarity)
    kept = settle(groups.where("cls = keeper_cls").select(F.col("least").alias("__id"), F.col("cls").alias("__kept"), "n"))
    rows = _with_digest(df, text_column)
    same = F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__cls") == F.col("__kept"))
    once = rows.join(kept.where("n = 1").drop("n"), same, "left_semi").drop("__cls")
    again = rows.join(kept.where("n > 1").drop("n"), same, "left_semi")
    first = again.groupBy("__cls", id_column).agg(F.min(F.struct(*[F.col(c) for c in df.columns])).alias("row")).select("row.*")
    return once.unionByName(first)

"""SimHash fingerprints, linked through tables of distances to reference fingerprints.

A reference (pivot) fingerprint gives each fingerprint a coordinate: its Hamming distance to the
pivot. By the triangle inequality two fingerprints at distance d differ by at most d in every
coordinate, so pairs with a larger coordinate difference are discarded unseen. Kept by block of bits,
the same table also yields join keys: of d + 2 blocks, d differing bits leave two untouched, and in
those all coordinates are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import settle, signed, splitmix, table
from sparkloom.llm.graph import connected_components

BITS = 64
PIVOTS = [splitmix(i) for i in range(16)]
#: Larger buckets are linked by one-bit neighbours instead of pair by pair.
PAIRED_BUCKET = 24
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, in order, repeats included.

    A-Z are lower-cased; words are split by space and \\t\\n\\v\\f\\r. Fewer words than ``size`` make
    one shingle, no word makes none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half the hashes; none give 0."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _COLUMN
    ones = (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(id, fp BIGINT) for each row; a null or wordless text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                found = [simhash(shingle_hashes(t.as_py(), shingle)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [(2**b - 1) ^ (2**a - 1) for a, b in zip(edges, edges[1:])]


def pivot_coordinates(fp: Column, mask: int = 2**BITS - 1) -> list[Column]:
    """Hamming distances to all pivots, within the bits of mask."""
    return [F.bit_count(fp.bitwiseXOR(F.lit(signed(p))).bitwiseAND(F.lit(signed(mask)))) for p in PIVOTS]


def block_keys(fp: Column, max_distance: int) -> Column:
    """ARRAY<BIGINT>: for each two blocks, a digest of their pivot coordinates."""
    table_ = [pivot_coordinates(fp, m) for m in _block_masks(max_distance + 2)]
    return F.array(*[F.xxhash64(F.lit(i), *table_[a], *table_[b]) for i, (a, b) in enumerate(combinations(range(max_distance + 2), 2))])


def pivot_table(fp: Column) -> Column:
    """ARRAY<BIGINT>: the distances to all pivots, eight of one byte each to a number; computed once for a fingerprint and stored beside it."""
    found = pivot_coordinates(fp)
    packed = lambda part: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c.cast("bigint"), 8 * i) for i, c in enumerate(part)])
    return F.array(*[packed(found[i : i + 8]) for i in range(0, len(found), 8)])


def near_pivots(x: Column, y: Column, max_distance: int) -> Column:
    """Whether no coordinate of two pivot tables differs by more than max_distance."""
    at = lambda t, i: F.shiftright(F.get(t, F.lit(i // 8)), 8 * (i % 8)).bitwiseAND(F.lit(255).cast("bigint"))
    return reduce(lambda a, b: a & b, [F.abs(at(x, i) - at(y, i)) <= max_distance for i in range(len(PIVOTS))])


def fingerprint_links(nodes: DataFrame, max_distance: int) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``fp`` of nodes, enough to connect what is linked.

    Every two fingerprints at max_distance (0 to 2) or fewer differing bits are connected, and no
    others. Pairs are formed within buckets of at most PAIRED_BUCKET fingerprints, discarded by pivot
    coordinates and then verified. The fingerprints of larger buckets meet at their one-bit
    neighbours: two at distance 2 or less share such a neighbour, which has at most 65 itself, so
    links stay linear in a bucket however large.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2")
    tabled = nodes.select("fp", pivot_table(F.col("fp")).alias("table"))
    keyed = tabled.select("fp", "table", F.explode(block_keys(F.col("fp"), max_distance)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    members = settle(keyed.join(sizes, F.col("key") == F.col("k")).select("key", "fp", "table", "n"))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_distance
    few = members.where(F.col("n") <= PAIRED_BUCKET).groupBy("key").agg(F.collect_list(F.struct("fp", "table")).alias("all"))
    pairs = few.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y")).where("x.fp < y.fp")
    pairs = pairs.where(near_pivots(F.col("x.table"), F.col("y.table"), max_distance)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pairs = pairs.where(near(F.col("a"), F.col("b")))
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(signed(1 << i)) for i in range(BITS)])
    many = members.where(F.col("n") > PAIRED_BUCKET).select("fp").distinct()
    meets = many.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("at"))
    met = meets.groupBy("at").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    # With a distance below 2 not all who meet are linked; each member is then held against each of the (at most 65) others.
    if max_distance < 2:
        stars = met.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b")).where("a < b")
        stars = stars.where(near(F.col("a"), F.col("b")))
    return pairs.unionAll(stars).distinct()


def simhash_components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(id, fp, component): the fingerprint of every row and the smallest id that it reaches over links.

    Equal fingerprints are one node, so copies are never paired. A null id is larger than any other;
    a component of null ids only has a null id. Rows that repeat stay repeated.
    """
    prints = settle(fingerprints(df, id_column, text_column, shingle))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(fingerprint_links(nodes, max_distance))
    rooted = settle(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    named = rooted.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component")
    return prints.join(named, F.col("fp") == F.col("f"), "left").select("id", "fp", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word SimHash fingerprints of all documents, linked at 2 or fewer differing bits."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )

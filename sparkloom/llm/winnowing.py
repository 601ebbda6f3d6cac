"""Benchmark decontamination by winnowed k-gram fingerprints.

Of every window of ``window - k + 1`` consecutive k-grams the one with the smallest hash is kept, on
both sides. Two texts that share ``window`` consecutive words share all k-grams of one such window,
hence its smallest, so the join of the kept fingerprints finds every shared span of that length.
Each hit is extended to its window, whose words are part of the join's key: what joins is verified,
and a k-gram that is common joins only under equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import settle, table

WINDOW = 10
#: Bytes of text whose words are hashed at once, except that a word is never cut.
SCAN_BYTES = 1_000_000
#: Bits of the filter over the benchmark's fingerprints that is sent to the executors, 4 MB whatever the benchmark's size. A
#: fuller filter lets more fingerprints through to the join, never fewer.
FILTER_BITS = 1 << 25

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of data into pieces of about SCAN_BYTES that end outside of words."""
    begin = 0
    while begin < len(data):
        end = min(begin + SCAN_BYTES, len(data))
        while end < len(data):
            gaps = np.flatnonzero(~_IS_WORD[data[end : end + 4096]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + 4096, len(data))
        yield begin, end
        begin = end


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of lower-cased bytes; equal words have equal hashes."""
    found = []
    for begin, end in _pieces(data):
        piece = data[begin:end]
        inside = np.zeros(len(piece) + 2, bool)
        inside[1:-1] = _IS_WORD[piece]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[0::2], edge[1::2]
        # Sums of byte x base^position wrap around; times base^-start they don't depend on the position.
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(piece)), out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(piece) + 1)[starts]
        found.append((_mix(hashes + (ends - starts).astype(np.uint64)), starts + begin, ends + begin))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


class Scanned:
    """The words of several texts: runs of digits, ASCII letters (A-Z lower-cased) and all characters from U+0080."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.digests = [xxhash.xxh3_128_digest(r) for r in raw]
        data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        self.hashes, self.starts, self.ends = _words(data)
        self.bytes = data.tobytes()
        bounds = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64)) if raw else np.empty(0, np.int64)
        upto = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(upto, prepend=0)
        self.first = upto - self.counts
        self.text = np.repeat(np.arange(len(raw)), self.counts)

    def window(self, at: int, length: int) -> bytes:
        """The words from one on, joined by single spaces."""
        return b" ".join(self.bytes[a:b] for a, b in zip(self.starts[at : at + length].tolist(), self.ends[at : at + length].tolist()))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start of each window of so many words that lies in one text, and its fingerprint."""
        k = min(5, length)
        grams = _grams(self.hashes, k)
        at = minima(grams, length - k + 1)
        # Fingerprints of windows of other lengths are others.
        prints = _mix(grams[at] + np.uint64(length))
        inside = self.text[: len(at)] == self.text[length - 1 :] if len(at) else np.empty(0, bool)
        begin = np.flatnonzero(inside)
        return begin, prints[begin].view(np.int64)


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return _mix(out)


def minima(grams: np.ndarray, window: int) -> np.ndarray:
    """For every window of so many k-grams, where its smallest hash is, the last one of equal hashes."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, least = np.arange(n), grams[:n].copy()
    for j in range(1, window):
        here = grams[j : j + n]
        lower = here <= least
        least[lower] = here[lower]
        at[lower] = np.flatnonzero(lower) + j
    return at


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """The positions that are kept: those of ``minima``, each once."""
    return np.unique(minima(grams, window))


def _parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about SCAN_BYTES of text in column ``at``; a text is never cut."""
    for whole in batches:
        sizes = pc.binary_length(whole.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // SCAN_BYTES, prepend=0))
        for a, b in zip([0, *cut], [*cut, whole.num_rows]):
            if a < b:
                yield whole.slice(a, b - a)


def benchmark_windows(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(item, length, print, words) of every window of every item, once each; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1):
            scanned = Scanned(part.column(1).to_pylist())
            for length in sorted({min(int(n), window) for n in scanned.counts if n}):
                begin, prints = scanned.windows(length)
                own = np.minimum(scanned.counts[scanned.text[begin]], window) == length
                begin, prints = begin[own], prints[own]
                for i in range(0, len(begin), 10_000):
                    some = begin[i : i + 10_000]
                    words = pa.array([scanned.window(at, length) for at in some.tolist()], pa.binary())
                    item = part.column(0).take(pa.array(scanned.text[some]))
                    yield pa.RecordBatch.from_arrays([item, pa.array(np.full(len(some), length, np.int32)), pa.array(prints[i : i + 10_000]), words], ["item", "length", "print", "words"])

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    return rows.mapInArrow(run, "item string, length int, print bigint, words binary").distinct()


def _filter(prints: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS over ``print``, as 64-bit words; at most that many bits reach the driver."""
    places = F.array(F.col("print").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned("print", 32).bitwiseAND(F.lit(FILTER_BITS - 1)))
    bits = prints.select(F.explode(places).alias("i")).select((F.col("i") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(i % 64 as int))").alias("b"))
    found = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def _passes(words: np.ndarray, prints: np.ndarray) -> np.ndarray:
    z, mask = prints.view(np.uint64), np.uint64(64 * len(words) - 1)
    ok = np.ones(len(z), bool)
    for i in (z & mask, (z >> np.uint64(32)) & mask):
        ok &= (words[i >> np.uint64(6)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def _candidates(docs: DataFrame, text_column: str, lengths: list[int], sent) -> DataFrame:
    """(digest, n, length, print, words, starts): windows of each text whose fingerprint passes the filter, with the words they start at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 0):
            scanned = Scanned(part.column(0).to_pylist())
            for length in lengths:
                begin, prints = scanned.windows(length)
                passed = _passes(sent.value, prints)
                found: dict[tuple[int, int, bytes], list[int]] = {}
                for at, h in zip(begin[passed].tolist(), prints[passed].tolist()):
                    text = int(scanned.text[at])
                    found.setdefault((text, h, scanned.window(at, length)), []).append(at - int(scanned.first[text]))
                if not found:
                    continue
                texts = [t for t, _, _ in found]
                columns = [
                    pa.array([scanned.digests[t] for t in texts], pa.binary()),
                    pa.array(scanned.counts[texts].astype(np.int64)),
                    pa.array(np.full(len(found), length, np.int32)),
                    pa.array([h for _, h, _ in found], pa.int64()),
                    pa.array([w for _, _, w in found], pa.binary()),
                    pa.array(list(found.values()), pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "length", "print", "words", "starts"])

    return docs.select(text_column).mapInArrow(run, "digest binary, n bigint, length int, print bigint, words binary, starts array<int>")


def _marked(hits: DataFrame) -> DataFrame:
    """(__d, __hit) of (digest, n, spans): a bit for each word that a span covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                bits = []
                for n, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    flags = np.zeros(n + 1, np.int64)
                    for span in spans:
                        starts = np.array(span["starts"], np.int64)
                        flags[starts] += 1
                        np.add.at(flags, starts + span["length"], -1)
                    bits.append(np.packbits(np.cumsum(flags[:-1]) > 0).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits, pa.binary())], ["__d", "__hit"])

    return hits.mapInArrow(run, "__d binary, __hit binary")


def _counted(docs: DataFrame, text_column: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with ``__n_words`` and ``__digest`` of the text."""
    names = [*keep, "__n_words", "__digest"]
    schema = docs.select(*keep, F.lit(0).cast("bigint").alias("__n_words"), F.lit(b"").cast("binary").alias("__digest")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 0):
            scanned = Scanned(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scanned.counts.astype(np.int64)), pa.array(scanned.digests, pa.binary())], names=names)

    return docs.select(F.col(text_column).alias("__text"), *keep).mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all by default) of docs with ``__n_words``, ``__hit`` (BINARY, a bit per word in order) and ``__items``.

    ``__hit`` is null and ``__items``, the sorted ids of the items that occur, empty where nothing
    occurs. A filter of fixed size over the benchmark's fingerprints keeps what cannot join on the
    executors; what passes is joined by fingerprint and words of the window, and only that is
    shuffled, once for equal texts. Null or wordless texts and items have no windows; rows that repeat
    stay repeated. Of the documents nothing reaches the driver, of the benchmark the filter.
    """
    keep = docs.columns if keep is None else keep
    items = settle(benchmark_windows(benchmark, item_id, item_text, window))
    windows = items.select("length", "print", "words").distinct()
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(_filter(windows.select("print")))
    met = _candidates(docs, text_column, lengths, sent).groupBy("digest", "n", "length", "print", "words").agg(F.first("starts").alias("starts"))
    met = settle(met.join(windows, ["print", "length", "words"]))
    spans = met.groupBy("digest", "n").agg(F.collect_list(F.struct("length", "starts")).alias("spans"))
    names = met.select("digest", "length", "print", "words").join(items, ["print", "length", "words"]).select("digest", "item").distinct()
    listed = names.groupBy(F.col("digest").alias("e")).agg(F.array_sort(F.collect_list("item")).alias("__items"))
    found = settle(_marked(spans).join(listed, F.col("__d") == F.col("e")).drop("e"))
    out = _counted(docs, text_column, keep).join(found, F.col("__digest") == F.col("__d"), "left")
    return out.select(*keep, "__n_words", "__hit", F.coalesce("__items", F.array().cast("array<string>")).alias("__items"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word passages of the benchmark, and the items they come from.

    Two benchmark rows with one item_id count as one item; a null item_id is written as the empty text.
    One row for each document, repeated ones included; a null text has no words. An empty table of
    documents gives no rows, an empty benchmark no hits.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    # Bits are counted by 32-bit piece of the hexadecimal text, for conv() takes 64 bits at most.
    pieces = F.regexp_extract_all(F.hex("__hit"), F.lit("[0-9A-F]{1,8}"), F.lit(0))
    n_hit = F.aggregate(pieces, F.lit(0).cast("bigint"), lambda s, x: s + F.bit_count(F.conv(x, 16, 10).cast("bigint")))
    n_hit = F.coalesce(n_hit, F.lit(0).cast("bigint"))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__items") > 0).alias("contaminated"),
    )


ORACLE = """
WITH norm AS (
  SELECT 'd' AS k, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT k, id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM norm
), lens AS (SELECT DISTINCT least(10, len(ws)) AS m FROM w WHERE k = 'b' AND len(ws) > 0),
grams AS (
  SELECT k, id, len(ws) AS n, m, p, array_to_string(ws[p:p + m - 1], ' ') AS g
  FROM (SELECT k, id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM w, lens
        WHERE len(ws) >= m AND (k = 'd' OR m = least(10, len(ws))))
), hits AS (
  SELECT d.id, d.p, d.m, b.id AS item FROM grams d JOIN (SELECT DISTINCT g, m, id FROM grams WHERE k = 'b') b
  ON d.k = 'd' AND d.g = b.g AND d.m = b.m
), marked AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS list
          FROM hits GROUP BY id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN marked ON marked.id = w.id LEFT JOIN items ON items.id = w.id WHERE w.k = 'd'
"""

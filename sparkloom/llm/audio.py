"""Chroma fingerprints of audio columns, and their alignment by offset histograms and bit errors."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import settle, table
from sparkloom.llm.graph import connected_components
from sparkloom.llm.linking import SHORT_LIST, attach, dealt, each_cell, in_cells, representative_pairs, shared_postings, short_pairs, with_roots, with_sizes

RATE = 8000
FRAME = 256
HOP = 64
#: Frames that one packed integer looks at.
SPAN = 8
#: Recordings align if at an offset they overlap by so many integers, by this share of the shorter one, with
#: at most so large a share of differing bits. Unrelated melodies and texts differ in 0.30 to 0.35 of the bits, and less
#: than one in 10,000 of their offsets in 0.12 or less. The landmarks find over nine in ten pairs up to this bound, by
#: comparison at all offsets; up to 0.06 they would find eight in ten, up to 0.1 about half.
LEAST_OVERLAP = 8
LEAST_SHARE = 0.5
MOST_ERRORS = 0.04
#: A landmark is a run of so many integers. Fewer survive more noise and agree more often by chance.
RUN = 3
#: Integers on either side of a landmark that go with it where long lists are compared, and how many bits may differ there.
AROUND = 256
MOST_ERRORS_AROUND = 0.12
_CLASSES = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pitch_map() -> np.ndarray:
    """Weight of each FFT bin in each pitch class; bins below 100 Hz have none."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hertz), _CLASSES), np.float32)
    audible = hertz >= 100
    pitch = 12 * np.log2(np.maximum(hertz, 1) / 440.0)
    low = np.floor(pitch).astype(int)
    part = (pitch - low).astype(np.float32)
    at = np.flatnonzero(audible)
    np.add.at(out, (at, low[at] % 12), 1 - part[at])
    np.add.at(out, (at, (low[at] + 1) % 12), part[at])
    return out


_PITCH = _pitch_map()
_WINDOW = np.hanning(FRAME).astype(np.float32)
#: (kind, first class, classes, frames) of each filter: differences of two or four areas, spread over classes and widths by rule.
FILTERS = [(i % 4, (5 * i) % 7, 4 + (3 * i) % 5 // 2 * 2 if (5 * i) % 7 + 8 <= 12 else 4, 2 + 2 * (i % 4)) for i in range(16)]
STEP = 0.12


def decode(data: bytes | None) -> np.ndarray:
    """Samples, mean 0: of a mono or stereo PCM WAV file of 8 or 16 bits, else of the bytes as headerless 8-bit PCM."""
    if not data:
        return np.empty(0, np.float32)
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        try:
            with wave.open(io.BytesIO(data)) as w:
                raw, width, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()
            if width in (1, 2):
                kind = np.uint8 if width == 1 else np.dtype("<i2")
                x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], kind).astype(np.float32)
                x = x.reshape(-1, channels).mean(1)
                return x - (x.mean() if len(x) else 0)
        except (wave.Error, EOFError):
            pass
    x = np.frombuffer(data, np.uint8).astype(np.float32)
    return x - x.mean()


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class frames, each of sum 1 (silence: 0)."""
    if len(samples) < FRAME:
        return np.zeros((0, _CLASSES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), _CLASSES), np.float32)
    for i in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[i : i + 4096] * _WINDOW, axis=1)).astype(np.float32)
        out[i : i + 4096] = power @ _PITCH
    return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def packed_integers(frames: np.ndarray) -> np.ndarray:
    """32 bits for each position: two Gray-coded bits of each filter over the integral image."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(frames) + 1, _CLASSES + 1))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        half, mid = w // 2, y + h // 2
        if kind == 0:
            a, b = area(0, w, y, mid), area(0, w, mid, y + h)
        elif kind == 1:
            a, b = area(0, half, y, y + h), area(half, w, y, y + h)
        elif kind == 2:
            a = area(0, half, y, mid) + area(half, w, mid, y + h)
            b = area(half, w, y, mid) + area(0, half, mid, y + h)
        else:
            a, b = 2 * area(0, w, mid - 1, mid + 1), area(0, w, y, mid - 1) + area(0, w, mid + 1, y + h)
        value = np.log((a + 1e-3) / (b + 1e-3))
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def _fingerprints(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                prints = [packed_integers(chroma(decode(x))) for x in part.column(1).to_pylist()]
                cls = np.array([xxhash.xxh3_64_intdigest(p.tobytes()) for p in prints], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cls), pa.array([p.tobytes() for p in prints], pa.binary())], ["id", "cls", "prints"]
                )

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, cls bigint, prints binary")


def _landmarks(nodes: DataFrame) -> DataFrame:
    """(key, node, at): a digest of the RUN integers from each position on, without runs of the same key (silence, hum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                keys, ats, rows = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
                for row, data in enumerate(part.column(1).to_pylist()):
                    p = np.frombuffer(data, np.uint32).astype(np.uint64)
                    key = np.zeros(max(0, len(p) - RUN + 1), np.uint64)
                    for j in range(RUN):
                        key = (key ^ p[j : j + len(key)]) * _ODD
                        key ^= key >> np.uint64(29)
                    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
                    keys.append(key[at].view(np.int64))
                    ats.append(at.astype(np.int32))
                    rows.append(np.full(len(at), row))
                node = part.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), node, pa.array(np.concatenate(ats))], ["key", "node", "at"])

    return nodes.select("cls", "prints").mapInArrow(run, "key bigint, node bigint, at int")


def _bit_errors(pairs: DataFrame) -> DataFrame:
    """Adds ``errors``: the share of differing bits where a and b overlap when b starts ``shift`` integers after a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                errors = []
                for x, y, s in zip(*(part.column(j).to_pylist() for j in (4, 5, 2))):
                    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                    x, y = (x[s:], y) if s >= 0 else (x, y[-s:])
                    n = min(len(x), len(y))
                    errors.append(float(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)) if n else 1.0)
                columns = [*part.columns[:4], pa.array(errors, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shift", "votes", "errors"])

    return pairs.mapInArrow(run, "a bigint, b bigint, shift int, votes bigint, errors double")


def _overlaps_enough(shift: Column, na: Column, nb: Column) -> Column:
    """Whether recordings of na and nb integers overlap enough when the second starts ``shift`` after the first."""
    overlap = F.when(shift >= 0, F.least(na - shift, nb)).otherwise(F.least(na, nb + shift))
    return (overlap >= LEAST_OVERLAP) & (overlap >= LEAST_SHARE * F.least(na, nb))


def _aligned(offsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, shift, votes, errors) of the offsets (a, b, shift, votes) at which two classes do align."""
    left, right = (nodes.select(F.col("cls").alias(c), F.col("prints").alias(p)) for c, p in (("ca", "pa"), ("cb", "pb")))
    both = offsets.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb")).select("a", "b", "shift", "votes", "pa", "pb")
    return _bit_errors(both).where(F.col("errors") <= MOST_ERRORS)


def _cell_links(blk: np.ndarray, node: np.ndarray, root: np.ndarray, at: np.ndarray, n: np.ndarray, first: np.ndarray, prints: list[bytes], both: bool) -> list[tuple]:
    """(a, b, shift, errors, sure) among the members of a cell: enough sure links to connect what aligns, and all unsure ones.

    A member has the integers from ``first`` on; if they hold the whole overlap of two members, their
    errors are known, else only those around their landmark. ``both``: only members of different blocks meet.
    """
    m = len(node)
    have = np.array([len(p) // 4 for p in prints])
    before = at - first
    lead, width = int(before.max()), int((have - before).max())
    bits = np.zeros((m, lead + width), np.uint32)
    lo, hi = lead - before, lead - before + have
    for row, p, a, b in zip(bits, prints, lo, hi):
        row[a:b] = np.frombuffer(p, np.uint32)
    label = root.copy()
    out = []
    for x in range(m - 1):
        y = np.arange(x + 1, m)
        fit = (label[y] != label[x]) & (node[y] != node[x])
        if both:
            fit &= blk[y] != blk[x]
        # Where the overlap begins and ends, counted from the landmark, for whole recordings.
        begin, end = -np.minimum(at[x], at[y]), np.minimum(n[x] - at[x], n[y] - at[y])
        overlap = end - begin
        fit &= (overlap >= LEAST_OVERLAP) & (overlap >= LEAST_SHARE * np.minimum(n[x], n[y]))
        y, begin, end = y[fit], begin[fit], end[fit]
        if not len(y):
            continue
        u, v = np.maximum(lo[x], lo[y]), np.minimum(hi[x], hi[y])
        wrong = np.bitwise_count(bits[y, lo[x] : hi[x]] ^ bits[x, lo[x] : hi[x]])
        inside = np.arange(lo[x], hi[x])
        wrong[(inside < u[:, None]) | (inside >= v[:, None])] = 0
        errors = wrong.sum(1, dtype=np.int64) / (32 * (v - u))
        sure = (u - lead == begin) & (v - lead == end)
        for i in np.flatnonzero(errors <= np.where(sure, MOST_ERRORS, MOST_ERRORS_AROUND)):
            a, b, shift = int(node[x]), int(node[y[i]]), int(at[x] - at[y[i]])
            if sure[i]:
                if label[y[i]] == label[x]:
                    continue
                label[label == label[y[i]]] = label[x]
            out.append((a, b, shift, float(errors[i]), bool(sure[i])) if a < b else (b, a, -shift, float(errors[i]), bool(sure[i])))
    return out


def _long_list_links(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, shift, votes, errors, sure) between members of different components, all lists whole, see ``_cell_links``.

    Members bring the integers around their landmark, so a list of many is compared within a task and
    what doesn't align is never written.
    """
    start = F.greatest(F.col("at") - AROUND, F.lit(0))
    window = F.substring("prints", start * 4 + 1, F.lit(8 * AROUND))
    known = members.join(nodes.select("cls", "prints"), F.col("node") == F.col("cls"))
    cells = in_cells(known.select("key", "node", "root", "at", "n", "size", start.alias("first"), window.alias("prints")))
    cells = cells.select("key", "c1", "c2", "blk", "node", "root", "at", "n", "first", "prints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in each_cell(batches):
            if rows is not None:
                columns = [rows.column(c).to_numpy() for c in ("blk", "node", "root", "at", "n", "first")]
                found += _cell_links(*columns, rows.column("prints").to_pylist(), rows.column("c1")[0] != rows.column("c2")[0])
            elif found:
                a, b, shift, errors, sure = zip(*found)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_())
                values = (a, b, shift, [1] * len(a), errors, sure)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["a", "b", "shift", "votes", "errors", "sure"])
                found = []

    return dealt(cells).mapInArrow(run, "a bigint, b bigint, shift int, votes bigint, errors double, sure boolean")


def align_recordings(df: DataFrame, id_column: str, audio_column: str) -> DataFrame:
    """(id, n_prints, recording, partner, shift, votes, errors): each row's recording, the smallest id that its class reaches.

    Rows of equal fingerprints are one class. Each landmark that two classes share votes for an offset
    between them; every offset with a vote is verified by overlap and bit errors, and what aligns is
    connected. Members of a short list meet pair by pair. Those of a long one meet two
    representatives, and what these have not connected is compared all with all inside tasks, in
    cells of bounded size, so no alignment between classes of different recordings is missed and
    copies of one are never paired. ``partner`` is the smallest id of the
    class with which the best verified alignment was seen, ``shift`` how many integers later the
    partner starts, ``votes`` that offset's height in the histogram; null without.
    Nulls, empty and too short audio have no fingerprint: they are their own recordings, as is a null
    id's row. A null id is larger than any other. Rows that repeat stay repeated.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(audio_column).alias("audio"))
    prints = settle(_fingerprints(rows))
    size = (F.octet_length("prints") / 4).cast("int")
    nodes = prints.where(F.octet_length("prints") > 0).groupBy("cls").agg(F.min("id").alias("least"), F.first("prints").alias("prints"), F.count("*").alias("n_rows"))
    nodes = settle(nodes)
    lengths = nodes.select(F.col("cls").alias("c"), size.alias("n"))
    shared = settle(with_sizes(shared_postings(_landmarks(nodes))).join(lengths, F.col("node") == F.col("c")).drop("c"))

    # Short lists pair by pair; the members of long ones with two representatives. The smaller class is a, and shift is where b starts in a.
    placed, long = shared.withColumn("at", F.struct("at", "n")), shared.where(F.col("size") > SHORT_LIST)
    met = short_pairs(placed).unionByName(representative_pairs(placed.where(F.col("size") > SHORT_LIST)))
    turned = F.col("node") > F.col("rep")
    flip = lambda same, other: F.when(turned, other).otherwise(same)
    met = met.select(
        F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"), flip(F.col("at.at") - F.col("rep_at.at"), F.col("rep_at.at") - F.col("at.at")).alias("shift"),
        flip(F.col("at.n"), F.col("rep_at.n")).alias("na"), flip(F.col("rep_at.n"), F.col("at.n")).alias("nb"),
    )
    fit = met.where(_overlaps_enough(F.col("shift"), F.col("na"), F.col("nb")))
    histogram = fit.groupBy("a", "b", "shift").agg(F.count("*").alias("votes"))
    links = settle(_aligned(histogram, nodes))

    # What the representatives have not connected, all against all of a list.
    members = with_roots(long, connected_components(links.select("a", "b")))
    more = settle(_long_list_links(members, nodes))
    unsure = more.where(~F.col("sure")).groupBy("a", "b", "shift").agg(F.count("*").alias("votes"))
    links = links.unionByName(more.where("sure").drop("sure")).unionByName(settle(_aligned(unsure, nodes)))

    roots = connected_components(links.select("a", "b"))
    rooted = settle(nodes.select("cls", "least", "n_rows").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", "n_rows", F.coalesce("root", "cls").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("recording")).withColumnRenamed("root", "r")
    ends = F.array(
        F.struct(F.col("a").alias("c"), F.col("errors"), F.col("b").alias("other"), F.col("shift"), F.col("votes")),
        F.struct(F.col("b").alias("c"), F.col("errors"), F.col("a").alias("other"), (-F.col("shift")).alias("shift"), F.col("votes")),
    )
    own = links.select(F.explode(ends).alias("x")).groupBy("x.c").agg(F.min(F.struct("x.errors", "x.other", "x.shift", "x.votes")).alias("best"))
    best = own.join(rooted.select(F.col("cls").alias("o"), F.col("least").alias("partner")), F.col("best.other") == F.col("o")).select("c", "partner", "best.shift", "best.votes", "best.errors")
    classes = rooted.join(firsts, F.col("root") == F.col("r")).join(best, F.col("cls") == F.col("c"), "left").select("cls", "n_rows", "recording", "partner", "shift", "votes", "errors")
    sized = prints.select("id", "cls", size.cast("bigint").alias("n_prints"))
    heard = attach(sized.where("n_prints > 0"), "cls", classes, "cls", "n_rows", prints.count())
    null = lambda kind: F.lit(None).cast(kind)
    silent = sized.where("n_prints = 0").select("id", "n_prints", F.col("id").alias("recording"), null(prints.schema["id"].dataType).alias("partner"), null("int").alias("shift"), null("bigint").alias("votes"), null("double").alias("errors"))
    out = ["id", "n_prints", "recording", "partner", "shift", "votes", "errors"]
    return heard.select(*out).unionByName(silent)


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings among all documents, whose bytes stand in for 8-bit audio: the tables have no media column.

    One row for each document, repeated ones included; a null text is an empty recording. An empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("audio"))
    return align_recordings(docs, "doc_id", "audio").withColumnRenamed("id", "doc_id")

"""Bounded labelled samples, and scoring of whole columns of text with models fitted on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import settle

#: So many labelled rows at most are learned from.
SAMPLE_ROWS = 6000
#: So many characters at most are learned from together. Sampled texts that no longer fit are passed over, in the order of
#: the draw; a text is taken whole or not at all, and all are scored whole.
SAMPLE_CHARS = 40_000_000


def _texts(found: DataFrame, columns: list[str], order: list[Column], chars: int) -> list[tuple]:
    """The columns, ``text`` first, of ``found``, a bounded number of rows, in the given order: as many as fit into ``chars``."""
    places = [f"__o{i}" for i in range(len(order))]
    rows = settle(found.select(*[c.alias(p) for c, p in zip(order, places)], *columns))
    fits, total = [], 0
    sizes = rows.select(*places, F.length("text").alias("size")).orderBy(*places).collect()
    for r in sizes:
        fits.append(total + r.size <= chars)
        total += r.size * fits[-1]
    if not all(fits):
        chosen = [tuple(r)[:-1] for r, ok in zip(sizes, fits) if ok]
        known = rows.sparkSession.createDataFrame(chosen, rows.select(*places).schema).toDF(*[f"{p}k" for p in places])
        rows = rows.join(F.broadcast(known), [F.col(p).eqNullSafe(F.col(f"{p}k")) for p in places], "left_semi")
    return [tuple(r)[len(places) :] for r in sorted(rows.collect(), key=lambda r: [(x is not None, x) for x in tuple(r)[: len(places)]])]


def labelled_sample(docs: DataFrame, labels: DataFrame, names: list[str], usable: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple]:
    """(text, *labels) of at most ``rows`` labelled documents, on the driver; ids are drawn by their hash.

    Labels of one doc_id that repeat count once (the largest); rows with a null id, text or label are
    left out. Of the texts of a doc_id that repeats the smallest counts. The drawn labels, at most
    ``rows``, are broadcast, so that the documents aren't shuffled; texts of one id are brought
    together before they travel.
    """
    known = labels.where(usable).groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names]).dropna()
    drawn = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "__id")
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))
    once = found.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(n).alias(n) for n in names])
    return _texts(once, ["text", *names], [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")], chars)


def own_label_sample(docs: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple]:
    """(text, label) of at most ``rows`` documents that carry their label themselves.

    Labels take turns, so that a rare one has its rows in the sample. Rows are drawn by a hash of id
    and text; a row that repeats counts once, null ids draw by their text alone. Only digests are
    dealt and ranked, and each task passes on ``rows`` of a label at most.
    """
    usable_rows = docs.where(usable & F.col(label).isNotNull() & F.col("text").isNotNull())
    digest = F.xxhash64(F.lit(11), "doc_id", "text")
    keys = usable_rows.select(F.col(label).alias("__label"), digest.alias("__digest")).distinct()
    turn = F.row_number().over(Window.partitionBy("__label").orderBy("__digest"))
    drawn = keys.withColumn("__turn", turn).where(F.col("__turn") <= rows).orderBy("__turn", "__digest", "__label").limit(rows)
    found = usable_rows.select("text", label, digest.alias("__d")).join(F.broadcast(drawn), (F.col("__d") == F.col("__digest")) & (F.col(label) == F.col("__label")))
    once = found.groupBy("__turn", "__digest", label).agg(F.min("text").alias("text"))
    return _texts(once, ["text", label], [F.col("__turn"), F.col("__digest"), F.col(label)], chars)


_LATEST: list[object] = []


def only_latest(model: object) -> object:
    """model, the one whose word cache this worker keeps: those of earlier models, which a reused worker still holds, are emptied."""
    if not _LATEST or _LATEST[0] is not model:
        for old in _LATEST:
            old.forget()
        _LATEST[:] = [model] if hasattr(model, "forget") else []
    return model


def score_column(
    df: DataFrame, text_column: str, model: object, score: Callable[[object, list[str]], list[np.ndarray]], fields: str, chunk: int = 256
) -> DataFrame:
    """df with new columns ``fields`` (as in DDL) that ``score(model, texts)`` gives as a list of arrays.

    Their names begin with two underscores, which tables leave to the operators: one that has such a
    column is refused, and all columns of a table come through as they are. Nulls are scored as the empty text. Texts go through in chunks of so many rows, each text whole.
    The model is sent to the executors once.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in fields.split(", ")]
    if clash := [c for c in df.columns if c in names]:
        raise ValueError(f"columns {clash} are the operator's own")
    at = df.columns.index(text_column)
    out = df
    for x in fields.split(", "):
        name, kind = x.split()
        out = out.withColumn(name, F.lit(None).cast(kind))
    schema = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = only_latest(sent.value)
        for whole in batches:
            for i in range(0, whole.num_rows, chunk):
                part = whole.slice(i, chunk)
                found = score(held, [t or "" for t in part.column(at).to_pylist()])
                columns = [*part.columns, *[pa.array(x) for x in found]]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature, of a fixed grid, under which the softmax of held-back logits has the least log loss."""
    if not len(logits):
        return 1.0
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [-np.log(softmax(logits / t)[np.arange(len(classes)), classes] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Standard:
    """Columns brought to mean 0 and deviation 1."""

    def __init__(self, x: np.ndarray):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


class TwoLayers:
    """x -> tanh -> softmax, fitted by Adam on shuffled mini-batches from a fixed seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, hidden: int = 24, epochs: int = 60, l2: float = 1e-4, rate: float = 0.01, batch: int = 64):
        rng = np.random.default_rng(5)
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, classes)), np.zeros(classes)]
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        t, target = 0, np.eye(classes)[y]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                h = np.tanh(x[rows] @ self.w[0] + self.w[1])
                d = (softmax(h @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (d @ self.w[2].T) * (1 - h * h)
                grads = [x[rows].T @ back + l2 * self.w[0], back.sum(0), h.T @ d + l2 * self.w[2], d.sum(0)]
                t += 1
                for a, g, mm, vv in zip(self.w, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

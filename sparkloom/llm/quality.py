"""Quality of documents: random-indexing word vectors, pooled, under a small calibrated network."""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, splitmix, table
from sparkloom.llm.learning import SAMPLE_ROWS, Standard, TwoLayers, labelled_sample, score_column, softmax, temperature

DIMENSIONS = 64
NONZERO = 8
VOCABULARY = 20_000
#: Distinct tokens kept in a worker's cache before it is emptied.
CACHE = 300_000
SHAPES = 250
#: Tokens that are counted at once while learning.
BLOCK = 500_000
_RUNS = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_]+)|(\d+)").sub
_CAPITALS = frozenset(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
_MARKS = frozenset(".,;:!?)")


def shape(token: str) -> str:
    """What kinds of characters follow each other in the token: A a 0 for runs, symbols themselves; six at most.

    Most tokens are a plain or capitalised word, with or without a mark behind it, and need no pattern.
    """
    mark = token[-1] if token[-1] in _MARKS else ""
    word = token[:-1] if mark else token
    if word.isalpha():
        if word[0] not in _CAPITALS:
            return f"<a{mark}>"
        if len(word) > 1 and word[1] not in _CAPITALS:
            return f"<Ta{mark}>"
    return "<" + _RUNS(lambda m: "A" if m[1] and len(m[1]) > 1 else "T" if m[1] else "a" if m[2] else "0", token)[:6] + ">"


class _Ids(dict):
    """token -> id of its word x SHAPES + id of its shape; filled while it is used."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int]):
        self.words, self.shapes = words, shapes

    def __missing__(self, token: str) -> int:
        kind = self.shapes.get(shape(token), 0)
        found = self[token] = self.words.get(token, kind) * SHAPES + kind
        return found


def _index_vector(term: str) -> np.ndarray:
    """A sparse vector of a few +1 and -1, fixed by the term."""
    seed = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))
    out = np.zeros(DIMENSIONS)
    for i in range(NONZERO):
        z = splitmix((seed ^ splitmix(i)) % 2**64)
        out[z % DIMENSIONS] += 1 if z >> 63 else -1
    return out


class PooledVectors:
    """Context vectors of words: sums of the index vectors of their neighbours, over the learning sample.

    Tokens stand between white space. Those outside the vocabulary share the vector of their shape
    (case, digits, symbols). A document has the mean vector of its words, the mean index vector of its
    shapes, the shares of tokens that repeat one of the two before them, and its length. An empty
    text has zeros.
    """

    def __init__(self, texts: list[str], window: int = 2):
        seen: Counter[str] = Counter()
        for t in texts:
            seen.update(t.split())
        kinds: Counter[str] = Counter()
        for w, n in seen.items():
            kinds[shape(w)] += n
        common = [k for k, _ in sorted(kinds.items(), key=lambda x: (-x[1], x[0]))[: SHAPES - 1]]
        self.shapes = {"<other>": 0} | {k: i + 1 for i, k in enumerate(common)}
        base = len(self.shapes)
        words = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 2]
        self.words = {w: base + i for i, w in enumerate(words)}
        self._cache = _Ids(self.words, self.shapes)
        index = np.array([_index_vector(k) for k in [*self.shapes, *words]])
        places = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
        values = np.take_along_axis(index, places, 1)
        context = np.zeros(index.size)
        block: list[np.ndarray] = []

        def add(ids: np.ndarray) -> None:
            for d in range(1, window + 1):
                for mine, other in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                    real = (mine >= 0) & (other >= 0)
                    mine, other = mine[real], other[real]
                    for j in range(NONZERO):
                        context[:] += np.bincount(mine * DIMENSIONS + places[other, j], values[other, j], context.size)

        for t in texts:
            block += [self._ids(t)[0], np.full(window, -1)]
            if sum(map(len, block)) > BLOCK:
                add(np.concatenate(block))
                block = []
        if block:
            add(np.concatenate(block))
        context = context.reshape(index.shape)
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = np.where(norm > 0, context / np.maximum(norm, 1e-9), index / NONZERO**0.5).astype(np.float32)
        self.own = (index[:base] / NONZERO**0.5).astype(np.float32)
        self._cache.clear()

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        if len(self._cache) > CACHE:
            self._cache.clear()
        tokens = text.split()
        both = np.fromiter(map(self._cache.__getitem__, tokens), np.int64, len(tokens))
        return both // SHAPES, both % SHAPES, tokens

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and its number of tokens."""
        out = np.zeros((len(texts), 2 * DIMENSIONS + 3), np.float32)
        lengths = np.zeros(len(texts), np.int64)
        for i, (row, text) in enumerate(zip(out, texts)):
            ids, kinds, tokens = self._ids(text)
            n = lengths[i] = len(ids)
            if not n:
                continue
            for at, of, vectors in ((0, ids, self.vectors), (DIMENSIONS, kinds, self.own)):
                counts = np.bincount(of)
                used = np.flatnonzero(counts)
                row[at : at + DIMENSIONS] = counts[used] @ vectors[used] / n
            row[-3] = sum(map(eq, tokens, islice(tokens, 1, None))) / n
            row[-2] = sum(map(eq, tokens, islice(tokens, 2, None))) / n
            row[-1] = np.log1p(n) / 10
        return out, lengths

    def forget(self) -> None:
        self._cache.clear()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._cache = _Ids(self.words, self.shapes)


class DocumentClassifier:
    """A two-layer network over pooled vectors; every fifth row of the sample is held back to set its temperature."""

    def __init__(self, texts: list[str], classes: list[int], n_classes: int):
        self.n_classes = n_classes
        self.constant = None
        y = np.array(classes, np.int64)
        if len(set(classes)) < 2:
            # Nothing can be told apart: the shares seen, one more of each class.
            counts = np.bincount(y, minlength=n_classes) + 1.0
            self.constant = counts / counts.sum()
            return
        self.pooled = PooledVectors(texts)
        x, _ = self.pooled(texts)
        self.scale = Standard(x)
        x = self.scale(x)
        held = np.arange(len(y)) % 5 == 4
        self.net = TwoLayers(x[~held], y[~held], n_classes)
        self.temperature = temperature(self.net.logits(x[held]), y[held])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the classes for each text, and its number of tokens (what stands between white space)."""
        if self.constant is not None:
            return np.tile(self.constant, (len(texts), 1)), np.array([len(t.split()) for t in texts], np.int64)
        x, lengths = self.pooled(texts)
        return softmax(self.net.logits(self.scale(x)) / self.temperature), lengths

    def forget(self) -> None:
        if self.constant is None:
            self.pooled.forget()


def fit_quality(docs: DataFrame, labels: DataFrame, usable, rows: int = SAMPLE_ROWS) -> DocumentClassifier:
    sample = labelled_sample(docs, labels, ["quality"], usable, rows)
    return DocumentClassifier([t for t, _ in sample], [int(q > 0) for _, q in sample], 2)


def score_quality(df: DataFrame, model: DocumentClassifier, text_column: str = "text") -> DataFrame:
    """df with ``__quality``, the calibrated probability of label 1; nulls are scored as empty."""
    return score_column(df, text_column, model, lambda m, texts: [m(texts)[0][:, 1].astype(np.float64)], "__quality double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows whose crc32(doc_id) mod 5 is not 0.

    One row for each document, repeated ones included. A null text is scored as empty; a null doc_id
    counts as the empty text in the remainder. Of an empty table there is nothing; without labels of
    both kinds every text gets the share of label 1 seen, one more of each kind.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score_quality(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        F.col("__quality").alias("score"),
        (F.col("__quality") >= 0.3).cast("int").alias("predicted"),
    )

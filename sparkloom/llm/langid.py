"""Language of texts: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, table
from sparkloom.llm.learning import SAMPLE_ROWS, own_label_sample, score_column, softmax, temperature

ORDERS = (3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
#: The model learns from each sampled text as a whole and, to know short texts too, from pieces of it of so many bytes.
PIECES = (40, 150)
#: Of the held-back pieces that are accepted, this share at least is right.
ACCEPTED_RIGHT = 0.995
UNKNOWN = "und"
#: Bytes that are hashed at once, except that a text is never cut.
SCAN_BYTES = 500_000

_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def subwords(data: bytes) -> list[np.ndarray]:
    """For each order, the bucket of the bytes from each position on; what is no letter counts as a space."""
    b = _LETTERS[np.frombuffer(data, np.uint8)]
    out = []
    for n in ORDERS:
        size = max(0, len(b) - n + 1)
        h = np.full(size, n, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) ^ b[j : j + size]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append(h >> np.uint32(16))
    return out


class LanguageModel:
    """Fitted on (texts, languages) by stochastic gradient descent; every fifth piece is held back for calibration."""

    def __init__(self, texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5):
        self.langs = sorted(set(langs)) or [UNKNOWN]
        of = {x: i for i, x in enumerate(self.langs)}
        rng = np.random.default_rng(3)
        pieces: list[tuple[np.ndarray, np.ndarray, int]] = []
        for text, lang in zip(texts, langs):
            data = b" " + text.lower().encode("utf-8", "surrogatepass") + b" "
            for size in (*PIECES, len(data)):
                at = int(rng.integers(0, max(1, len(data) - size)))
                ids = np.concatenate(subwords(data[at : at + size]))
                if len(ids):
                    used, n = np.unique(ids, return_counts=True)
                    pieces.append((used, (n / len(ids)).astype(np.float32), of[lang]))
        k = len(self.langs)
        e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        w, b = rng.normal(0, 0.3, (DIMENSIONS, k)).astype(np.float32), np.zeros(k, np.float32)
        train = [i for i in range(len(pieces)) if i % 5 != 4]
        for epoch in range(epochs):
            step = np.float32(rate * (1 - epoch / epochs))
            for i in rng.permutation(train):
                used, share, y = pieces[i]
                v = share @ e[used]
                d = softmax(v @ w + b).astype(np.float32)
                d[y] -= 1
                back = w @ d
                w -= step * np.outer(v, d)
                b -= step * np.float32(0.1) * d
                # A bucket's share in a piece is small, so its embedding takes steps relative to it.
                e[used] -= step * np.outer(share * np.float32(10), back)
        self.scores, self.bias = e @ w, b
        held = pieces[4::5]
        logits = np.array([share @ self.scores[used] + b for used, share, _ in held]).reshape(-1, k)
        y = np.array([p[2] for p in held], np.int64)
        self.temperature = temperature(logits, y)
        p = softmax(logits / self.temperature)
        order = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum((p.argmax(1) == y)[order]) / np.arange(1, len(y) + 1)
        enough = np.flatnonzero(right >= ACCEPTED_RIGHT)
        # Texts below this probability are rejected by callers that want no doubtful language.
        self.doubtful = float(p.max(1)[order[enough[-1]]]) if len(enough) else 1.0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Language, probability and whether it is accepted, of each text; one without letters is ``und`` at 0."""
        raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
        logits = np.tile(self.bias, (len(texts), 1))
        begin = 0
        while begin < len(raw):
            end, size = begin + 1, len(raw[begin])
            while end < len(raw) and size + len(raw[end]) <= SCAN_BYTES:
                size += len(raw[end])
                end += 1
            lengths = np.array([len(r) for r in raw[begin:end]])
            starts = np.cumsum(lengths) - lengths
            total, count = np.zeros((end - begin, len(self.langs)), np.float64), np.zeros(end - begin)
            for n, ids in zip(ORDERS, subwords(b"".join(raw[begin:end]))):
                # What would reach over the end of a text lies between its own end and the next text's start.
                own = np.maximum(lengths - n + 1, 0)
                for c in range(len(self.langs)):
                    sums = np.concatenate(([0.0], np.cumsum(self.scores[:, c][ids], dtype=np.float64)))
                    total[:, c] += sums[starts + own] - sums[starts]
                count += own
            logits[begin:end] += total / np.maximum(count, 1)[:, None]
            begin = end
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        known = np.array([has_letter(t) for t in texts], bool)
        names = np.where(known, np.array(self.langs, object)[best], UNKNOWN)
        score = np.where(known, p.max(1), 0.0).astype(np.float64)
        return [names, score, known & (score >= self.doubtful)]


def fit_language(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> LanguageModel:
    sample = own_label_sample(docs.select("doc_id", "text", "lang"), "lang", usable, rows)
    return LanguageModel([t for t, _ in sample], [x for _, x in sample])


def detect_language(df: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """df with ``__language``, ``__language_score`` and ``__language_accepted``; nulls and texts without a letter are ``und``."""
    return score_column(df, text_column, model, lambda m, texts: m(texts), "__language string, __language_score double, __language_accepted boolean")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 3 is not 1.

    One row for each document, repeated ones included. A null text and one without a letter are
    ``und`` at 0; a null doc_id counts as the empty text in the remainder. Of an empty table there is
    nothing; without any learnable row all are ``und``.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs, crc_mod("doc_id", 3) != 1)
    return detect_language(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        F.col("__language").alias("lang_pred"),
        F.col("__language_score").alias("score"),
        F.col("__language_accepted").alias("accepted"),
    )

"""Mixing to target weights: document rates fitted so that expected tokens by domain come out as wished.

A classifier learned from the label table gives each document a posterior p over domains. With rate x
and t tokens it is expected to bring t * x * p tokens to each domain. Rates start at 1 and minimise
half the weighted squared distance of the domains' shares from the targets, plus ``ridge`` times half
the token-weighted squared distance of the rates from 1, under lower and upper bounds, by accelerated
projected gradient: each round is one distributed sum per domain, and only those few sums reach the
driver. Domains are weighted by the inverse of their share, so that a rare one comes as near to its
target as a common one in the same rounds. A document's rate follows from its posterior and the past
rounds' sums, so rows can be rated without having been stored with their rates.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import settle, shared_folder, table
from sparkloom.llm.learning import SAMPLE_ROWS, labelled_sample, score_column
from sparkloom.llm.quality import DocumentClassifier

# The domains are the kinds of labelled rows, by (quality, toxic).
DOMAINS = {"good": (1, 0), "poor": (0, 0), "good_toxic": (1, 1), "poor_toxic": (0, 1)}
TARGETS = {"good": 0.80, "poor": 0.10, "good_toxic": 0.07, "poor_toxic": 0.03}


@dataclass(frozen=True)
class Mixture:
    """Rows with ``__posterior``, ``__tokens`` and ``__rate``; wished shares, and those at rate 1 and at the fitted rates."""

    rows: DataFrame
    domains: list[str]
    wished: list[float]
    before: list[float]
    after: list[float]
    rounds: int


def fit_domains(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> DocumentClassifier:
    sample = labelled_sample(docs, labels, ["quality", "toxic"], usable, rows)
    kinds = list(DOMAINS.values())
    return DocumentClassifier([t for t, _, _ in sample], [kinds.index((int(q > 0), int(x > 0))) for _, q, x in sample], len(kinds))


def with_posteriors(df: DataFrame, model: DocumentClassifier, text_column: str = "text") -> DataFrame:
    """df with ``__posterior`` ARRAY<DOUBLE> and ``__tokens``, the words between white space; a null text has none."""
    def score(m: DocumentClassifier, texts: list[str]) -> list:
        posteriors, tokens = m(texts)
        return [posteriors.tolist(), tokens]

    return score_column(df, text_column, model, score, "__posterior array<double>, __tokens bigint")


def _moved(posterior: Column, x: Column, y: Column, slope: list[float], ridge: float, step: float, low: float, high: float) -> Column:
    """The rate after a gradient step from y, within its bounds."""
    dot = sum((posterior[i] * float(v) for i, v in enumerate(slope[1:], 1)), posterior[0] * float(slope[0]))
    return F.least(F.greatest(y - step * (dot + ridge * (y - 1.0)), F.lit(float(low))), F.lit(float(high)))


def _rate(posterior: Column, past: list[tuple[list[float], float]], ridge: float, low: float, high: float) -> Column:
    """Rate after the rounds of ``past``: the weighted residual of each domain, and the momentum after it."""
    if not past:
        return F.lit(1.0)
    steps = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in r]).alias("r"), F.lit(float(m)).alias("m")) for r, m in past])
    step = 1 / (1 + ridge)

    def move(s: Column, z: Column) -> Column:
        dot = F.aggregate(F.zip_with(posterior, z["r"], lambda p, r: p * r), F.lit(0.0), lambda a, b: a + b)
        x = F.least(F.greatest(s["y"] - step * (dot + ridge * (s["y"] - 1.0)), F.lit(float(low))), F.lit(float(high)))
        return F.struct(x.alias("x"), (x + z["m"] * (x - s["x"])).alias("y"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")), move)["x"]


def fit_rates(
    rows: DataFrame,
    targets: list[float],
    ridge: float = 0.0,
    low: float = 0.0,
    high: float = 4.0,
    total: float = 1.0,
    rounds: int = 200,
    enough: float = 2e-4,
    weighted: bool = False,
) -> tuple[DataFrame, list[tuple[list[float], float]], list[float], list[float]]:
    """rows with ``__rate``; the past of the rounds (for ``_rate``); shares at rate 1 and at the fitted rates.

    rows has ``__posterior`` and ``__tokens``. The fit ends when no domain is farther than ``enough``
    from its target, or when the bounds or the ridge let it come no nearer: the distance has not
    shrunk by a thousandth in ten rounds. ``rounds`` is a guard. Rates are carried along as columns
    and stored every few rounds. ``weighted`` weighs domains by the inverse of their share.
    """
    k = len(targets)
    wish = total * np.array(targets, float) / sum(targets)
    tokens = rows.agg(F.sum("__tokens")).first()[0] or 0

    def shares(of: DataFrame, rate: str) -> np.ndarray:
        sums = [F.sum(F.col("__tokens") * F.col(rate) * F.col("__posterior")[i]) for i in range(k)]
        return np.array([float(v or 0.0) for v in of.agg(*sums).first()]) / max(1, tokens)

    past: list[tuple[list[float], float]] = []
    state = rows.withColumn("__x", F.lit(1.0)).withColumn("__y", F.lit(1.0))
    if not tokens:
        return state.withColumnRenamed("__x", "__rate").drop("__y"), past, [0.0] * k, [0.0] * k
    first = shares(state, "__y")
    weights = 1 / np.maximum(first, 1e-9) if weighted else np.ones(k)
    t, step, residual = 1.0, 1 / (1 + ridge), first - wish
    best, since = np.inf, 0
    while len(past) < rounds and np.abs(residual).max() > enough:
        loss = float((weights * residual**2).sum())
        # Momentum starts anew when it has carried the rates past the least.
        t = 1.0 if loss > 1.05 * best else t
        since = 0 if loss < 0.999 * best else since + 1
        best = min(best, loss)
        if enough and since >= 10:
            break
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        past.append(((weights * residual).tolist(), (t - 1) / after))
        moved = _moved(F.col("__posterior"), F.col("__x"), F.col("__y"), past[-1][0], ridge, step, low, high)
        state = state.withColumn("__new", moved).withColumn("__y", F.col("__new") + past[-1][1] * (F.col("__new") - F.col("__x")))
        state = state.drop("__x").withColumnRenamed("__new", "__x")
        if len(past) % 5 == 0:
            state = settle(state)
        t = after
        residual = shares(state, "__y") - wish
    return state.withColumnRenamed("__x", "__rate").drop("__y"), past, first.tolist(), shares(state, "__x").tolist()


def mix(
    df: DataFrame,
    model: DocumentClassifier,
    targets: dict[str, float],
    text_column: str = "text",
    keep: list[str] | None = None,
    ridge: float = 0.0,
    low: float = 0.0,
    high: float = 4.0,
    total: float = 1.0,
) -> Mixture:
    """Rates for all rows of df, under which the domains' tokens come to ``total`` times those of df in the wished shares.

    rows has the columns ``keep`` of df (all by default). Texts are scored once: the scored rows are
    written to the shared folder, and the fit reads posteriors and tokens alone. Equal texts get equal
    rates; rows without tokens count for no domain and have a rate all the same. Of an empty table
    there are no rows, and all shares are 0.
    """
    if list(targets) != list(DOMAINS):
        raise ValueError(f"targets must be for {list(DOMAINS)}")
    keep = df.columns if keep is None else keep
    path = f"{shared_folder(df.sparkSession)}/mixed-{uuid.uuid4().hex}"
    with_posteriors(df, model, text_column).select(*keep, "__posterior", "__tokens").write.parquet(path)
    scored = df.sparkSession.read.parquet(path)
    _, past, before, after = fit_rates(scored.select("__posterior", "__tokens"), list(targets.values()), ridge, low, high, total, weighted=True)
    wished = [total * v / sum(targets.values()) for v in targets.values()]
    return Mixture(scored.withColumn("__rate", _rate(F.col("__posterior"), past, ridge, low, high)), list(targets), wished, before, after, len(past))


def copies(rate: Column, key: Column) -> Column:
    """How often a row goes into the mixture: the whole part of its rate, and one more with the rest's probability, decided by its key."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(17), key), 11) / F.lit(float(2**53))
    return (F.floor(rate) + F.when(uniform < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of every document under the target weights of the domains, and how often it is taken.

    With the shares of the document's likeliest domain (of all tokens): before, wished, and expected
    at the fitted rates. One row for each document, repeated ones included; a null text has no tokens.
    Ties of domains go to the later name. Of an empty table there is nothing.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_domains(docs, table(spark, sf_dir, "labels"), F.lit(True))
    mixed = mix(docs, model, TARGETS, keep=["doc_id"])
    facts = zip(mixed.domains, mixed.before, mixed.wished, mixed.after)
    known = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(b).alias("b"), F.lit(w).alias("w"), F.lit(a).alias("a")) for d, b, w, a in facts])
    best = F.array_max(F.zip_with("__posterior", known, lambda p, d: F.struct(p.alias("p"), d.alias("d"))))
    domain = best["d"]
    return mixed.rows.select(
        "doc_id", F.col("__tokens").alias("tokens"), domain["d"].alias("domain"), best["p"].alias("domain_p"), F.col("__rate").alias("rate"),
        copies(F.col("__rate"), F.col("doc_id")).alias("copies"), domain["b"].alias("share_before"), domain["w"].alias("share_wished"), domain["a"].alias("share_reached"),
    )

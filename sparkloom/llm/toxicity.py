"""Toxicity: a learned lexicon, met by Levenshtein automata walking its trie, and scores of the words around."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, table
from sparkloom.llm.learning import SAMPLE_ROWS, Standard, fit_logistic, labelled_sample, score_column

#: Terms of the lexicon at most, and the documents and odds that a term needs.
TERMS = 3000
LEAST_DOCUMENTS = 3
LEAST_ODDS = 2.0
#: Shorter terms have to be met exactly; longer ones may miss, add or change one character.
FUZZY_LENGTH = 5
#: Words on either side of a term that make up its context.
CONTEXT = 10
CACHE = 150_000
_WORDS = re.compile(r"[^\W_]+").findall
_QUOTES = "\"“”«»„‟"
_REPORTED = re.compile(r"(?<![^\W_])(said|says|wrote|quoted?|called|dit|écrit|sagte|schrieb|dijo|escribió)(?![^\W_])", re.I)


class Automaton:
    """All terms at an edit distance of at most 1, as a deterministic automaton that is built while it is used.

    A state is a set of (trie node, edits so far): the product of each term's Levenshtein automaton
    with the trie of the lexicon. Most words leave the automaton within a few characters.
    """

    MOST_MOVES = 200_000

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for term in sorted(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends[node] = term
        self._forget()

    def _forget(self) -> None:
        self.moves: dict[tuple[int, str], int] = {}
        self.states: dict[frozenset[tuple[int, int]], int] = {}
        self.members: list[frozenset[tuple[int, int]]] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        # A term's character may be missing in the word.
        pairs = pairs | {(child, 1) for node, e in pairs if not e for child in self.children[node].values()}
        least: dict[int, int] = {}
        for node, e in pairs:
            least[node] = min(e, least.get(node, 1))
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        onto: set[tuple[int, int]] = set()
        for node, e in self.members[state]:
            below = self.children[node]
            if c in below:
                onto.add((below[c], e))
            if not e:
                onto.add((node, 1))
                onto.update((child, 1) for other, child in below.items() if other != c)
        found = self._state(onto) if onto else -1
        self.moves[state, c] = found
        return found

    def best(self, word: str) -> tuple[str, int] | None:
        """The term nearest to word, the weightiest and then first of equals, with its distance (0 or 1)."""
        if len(self.moves) > self.MOST_MOVES:
            self._forget()
        state, moves = self.start, self.moves
        for c in word:
            onto = moves.get((state, c))
            state = self._move(state, c) if onto is None else onto
            if state < 0:
                return None
        met = [(e, -self.terms[self.ends[node]], self.ends[node]) for node, e in self.members[state] if node in self.ends]
        met = [x for x in met if x[0] == 0 or len(x[2]) >= FUZZY_LENGTH]
        return (min(met)[2], min(met)[0]) if met else None

    def forget(self) -> None:
        self._cache.clear()

    def __getstate__(self) -> dict:
        return {"terms": self.terms}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["terms"])


class _Weights(dict):
    """token -> its weight; filled while it is used."""

    def __init__(self, model: ToxicityModel):
        self.model = model

    def __missing__(self, token: str) -> float:
        found = self[token] = self.model.weigh_token(token)
        return found


class ToxicityModel:
    """Fitted on (texts, labels): which words are terms and how much they weigh, and a logistic regression over a document's hits."""

    def __init__(self, texts: list[str], toxic: list[int]):
        y = np.array(toxic, np.float64)
        self.constant = None
        if len(set(toxic)) < 2:
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return
        # The regression sees each half of the sample through a lexicon that was learned from the other.
        half = np.arange(len(y)) % 2
        x = np.zeros((len(y), 9))
        for h in (0, 1):
            self._learn_terms([t for t, p in zip(texts, half) if p != h], y[half != h])
            x[half == h] = [self.features(t) for t, p in zip(texts, half) if p == h]
        self._learn_terms(texts, y)
        self.scale = Standard(x)
        self.weights = fit_logistic(self.scale(x), y)

    def _learn_terms(self, texts: list[str], y: np.ndarray) -> None:
        docs: Counter[str] = Counter()
        bad: Counter[str] = Counter()
        around: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for text, label in {t: x for t, x in zip(texts, y)}.items():
            words = _WORDS(text.lower())
            docs.update({*words})
            if label:
                bad.update({*words})
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    around[word].add((before, after))
        n_bad = max(1, int(y.sum()))
        n_good = max(1, int(len(y) - y.sum()))
        odds = {}
        for word, n in bad.items():
            # A word of one passage that several documents share counts as often as it has different neighbours.
            seen = min(n, len(around[word]))
            if seen >= LEAST_DOCUMENTS and len(word) > 2:
                value = np.log((seen + 0.5) / n_bad) - np.log((docs[word] - n + 0.5) / n_good)
                # The more documents speak for a word, the more of its odds are believed.
                value *= seen / (seen + 2)
                if value >= LEAST_ODDS:
                    odds[word] = float(value)
        kept = sorted(odds, key=lambda w: (-odds[w] * np.log1p(bad[w]), w))[:TERMS]
        self.lexicon = {w: odds[w] for w in sorted(kept)}
        #: Known words that aren't terms are no misspelled terms.
        self.clean = {w for w, n in docs.items() if w not in self.lexicon and n - bad[w] >= 2}
        self.automaton = Automaton(self.lexicon)
        self._cache = _Weights(self)

    def _weigh(self, word: str) -> tuple[float, float]:
        """Weight of the word, and 1 if it is misspelled."""
        if word in self.clean:
            return 0.0, 0.0
        met = self.automaton.best(word)
        if met is None:
            return 0.0, 0.0
        term, edits = met
        return self.lexicon[term] * (0.7 if edits else 1.0), float(edits)

    def weigh_token(self, token: str) -> float:
        """Of what stands between white space: the weight of its heaviest word, negative if that is misspelled."""
        best, edits = max((self._weigh(w) for w in _WORDS(token)), default=(0.0, 0.0))
        return -best if edits else best

    def hits(self, text: str) -> list[tuple[int, str, float, bool]]:
        """(position among the tokens, token, weight, whether misspelled) of each token that meets the lexicon."""
        if len(self._cache) > CACHE:
            self._cache.clear()
        tokens = text.lower().split()
        weights = np.fromiter(map(self._cache.__getitem__, tokens), np.float64, len(tokens))
        return [(i, tokens[i], abs(weights[i]), weights[i] < 0) for i in np.flatnonzero(weights).tolist()]

    def features(self, text: str) -> np.ndarray:
        """Of a document: own and quoted weight, the heaviest context, share of words, different terms, misspelled ones, length."""
        hits = self.hits(text)
        out = np.zeros(9)
        low = text.lower()
        n = len(low.split()) if hits else text.count(" ") + text.count("\n") + 1
        out[8] = np.log1p(n)
        if not hits:
            return out
        spans = [m.span() for m in re.finditer(r"\S+", low)]
        marks = np.array([m.start() for m in re.finditer(f"[{_QUOTES}]", low)])
        reports = np.array([m.start() for m in _REPORTED.finditer(low)])

        def quoted(start: int, end: int) -> float:
            """1 between two quotation marks that stand close by, a half after a verb of saying."""
            before, after = marks[(marks <= start) & (marks > start - 200)], marks[(marks > start) & (marks < end + 200)]
            if len(before) % 2 and len(after):
                return 1.0
            return 0.5 if len(reports) and ((reports < start) & (reports > start - 60)).any() else 0.0

        place = np.array([h[0] for h in hits])
        weight = np.array([h[2] for h in hits])
        share = np.array([quoted(*spans[h[0]]) for h in hits])
        own = weight * (1 - share)
        sums = np.concatenate(([0], np.cumsum(own)))
        around = sums[np.searchsorted(place, place + CONTEXT, "right")] - sums[np.searchsorted(place, place - CONTEXT)]
        out[0] = np.log1p(own.sum())
        out[1] = np.log1p((weight * share).sum())
        out[2] = np.log1p(around.max())
        out[3] = np.log1p(1000 * own.sum() / n)
        out[4] = np.log1p(len({h[1] for h in hits}))
        out[5] = sum(h[3] for h in hits) / len(hits)
        out[6] = weight.max()
        out[7] = np.log1p(len(hits))
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = self.scale(np.array([self.features(t) for t in texts]).reshape(-1, 9))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._cache = _Weights(self)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Without labelled rows of both kinds, the model gives every text the share of toxic rows."""
    sample = labelled_sample(docs, labels, ["toxic"], usable, rows)
    return ToxicityModel([t for t, _ in sample], [int(x > 0) for _, x in sample])


def score_toxicity(df: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """df with ``__toxicity``, the probability of being toxic; nulls are scored as empty, texts whole."""
    return score_column(df, text_column, model, lambda m, texts: [m(texts)], "__toxicity double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows whose crc32(doc_id) mod 5 is not 0.

    One row for each document, repeated ones included. A null text is scored as empty; a null doc_id
    counts as the empty text in the remainder. Of an empty table there is nothing; without labels of
    both kinds every text gets the share of toxic rows seen, one more of each kind.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score_toxicity(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        F.col("__toxicity").alias("score"),
        (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"),
    )

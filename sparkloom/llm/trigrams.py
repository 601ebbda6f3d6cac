"""Boolean trigram queries of regular expressions, and their evaluation over an index of posting bits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: As many strings are told apart before a run of literals is closed.
MOST_STRINGS = 64
MOST_IN_CLASS = 4
_WORD_BITS = 62


@dataclass(frozen=True)
class AnyOf:
    """A text qualifies if it holds all trigrams of one of the sets; ``None`` as the query means any text qualifies."""

    sets: frozenset[frozenset[str]]


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _close(strings: set[str]) -> AnyOf | None:
    sets = {_grams(s) for s in strings}
    if any(not x for x in sets):
        return None
    return AnyOf(frozenset(x for x in sets if not any(y < x for y in sets)))


def _both(a: AnyOf | None, b: AnyOf | None) -> AnyOf | None:
    if a is None or b is None:
        return a or b
    joined = {x | y for x in a.sets for y in b.sets}
    return AnyOf(frozenset(joined)) if len(joined) <= MOST_STRINGS else a


def _either(queries: list[AnyOf | None]) -> AnyOf | None:
    if any(q is None for q in queries):
        return None
    return AnyOf(frozenset().union(*(q.sets for q in queries)))


def _strings(op, arg) -> set[str] | None:
    """All lower-cased texts that the element matches if they are few, else None."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
        return {""}
    if op is rc.IN:
        found = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                found.add(chr(x).lower())
            elif kind is rc.RANGE and x[1] - x[0] < MOST_IN_CLASS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_IN_CLASS else None
    if op is rc.SUBPATTERN:
        return _all(arg[3])
    if op is rc.BRANCH:
        parts = [_all(x) for x in arg[1]]
        if any(p is None for p in parts):
            return None
        found = set().union(*parts)
        return found if len(found) <= MOST_STRINGS else None
    if op is rc.MAX_REPEAT and arg[1] != rc.MAXREPEAT and arg[1] <= 6:
        once = _all(arg[2])
        if once is None:
            return None
        found = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(once, repeat=n)} if len(once) ** arg[1] <= MOST_STRINGS else None
        return found if found is not None and len(found) <= MOST_STRINGS else None
    return None


def _all(parsed) -> set[str] | None:
    found = {""}
    for op, arg in parsed:
        more = _strings(op, arg)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _query(parsed) -> AnyOf | None:
    run, query = {""}, None
    for op, arg in parsed:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        query, run = _both(query, _close(run)), {""}
        if more is not None:
            run = more
        elif op is rc.SUBPATTERN:
            query = _both(query, _query(arg[3]))
        elif op is rc.BRANCH:
            query = _both(query, _either([_query(x) for x in arg[1]]))
        elif op is rc.MAX_REPEAT and arg[0] >= 1:
            query = _both(query, _query(arg[2]))
    return _both(query, _close(run))


def trigram_query(regex: str) -> AnyOf | None:
    """What lower-cased trigrams a text must hold for the regex to match anywhere in it; None: the regex demands none."""
    return _query(rp.parse(regex))


class TrigramIndex:
    """Posting bits of the trigrams that the rules ask for.

    The index is inverted by column: bit i says, for every row, whether it is in the postings of
    trigram i, so intersecting postings is a bitwise AND, and candidates need no join back to their
    texts. Trigrams that no rule asks for have no postings.
    """

    def __init__(self, rules: dict[str, str]):
        self.queries = {name: trigram_query(regex) for name, regex in rules.items()}
        self.trigrams = sorted({t for q in self.queries.values() if q for s in q.sets for t in s})

    @property
    def words(self) -> list[str]:
        return [f"__postings{i}" for i in range(-(-len(self.trigrams) // _WORD_BITS))]

    def add_to(self, df: DataFrame, text_column: str) -> DataFrame:
        """df with its posting words; a null text is in no postings."""
        low = df.withColumn("__low", F.lower(F.coalesce(F.col(text_column), F.lit(""))))
        bit = lambda i, t: F.when(F.contains("__low", F.lit(t)), F.lit(1 << (i % _WORD_BITS)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        bits = [bit(i, t) for i, t in enumerate(self.trigrams)]
        return low.withColumns(
            {w: reduce(lambda a, b: a.bitwiseOR(b), bits[i * _WORD_BITS : (i + 1) * _WORD_BITS]) for i, w in enumerate(self.words)}
        ).drop("__low")

    def candidate(self, rule: str) -> Column:
        """Whether a row is a candidate of the rule; true for all rows where the rule has no mandatory trigram."""
        query = self.queries[rule]
        if query is None:
            return F.lit(True)
        at = {t: i for i, t in enumerate(self.trigrams)}

        def holds(grams: frozenset[str]) -> Column:
            masks: dict[int, int] = {}
            for t in grams:
                masks[at[t] // _WORD_BITS] = masks.get(at[t] // _WORD_BITS, 0) | 1 << (at[t] % _WORD_BITS)
            tests = [F.col(self.words[w]).bitwiseAND(F.lit(m).cast("bigint")) == m for w, m in sorted(masks.items())]
            return reduce(lambda a, b: a & b, tests)

        return reduce(lambda a, b: a | b, [holds(s) for s in sorted(query.sets, key=sorted)])

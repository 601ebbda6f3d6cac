"""Secrets in texts: candidates by a trigram index, verified by their regular expressions; built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table
from sparkloom.llm.trigrams import TrigramIndex


@dataclass(frozen=True)
class SecretRule:
    """regex: in the syntax that Java and Python share. A match counts if ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# Fixed patterns of the three base kinds, in the order in which kinds are listed.
BASE_RULES = [
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
]
MORE_RULES = [
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]


#: Matches of a text that are placed at once.
BLOCK = 128


def match_spans(text: Column, rule: SecretRule) -> Column:
    """ARRAY<STRUCT<start, end>> in code points of the leftmost non-overlapping matches that count.

    What lies between the matches comes from split(), the matches from regexp_extract_all(): both
    walk the text in the same way, so lengths add up to positions.
    """
    between = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x))
    matched = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), lambda x: F.length(x))
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), lambda x: F.length(x))
    parts = F.arrays_zip(between.alias("gap"), matched.alias("size"), counted.alias("own"))
    span = "array<struct<start:int,end:int>>"
    zero = F.lit(0)
    # An array that grows is copied for each match, so it grows by block: of matches within a block, and of blocks.
    cut = lambda p: F.transform(F.sequence(zero, F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK))
    size = lambda b: F.aggregate(b, zero, lambda n, x: n + x["gap"] + F.coalesce(x["size"], zero))
    begins = lambda blocks: F.aggregate(
        F.transform(blocks, size),
        F.struct(zero.alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc.getField("at") + x.getField("gap")
        end = start + F.coalesce(x.getField("size"), zero)
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        keep = F.coalesce(x.getField("own") >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc.getField("found"), one)).otherwise(acc.getField("found")).alias("found"))

    within = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(span).alias("found")), step, lambda acc: acc.getField("found"))
    # What a lambda binds is computed once, not once for each use.
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return once(parts, lambda p: once(cut(p), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), within))))


def find_secrets(df: DataFrame, text_column: str = "text", rules: list[SecretRule] | None = None) -> DataFrame:
    """df with ``__secrets``: ARRAY<STRUCT<start, ord, kind, end>> of all matches, by start and then by kind as listed.

    A null text counts as empty. Every whole text is looked at: rules with mandatory trigrams verify
    the rows that their Boolean query over the posting bits leaves, the others scan all rows.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    index = TrigramIndex({r.kind: r.regex for r in rules})
    text = F.coalesce(F.col(text_column), F.lit(""))
    out = index.add_to(df, text_column)
    none = F.array().cast("array<struct<start:int,end:int>>")
    for i, r in enumerate(rules):
        verified = index.candidate(r.kind) & text.rlike(_gate(r))
        spans = F.when(verified, match_spans(text, r)).otherwise(none)
        out = out.withColumn(f"__found{i}", _named(spans, i, r.kind))
    found = [f"__found{i}" for i in range(len(rules))]
    return out.withColumn("__secrets", F.array_sort(F.concat(*found))).drop(*found, *index.words)


def _named(spans: Column, ord_: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _gate(rule: SecretRule) -> str:
    """A regex that finds a first match that counts at least wherever there is one."""
    if rule.group == 0 and rule.least > 1 and rule.regex.endswith("]+"):
        fixed = rule.regex[: rule.regex.index("[")]
        return f"{rule.regex[:-1]}{{{rule.least - len(fixed)},}}"
    return rule.regex


def _written(spans: Column) -> Column:
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans.

    One row for each document, repeated ones included; a null text counts as empty. Spans of equal
    start are in the order of the kinds. An empty table gives no rows.
    """
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__secrets", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("__secrets", lambda x: x["ord"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("__secrets")).alias("spans"),
    )


def _kind_sql(ord_: int, rule: SecretRule) -> str:
    """The spans of one rule: what lies before the i-th match, and the match, by the lengths of all pieces."""
    regex = rule.regex.replace("'", "''")
    return f"""SELECT doc_id, row, {ord_} AS ord, '{rule.kind}' AS kind, start, start + sizes[i] AS stop FROM (
      SELECT *, unnest(range(1, len(sizes) + 1)) AS i, unnest(list_transform(range(1, len(sizes) + 1), lambda j: list_sum(gaps[1:j]) + coalesce(list_sum(sizes[1:j - 1]), 0))) AS start FROM (
        SELECT doc_id, row, list_transform(regexp_split_to_array(t, '{regex}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, '{regex}'), lambda x: length(x)) AS sizes,
          list_transform(regexp_extract_all(t, '{regex}', {rule.group}), lambda x: length(x)) AS own FROM d) WHERE len(sizes) > 0) WHERE own[i] >= {rule.least}"""


_SPANS_SQL = " UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(BASE_RULES + MORE_RULES))
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents), s AS ({_SPANS_SQL}),
w AS (SELECT row, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) AS spans,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) FILTER (ord < {len(BASE_RULES)}) AS base,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM s GROUP BY row)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN w ON d.row = w.row
"""

"""Metrics, aggregates, thresholds and decisions; documents are regions, their sources files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import decision, metrics
from sparkloom.functions.numeric import half_up
from sparkloom.operators import aggregates
from sparkloom.plans.registry import Registry, table
from sparkloom.plans.text_queries import CC_SQL, DISTINCT_SQL, LOOSE_SQL, MI_SQL

R = Registry(doubles=True)

KINDS = ["react-component", "hook", "utility-function", "class", "type-block", "constant-block", "context-provider"]
_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][CAST(doc_id % 7 AS INT) + 1]"
_WEIGHT_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {metrics.KIND_WEIGHT.get(k, 1.0)}" for k in KINDS) + " ELSE 1.0 END"
_EFFORT_SQL = "CAST(floor(identifiers * 7.5 * loc) AS DOUBLE)"
#: Regions with all metrics, as a common table expression.
REGIONS_SQL = f"""
l AS (SELECT doc_id, source, text, {_KIND_SQL} AS kind,
  list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ls FROM documents),
b AS (SELECT doc_id, source, kind, len(ls) AS loc, len(list_filter(ls, lambda x: x = '')) AS blank_lines,
  len(list_filter(ls, lambda x: starts_with(x, '//') OR starts_with(x, '*'))) AS comment_lines,
  {DISTINCT_SQL.format('text')} AS identifiers, {CC_SQL.format('text')} AS cc, {LOOSE_SQL.format('text')} AS loose_cc FROM l),
m AS (SELECT *, loc - blank_lines - comment_lines AS code_lines, {MI_SQL.format(u='identifiers', cc='cc', loc='loc')} AS mi, doc_id % 3 AS smells,
  {_EFFORT_SQL} AS effort FROM b),
regions AS (SELECT *, floor(code_lines * {_WEIGHT_SQL} * 10.0 + 0.5) / 10.0 AS bundle,
  CAST(floor(greatest(0, cc - 10) * 5 + greatest(0, 50 - mi) * 2 + greatest(0, loc - 100) * 0.5 + smells * 15 + 0.5) AS BIGINT) AS debt FROM m)
"""


def kind_of(id_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (id_ % 7 + 1).cast("int"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a kind, the number of smells that their id says, their metrics and an effort."""
    from sparkloom.functions.text import IDENTIFIER

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.withColumn("kind", kind_of(F.col("doc_id"))).withColumn("smells", F.col("doc_id") % 3)
    out = aggregates.region_metrics(docs, "text", F.col("kind"), F.col("smells"))
    out = out.withColumn("identifiers", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))))
    return out.withColumn("effort", F.floor(F.col("identifiers") * 7.5 * F.col("loc")).cast("double")).drop("text")


_GRADE_SQL = (
    "CASE WHEN avg_mi > 85 AND avg_cc < 4 THEN 'S' WHEN avg_mi > 70 AND avg_cc < 6 THEN 'A' WHEN avg_mi > 55 AND avg_cc < 9 THEN 'B'"
    " WHEN avg_mi > 40 AND avg_cc < 13 THEN 'C' WHEN avg_mi > 25 AND avg_cc < 18 THEN 'D' ELSE 'F' END"
)


@R.add(f"""
WITH {REGIONS_SQL},
f AS (SELECT source, count(*) AS regions, CAST(sum(loc) AS BIGINT) AS total_lines, CAST(sum(code_lines) AS BIGINT) AS code_lines,
  CAST(sum(blank_lines) AS BIGINT) AS blank_lines, CAST(sum(comment_lines) AS BIGINT) AS comment_lines,
  floor(avg(cc) * 10.0 + 0.5) / 10.0 AS avg_cc, max(cc) AS max_cc, CAST(floor(avg(mi) + 0.5) AS BIGINT) AS avg_mi,
  floor(sum(bundle) * 10.0 + 0.5) / 10.0 AS bundle, CAST(sum(debt) AS BIGINT) AS debt FROM regions GROUP BY source)
SELECT *, {_GRADE_SQL} AS grade FROM f
""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.file_metrics(regions(spark, sf_dir), "source")


@R.add(r"""
WITH w AS (SELECT source, unnest(regexp_extract_all(text, '\b[a-zA-Z_]\w{3,}\b')) AS word FROM documents),
n AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT source, count_if(n > 5) AS frequent FROM n GROUP BY source)
SELECT s.source, CAST(coalesce(frequent, 0) AS BIGINT) AS frequent, floor(least(1.0, coalesce(frequent, 0) / 30.0) * 100.0 + 0.5) / 100.0 AS risk
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN f USING (source)
""")
def duplicate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "text")
    return aggregates.repeated_words(docs, "source", "text", r"(?<![A-Za-z0-9_])[a-zA-Z_][A-Za-z0-9_]{3,}(?![A-Za-z0-9_])")


_OPERATORS, _OPERANDS = r"[-+*/=<>!&|?:;.,%]+|[(){}\[\]]", r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"


@R.add(f"""
WITH t AS (SELECT page_id, regexp_extract_all(html, '{_OPERATORS}') AS o, regexp_extract_all(html, '{_OPERANDS}') AS p FROM pages),
c AS (SELECT page_id, greatest(1, len(list_distinct(o))) :: DOUBLE AS n1, greatest(1, len(list_distinct(p))) :: DOUBLE AS n2,
  greatest(1, len(o)) :: DOUBLE AS t1, greatest(1, len(p)) :: DOUBLE AS t2 FROM t),
v AS (SELECT page_id, (t1 + t2) * log2(n1 + n2) AS volume, n1 / 2.0 * (t2 / n2) AS difficulty FROM c)
SELECT page_id, CAST(floor(volume + 0.5) AS BIGINT) AS volume, CAST(floor(difficulty * volume + 0.5) AS BIGINT) AS effort,
  floor(difficulty * 10.0 + 0.5) / 10.0 AS difficulty, CAST(floor(difficulty * volume / 18.0 + 0.5) AS BIGINT) AS time,
  floor(pow(difficulty * volume, 2.0 / 3.0) / 3000.0 * 100.0 + 0.5) / 100.0 AS bugs FROM v
""")
def halstead_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregates.token_counts(table(spark, sf_dir, "pages"), "page_id", "html", _OPERATORS, _OPERANDS)
    found = metrics.halstead(*[F.col(c) for c in ("n1", "n2", "t1", "t2")])
    return counts.select("page_id", *[c.alias(n) for n, c in found.items()])


@R.add(f"""
WITH {REGIONS_SQL},
x AS (SELECT doc_id, kind, code_lines, least(loc, 12) AS nesting, doc_id % 4 = 0 AS is_async, doc_id % 5 = 0 AS has_jsx, cc FROM regions)
SELECT doc_id, floor(code_lines * {_WEIGHT_SQL} * 10.0 + 0.5) / 10.0 AS bundle,
  greatest(0, least(100, 100 - least(40, cc * 3) - least(20, nesting * 4) - CASE WHEN is_async THEN 10 ELSE 0 END - CASE WHEN has_jsx THEN 5 ELSE 0 END
   + CASE WHEN kind = 'hook' THEN 10 ELSE 0 END + CASE WHEN kind = 'utility-function' AND NOT is_async THEN 15 ELSE 0 END)) AS testability FROM x
""")
def testability(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("doc_id")
    score = metrics.testability(F.col("cc"), F.least("loc", F.lit(12)), id_ % 4 == 0, id_ % 5 == 0, F.col("kind"))
    return regions(spark, sf_dir).select("doc_id", "bundle", score.alias("testability"))


_SEVERITY_SQL = "CASE WHEN loc > 200 OR cc > 20 THEN 'critical' WHEN loc > 100 OR cc > 10 THEN 'high' WHEN loc > 8 THEN 'medium' ELSE 'low' END"


@R.add(f"""
WITH {REGIONS_SQL}, x AS (SELECT source, {_SEVERITY_SQL} AS severity FROM regions)
SELECT source, CAST(count_if(severity = 'critical') AS BIGINT) AS critical, CAST(count_if(severity = 'high') AS BIGINT) AS high, CAST(count_if(severity = 'medium') AS BIGINT) AS medium,
  CAST(count_if(severity = 'low') AS BIGINT) AS low FROM x GROUP BY source
""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc, cc = F.col("loc"), F.col("cc")
    severity = F.when((loc > 200) | (cc > 20), "critical").when((loc > 100) | (cc > 10), "high").when(loc > 8, "medium").otherwise("low")
    names = ["critical", "high", "medium", "low"]
    found = regions(spark, sf_dir).select("source", severity.alias("severity")).groupBy("source").pivot("severity", names).count()
    return found.fillna(0, names)


_THRESHOLD_SQL = (
    "floor(CASE WHEN coalesce(p75, 0) > 0 THEN greatest(0.10, least(0.75, 0.10 + 0.65 * (1.0 / (1.0 + exp(-((3000.0 - p75) / 2500.0)))) + {bias}))"
    " ELSE 0.35 END * 1000.0 + 0.5) / 1000.0"
)
_BAND_SQL = (
    "CASE WHEN coalesce(p75, 0) < 200 THEN 'trivial-file' WHEN p75 < 1000 THEN 'simple-file' WHEN p75 < 4000 THEN 'typical-file'"
    " WHEN p75 < 9000 THEN 'complex-file' ELSE 'highly-complex-file' END"
)


@R.add(f"""
WITH {REGIONS_SQL}, q AS (SELECT source, quantile_cont(CASE WHEN effort > 0 THEN effort END, 0.75) AS p75,
  quantile_cont(CASE WHEN effort > 0 THEN effort END, 0.5) AS median FROM regions GROUP BY source)
SELECT *, {_THRESHOLD_SQL.format(bias='0.1')} AS threshold, {_BAND_SQL} AS band FROM q
""")
def file_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.calibrated_thresholds(regions(spark, sf_dir), "source", "effort", setting=0.45)


_REGION_THRESHOLD_CTE = f"""
q AS (SELECT source, quantile_cont(CASE WHEN effort > 0 THEN effort END, 0.75) AS p75, quantile_cont(CASE WHEN effort > 0 THEN effort END, 0.5) AS median
  FROM regions GROUP BY source),
t AS (SELECT r.*, median, {_THRESHOLD_SQL.format(bias='0')} AS threshold FROM regions r JOIN q USING (source)),
u AS (SELECT *, CASE WHEN effort > 0 AND coalesce(median, 0) > 0 THEN greatest(0.1, least(10.0, effort / median)) ELSE 1.0 END AS ratio FROM t),
v AS (SELECT *, CASE WHEN effort > 0 AND coalesce(median, 0) > 0 THEN floor(greatest(0.10, least(0.75, threshold
  + greatest(-0.18, least(0.18, (1.0 / (1.0 + exp(-((1.0 - ratio) * 1.5))) - 0.5) * 0.36)))) * 1000.0 + 0.5) / 1000.0 ELSE threshold END AS region_threshold FROM u)
"""


@R.add(f"WITH {REGIONS_SQL}, {_REGION_THRESHOLD_CTE} SELECT doc_id, source, effort, median, threshold, region_threshold, floor(ratio * 100.0 + 0.5) / 100.0 AS ratio FROM v")
def region_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.region_thresholds(regions(spark, sf_dir), "source", "effort")
    return found.select(
        "doc_id", "source", "effort", "median", "threshold", "region_threshold", half_up(decision.effort_ratio(F.col("effort"), F.col("median")), 2).alias("ratio")
    )


_SMELL_NAMES = ["God Component", "Prop Drilling", "Magic Numbers"]


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with coupling, cohesion and flags that the id says."""
    id_ = F.col("doc_id")
    found = aggregates.region_thresholds(regions(spark, sf_dir), "source", "effort")
    share = lambda n: (id_ % n).cast("double") / n
    smells = F.slice(F.array(*[F.lit(x) for x in _SMELL_NAMES]), F.lit(1), F.col("smells").cast("int"))
    result = decision.decide(
        F.col("kind"), F.col("loc") * 9, F.col("cc"), F.col("loose_cc") * 5, F.col("mi"), smells, share(11), share(9), share(5), id_ % 13 == 0, id_ % 17 == 0, F.col("region_threshold")
    )
    return found.withColumn("d", result)


_DECIDE_CTE = f"""
i AS (SELECT *, loc * 9 AS len, loose_cc * 5 AS cog, (doc_id % 11) / 11.0 AS ob, (doc_id % 9) / 9.0 AS ib, (doc_id % 5) / 5.0 AS coh,
  doc_id % 13 = 0 AS dead, doc_id % 17 = 0 AS cyc,
  CASE kind WHEN 'context-provider' THEN 0.95 WHEN 'hook' THEN 0.85 WHEN 'class' THEN 0.75 WHEN 'react-component' THEN 0.65
   WHEN 'utility-function' THEN 0.6 WHEN 'constant-block' THEN 0.4 ELSE 0.05 END AS aff,
  CASE smells WHEN 0 THEN 0.0 ELSE 0.15 END AS sm FROM v),
c0 AS (SELECT *, CASE WHEN cc >= 20 THEN 0.25 WHEN cc >= 10 THEN 0.18 WHEN cc >= 6 THEN 0.10 ELSE 0.0 END AS br FROM i),
s AS (SELECT *, CASE WHEN len >= 120 THEN 0.25 WHEN len >= 60 THEN 0.15 ELSE len / 240.0 END
  + CASE WHEN cog >= 25 THEN least(0.25, br + 0.08) WHEN cog >= 15 THEN least(0.25, br + 0.04) ELSE br END
  + aff * 0.2 + sm + CASE WHEN ob >= 0.6 THEN 0.10 WHEN ob >= 0.3 THEN 0.06 ELSE ob * 0.1 / 0.6 END
  - CASE WHEN ib >= 0.6 THEN 0.08 WHEN ib >= 0.3 THEN 0.04 ELSE ib * 0.04 / 0.6 END + coh * 0.05
  + CASE WHEN kind IN ('utility-function', 'hook') THEN 0.05 ELSE 0.0 END - CASE WHEN dead THEN 0.05 ELSE 0.0 END - CASE WHEN cyc THEN 0.08 ELSE 0.0 END AS raw FROM c0),
e AS (SELECT *, CASE WHEN kind = 'type-block' THEN 1 WHEN len < 15 THEN 2 WHEN dead AND len < 30 THEN 3 ELSE 0 END AS rule FROM s),
dec AS (SELECT *, rule = 0 AND raw >= region_threshold AS extract,
  CASE rule WHEN 1 THEN 'definitive' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE CASE WHEN raw >= 0.85 THEN 'definitive' WHEN raw >= 0.7 THEN 'high'
   WHEN raw >= 0.5 THEN 'medium' WHEN raw >= 0.3 THEN 'low' ELSE 'speculative' END END AS sure,
  CASE rule WHEN 1 THEN ['Type blocks are routed to existing types file'] WHEN 2 THEN ['Too small to extract (' || len || ' lines < 15)']
   WHEN 3 THEN ['Dead export — too small to justify a new file'] ELSE list_filter([
    CASE WHEN len >= 120 THEN 'Large region (' || len || ' lines ≥ 120)' WHEN len >= 60 THEN 'Medium region (' || len || ' lines ≥ 60)' END,
    CASE WHEN cc >= 20 THEN 'Critical cyclomatic complexity (CC=' || cc || ')' WHEN cc >= 10 THEN 'High cyclomatic complexity (CC=' || cc || ')' END,
    CASE WHEN cog >= 25 THEN 'Critical cognitive complexity (CogC=' || cog || ')' END,
    CASE WHEN aff >= 0.8 THEN kind || ' inherently benefits from file isolation' END,
    CASE WHEN sm > 0.05 THEN smells || ' code smell(s) detected' END,
    CASE WHEN ob >= 0.6 THEN 'High outbound coupling — depends on many regions' WHEN ob >= 0.3 THEN 'Moderate outbound coupling — several dependencies' END,
    CASE WHEN ib >= 0.6 THEN 'High inbound coupling — stable shared region' END,
    CASE WHEN kind IN ('utility-function', 'hook') THEN 'Extracting improves test isolation' END,
    CASE WHEN cyc THEN 'Part of a circular dependency — extraction needs care' END], lambda x: x IS NOT NULL) END AS why FROM e),
dec2 AS (SELECT *, CASE WHEN rule > 0 THEN why ELSE list_concat(CASE WHEN extract AND len(why) = 0 THEN ['Multiple moderate signals combined to recommend extraction'] ELSE why END,
   CASE WHEN region_threshold <> 0.35 THEN ['Threshold calibrated to ' || CAST(floor(region_threshold * 100.0 + 0.5) AS BIGINT) || '% (Halstead P75 effort)'] ELSE [] END) END AS reasons,
  CASE WHEN extract THEN CAST(floor((100 - mi) * 0.3 * raw + 0.5) AS BIGINT) ELSE 0 END AS mi_delta FROM dec)
"""


@R.add(f"""
WITH {REGIONS_SQL}, {_REGION_THRESHOLD_CTE}, {_DECIDE_CTE}
SELECT doc_id, extract AS should_extract, CASE WHEN rule = 0 THEN floor(raw * 10000.0 + 0.5) / 10000.0 END AS score, sure AS confidence,
  array_to_string(reasons, '; ') AS reasons, CAST(mi_delta AS BIGINT) AS mi_delta,
  CASE kind WHEN 'context-provider' THEN 'providers' WHEN 'hook' THEN 'hooks' WHEN 'class' THEN 'services' WHEN 'react-component' THEN 'components'
   WHEN 'constant-block' THEN 'constants' WHEN 'type-block' THEN 'types' ELSE 'utils' END || '/my-doc' || doc_id || '.ts' AS file FROM dec2
""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("MyDoc"), F.col("doc_id").cast("string"))
    return _decided(spark, sf_dir).select(
        "doc_id", "d.should_extract", half_up(F.col("d.score"), 4).alias("score"), "d.confidence", F.array_join("d.reasons", "; ").alias("reasons"), "d.mi_delta",
        decision.suggested_file(name, F.col("kind"), F.lit("ts")).alias("file"),
    )


@R.add(f"""
WITH {REGIONS_SQL}, {_REGION_THRESHOLD_CTE}, {_DECIDE_CTE},
o AS (SELECT *, doc_id % 6 = 0 AS route, doc_id % 10 = 0 AS store, doc_id % 15 = 0 AS server FROM dec2)
SELECT doc_id, CASE WHEN server THEN false WHEN store THEN true WHEN route THEN false ELSE extract END AS should_extract,
  CASE WHEN server THEN 'medium' WHEN store OR route THEN 'high' ELSE sure END AS confidence,
  CAST(CASE WHEN store THEN greatest(1, mi_delta) ELSE mi_delta END AS BIGINT) AS mi_delta,
  len(reasons) + route :: INT + store :: INT + server :: INT AS n_reasons FROM o
""")
def overridden_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("doc_id")
    found = _decided(spark, sf_dir).select("doc_id", "d")
    found = found.withColumn("d", decision.override(F.col("d"), id_ % 6 == 0, False, "Route export boundary (loader/action/meta)", "high"))
    found = found.withColumn("d", decision.override(F.col("d"), id_ % 10 == 0, True, "Svelte store declared inline", "high"))
    found = found.withColumn("d", decision.override(F.col("d"), id_ % 15 == 0, False, "Next.js server boundary (client features present)", "medium"))
    return found.select("doc_id", "d.should_extract", "d.confidence", "d.mi_delta", F.size("d.reasons").alias("n_reasons"))


@R.add(f"""
WITH {REGIONS_SQL}, {_REGION_THRESHOLD_CTE}, {_DECIDE_CTE},
g AS (SELECT source, count(*) AS total, CAST(count_if(extract) AS BIGINT) AS extracted, CAST(count_if(kind = 'type-block') AS BIGINT) AS types, CAST(sum(debt) AS BIGINT) AS minutes FROM dec2 GROUP BY source)
SELECT source, total, extracted, total - extracted AS retained, types, minutes,
  CASE WHEN total > 10 AND extracted > 5 THEN 'highly-complex' WHEN total > 6 AND extracted > 3 THEN 'complex' WHEN total > 3 AND extracted > 1 THEN 'moderate' ELSE 'simple' END AS band,
  CASE WHEN extracted > 0 THEN 'Extract ' || extracted || ' region(s) to dedicated files.' ELSE 'File is well-structured — no extraction needed.' END AS advice FROM g
""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.col("d.should_extract") & (F.col("kind") != "type-block")
    found = _decided(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(taken).alias("extracted"), F.count_if(F.col("kind") == "type-block").alias("types"), F.sum("debt").alias("minutes")
    )
    n = F.col("extracted")
    advice = F.when(n > 0, F.concat(F.lit("Extract "), n.cast("string"), F.lit(" region(s) to dedicated files."))).otherwise("File is well-structured — no extraction needed.")
    return found.select(
        "source", "total", "extracted", (F.col("total") - n).alias("retained"), "types", "minutes", aggregates.complexity_band(F.col("total"), n).alias("band"), advice.alias("advice")
    )

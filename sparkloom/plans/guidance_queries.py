"""Texts, flags and checks that accompany results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import generate, guidance
from sparkloom.functions.numeric import half_up
from sparkloom.operators import checks, symbols
from sparkloom.plans.registry import Registry, table

R = Registry(doubles=True)

_GRADES = ["S", "A", "B", "C", "D", "F", "X"]
_SEVERITIES = ["critical", "high", "medium", "low", "info", "none"]


def _color_sql(colors: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in colors.items()) + f" ELSE '{guidance.OTHER_COLOR}' END"


@R.add(f"""WITH k AS (SELECT p_partkey, {_GRADES}[p_partkey % 7 + 1] AS g, {_SEVERITIES}[p_partkey % 6 + 1] AS s FROM part)
SELECT p_partkey, {_color_sql(guidance.GRADE_COLOR, 'g')} AS grade_color, {_color_sql(guidance.SEVERITY_COLOR, 's')} AS severity_color FROM k""")
def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", guidance.grade_color(pick(_GRADES)).alias("grade_color"), guidance.severity_color(pick(_SEVERITIES)).alias("severity_color"))


_BANDS = list(guidance.BAND_TEXT)
_PARTS = ["[" + ", ".join(f"'{v[i]}'" for v in guidance.BAND_TEXT.values()) + "][p_partkey % 5 + 1]" for i in range(3)]


@R.add(f"""SELECT p_partkey, 'P75 effort ' || CAST(floor(p_retailprice + 0.5) AS BIGINT) || ': ' || {_PARTS[0]} || ' file, threshold ' || {_PARTS[1]} || ' ' || CAST(p_size AS BIGINT) || '%; ' || {_PARTS[2]}
 || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (with +5% from settings)' ELSE ' (with -5% from settings)' END AS text FROM part""")
def threshold_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    band = F.element_at(F.array(*[F.lit(b) for b in _BANDS]), (k % 5 + 1).cast("int"))
    bias = F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.05).otherwise(-0.05)
    return table(spark, sf_dir, "part").select("p_partkey", guidance.explain_threshold(band, F.col("p_size") / 100.0, F.col("p_retailprice"), bias).alias("text"))


@R.add("""WITH f AS (SELECT p_partkey, p_partkey * 37 % 1048576 AS v FROM part)
SELECT p_partkey, v & (8 + 64 + 2048 + 262144 + 524288) <> 0 AS is_type, v & (1 + 2 + 16 + 32 + 512 + 1024 + 128 + 256) <> 0 AS is_value FROM f""")
def symbol_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = guidance.symbol_namespaces(F.col("p_partkey") * 37 % 1048576)
    return table(spark, sf_dir, "part").select("p_partkey", flags["is_type"].alias("is_type"), flags["is_value"].alias("is_value"))


@R.add(r"""WITH t AS (SELECT page_id, url, html || CASE page_id % 3 WHEN 0 THEN chr(10) || '  "use strict";' WHEN 1 THEN ' ''use strict'';' ELSE '' END
  || CASE page_id % 4 WHEN 0 THEN ' export  class Widget' || page_id || ' {' ELSE '' END AS t FROM pages)
SELECT page_id, page_id % 5 = 0 OR page_id % 3 = 0 AS strict, CASE page_id % 4 WHEN 0 THEN 'Widget' || page_id ELSE 'Component' END AS class_name FROM t""")
def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("page_id")
    tail = F.when(id_ % 3 == 0, F.lit('\n  "use strict";')).when(id_ % 3 == 1, F.lit(" 'use strict';")).otherwise("")
    more = F.when(id_ % 4 == 0, F.concat(F.lit(" export  class Widget"), id_.cast("string"), F.lit(" {"))).otherwise("")
    text = F.concat("html", tail, more)
    return table(spark, sf_dir, "pages").select("page_id", guidance.is_strict(text, F.when(id_ % 5 == 0, True)).alias("strict"), guidance.class_name(text).alias("class_name"))


@R.add("""WITH e AS (SELECT p_partkey, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN '<script>' || chr(10) || 'import { A } from ''./a'';' || chr(10) || '</script>' || chr(10) || chr(10) || '<p/>'
 WHEN 1 THEN '<SCRIPT lang="ts">' || chr(10) || 'import { A } from ''./a'';' || chr(10) || chr(10) || 'let x' || chr(10) || '</SCRIPT>'
 WHEN 2 THEN '<script>' || chr(10) || '  import { A } from ''./a'';' || chr(10) || '</script>'
 ELSE '<script>' || chr(10) || 'import { A } from ''./a'';' || chr(10) || '</script>' || chr(10) || chr(10) || '<script>' || chr(10) || 'open' END AS text FROM e""")
def svelte_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("p_partkey") % 4, guidance.reimport(F.lit("A"), F.lit("./a"))
    rows = lambda *x: F.array(*[F.lit(v) for v in x])
    retained = F.when(k == 0, rows("<p/>")).when(k == 1, rows('<SCRIPT lang="ts">', "let x", "</SCRIPT>"))
    retained = retained.when(k == 2, rows("<script>", "  import { A } from './a';", "</script>")).otherwise(rows("<script>", "open"))
    return table(spark, sf_dir, "part").select("p_partkey", guidance.svelte_updated_source(retained, F.array(line)).alias("text"))


@R.add("""WITH t AS (SELECT 'src/' || url || '/f' || page_id || '.test.ts' AS path FROM pages WHERE page_id % 2 = 0), p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN '/f' ELSE 'g' END || page_id || '.test.ts' AS test_path FROM pages)
SELECT page_id, test_path, EXISTS (SELECT 1 FROM t WHERE ends_with(path, test_path)) AS has_test FROM p""")
def existing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("page_id")
    name = F.concat(id_.cast("string"), F.lit(".test.ts"))
    pages = table(spark, sf_dir, "pages")
    tests = pages.where(id_ % 2 == 0).select(F.concat(F.lit("src/"), "url", F.lit("/f"), name).alias("path"))
    proposed = pages.select("page_id", F.concat(F.when(id_ % 3 == 0, "f").when(id_ % 3 == 1, "/f").otherwise("g"), name).alias("test_path"))
    return checks.with_existing_tests(proposed, tests)


@R.add(r"""WITH r AS (SELECT page_id % 20 AS file, page_id AS region, page_id % 7 = 0 OR regexp_matches(html || CASE page_id % 11 WHEN 0 THEN ' onClick = {f}' ELSE '' END, 'on[A-Z][A-Za-z]+\s*=') AS uses FROM pages)
SELECT file, 'React Server Component uses client features' AS name, 'critical' AS severity, array_to_string(list_sort(list(region)), ',') AS affected FROM r WHERE uses AND file % 2 = 0 AND file % 3 <> 0 GROUP BY file""")
def client_feature_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("page_id")
    text = F.concat("html", F.when(id_ % 11 == 0, " onClick = {f}").otherwise(""))
    regions = table(spark, sf_dir, "pages").select((id_ % 20).alias("file"), id_.alias("region"), text.alias("text"), (id_ % 7 == 0).alias("has_hooks"))
    files = regions.select("file").distinct().select("file", (F.col("file") % 2 == 0).alias("boundary"), (F.col("file") % 3 == 0).alias("use_client"))
    found = checks.client_features(regions, files)
    return found.withColumn("affected", F.array_join(F.col("affected").cast("array<string>"), ","))


@R.add("""SELECT count(*) AS entries, count(DISTINCT user_id) AS files, floor(avg(epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts))) + 0.5) AS mean_age, 0.75 AS hit_rate,
 CAST(30 AS BIGINT) AS hits, CAST(10 AS BIGINT) AS misses, CAST(2 AS BIGINT) AS evictions FROM events""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("last_read"))
    found = checks.store_stats(entries, F.lit("2030-01-01").cast("timestamp"), F.lit(30), F.lit(10), F.lit(2))
    return found.withColumn("mean_age", half_up(F.col("mean_age"), 0))


@R.add("""WITH k AS (SELECT p_partkey AS k, 'Part' || p_partkey AS n, p_partkey % 4 AS s FROM part)
SELECT k AS p_partkey, CASE WHEN k % 7 = 0 THEN 'import { describe, it, expect, vi } from ''vitest'';' || chr(10) ELSE '' END
 || CASE WHEN k % 5 = 0 THEN 'import { render, screen } from ''@testing-library/react'';' || chr(10) ELSE '' END
 || CASE WHEN k % 3 = 0 THEN 'import { renderHook, act } from ''@testing-library/react'';' || chr(10) ELSE '' END
 || 'import ' || CASE WHEN k % 2 = 0 THEN n ELSE '{ ' || n || ' }' END || ' from ''./' || n || ''';' || chr(10) || chr(10) || 'describe(''' || n || ''', () => {' || chr(10)
 || CASE WHEN s < 2 THEN '  it(''works correctly'', () => {' || chr(10) || '    expect(' || n || ').toBeDefined();' || chr(10) || '  });'
   ELSE array_to_string(list_transform(range(1, s), lambda i: '  it(''case ' || i || ''', () => {' || chr(10) || '    // TODO: implement test' || chr(10) || '    expect(true).toBe(true);' || chr(10) || '  });'), chr(10) || chr(10)) END
 || chr(10) || '});' || chr(10) AS text FROM k""")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("Part"), k.cast("string"))
    cases = F.transform(F.sequence(F.lit(1), (k % 4 - 1).cast("int")), lambda i: F.concat(F.lit("case "), i.cast("string")))
    cases = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 > 1, cases)
    kind = F.when(k % 3 == 0, "hook").otherwise("utility-function")
    text = generate.test_file(name, kind, k % 2 == 0, k % 5 == 0, cases, F.when(k % 7 == 0, "vitest").otherwise("jest"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


_GUIDES_SQL = {f: "'" + "' || chr(10) || '".join(line.replace("'", "''").replace("%s", "' || n || '") for line in lines) + "'" for f, lines in (("standalone", guidance.STANDALONE_GUIDE), ("composition", guidance.COMPOSITION_GUIDE))}


@R.add(f"""WITH k AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'Component' WHEN 1 THEN 'Part' || p_partkey || 'Component' ELSE 'ComponentPart' || p_partkey END AS n, list_transform(range(1, p_partkey % 12), lambda i: 'b' || (i * i) % 11) AS l FROM part),
d AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i)[1:6] AS u FROM k)
SELECT k AS p_partkey, {_GUIDES_SQL['standalone']} AS standalone, {_GUIDES_SQL['composition']} AS composition,
 'export function use' || n || '() {{' || chr(10) || '  // Related state and watchers, extracted into a composable.' || chr(10) || CASE WHEN len(u) = 0 THEN '  return {{}};' ELSE '  return {{ ' || array_to_string(u, ', ') || ' }};' END || chr(10) || '}}' AS composable,
 'import {{ Injectable }} from ''@angular/core'';' || chr(10) || chr(10) || '@Injectable({{ providedIn: ''root'' }})' || chr(10) || 'export class '
  || CASE k % 3 WHEN 0 THEN 'Service' WHEN 1 THEN 'Part' || k || 'Service' ELSE n END || ' {{' || chr(10) || '  // Move data loading, orchestration, and transformation logic here.' || chr(10) || '}}' AS service FROM d""")
def migration_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "Component").when(k % 3 == 1, F.concat(F.lit("Part"), k.cast("string"), F.lit("Component"))).otherwise(F.concat(F.lit("ComponentPart"), k.cast("string")))
    bindings = F.transform(F.sequence(F.lit(1), F.greatest(k % 12 - 1, F.lit(1))), lambda i: F.concat(F.lit("b"), (i * i % 11).cast("string")))
    bindings = F.when(k % 12 > 1, bindings).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", guidance.standalone_guide(name).alias("standalone"), guidance.composition_guide(name).alias("composition"),
        guidance.composable_preview(name, bindings).alias("composable"), guidance.service_preview(name).alias("service"),
    )


@R.add("""WITH r AS (SELECT page_id AS i, CASE page_id % 2 WHEN 0 THEN 'main.ts' ELSE 'deep/down/main.ts' END AS source, CASE page_id % 3 WHEN 0 THEN 'hooks/useR' || page_id || '.ts' WHEN 1 THEN 'R' || page_id || '.tsx' ELSE 'deep/R' || page_id || '.js' END AS file_name FROM pages WHERE page_id % 5 <> 0)
SELECT source, file_name, 'import { R' || i || ' } from ''' || CASE i % 3 WHEN 0 THEN '@hooks/useR' || i
 WHEN 1 THEN CASE i % 2 WHEN 0 THEN './R' ELSE '../../R' END || i ELSE CASE i % 2 WHEN 0 THEN './deep/R' ELSE '../R' END || i END || ''';' AS line FROM r""")
def reimport_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    text = i.cast("string")
    file_name = F.when(i % 3 == 0, F.concat(F.lit("hooks/useR"), text, F.lit(".ts"))).when(i % 3 == 1, F.concat(F.lit("R"), text, F.lit(".tsx"))).otherwise(F.concat(F.lit("deep/R"), text, F.lit(".js")))
    source = F.when(i % 2 == 0, "main.ts").otherwise("deep/down/main.ts")
    planned = table(spark, sf_dir, "pages").select(source.alias("source"), file_name.alias("file_name"), F.concat(F.lit("R"), text).alias("name"), (i % 5 == 0).alias("routed"))
    return symbols.reimport_lines(planned, "src", [("@hooks/*", "src/hooks/*")])

"""Symbols of regions, aliases of paths and split regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import generate
from sparkloom.operators import joins, symbols
from sparkloom.plans import standins
from sparkloom.plans.registry import Registry, table
from sparkloom.plans.standins import USAGES_SQL

R = Registry()


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    used = standins.usages(spark, sf_dir)
    bound, decls = standins.bindings(used), standins.decls(spark, sf_dir)
    return used, bound, decls, standins.imports(spark, sf_dir).withColumn("form", F.when(F.col("line") % 8 == 2, "dynamic").otherwise("named"))


@R.add(f"WITH {USAGES_SQL} SELECT CAST(region AS BIGINT) AS region, name FROM decls WHERE region IN (SELECT t FROM resolved WHERE kind = 'type')")
def exported_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, bound, decls, _ = _relations(spark, sf_dir)
    return symbols.exported_symbols(decls, joins.resolve_usages(used.where("kind = 'type'"), bound, decls)).select("region", "name")


@R.add(f"""WITH {USAGES_SQL} SELECT CAST(f AS BIGINT) AS region, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM resolved GROUP BY f""")
def imported_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, bound, decls, _ = _relations(spark, sf_dir)
    return symbols.imported_symbols(used, bound, decls).select("region", F.array_join("symbols", ",").alias("symbols"))


@R.add(f"""WITH {USAGES_SQL}, s AS (SELECT alias, arg_min(specifier, line) AS specifier FROM imports WHERE line % 8 <> 2 GROUP BY alias)
SELECT CAST(region AS BIGINT) AS region, array_to_string(list_sort(list(DISTINCT specifier)), ',') AS packages FROM usages JOIN s ON symbol = alias GROUP BY region""")
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _, _, imports = _relations(spark, sf_dir)
    return symbols.external_packages(used, imports).select("region", F.array_join("packages", ",").alias("packages"))


@R.add(f"""WITH {USAGES_SQL} SELECT CAST(u.region AS BIGINT) AS region, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS types FROM usages u JOIN decls d ON u.symbol = d.name
WHERE d.kind = 'type-block' GROUP BY u.region""")
def inline_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _, decls, _ = _relations(spark, sf_dir)
    return symbols.inline_types(used, decls).select("region", F.array_join("types", ",").alias("types"))


@R.add(f"""WITH {USAGES_SQL}, t AS (SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'both' ELSE 'value' END AS found FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_name, 'type' FROM nation WHERE n_nationkey % 8 = 0)
SELECT d.name, coalesce(CASE WHEN bool_or(t.found = 'type') THEN 'type' WHEN bool_or(t.found = 'both') THEN 'both' WHEN bool_or(t.found = 'value') THEN 'value' END, CASE WHEN d.kind = 'type-block' THEN 'type' ELSE 'value' END) AS namespace
FROM decls d LEFT JOIN t ON d.name = t.name GROUP BY d.name, d.kind""")
def patched_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    base = lambda df, found: df.select(F.lit(0).cast("bigint").alias("file"), F.col("n_name").alias("name"), found.alias("found"))
    types = base(nation.where(n % 4 == 0), F.when(n % 3 == 0, "both").otherwise("value")).unionAll(base(nation.where(n % 8 == 0), F.lit("type")))
    return symbols.patched_namespaces(standins.decls(spark, sf_dir), types).select("name", "namespace")


@R.add(r"""WITH u AS (SELECT p_partkey, p_type || '/' || replace(p_name, ' ', '/') || '.ts' AS p FROM part)
SELECT p_partkey, CASE WHEN p LIKE 'ECONOMY/%' THEN '@eco/' || regexp_replace(p[9:], '\.[jt]sx?$', '') WHEN p LIKE 'SMALL/%' THEN 'small/' || regexp_replace(p[7:], '\.[jt]sx?$', '')
 WHEN p LIKE 'x/%' THEN '' ELSE '../' || regexp_replace(p, '\.[jt]sx?$', '') END AS path FROM u""")
def alias_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat("p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".ts"))
    aliases = [("@eco/*", "src/ECONOMY/*"), ("small", "src/SMALL")]
    return table(spark, sf_dir, "part").select("p_partkey", symbols.import_path(F.lit("x/a.ts"), p, "src", aliases).alias("path"))


@R.add("""WITH r AS (SELECT source, doc_id, len(text) % 40 AS lines FROM documents), p AS (SELECT source, doc_id AS parent, unnest([0, 1]) AS ordinal, lines // 2 AS lines FROM r WHERE doc_id % 2 = 0 AND lines >= 15)
SELECT source AS file, doc_id AS major, CAST(-1 AS BIGINT) AS minor, CAST(lines AS BIGINT) AS lines FROM r WHERE NOT (doc_id % 2 = 0 AND lines >= 15) UNION ALL SELECT source, parent, CAST(ordinal AS BIGINT), CAST(lines AS BIGINT) FROM p""")
def split_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.length("text") % 40
    regions = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("ordinal"), F.lit("r").alias("name"), lines.alias("lines"))
    parts = regions.where("ordinal % 2 = 0").select("file", F.col("ordinal").alias("parent"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"), F.lit("p").alias("name"), F.floor(F.col("lines") / 2).cast("int").alias("lines"))
    return symbols.split_regions(regions, parts).select("file", "major", "minor", "lines")


@R.add("""WITH s AS (SELECT p_partkey, 'import ' || CASE p_partkey % 4 WHEN 0 THEN 'React from ''react''' WHEN 1 THEN '{ a } from ''pkg''' WHEN 2 THEN '{ b } from ''./b''' ELSE 'type { T } from ''./t''' END || ';' AS st FROM part)
SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS BIGINT) AS rank, CASE WHEN p_partkey % 3 = 0 THEN 'export default N;' WHEN p_partkey % 5 = 0 THEN NULL ELSE 'export { N };' END AS export FROM s""")
def import_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tails = F.array(F.lit("React from 'react'"), F.lit("{ a } from 'pkg'"), F.lit("{ b } from './b'"), F.lit("type { T } from './t'"))
    statement = F.concat(F.lit("import "), F.element_at(tails, (k % 4 + 1).cast("int")), F.lit(";"))
    return table(spark, sf_dir, "part").select("p_partkey", generate.import_rank(statement).alias("rank"), generate.export_statement(F.lit("N"), k % 5 == 0, k % 3 == 0).alias("export"))

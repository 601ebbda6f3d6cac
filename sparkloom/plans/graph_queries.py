"""Dependency edges and graph fix-points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.numeric import half_up
from sparkloom.operators import graph, joins
from sparkloom.plans import standins
from sparkloom.plans.registry import Registry, table
from sparkloom.plans.standins import TRADE_SQL, USAGES_SQL

R = Registry(doubles=True)

_REACH_SQL = "reach AS (SELECT f AS a, t AS b FROM edges UNION SELECT r.a, e.t FROM reach r JOIN edges e ON r.b = e.f)"
_DIST_SQL = "walk AS (SELECT f AS a, t AS b, 1 AS d FROM edges UNION SELECT w.a, e.t, w.d + 1 FROM walk w JOIN edges e ON w.b = e.f WHERE w.d < 26), dist AS (SELECT a, b, min(d) AS d FROM walk GROUP BY a, b)"
_SCC_SQL = (
    "mutual AS (SELECT x.a, min(x.b) AS m FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),"
    "labels AS (SELECT n_nationkey AS node, least(n_nationkey, coalesce(m, n_nationkey)) AS scc FROM nation LEFT JOIN mutual ON n_nationkey = a),"
    "scc AS (SELECT node, scc, count(*) OVER (PARTITION BY scc) AS size FROM labels)"
)
_INT = "CAST({0} AS BIGINT) AS {1}"


@R.add(f"WITH RECURSIVE {TRADE_SQL}, {_DIST_SQL} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(d AS BIGINT) AS d FROM dist")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(standins.edges(spark, sf_dir))


@R.add(f"WITH RECURSIVE {TRADE_SQL}, {_REACH_SQL}, {_SCC_SQL} SELECT CAST(node AS BIGINT) AS node, CAST(scc AS BIGINT) AS scc, CAST(size AS BIGINT) AS size FROM scc")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(standins.nodes(spark, sf_dir), standins.edges(spark, sf_dir))


@R.add(f"""WITH RECURSIVE {TRADE_SQL}, {_REACH_SQL}, {_SCC_SQL}
SELECT CAST(f AS BIGINT) AS f, CAST(t AS BIGINT) AS t, f IN (SELECT node FROM scc WHERE size > 1) AND t IN (SELECT node FROM scc WHERE size > 1) AS is_cyclic FROM edges""")
def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = standins.edges(spark, sf_dir)
    return graph.cyclic_edges(edges, graph.strong_components(standins.nodes(spark, sf_dir), edges))


@R.add(f"""WITH RECURSIVE {TRADE_SQL}, dag AS (SELECT f, t FROM edges WHERE f < t),
walk AS (SELECT n_nationkey AS node, 0 AS d FROM nation UNION SELECT e.t, d + 1 FROM walk JOIN dag e ON node = e.f)
SELECT CAST(node AS BIGINT) AS node, CAST(max(d) AS BIGINT) AS level FROM walk GROUP BY node""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_levels(standins.nodes(spark, sf_dir), standins.edges(spark, sf_dir).where("f < t"))


@R.add(f"""WITH RECURSIVE {TRADE_SQL}, {_DIST_SQL.replace('FROM edges', 'FROM edges')},
p AS (SELECT f AS a, t AS b, 1 AS d, [f, t] AS path FROM edges UNION ALL
  SELECT p.a, e.t, p.d + 1, list_append(p.path, e.t) FROM p JOIN edges e ON p.b = e.f JOIN dist s ON s.a = p.a AND s.b = e.t AND s.d = p.d + 1 WHERE e.t <> p.a)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(d AS BIGINT) AS d, array_to_string(min(path), '-') AS path FROM p GROUP BY a, b, d""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_paths(standins.edges(spark, sf_dir))
    return found.select("a", "b", "d", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@R.add(f"""WITH RECURSIVE {TRADE_SQL}, {_DIST_SQL}
SELECT CAST(x.a AS BIGINT) AS a, CAST(x.b AS BIGINT) AS b, CAST(x.d + y.d + 1 AS BIGINT) AS nodes FROM dist x JOIN dist y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.d + y.d > 2""")
def indirect_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.indirect_cycles(graph.shortest_paths(standins.edges(spark, sf_dir)))
    return found.select("a", "b", F.size("path").alias("nodes"))


@R.add(f"""WITH RECURSIVE {TRADE_SQL}, dag AS (SELECT f, t FROM edges WHERE f < t),
walk AS (SELECT n_nationkey AS node, 0 AS d, [n_nationkey] AS path FROM nation UNION ALL SELECT e.t, d + 1, list_append(path, e.t) FROM walk JOIN dag e ON node = e.f),
best AS (SELECT min(path) AS path FROM walk WHERE d = (SELECT max(d) FROM walk))
SELECT CAST(unnest(range(0, len(path))) AS BIGINT) AS position, CAST(unnest(path) AS BIGINT) AS node FROM best""")
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_path(standins.nodes(spark, sf_dir), standins.edges(spark, sf_dir).where("f < t"))


_EDGE_CTE = """
agg AS (SELECT f, t, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols, count(DISTINCT symbol) AS n,
  min(CASE kind WHEN 'inheritance' THEN 0 WHEN 'call' THEN 1 WHEN 'reference' THEN 2 WHEN 'type' THEN 3 WHEN 'reexport' THEN 4 ELSE 5 END) AS rank,
  sum(CASE kind WHEN 'inheritance' THEN 2.0 WHEN 'call' THEN 1.5 WHEN 'reference' THEN 1.0 WHEN 'type' THEN 0.1 WHEN 'reexport' THEN 0.0 ELSE 1.2 END) AS w,
  max(CASE to_kind WHEN 'hook' THEN 1.4 WHEN 'context-provider' THEN 1.3 WHEN 'utility-function' THEN 0.9 WHEN 'type-block' THEN 0.3 ELSE 1.0 END) AS factor,
  bool_and(kind = 'type') AS type_only FROM resolved GROUP BY f, t),
dep AS (SELECT f, t, symbols, ['inheritance', 'call', 'reference', 'type', 'reexport', 'cochange'][rank + 1] AS edge_type,
  floor(least(1.0, CASE WHEN w * 0.2 * factor > 0 THEN w * 0.2 * factor ELSE n * 0.2 * factor END) * 100.0 + 0.5) / 100.0 AS strength, type_only FROM agg)
"""


def _dependencies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    used = standins.usages(spark, sf_dir)
    bound, decls = standins.bindings(used), standins.decls(spark, sf_dir)
    resolved = joins.resolve_usages(used, bound, decls)
    return used, bound, decls, resolved, joins.aggregate_edges(resolved)


@R.add(f"WITH {USAGES_SQL}, {_EDGE_CTE} SELECT CAST(f AS BIGINT) AS f, CAST(t AS BIGINT) AS t, symbols, edge_type, strength, type_only FROM dep")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _dependencies(spark, sf_dir)[-1]
    return edges.select("f", "t", F.array_join("symbols", ",").alias("symbols"), "edge_type", "strength", "type_only")


_EXTERNAL_CTE = """
ext AS (SELECT region, array_to_string(list_sort(list(DISTINCT specifier)), ',') AS packages, sum(wt) AS weight FROM (
  SELECT k.region, i.specifier, [2.0, 1.5, 1.0, 0.1, 0.0, 1.2][k.rank + 1] * 0.2 AS wt FROM (
   SELECT file, region, symbol, min(CASE kind WHEN 'inheritance' THEN 0 WHEN 'call' THEN 1 WHEN 'reference' THEN 2 WHEN 'type' THEN 3 WHEN 'reexport' THEN 4 ELSE 5 END) AS rank
   FROM free WHERE symbol NOT IN (SELECT name FROM decls) GROUP BY ALL) k
  JOIN (SELECT DISTINCT file, alias, specifier FROM imports) i ON k.file = i.file AND k.symbol = i.alias) GROUP BY region)
"""


@R.add(f"WITH {USAGES_SQL}, {_EXTERNAL_CTE} SELECT CAST(region AS BIGINT) AS region, packages, floor(weight * 1000.0 + 0.5) / 1000.0 AS weight FROM ext")
def external_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, bound, decls, _, _ = _dependencies(spark, sf_dir)
    found = joins.external_coupling(used, bound, decls, standins.imports(spark, sf_dir))
    return found.select("region", F.array_join("packages", ",").alias("packages"), half_up(F.col("weight"), 3).alias("weight"))


@R.add(f"""WITH {USAGES_SQL}, {_EDGE_CTE}, {_EXTERNAL_CTE},
o AS (SELECT f, sum(strength) AS o FROM dep GROUP BY f), i AS (SELECT t, sum(strength) AS i FROM dep GROUP BY t)
SELECT CAST(n_nationkey AS BIGINT) AS region, floor((coalesce(o, 0.0) + coalesce(weight, 0.0)) * 1000.0 + 0.5) / 1000.0 AS outbound, floor(coalesce(i, 0.0) * 1000.0 + 0.5) / 1000.0 AS inbound,
  floor((coalesce(o, 0.0) + coalesce(i, 0.0) * 0.5 + coalesce(weight, 0.0)) * 1000.0 + 0.5) / 1000.0 AS total
FROM nation LEFT JOIN o ON f = n_nationkey LEFT JOIN i ON t = n_nationkey LEFT JOIN ext ON region = n_nationkey""")
def coupling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, bound, decls, _, edges = _dependencies(spark, sf_dir)
    external = joins.external_coupling(used, bound, decls, standins.imports(spark, sf_dir))
    regions = standins.nodes(spark, sf_dir).withColumnRenamed("node", "region")
    found = joins.coupling(regions, edges, external)
    return found.select("region", *[half_up(F.col(c), 3).alias(c) for c in ("outbound", "inbound", "total")])


@R.add(f"""WITH {USAGES_SQL}, u AS (SELECT region, count(DISTINCT symbol) AS used FROM usages GROUP BY region), b AS (SELECT region, count(*) AS bound FROM bindings GROUP BY region)
SELECT CAST(region AS BIGINT) AS region, used, coalesce(bound, 0) AS bound, CASE WHEN coalesce(bound, 0) > 0 THEN floor(least(1.0, used / CAST(bound + 1 AS DOUBLE)) * 100.0 + 0.5) / 100.0 ELSE 0.5 END AS cohesion FROM u LEFT JOIN b USING (region)""")
def cohesion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = standins.usages(spark, sf_dir)
    bound = standins.bindings(used).groupBy("region").agg(F.count("*").alias("bound"))
    found = used.groupBy("region").agg(F.countDistinct("symbol").alias("used")).join(bound, "region", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    return found.withColumn("cohesion", joins.cohesion(F.col("used"), F.col("bound")))


@R.add(f"WITH {USAGES_SQL} SELECT CAST(region AS BIGINT) AS region, name FROM decls WHERE exported AND region NOT IN (SELECT t FROM resolved WHERE kind = 'inheritance')")
def dead_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, decls, resolved, _ = _dependencies(spark, sf_dir)
    return joins.dead_exports(decls, resolved.where("kind = 'inheritance'")).select("region", "name")


@R.add(f"WITH {USAGES_SQL} SELECT DISTINCT symbol FROM usages WHERE symbol NOT IN (SELECT name FROM decls)")
def unresolved_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _, decls, _, _ = _dependencies(spark, sf_dir)
    return joins.unresolved_symbols(used, decls, standins.imports(spark, sf_dir)).select("symbol")


_PROPOSED_CTE = "proposed AS (SELECT region, 'dir' || (region % 4) || '/f' || (region % 8) || '.ts' AS target FROM decls WHERE region % 7 <> 3)"


def _proposed(decls: DataFrame) -> DataFrame:
    r = F.col("region")
    return decls.where(r % 7 != 3).select("file", "region", F.concat(F.lit("dir"), (r % 4).cast("string"), F.lit("/f"), (r % 8).cast("string"), F.lit(".ts")).alias("target"))


_LINK_CTE = """
links AS (SELECT p.target AS a, q.target AS b, array_to_string(list_sort(list(DISTINCT r.symbol)), ',') AS symbols, count(DISTINCT r.symbol) AS weight
  FROM (SELECT DISTINCT f, t, symbol FROM resolved) r JOIN proposed p ON r.f = p.region JOIN proposed q ON r.t = q.region WHERE p.target <> q.target GROUP BY p.target, q.target),
linked AS (SELECT x.*, y.a IS NOT NULL AS circular FROM links x LEFT JOIN links y ON x.a = y.b AND x.b = y.a)
"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, decls, resolved, _ = _dependencies(spark, sf_dir)
    imported = resolved.select("file", F.col("f").alias("region"), "symbol").distinct()
    return joins.linkage(imported, decls, _proposed(decls))


@R.add(f"WITH {USAGES_SQL}, {_PROPOSED_CTE}, {_LINK_CTE} SELECT a, b, symbols, weight, circular FROM linked")
def file_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("a", "b", F.array_join("symbols", ",").alias("symbols"), "weight", "circular")


@R.add(f"WITH {USAGES_SQL}, {_PROPOSED_CTE}, {_LINK_CTE} SELECT DISTINCT unnest([a, b]) AS target FROM linked WHERE circular")
def circular_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("circular").select(F.explode(F.array("a", "b")).alias("target")).distinct()


@R.add(f"""WITH {USAGES_SQL} SELECT CAST(region AS BIGINT) AS region, specifier, CAST(i.line AS BIGINT) AS line, NOT is_side_effect AND i.line < d.ordinal * 2 + 1 AS before
FROM decls d JOIN imports i ON d.file = i.file AND abs(i.line - (d.ordinal * 2 + 1)) <= 3 WHERE is_side_effect OR i.line < d.ordinal * 2 + 1""")
def adjacent_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-effect imports within three lines of a region, and other (dynamic) ones within three lines before it."""
    decls = standins.decls(spark, sf_dir).select("file", "region", (F.col("ordinal") * 2 + 1).alias("start"))
    found = joins.band_join(decls, standins.imports(spark, sf_dir), ["file"], "start", "line", 3)
    earlier = F.col("line") < F.col("start")
    found = found.where(F.col("is_side_effect") | earlier)
    return found.select("region", "specifier", "line", (~F.col("is_side_effect") & earlier).alias("before"))


@R.add("""SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln FROM documents)
WHERE NOT (ln BETWEEN doc_id % 5 + 1 AND doc_id % 5 + 2) AND NOT (doc_id % 3 = 0 AND ln BETWEEN 4 AND 70) GROUP BY doc_id""")
def retained_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("ln"))
    first = docs.select("doc_id", (F.col("doc_id") % 5 + 1).alias("a"), (F.col("doc_id") % 5 + 2).alias("z"))
    more = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(4).cast("bigint").alias("a"), F.lit(70).cast("bigint").alias("z"))
    kept = joins.outside_ranges(lines, first.unionAll(more), "doc_id", "ln", "a", "z")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"))


@R.add(f"""WITH {USAGES_SQL}, {_PROPOSED_CTE}, need AS (SELECT DISTINCT region, symbol FROM free),
types AS (SELECT n_name AS symbol FROM nation WHERE n_nationkey % 6 = 5 AND n_nationkey % 4 = 1),
imp AS (SELECT alias, arg_min(specifier, line) AS specifier FROM imports GROUP BY alias)
SELECT CAST(n.region AS BIGINT) AS region, n.symbol,
  CASE WHEN d.region IS NOT NULL THEN CASE WHEN p.target IS NOT NULL THEN 'region' END WHEN t.symbol IS NOT NULL THEN 'type' WHEN i.specifier IS NOT NULL THEN 'import' END AS route,
  CASE WHEN d.region IS NOT NULL THEN p.target WHEN t.symbol IS NOT NULL THEN './types.ts' ELSE i.specifier END AS target
FROM need n LEFT JOIN decls d ON n.symbol = d.name AND n.region <> d.region LEFT JOIN proposed p ON d.region = p.region
LEFT JOIN types t ON n.symbol = t.symbol LEFT JOIN imp i ON n.symbol = i.alias""")
def symbol_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, bound, decls, _, _ = _dependencies(spark, sf_dir)
    needed = joins.unbound(used, bound).select("file", "region", "symbol").distinct()
    n = F.col("n_nationkey")
    types = table(spark, sf_dir, "nation").where((n % 6 == 5) & (n % 4 == 1)).select(F.lit(0).cast("bigint").alias("file"), F.col("n_name").alias("symbol"), F.lit("./types.ts").alias("target"))
    return joins.route_symbols(needed, decls, _proposed(decls), types, standins.imports(spark, sf_dir)).select("region", "symbol", "route", "target")


_PREFERRED = ["types.ts", "types.tsx", "interfaces.ts", "global.d.ts", "index.d.ts", "types/index.ts"]


@R.add("""WITH c AS (SELECT r_regionkey AS file, n_nationkey AS ordinal, CASE WHEN n_nationkey % 5 = r_regionkey THEN 'src/' ELSE 'lib/' END
   || n_name || ['/types.ts', '/other.ts', '/interfaces.ts'][n_nationkey % 3 + 1] AS path FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 4),
k AS (SELECT *, CASE WHEN NOT (path LIKE '%types.ts' OR path LIKE '%interfaces.ts') THEN 2 WHEN path LIKE 'src/%' THEN 0 ELSE 1 END AS tier FROM c)
SELECT CAST(r_regionkey AS BIGINT) AS file, coalesce(arg_min(path, tier * 1000 + ordinal), './types.ts') AS target, count(path) = 0 AS is_new
FROM region LEFT JOIN k ON file = r_regionkey GROUP BY r_regionkey""")
def type_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    nation = table(spark, sf_dir, "nation").where("n_regionkey <> 4")
    joined = table(spark, sf_dir, "region").join(nation, F.col("n_regionkey") == r, "left")
    ends = F.element_at(F.array(F.lit("/types.ts"), F.lit("/other.ts"), F.lit("/interfaces.ts")), n % 3 + 1)
    path = F.concat(F.when(n % 5 == r, F.lit("src/")).otherwise(F.lit("lib/")), F.col("n_name"), ends)
    return joins.type_target(joined.select(r.alias("file"), path.alias("path"), n.alias("ordinal")), F.lit("src/"), _PREFERRED)


_HISTORY = "h AS (SELECT DISTINCT event_type || '/' || (event_id % 20) AS region, user_id AS commit FROM events)"
_COCHANGE_CTE = f"""{_HISTORY}, sz AS (SELECT region, count(*) AS n FROM h GROUP BY region),
pairs AS (SELECT x.region AS a, y.region AS b, count(*) AS shared FROM h x JOIN h y ON x.commit = y.commit AND x.region < y.region GROUP BY ALL),
co AS (SELECT a, b, shared, shared / CAST(s.n + z.n - shared AS DOUBLE) AS coupling FROM pairs JOIN sz s ON s.region = a JOIN sz z ON z.region = b)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.concat("event_type", F.lit("/"), (F.col("event_id") % 20).cast("string"))
    return table(spark, sf_dir, "events").select(region.alias("region"), F.col("user_id").alias("commit"))


@R.add(f"WITH {_COCHANGE_CTE} SELECT a, b, shared, floor(coupling * 10000.0 + 0.5) / 10000.0 AS coupling FROM co WHERE coupling >= 0.35")
def cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.cochange_pairs(_history(spark, sf_dir), 0.35).withColumn("coupling", half_up(F.col("coupling"), 4))


@R.add(f"""WITH {_COCHANGE_CTE}, bo AS (SELECT a, b, coupling AS c FROM co WHERE coupling >= 0.40 UNION ALL SELECT b, a, coupling FROM co WHERE coupling >= 0.40),
e AS (SELECT DISTINCT event_type || '/' || (event_id % 20) AS f, event_type || '/' || (event_id * 7 % 20) AS t FROM events), g AS (SELECT f, t, 0.7 AS strength FROM e WHERE f <> t)
SELECT coalesce(f, a) AS f, coalesce(t, b) AS t, CASE WHEN f IS NULL THEN 'cochange' ELSE 'call' END AS edge_type,
  floor(CASE WHEN f IS NULL THEN c WHEN c IS NULL THEN strength ELSE least(1.0, strength + c * 0.5) END * 10000.0 + 0.5) / 10000.0 AS strength, floor(c * 10000.0 + 0.5) / 10000.0 AS cochange
FROM g FULL OUTER JOIN bo ON f = a AND t = b""")
def cochange_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda n: F.concat("event_type", F.lit("/"), (n % 20).cast("string"))
    edges = table(spark, sf_dir, "events").select(name(F.col("event_id")).alias("f"), name(F.col("event_id") * 7).alias("t")).distinct().where("f <> t")
    edges = edges.select("f", "t", F.lit("call").alias("edge_type"), F.lit(0.7).alias("strength"))
    found = joins.upsert_cochange(edges, joins.cochange_pairs(_history(spark, sf_dir), 0.40).select("a", "b", "coupling"))
    return found.select("f", "t", "edge_type", half_up(F.col("strength"), 4).alias("strength"), half_up(F.col("cochange"), 4).alias("cochange"))


@R.add(f"""WITH {USAGES_SQL} SELECT f, t, CASE f % 2 WHEN 0 THEN bool_and(to_kind IN ('type-block', 'enum')) ELSE bool_and(kind = 'type') END AS type_only FROM resolved GROUP BY f, t""")
def type_only_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of types only, by the kinds of usages or, where none is known, by what they use."""
    used = standins.usages(spark, sf_dir)
    unknown = used.withColumn("kind", F.when(F.col("region") % 2 == 1, F.col("kind")))
    found = joins.aggregate_edges(joins.resolve_usages(unknown, standins.bindings(used), standins.decls(spark, sf_dir)))
    return found.select("f", "t", "type_only")

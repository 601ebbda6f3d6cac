"""Relations of regions, usages and imports, read out of the driver's tables; each with the same in SQL.

Nations are regions (of a region's file) and part of the trade between nations is usage: the customer's
nation uses the supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.joins import ranked
from sparkloom.plans.registry import table

KIND_NAMES = ["hook", "context-provider", "utility-function", "type-block", "class"]
USAGE_NAMES = ["call", "type", "reexport", "inheritance", "reference"]

TRADE_SQL = """
trade AS (SELECT c_nationkey AS f, s_nationkey AS t, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edges AS (SELECT f, t FROM (SELECT f, t, row_number() OVER (PARTITION BY f ORDER BY q DESC, t) AS rn FROM trade) WHERE rn <= 2)
"""
USAGES_SQL = """
usages AS (SELECT DISTINCT CAST(0 AS BIGINT) AS file, c_nationkey AS region, 'NATION_' || s_nationkey AS symbol,
   ['call', 'type', 'reexport', 'inheritance', 'reference'][l_linenumber % 5 + 1] AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
bindings AS (SELECT DISTINCT file, region, symbol FROM usages WHERE (region * 7 + CAST(substr(symbol, 8) AS INT)) % 11 = 0),
decls AS (SELECT CAST(0 AS BIGINT) AS file, n_nationkey AS region, n_name AS name,
  ['hook', 'context-provider', 'utility-function', 'type-block', 'class'][n_nationkey % 5 + 1] AS kind, n_nationkey AS ordinal, n_nationkey % 3 = 0 AS exported
  FROM nation WHERE n_nationkey % 6 <> 5),
imports AS (SELECT DISTINCT CAST(0 AS BIGINT) AS file, 'pkg' || (n_nationkey % 4) AS specifier, n_name AS alias, n_nationkey * 2 AS line, n_nationkey % 2 = 0 AS is_side_effect FROM nation WHERE n_nationkey % 6 = 5 OR n_nationkey % 4 = 1),
free AS (SELECT u.* FROM usages u ANTI JOIN bindings b ON u.file = b.file AND u.region = b.region AND u.symbol = b.symbol),
resolved AS (SELECT u.file, u.region AS f, d.region AS t, u.symbol, u.kind, d.kind AS to_kind FROM free u JOIN decls d ON u.file = d.file AND u.symbol = d.name WHERE u.region <> d.region)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, t): the two nations that each nation buys most from."""
    trade = _lines(spark, sf_dir).where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("f"), F.col("s_nationkey").alias("t")).agg(F.sum("l_quantity").alias("q"))
    return ranked(trade, ["f"], [F.desc("q"), F.asc("t")], 2).select("f", "t")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in USAGE_NAMES]), F.col("l_linenumber") % 5 + 1)
    found = _lines(spark, sf_dir)
    return found.select(
        F.lit(0).cast("bigint").alias("file"), F.col("c_nationkey").alias("region"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("symbol"), kind.alias("kind")
    ).distinct()


def bindings(used: DataFrame) -> DataFrame:
    return used.where((F.col("region") * 7 + F.substring("symbol", 8, 9).cast("int")) % 11 == 0).select("file", "region", "symbol").distinct()


def decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in KIND_NAMES]), n % 5 + 1)
    found = table(spark, sf_dir, "nation").where(n % 6 != 5)
    return found.select(F.lit(0).cast("bigint").alias("file"), n.alias("region"), F.col("n_name").alias("name"), kind.alias("kind"), n.alias("ordinal"), (n % 3 == 0).alias("exported"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    found = table(spark, sf_dir, "nation").where((n % 6 == 5) | (n % 4 == 1))
    return found.select(
        F.lit(0).cast("bigint").alias("file"), F.concat(F.lit("pkg"), (n % 4).cast("string")).alias("specifier"), F.col("n_name").alias("alias"), (n * 2).alias("line"), (n % 2 == 0).alias("is_side_effect")
    )

"""Files near a file, their roles, project files and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.numeric import half_up
from sparkloom.operators import joins
from sparkloom.plans.registry import Registry, table
from sparkloom.sources import projects

R = Registry(doubles=True)


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _choose(key: Column, *values) -> Column:
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (key % len(values) + 1).cast("int"))


_NEAR_SQL = """f AS (SELECT 'w/a' || page_id % 4 || '/b' || page_id % 3 || ['/c0', '/c1/d', '', '/dist'][page_id % 4 + 1] || '/f' || page_id || ['.ts', '.jsx', '.md', '.tsx', '.mjs'][page_id % 5 + 1] AS path FROM pages),
s AS (SELECT 'w/a' || n_nationkey % 4 || '/b' || n_nationkey % 3 || CASE n_nationkey % 2 WHEN 0 THEN '' ELSE '/c1' END || '/s' || n_nationkey || '.ts' AS source,
 CASE n_nationkey % 2 WHEN 0 THEN 'w' ELSE 'w/a' || n_nationkey % 4 END AS top FROM nation)"""


def _near_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = _cat("w/a", k % 4, "/b", k % 3, _choose(k, "/c0", "/c1/d", "", "/dist"), "/f", k, _choose(k, ".ts", ".jsx", ".md", ".tsx", ".mjs"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@R.add(f"WITH {_NEAR_SQL} SELECT source, path FROM s JOIN f ON starts_with(path, top || '/') WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AND path NOT LIKE '%/dist/%'")
def near_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    sources = table(spark, sf_dir, "nation").select(_cat("w/a", n % 4, "/b", n % 3, F.when(n % 2 == 0, "").otherwise("/c1"), "/s", n, ".ts").alias("path"))
    return projects.near_files(_near_paths(spark, sf_dir), sources)


@R.add("""SELECT 'p' || page_id || unnest(['/types.ts', '/useIt.tsx', '/utils/deep/x.ts', '/index.ts', '/it.spec.ts', '/utils/index.ts', '/utils/index.ts', '/use.test.tsx', '/use.test.tsx', '/global.d.ts']) AS path,
 unnest(['types', 'hooks', 'utils', 'index', 'tests', 'utils', 'index', 'hooks', 'tests', 'types']) AS role FROM pages""")
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["types.ts", "useIt.tsx", "utils/deep/x.ts", "index.ts", "it.spec.ts", "utils/index.ts", "use.test.tsx", "global.d.ts", "plain.ts", "index.tsx", "types.tsx", "myuse.ts"]
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("n"))
    return projects.file_roles(pages.select(_cat("p", F.col("page_id"), "/", F.col("n")).alias("path")))


@R.add("""SELECT CAST(c_custkey AS VARCHAR) AS root, ['vitest', 'jest', 'jest', 'unknown', 'unknown'][c_custkey % 5 + 1] AS test_framework, ['npm', 'yarn', 'pnpm', 'unknown'][c_custkey % 4 + 1] AS package_manager,
 c_custkey % 3 = 1 AS is_monorepo FROM customer""")
def workspace_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workspace for each customer."""
    k = F.col("c_custkey")
    package = _choose(k, '{"dependencies": {"jest": "1"}, "devDependencies": {"vitest": "2"}}', '{"devDependencies": {"jest": "29"}}', '{"dependencies": {"ts-jest": "^29"}}', '{"dependencies": {"vitest": ""}}', "{ not JSON")
    lock = _choose(k, "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "deep/yarn.lock")
    more = _choose(k, "deep/nx.json", "lerna.json", "README.md")
    rows = F.array(*[F.struct(p.alias("path"), t.alias("text")) for p, t in ((F.lit("package.json"), package), (lock, F.lit("")), (more, F.lit("{}")), (F.lit("package-lock.json"), F.when(k % 4 == 1, "")))])
    files = table(spark, sf_dir, "customer").select(k.cast("string").alias("root"), F.explode(rows).alias("r")).select("root", "r.*")
    return projects.workspace_facts(files.where("text is not null"))


_CONFIGS = [
    ("w/tsconfig.json", '{ // all\n "compilerOptions": {"strict": true, "baseUrl": ".", "paths": {"@w/*": ["*"],},}, }'),
    ("w/a1/tsconfig.json", '{"extends": "../tsconfig", "compilerOptions": {"baseUrl": "./b0/../b1", "paths": {"@b": ["c1"], "@all/*": ["../*"]}}}'),
    ("w/a2/tsconfig.json", '{"extends": "./mid.json", "compilerOptions": {"strict": false}}'),
    ("w/a2/mid.json", '{"extends": "../tsconfig.json", "compilerOptions": {"paths": {"#/*": ["./a2/b2/*", "a2/*"]}}}'),
    ("w/a3/tsconfig.json", "{ broken"),
]


@R.add(r"""WITH f AS (SELECT page_id, page_id % 4 AS a, page_id % 3 AS b, ['/c0', '/c1/d', '', '/dist'][page_id % 4 + 1] || '/f' || page_id || ['.ts', '.jsx', '.md', '.tsx', '.mjs'][page_id % 5 + 1] AS tail FROM pages),
g AS (SELECT *, regexp_replace(tail, '\.[jt]sx?$', '') AS bare FROM f)
SELECT page_id, CASE a WHEN 0 THEN 'w' ELSE 'w/a' || a END || '/tsconfig.json' AS config, CASE a WHEN 1 THEN 'w/a1/b1' WHEN 3 THEN 'w/a3' ELSE 'w' END AS base_url, a IN (0, 1) AS strict,
 CASE a WHEN 0 THEN '@w/a0/b' || b || bare WHEN 1 THEN CASE b WHEN 1 THEN '@b' || replace(bare, '/c1', '') ELSE '@all/b' || b || bare END
  WHEN 2 THEN CASE b WHEN 2 THEN '#' || bare ELSE '#/b' || b || bare END ELSE 'none' END AS alias FROM g""")
def project_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's file under the closest project file, and its path by that one's aliases."""
    configs = projects.read_configs(spark.createDataFrame(_CONFIGS, "path string, text string"))
    found = projects.nearest_configs(_near_paths(spark, sf_dir), configs)
    alias = projects.aliased(F.col("path"), F.col("base_url"), F.col("paths"))
    return found.select("page_id", "config", "base_url", F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce(alias, F.lit("none")).alias("alias"))


_HISTORY_SQL = "h AS (SELECT DISTINCT s_nationkey AS region, lpad(format('{:x}', s_suppkey % 17), 40, '0') AS sha FROM supplier WHERE s_suppkey % 5 <> 0)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits out of a log for each nation, told by its suppliers; every fifth line is one of a diff."""
    k = F.col("s_suppkey")
    line = F.when(k % 5 == 0, _cat("@@ -", k, " +1 @@")).otherwise(F.lpad(F.lower(F.hex(k % 17)), 40, "0"))
    logs = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("region")).agg(F.concat(F.lit("\n "), F.array_join(F.collect_list(line), " \n\n")).alias("output"))
    return projects.region_commits(logs)


@R.add(f"WITH {_HISTORY_SQL} SELECT region, sha AS commit FROM h")
def region_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@R.add(f"""WITH {_HISTORY_SQL}, n AS (SELECT region, count(*) AS n FROM h GROUP BY region),
p AS (SELECT x.region AS a, y.region AS b, count(*) AS shared FROM h x JOIN h y ON x.sha = y.sha AND x.region < y.region GROUP BY ALL)
SELECT a, b, shared, floor(shared / (na.n + nb.n - shared) * 1000.0 + 0.5) / 1000.0 AS coupling FROM p JOIN n na ON na.region = a JOIN n nb ON nb.region = b WHERE shared / (na.n + nb.n - shared) >= 0.1""")
def logged_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From logs of lines to regions that change together."""
    return joins.cochange_pairs(_history(spark, sf_dir), 0.1).select("a", "b", "shared", half_up(F.col("coupling"), 3).alias("coupling"))

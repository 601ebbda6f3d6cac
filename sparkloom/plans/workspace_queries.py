"""Multi-file index, merge ranking, generated lines, snapshots and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import incremental, workspace
from sparkloom.operators.session import checkpointed
from sparkloom.plans.registry import Registry, table
from sparkloom.sources import scans

R = Registry(doubles=True)

_CODE_SQL = "CASE page_id % 4 WHEN 0 THEN 'export const aux_' || page_id || ' = 1' || chr(10) || 'import x from ''./pkg' || (page_id % 9) || '''' WHEN 1 THEN 'export default function load_' || page_id || '() {}' || chr(10) || 'export class T' || (page_id % 9) || ' {}' || chr(10) || 'import { a } from \"lib' || (page_id % 9) || '\"' WHEN 2 THEN 'export { A, B as C' || page_id || ' } from ''./mod' || (page_id % 9) || '''' || chr(10) || 'export * from ''./deep' || (page_id % 9) || '''' ELSE 'const hidden = 2' END"
_FILES_SQL = f"files AS (SELECT page_id, CASE WHEN page_id % 10 = 7 THEN 'src/dist/' ELSE 'src/' END || 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '.py' END AS path, {_CODE_SQL} AS text FROM pages)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code file for each page: of its kind the id decides."""
    id_, nine = F.col("page_id").cast("string"), (F.col("page_id") % 9).cast("string")
    s = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    code = (
        F.when(F.col("page_id") % 4 == 0, s("export const aux_", id_, " = 1\nimport x from './pkg", nine, "'"))
        .when(F.col("page_id") % 4 == 1, s("export default function load_", id_, "() {}\nexport class T", nine, " {}\nimport { a } from \"lib", nine, '"'))
        .when(F.col("page_id") % 4 == 2, s("export { A, B as C", id_, " } from './mod", nine, "'\nexport * from './deep", nine, "'"))
        .otherwise("const hidden = 2")
    )
    folder = F.when(F.col("page_id") % 10 == 7, "src/dist/").otherwise("src/")
    ext = F.element_at(F.array(F.lit(".ts"), F.lit("/index.ts"), F.lit(".py")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.lit("p"), id_, ext).alias("path"), code.alias("text"))


@R.add(f"""WITH {_FILES_SQL} SELECT path, '.ts' AS ext, len(string_split(text, chr(10))) AS line_count,
 array_to_string(regexp_extract_all(text, '(?m)^export\\s+(?:default\\s+)?(?:const|function|class|interface|type|enum|abstract\\s+class)\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), ',') AS exports,
 array_to_string(regexp_extract_all(text, 'from\\s+[''"]([^''"]+)[''"]', 1), ',') AS imports, path LIKE '%index.ts' AS is_barrel FROM files WHERE path LIKE '%.ts' AND path NOT LIKE '%/dist/%'""")
def workspace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.scan_workspace(_files(spark, sf_dir))
    return found.select("path", "ext", "line_count", F.array_join("exports", ",").alias("exports"), F.array_join("imports", ",").alias("imports"), "is_barrel")


_LINKS = r"href=\"/([^\"]*)\""


@R.add("""SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS symbol, 'site/' || page_id AS path FROM pages""")
def symbol_exporters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string")).alias("path"), scans.exports_of(F.col("html"), _LINKS).alias("exports"))
    return workspace.symbol_exporters(pages)


@R.add(f"""WITH {_FILES_SQL}, n AS (SELECT path, unnest(regexp_extract_all(text, 'export\\s*\\{{([^}}]+)\\}}\\s*from\\s*[''"]([^''"]+)[''"]', 1)) AS names, unnest(regexp_extract_all(text, 'export\\s*\\{{([^}}]+)\\}}\\s*from\\s*[''"]([^''"]+)[''"]', 2)) AS specifier FROM files),
s AS (SELECT path, specifier, unnest(string_split(names, ',')) AS part FROM n)
SELECT path, specifier, regexp_extract(trim(part), '^(\\S+)', 1) AS symbol FROM s
UNION ALL SELECT path, unnest(regexp_extract_all(text, 'export\\s*\\*(?:\\s+as\\s+\\w+)?\\s+from\\s*[''"]([^''"]+)[''"]', 1)), '*' FROM files""")
def reexport_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.reexports(_files(spark, sf_dir))


_EXP_SQL = """exporters AS (SELECT DISTINCT 'NATION_' || s_nationkey AS symbol, 'src/m' || (s_suppkey % 40) || CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '.jsx' END AS path FROM supplier),
rex AS (SELECT 'src/b' || (c_custkey % 7) || '.ts' AS path, CASE WHEN c_custkey % 3 = 0 THEN '*' ELSE 'NATION_' || c_nationkey END AS symbol, 'src/m' || (c_custkey % 50) AS base FROM customer),
cand AS (SELECT base, i, base || sfx AS p FROM (SELECT DISTINCT base FROM rex), (SELECT unnest(['.ts', '.tsx', '.js', '.jsx', '.mts', '.cts', '/index.ts', '/index.js', '']) AS sfx, unnest(range(1, 10)) AS i)),
res AS (SELECT base, arg_min(p, i) AS resolved FROM cand JOIN (SELECT DISTINCT path FROM exporters) ON p = path GROUP BY base)"""


@R.add(f"""WITH {_EXP_SQL}, k AS (SELECT r.path, symbol, resolved FROM rex r JOIN res USING (base))
SELECT symbol, path FROM exporters UNION SELECT symbol, path FROM k WHERE symbol <> '*' UNION SELECT e.symbol, k.path FROM k JOIN exporters e ON k.resolved = e.path WHERE k.symbol = '*'""")
def reexport_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    ends = F.element_at(F.array(F.lit(".ts"), F.lit("/index.ts"), F.lit(".jsx")), (n % 3 + 1).cast("int"))
    exporters = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("symbol"), F.concat(F.lit("src/m"), (n % 40).cast("string"), ends).alias("path")
    ).distinct()
    c = F.col("c_custkey")
    rex = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src/b"), (c % 7).cast("string"), F.lit(".ts")).alias("path"),
        F.when(c % 3 == 0, "*").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("symbol"),
        F.concat(F.lit("src/m"), (c % 50).cast("string")).alias("base"),
    )
    return workspace.with_reexports(exporters, workspace.resolve_specifiers(rex, exporters, "base"))


_MERGE_SQL = """
f AS (SELECT 'w' || page_id AS path, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS exports, regexp_extract_all(html, '<a href="/([^"]{4,6})"', 1) AS imports,
  [['hook', 'class'], ['react-component'], ['utility-function']][CAST(page_id % 3 AS INT) + 1] AS kinds, page_id % 120 AS line_count, page_id % 11 = 0 AS is_barrel,
  CASE WHEN page_id % 2 = 0 THEN 'react' ELSE 'none' END AS framework, page_id FROM pages),
r AS (SELECT page_id AS region, exports[1] AS name, ['hook', 'react-component', 'class', 'utility-function', 'enum'][CAST(page_id % 5 AS INT) + 1] AS kind, exports[2:5] AS used, path AS source_path FROM f),
p AS (SELECT region, path, name, used, f.exports, line_count, list_contains(kinds, kind) AS sk,
  len(list_filter(f.exports, lambda e: contains(lower(e), lower(name)[1:4]) OR contains(lower(name), lower(e)[1:4]))) > 0 AS nm,
  len(list_intersect(used, f.exports)) AS shared, kind IN ('hook', 'react-component') AND framework = 'react' AS fw,
  len(list_filter(f.imports, lambda i: contains(i, lower(name)))) > 0 AS im FROM r, f WHERE f.path <> source_path AND NOT is_barrel AND NOT list_contains(f.exports, name)),
s AS (SELECT region, path, shared, line_count + 20 > 200 AS too_long, least(1.0, CASE WHEN sk THEN 0.3 ELSE 0.0 END + CASE WHEN nm THEN 0.2 ELSE 0.0 END + least(0.3, shared * 0.1)
  + CASE WHEN fw THEN 0.1 ELSE 0.0 END + CASE WHEN im THEN 0.15 ELSE 0.0 END + CASE WHEN line_count < 80 THEN 0.05 ELSE 0.0 END) AS raw FROM p),
t AS (SELECT region, path, floor(raw * 100.0 + 0.5) / 100.0 AS score, shared, too_long FROM s WHERE raw >= 0.25)
"""


@R.add(f"WITH {_MERGE_SQL} SELECT region, path, score, shared, too_long, rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, path) AS rank FROM t) WHERE rank <= 3")
def merge_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("page_id")
    kinds = F.array(F.array(F.lit("hook"), F.lit("class")), F.array(F.lit("react-component")), F.array(F.lit("utility-function")))
    files = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("w"), id_.cast("string")).alias("path"), scans.exports_of(F.col("html"), _LINKS).alias("exports"), scans.exports_of(F.col("html"), r"<a href=\"/([^\"]{4,6})\"").alias("imports"),
        F.element_at(kinds, (id_ % 3 + 1).cast("int")).alias("kinds"), (id_ % 120).alias("line_count"), (id_ % 11 == 0).alias("is_barrel"),
        F.when(id_ % 2 == 0, "react").otherwise("none").alias("framework"), "page_id",
    )
    files = checkpointed(files)  # The links are read once for both sides.
    own = F.element_at(F.array(*[F.lit(k) for k in ("hook", "react-component", "class", "utility-function", "enum")]), (id_ % 5 + 1).cast("int"))
    regions = files.select(
        F.col("page_id").alias("region"), F.element_at("exports", 1).alias("name"), own.alias("kind"), F.slice("exports", 2, 4).alias("used"), F.col("path").alias("source_path")
    )
    return workspace.merge_suggestions(regions, files.drop("page_id"))


_ENTRY_SQL = "e AS (SELECT p_partkey AS ordinal, p_type || '/' || replace(p_name, ' ', '-') || '.ts' AS file_name, 'export { P' || p_partkey || ' } from ''./' || p_type || '/' || replace(p_name, ' ', '-') || ''';' AS entry FROM part)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat("p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.concat(stem, F.lit(".ts")).alias("file_name"),
        F.concat(F.lit("export { P"), F.col("p_partkey").cast("string"), F.lit(" } from './"), stem, F.lit("';")).alias("entry"),
    )


@R.add(f"WITH {_ENTRY_SQL} SELECT string_split(file_name, '/')[1] AS grp, '// ' || string_split(file_name, '/')[1] || '/' || chr(10) || string_agg(entry, chr(10) ORDER BY ordinal) AS text FROM e GROUP BY 1")
def barrel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.barrel_lines(_entries(spark, sf_dir))


@R.add(f"""WITH {_ENTRY_SQL}, x AS (SELECT entry AS line FROM e WHERE ordinal % 2 = 0 UNION SELECT '// ' || string_split(file_name, '/')[1] || '/' FROM e WHERE ordinal % 5 = 0 AND ordinal < 40)
SELECT string_split(file_name, '/')[1] AS grp, entry, '// ' || string_split(file_name, '/')[1] || '/' NOT IN (SELECT line FROM x) AS new_group FROM e WHERE entry NOT IN (SELECT line FROM x)""")
def barrel_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir).withColumn("grp", F.element_at(F.split("file_name", "/"), 1))
    headers = entries.where("ordinal % 5 = 0 and ordinal < 40").select(F.concat(F.lit("// "), "grp", F.lit("/")).alias("line"))
    existing = entries.where("ordinal % 2 = 0").select(F.col("entry").alias("line")).unionAll(headers)
    return workspace.barrel_additions(existing, entries.select("grp", "entry"))


_NOW = "2024-03-01 00:00:00"
_SNAP_SQL = f"""cur AS (SELECT source AS file, doc_id AS name, md5(text) AS hash FROM documents),
snap AS (SELECT source AS file, doc_id AS name, md5(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS hash, TIMESTAMP '{_NOW}' - to_minutes(doc_id % 45) AS last_read FROM documents WHERE doc_id % 10 <> 0),
diff AS (SELECT c.*, coalesce(c.hash = s.hash AND epoch(TIMESTAMP '{_NOW}') - epoch(last_read) < 1800, false) AS cached FROM cur c LEFT JOIN snap s ON c.file = s.file AND c.name = s.name)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    current = docs.select(F.col("source").alias("file"), F.col("doc_id").alias("name"), F.md5(F.col("text").cast("binary")).alias("hash"))
    old = F.md5(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")).cast("binary"))
    read = F.timestamp_seconds(F.unix_timestamp(F.lit(_NOW)) - F.col("doc_id") % 45 * 60)
    return current, docs.where("doc_id % 10 <> 0").select(F.col("source").alias("file"), F.col("doc_id").alias("name"), old.alias("hash"), read.alias("last_read"))


@R.add(f"WITH {_SNAP_SQL} SELECT file, name, cached FROM diff")
def cache_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, snapshot = _snapshots(spark, sf_dir)
    return incremental.cache_diff(current, snapshot, F.lit(_NOW).cast("timestamp")).select("file", "name", "cached")


@R.add(f"WITH {_SNAP_SQL} SELECT CAST(count_if(cached) AS BIGINT) AS cached, CAST(count_if(NOT cached) AS BIGINT) AS dirty, floor(count_if(cached) / count(*) * 10000 + 0.5) / 10000.0 AS hit_rate FROM diff")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.functions.numeric import half_up

    current, snapshot = _snapshots(spark, sf_dir)
    return incremental.cache_stats(incremental.cache_diff(current, snapshot, F.lit(_NOW).cast("timestamp"))).withColumn("hit_rate", half_up(F.col("hit_rate"), 4))


@R.add("""WITH f AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 40),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE user_id IN (SELECT user_id FROM f)) SELECT user_id, event_id FROM e WHERE rn <= 25""")
def evicted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return incremental.evict(events, "user_id", "ts", most_regions=25, most_files=40, tie="event_id").select("user_id", "event_id")


@R.add("""WITH a AS (SELECT url AS path, page_id % 100 AS mtime FROM pages WHERE page_id % 9 <> 0), b AS (SELECT url AS path, page_id % 100 + CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS mtime FROM pages WHERE page_id % 8 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'drop' WHEN a.mtime = b.mtime THEN 'keep' ELSE 'scan' END AS action FROM a FULL OUTER JOIN b ON a.path = b.path""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    id_ = F.col("page_id")
    return incremental.changed_files(
        pages.where(id_ % 9 != 0).select(F.col("url").alias("path"), (id_ % 100).alias("mtime")),
        pages.where(id_ % 8 != 0).select(F.col("url").alias("path"), (id_ % 100 + F.when(id_ % 4 == 0, 1).otherwise(0)).alias("mtime")),
    )


@R.add("""SELECT url AS path, regexp_matches(url, '(^|[\\\\/])(node_modules|dist|out|build|\\.next|\\.nuxt|coverage|\\.git|\\.vscode|__pycache__|\\.turbo|fr)([\\\\/]|$)') AS ignored FROM pages""")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(url.alias("path"), (scans.ignored(url) | F.array_contains(F.split(url, r"[\\/]"), "fr")).alias("ignored"))


@R.add("""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/* note' || chr(10) || '*/' || chr(10) || '''use client'';' || chr(10) WHEN 1 THEN '// a' || chr(10) || chr(10) || '"use server"' || chr(10) WHEN 2 THEN 'x' || chr(10) || '''use client''' ELSE '' END AS h FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'use client' WHEN 1 THEN 'use server' END AS directive FROM x""")
def file_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(F.lit("/* note\n*/\n'use client';\n"), F.lit('// a\n\n"use server"\n'), F.lit("x\n'use client'"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", scans.directive_of(F.concat(head, "text")).alias("directive"))


@R.add(r"""SELECT page_id, md5(regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS script, md5(regexp_extract(html, '(?is)<style[^>]*>(.*?)</style>', 1)) AS style,
 md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '^\s+|\s+$', '', 'g')) AS template FROM pages""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "pages").select(
        "page_id", md5(scans.block(html, "script")).alias("script"), md5(scans.block(html, "style")).alias("style"), md5(scans.without_blocks(html)).alias("template")
    )


@R.add("""WITH n AS (SELECT DISTINCT regexp_replace(url, '#.*|\\?.*', '') AS path FROM pages WHERE page_id % 2 = 0) SELECT page_id, regexp_replace(url, '#.*|\\?.*', '') AS path,
 CASE WHEN regexp_replace(url, '#.*|\\?.*', '') IN (SELECT path FROM n) THEN 'skipped' ELSE 'created' END AS status FROM pages WHERE page_id % 3 = 0""")
def apply_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a plan would be written: existing files are skipped."""
    from sparkloom.sources.sinks import preflight

    path = F.regexp_replace("url", r"#.*|\?.*", "")
    pages = table(spark, sf_dir, "pages")
    return preflight(pages.where("page_id % 3 = 0").select("page_id", path.alias("path")), pages.where("page_id % 2 = 0").select(path.alias("path")))


@R.add("""SELECT e.event_id, CASE e.event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Warning' ELSE 'Information' END AS level, CAST(c.c_custkey * 3 AS BIGINT) AS first_line, CAST(c.c_custkey * 3 + 2 AS BIGINT) AS last_line
FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_id % 4 <> 1""")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule hits placed on the lines of the first region they affect; those without are left out."""
    from sparkloom.sources.sinks import diagnostics as place

    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "medium").otherwise("low").alias("severity"),
        F.when(F.col("event_id") % 4 == 1, F.array().cast("array<bigint>")).otherwise(F.array(F.col("user_id"), F.lit(1).cast("bigint"))).alias("affected"),
    )
    c = F.col("c_custkey")
    regions = table(spark, sf_dir, "customer").select(c.alias("region"), (c * 3).alias("first_line"), (c * 3 + 2).alias("last_line"))
    return place(events, regions).select("event_id", "level", "first_line", "last_line")


@R.add("""WITH m AS (SELECT n_nationkey AS file, count(*) AS loc, CAST(floor(avg(s_acctbal)) AS BIGINT) AS mi FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT CAST(file AS BIGINT) AS file, unnest(['loc', 'mi']) AS label, unnest([CAST(loc AS VARCHAR), CAST(mi AS VARCHAR)]) AS value FROM m""")
def quick_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.sources.sinks import label_values

    joined = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("file")).agg(F.count("*").alias("loc"), F.floor(F.avg("s_acctbal")).alias("mi"))
    return label_values(joined, "file", ["loc", "mi"])


@R.add("""SELECT o_orderkey, ['S', 'A', 'B', 'C', 'D', 'F'][CAST(o_orderkey % 6 AS INT) + 1] || ' · MI ' || (o_orderkey % 100) AS text,
 CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 OR o_orderkey % 6 >= 4 THEN 'warning' ELSE 'ok' END AS level FROM orders""")
def status_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.sources.sinks import status

    k = F.col("o_orderkey")
    grade = F.element_at(F.array(*[F.lit(g) for g in "SABCDF"]), (k % 6 + 1).cast("int"))
    text, level = status(grade, k % 100, k % 7 == 0, k % 5 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), level.alias("level"))


@R.add("""SELECT p_partkey, 'test/' || regexp_replace(n, '\\.[jt]sx?$', '') || CASE WHEN n LIKE '%sx' THEN '.test.tsx' ELSE '.test.ts' END AS test_path,
 CASE WHEN p_partkey % 2 = 0 THEN 'export { default as N } from ''./' ELSE 'export { N } from ''./' END || regexp_replace(n, '\\.[jt]sx?$', '') || ''';' AS barrel_entry
FROM (SELECT p_partkey, replace(p_name, ' ', '') || CASE p_partkey % 3 WHEN 0 THEN '.tsx' WHEN 1 THEN '.ts' ELSE '.jsx' END AS n FROM part)""")
def generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.functions import generate

    ext = F.element_at(F.array(F.lit(".tsx"), F.lit(".ts"), F.lit(".jsx")), (F.col("p_partkey") % 3 + 1).cast("int"))
    n = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), ext)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("test/"), generate.test_path(n)).alias("test_path"), generate.barrel_entry(F.lit("N"), n, F.col("p_partkey") % 2 == 0).alias("barrel_entry")
    )


@R.add("""WITH i AS (SELECT o_orderkey AS region, 'pkg' || (l_suppkey % 5) AS specifier, 'n' || l_partkey AS name, CASE l_linenumber % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'default' ELSE 'namespace' END AS form
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT region, specifier, min(CASE WHEN form = 'default' THEN name END) AS d, min(CASE WHEN form = 'namespace' THEN name END) AS ns, string_agg(DISTINCT CASE WHEN form = 'named' THEN name END, ', ' ORDER BY CASE WHEN form = 'named' THEN name END) AS nm FROM i GROUP BY ALL)
SELECT region, 'import ' || concat_ws(', ', d, '* as ' || ns, '{ ' || nm || ' }') || ' from ''' || specifier || ''';' AS statement FROM g""")
def import_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.functions import generate

    form = F.element_at(F.array(F.lit("named"), F.lit("default"), F.lit("namespace")), F.col("l_linenumber") % 3 + 1)
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    used = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("region"), F.concat(F.lit("pkg"), (F.col("l_suppkey") % 5).cast("string")).alias("specifier"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name"), form.alias("form")
    )
    return generate.import_statements(used).select("region", "statement")

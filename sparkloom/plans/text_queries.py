"""Text, name and path functions over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import metrics, numeric, text
from sparkloom.plans.registry import Registry, table

R = Registry()

_TRIMMED = "list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
CC_SQL = "(1 + " + " + ".join(_COUNT.format("{0}", p) for p in [rf"\b{w}\b" for w in metrics.BRANCH_WORDS] + [r"\?\?|\?\.", r"&&|\|\|"]) + ")"
LOOSE_SQL = "(1 + " + _COUNT.format("{0}", r"\bif\b|\bfor\b|\bwhile\b|\b&&\b|\b\|\|\b") + ")"
DISTINCT_SQL = "len(list_distinct(regexp_extract_all({0}, '\\b[a-zA-Z_$]\\w*\\b')))"
MI_SQL = (
    "greatest(0, least(100, CAST(floor((171.0 - 5.2 * ln(CASE WHEN {u} > 1 THEN CAST({u} AS DOUBLE) * log2(CAST({u} AS DOUBLE)) ELSE 1.0 END)"
    " - 0.23 * {cc} - 16.2 * ln(CAST(greatest(1, {loc}) AS DOUBLE))) * 100.0 / 171.0 + 0.5) AS BIGINT)))"
)


@R.add(f"""
WITH l AS (SELECT doc_id, {_TRIMMED} AS ls FROM documents),
c AS (SELECT doc_id, len(ls) AS loc, len(list_filter(ls, lambda x: x = '')) AS blank_lines,
  len(list_filter(ls, lambda x: starts_with(x, '//') OR starts_with(x, '*'))) AS comment_lines FROM l)
SELECT *, loc - blank_lines - comment_lines AS code_lines,
  CAST(floor(comment_lines / CAST(greatest(1, loc - blank_lines - comment_lines) AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS comment_quality FROM c
""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = metrics.line_stats(F.col("text"))
    return docs.select("doc_id", *[c.alias(n) for n, c in stats.items()], metrics.comment_quality(F.col("text")).alias("comment_quality"))


@R.add(f"""
SELECT 'd' AS kind, doc_id AS id, {CC_SQL.format('text')} AS cc, {LOOSE_SQL.format('text')} AS loose_cc FROM documents
UNION ALL SELECT 'p', page_id, {CC_SQL.format('html')}, {LOOSE_SQL.format('html')} FROM pages
""")
def cyclomatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    t = F.col("text")
    return docs.unionAll(pages).select("kind", "id", metrics.cyclomatic(t).alias("cc"), metrics.loose_cyclomatic(t).alias("loose_cc"))


@R.add(f"""
WITH m AS (SELECT doc_id, len(string_split(text, chr(10))) AS loc, {DISTINCT_SQL.format('text')} AS identifiers, {CC_SQL.format('text')} AS cc FROM documents)
SELECT doc_id, loc, identifiers, cc, {MI_SQL.format(u='identifiers', cc='cc', loc='loc')} AS mi FROM m
""")
def maintainability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    found = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.size(F.split(t, "\n")).alias("loc"),
        F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(text.IDENTIFIER), F.lit(0)))).alias("identifiers"),
        metrics.cyclomatic(t).alias("cc"),
    )
    return found.select("doc_id", "loc", "identifiers", "cc", metrics.maintainability(t, F.col("loc"), F.col("cc")).alias("mi"))


@R.add("""
WITH c AS (SELECT page_id, unnest(range(1, len(html) + 1)) AS i, html FROM pages),
s AS (SELECT page_id, i, CASE WHEN html[i] IN ('{', '(', '[') THEN 1 WHEN html[i] IN ('}', ')', ']') THEN -1 ELSE 0 END AS v FROM c),
r AS (SELECT page_id, i, sum(v) OVER (PARTITION BY page_id ORDER BY i) AS s FROM s WHERE v <> 0),
d AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM r)
SELECT page_id, CAST(coalesce(max(depth), 0) AS BIGINT) AS depth FROM pages LEFT JOIN d USING (page_id) GROUP BY page_id
""")
def bracket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.max_bracket_depth(F.col("html")).alias("depth"))


@R.add("""
WITH l AS (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS ls FROM pages),
x AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l)
SELECT page_id, CAST(sum(len(regexp_extract_all(line, '&&|\\|\\|')) + len(regexp_extract_all(line, '!')) - len(regexp_extract_all(line, '!='))) AS BIGINT) AS score
FROM x GROUP BY page_id
""")
def line_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-wise cognitive score of pages, one tag a line; no line of theirs opens or continues a branch."""
    lines = F.replace(F.col("html"), F.lit("><"), F.lit(">\n<"))
    return table(spark, sf_dir, "pages").select("page_id", metrics.nesting_line_score(lines).alias("score"))


@R.add("""
WITH s AS (SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand AS t FROM part)
SELECT p_partkey, lower(printf('%08x', list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(range(1, len(t) + 1), lambda i: CAST(unicode(t[i]) AS BIGINT))),
  lambda h, c: xor((h * 33) & 4294967295, c)))) AS hash FROM s
""")
def djb2_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.region_hash(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("hash"))


_PASCAL = "regexp_replace(list_aggregate(list_transform(regexp_split_to_array(regexp_replace(n, '\\.[^.]+$', ''), '[-_\\s]+'), lambda p: upper(p[1:1]) || p[2:]), 'string_agg', ''), '[^a-zA-Z0-9]', '', 'g')"


@R.add(f"""
WITH m AS (SELECT DISTINCT replace(p_name, ' ', '') AS n0, p_name || p_type || '_' || p_brand || '.tsx' AS n FROM part
  UNION SELECT n_name, n_name || 'Provider' FROM nation),
x AS (SELECT n0, n, regexp_replace(n, '([A-Z])', ' \\1', 'g') AS sp FROM m)
SELECT n0, n, regexp_replace(lower(regexp_replace(n, '([A-Z])', '-\\1', 'g')), '^-', '') AS kebab,
  lower(regexp_replace(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS kebab_words,
  {_PASCAL} AS pascal, regexp_replace(upper(sp[1:1]) || sp[2:], '^\\s+|\\s+$', '', 'g') AS title FROM x
""")
def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    names = part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("n0"), F.concat("p_name", "p_type", F.lit("_"), "p_brand", F.lit(".tsx")).alias("n"))
    names = names.unionAll(nation.select("n_name", F.concat("n_name", F.lit("Provider")))).distinct()
    n = F.col("n")
    return names.select("n0", "n", text.kebab(n).alias("kebab"), text.kebab_words(n).alias("kebab_words"), text.pascal(n).alias("pascal"), text.title(n).alias("title"))


@R.add("""
WITH e AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS t FROM pages)
SELECT page_id, md5(t) AS escaped, CASE WHEN len(t) <= 80 THEN t ELSE t[1:79] || '…' END AS short FROM e
""")
def escape_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5(F.col("t").cast("binary")).alias("escaped"), text.truncate(F.col("t"), 80).alias("short"))


@R.add(r"""
WITH u AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/main.test.tsx' WHEN 1 THEN '/.env' WHEN 2 THEN '.js' ELSE '' END AS p FROM pages),
b AS (SELECT *, string_split(p, '/') AS s FROM u)
SELECT page_id, s[-1] AS base, CASE WHEN len(s) = 1 OR array_to_string(s[1:len(s) - 1], '/') = '' THEN '.' ELSE array_to_string(s[1:len(s) - 1], '/') END AS dir,
  regexp_extract(s[-1], '.(\.[^.]*)$', 1) AS ext, regexp_replace(p, '\.[jt]sx?$', '') AS bare,
  CASE lower(string_split(p, '.')[-1]) WHEN 'tsx' THEN 'TypeScript/React' WHEN 'js' THEN 'JavaScript' ELSE 'Unknown' END AS lang FROM b
""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(F.lit("/main.test.tsx"), F.lit("/.env"), F.lit(".js"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    p = F.col("p")
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.concat("url", tail).alias("p"))
        .select("page_id", text.basename(p).alias("base"), text.dirname(p).alias("dir"), text.extname(p).alias("ext"), text.strip_extension(p).alias("bare"), text.language_of(p).alias("lang"))
    )


@R.add(r"""
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') || '.ts' AS p FROM pages),
j AS (SELECT a.page_id, string_split(a.p, '/') AS f, string_split(b.p, '/') AS t FROM u a JOIN u b ON b.page_id = a.page_id - a.page_id % 5),
k AS (SELECT page_id, f[1:len(f) - 1] AS f, t, least(len(f) - 1, len(t) - 1) AS most FROM j),
c AS (SELECT *, coalesce(list_min(list_filter(range(1, most + 1), lambda i: f[i] <> t[i])) - 1, most) AS common FROM k)
SELECT page_id, regexp_replace(CASE WHEN len(f) = common THEN './' ELSE repeat('../', len(f) - common) END || array_to_string(t[common + 1:], '/'), '\.[jt]sx?$', '') AS rel FROM c
""")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".ts")).alias("p"))
    other = paths.select(F.col("page_id").alias("o"), F.col("p").alias("q"))
    joined = paths.join(other, F.col("o") == F.col("page_id") - F.col("page_id") % 5)
    return joined.select("page_id", text.relative_path(F.col("p"), F.col("q")).alias("rel"))


@R.add("""
WITH m AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 7 AS n, p_retailprice AS v FROM part)
SELECT p_partkey, CASE WHEN n < 60 THEN n || 'm' WHEN n % 60 > 0 THEN (n // 60) || 'h ' || (n % 60) || 'm' ELSE (n // 60) || 'h' END AS spent,
  least(100.0, floor(v / 1500.0 * 100.0 + 0.5)) AS bar, greatest(0.0, least(1.0, v / 1200.0)) AS share, floor(v * 10.0 + 0.5) / 10.0 AS rounded FROM m
""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        numeric.format_minutes(F.col("p_size").cast("bigint") * 7).alias("spent"),
        numeric.bar_percent(v, F.lit(1500.0)).alias("bar"),
        numeric.clamp01(v / 1200.0).alias("share"),
        numeric.half_up(v, 1).alias("rounded"),
    )


@R.add("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE t WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END :: BIGINT AS rank,
  CASE c WHEN 'definitive' THEN 97 WHEN 'high' THEN 85 WHEN 'medium' THEN 65 WHEN 'low' THEN 40 WHEN 'speculative' THEN 20 ELSE 0 END :: BIGINT AS percent
FROM (SELECT l_orderkey, l_linenumber, CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'x' END AS t,
  CASE WHEN l_discount >= 0.085 THEN 'definitive' WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.05 THEN 'medium' WHEN l_discount >= 0.03 THEN 'low' ELSE 'speculative' END AS c FROM lineitem)
""")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info", "x")])
    severity = F.element_at(names, (F.col("l_quantity").cast("int") % 6 + 1).cast("int"))
    from sparkloom.functions.decision import confidence

    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.severity_rank(severity).alias("rank"), text.confidence_percent(confidence(F.col("l_discount") * 10)).alias("percent")
    )


@R.add(r"""
SELECT page_id, len(regexp_extract_all(html, '\.[A-Za-z_$][A-Za-z0-9_$]*\s*\(')) >= 2 AS chained,
  CAST(len(html[1:p]) - len(replace(replace(html[1:p], '<', ''), chr(10), '')) + 1 AS BIGINT) AS at_tag
FROM (SELECT page_id, html, instr(html, 'article') AS p FROM pages)
""")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.has_chained_calls(html).alias("chained"), text.line_of(F.replace(html, F.lit("<"), F.lit("\n")), F.instr(html, "article")).alias("at_tag")
    )

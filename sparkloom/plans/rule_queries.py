"""Rules over regions and pages, fragments that repeat, and cohesion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import metrics
from sparkloom.functions.numeric import half_up
from sparkloom.functions.text import severity_rank
from sparkloom.operators import cohesion, rules
from sparkloom.operators.joins import ranked
from sparkloom.plans.metric_queries import KINDS, kind_of
from sparkloom.plans.registry import Registry, table
from sparkloom.plans.text_queries import LOOSE_SQL
from sparkloom.sources import scans

R = Registry()

#: Pieces of code that are put behind a document's text, in turn, so that the rules have something to find.
SNIPPETS = [
    "const [a, b] = useState(0); useEffect(() => { fetch('/x').then(r => r) }); return <Box className='x'>{items.map(i => <Row key={i} />)}</Box>",
    "const a = props.user.name.first; const b = props.user.address.street; axios.get('/y'); return <Card />",
    "useEffect(async () => { await load() })",
    "console.log('x'); const t: any = 1; const u: any = 2; function f(v: any) {} // TODO one",
    "document.getElementById('x'); switch (k) { case 1: case 2: case 3: case 4: case 5: case 6: case 7: case 8: case 9: break }",
    "const n = [100, 200, 300, 400, 500, 600]; x!.y; x!.z; q![0]; w!(1); v!.u",
    "// TODO a\n// FIXME b\n// HACK c\nif (a) { if (b) { if (c) { if (d) { if (e) { if (f) { g() } } } } } }",
]
_SNIPPET_SQL = "[" + ", ".join("'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for s in SNIPPETS) + "][CAST(doc_id % 7 AS INT) + 1]"
_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][CAST(doc_id // 7 % 7 AS INT) + 1]"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    snippet = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("doc_id") % 7 + 1).cast("int"))
    out = docs.select("doc_id", kind_of(F.floor(F.col("doc_id") / 7)).alias("kind"), F.concat("text", F.lit("\n"), snippet).alias("text"))
    return out.select(
        "doc_id", "kind", "text", (F.size(F.split("text", "\n")) * 5).alias("line_count"), metrics.loose_cyclomatic(F.col("text")).alias("loose_cc"),
        (F.col("doc_id") % 11).alias("nesting"), F.concat(F.lit("region"), F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("doc_id") % 5 == 0, "a.test.ts").otherwise("a.ts").alias("path"), F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("pino"))).otherwise(F.array(F.lit("x"))).alias("imports"),
    )


_N = "len(regexp_extract_all(text, '{0}'))"
_RULE_SQL = [
    ("God Component", "critical", "comp AND (" + " + ".join(f"CAST(regexp_matches(text, '{c}') AS INT)" for c in rules.CONCERNS) + ") >= 4"),
    ("Prop Drilling", "high", "comp AND " + _N.format(r"props\.\w+\.\w+\.\w+") + " >= 2"),
    ("Mixed Concerns — API + Render", "high", r"comp AND regexp_matches(text, 'fetch\(|axios\.|\.then\(') AND regexp_matches(text, '<[A-Z]\w*')"),
    ("Excessive Inline Styles", "low", "comp AND " + _N.format(r"style\s*=\s*\{\{") + " > 3"),
    ("Missing Memoisation on Mapped JSX", "medium", r"comp AND NOT regexp_matches(text, 'useCallback|useMemo') AND regexp_matches(text, '\.map\(.*=>\s*<') AND line_count > 40"),
    ("Direct DOM Manipulation", "high", r"comp AND regexp_matches(text, 'document\.(getElementById|querySelector|createElement)')"),
    ("Missing useEffect Dependency Array", "high", r"kind = 'hook' AND regexp_matches(text, 'useEffect\s*\(\s*(?:async\s*)?\(\s*\)\s*=>') AND NOT regexp_matches(text, ',\s*\[')"),
    ("Async useEffect", "medium", r"kind = 'hook' AND regexp_matches(text, 'useEffect\s*\(\s*async')"),
    ("Oversized Module (>200 lines)", "critical", "line_count > 200"),
    ("Large Module (>100 lines)", "high", "line_count > 100 AND line_count <= 200"),
    ("Extreme Nesting (>8 levels)", "critical", "nesting > 8"),
    ("Deep Nesting (>5 levels)", "medium", "nesting > 5 AND nesting <= 8"),
    ("Extreme Cyclomatic Complexity (>20)", "critical", "loose_cc > 20"),
    ("High Cyclomatic Complexity (>10)", "high", "loose_cc > 10 AND loose_cc <= 20"),
    ("Long Switch Statement", "medium", _N.format(r"\bcase\b") + " > 8"),
    ("TODO/FIXME Debt", "low", _N.format("//.*(?:TODO|FIXME|HACK|XXX)") + " > 2"),
    ("Console Logging", "low", _N.format(r"\bconsole\.(?:log|warn|error|debug|info)\b") + " > 0 AND doc_id % 5 <> 0 AND doc_id % 9 <> 0"),
    ("Excessive `any` Usage", "medium", _N.format(r":\s*any\b") + " > 2"),
    ("Non-null Assertion Abuse", "medium", _N.format(r"[^!]!\s*[.\[(]") + " > 3"),
]
_HITS_SQL = f"""
r AS (SELECT doc_id, source, {_KIND_SQL} AS kind, text || chr(10) || {_SNIPPET_SQL} AS text, doc_id % 11 AS nesting FROM documents),
m AS (SELECT *, len(string_split(text, chr(10))) * 5 AS line_count, {LOOSE_SQL.format('text')} AS loose_cc, kind IN ('react-component', 'context-provider') AS comp FROM r),
hits AS (""" + " UNION ALL ".join(f"SELECT doc_id, source, '{n}' AS name, '{s}' AS severity FROM m WHERE {w}" for n, s, w in _RULE_SQL) + ")"
#: Their patterns look ahead or behind, which the SQL's expressions cannot.
_NOT_IN_SQL = ["Magic Numbers", "SetState Outside Effect"]


@R.add(f"WITH {_HITS_SQL} SELECT doc_id, name, severity FROM hits")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = [r for r in rules.CODE_RULES if r.name not in _NOT_IN_SQL]
    return rules.hits(_regions(spark, sf_dir), ["doc_id"], checked).select("doc_id", "name", "severity")


@R.add()
def lookaround_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules whose patterns look ahead or behind; held against fixtures in the tests."""
    checked = [r for r in rules.CODE_RULES if r.name in _NOT_IN_SQL]
    return rules.hits(_regions(spark, sf_dir), ["doc_id"], checked).select("doc_id", "name", "severity")


@R.add(f"""WITH {_HITS_SQL}, k AS (SELECT doc_id, name, severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank FROM hits)
SELECT doc_id, name, CAST(rn AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, name) AS rn FROM k) WHERE rn <= 3""")
def worst_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three gravest hits of each region."""
    from pyspark.sql import Window

    found = rule_hits(spark, sf_dir)
    order = [F.desc(severity_rank(F.col("severity"))), F.asc("name")]
    top = ranked(found, ["doc_id"], order, 3)
    return top.select("doc_id", "name", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).alias("position"))


@R.add(r"""
WITH b AS (SELECT page_id, html, regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS script,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '^\s+|\s+$', '', 'g') AS template FROM pages),
x AS (SELECT page_id, script || ' subscribe getContext writable $: store.subscribe(' AS script, template || CASE page_id % 3 WHEN 0 THEN '{#each items as i}' WHEN 1 THEN '$store = 1' ELSE '' END AS template,
  html AS text FROM b)
SELECT page_id, name FROM (
 SELECT page_id, 'Store Subscription Without onDestroy' AS name FROM x WHERE NOT regexp_matches(script, 'import\s*\{[^}]*onDestroy|onDestroy\s*\(') AND NOT regexp_matches(template, '\$\w+')
 UNION ALL SELECT page_id, 'Direct Writable Store Assignment in Template' FROM x WHERE regexp_matches(template, '\$\w+\s*=\s*')
 UNION ALL SELECT page_id, 'Missing key on {#each}' FROM x WHERE regexp_matches(template, '\{#each') AND NOT regexp_matches(template, '\{#each[^}]+(key)')
 UNION ALL SELECT page_id, 'getContext Without setContext in Tree' FROM x WHERE NOT regexp_matches(text, 'setContext'))
""")
def svelte_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rules.with_svelte_blocks(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))
    more = F.when(F.col("page_id") % 3 == 0, "{#each items as i}").when(F.col("page_id") % 3 == 1, "$store = 1").otherwise("")
    pages = pages.withColumns({"script": F.concat("script", F.lit(" subscribe getContext writable $: store.subscribe(")), "template": F.concat("template", more)})
    return rules.hits(pages, ["page_id"], rules.SVELTE_RULES).select("page_id", "name")


_VUE_TAIL = "<template><li v-for=\"a in b\" v-if=\"c\">{{ a }}</li></template><script setup>const a = ref(1); const b = computed(() => 2); watch(a, () => setTimeout(f, 9)); window.addEventListener('x', f); defineProps(['q'])</script>"


@R.add(f"""
WITH x AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g') || CASE page_id % 2 WHEN 0 THEN '{_VUE_TAIL.replace("'", "''")}' ELSE '' END AS t FROM pages),
b AS (SELECT page_id, regexp_extract(t, '(?is)<script\\s[^>]*setup[^>]*>(.*?)</script>', 1) AS script, regexp_extract(t, '(?is)<template>(.*?)</template>', 1) AS template, t FROM x)
SELECT page_id, name FROM (
 SELECT page_id, 'Vue Composable Candidate' AS name FROM b WHERE len(list_distinct(regexp_extract_all(script, 'const\\s+([A-Za-z_$][\\w$]*)\\s*=\\s*(?:ref|computed|reactive|shallowRef|readonly)\\s*\\(', 1))) >= 2
 UNION ALL SELECT page_id, 'Untyped defineProps' FROM b WHERE regexp_matches(script, 'defineProps\\s*\\(\\s*\\[')
 UNION ALL SELECT page_id, 'watch Without Cleanup' FROM b WHERE regexp_matches(script, '\\bwatch\\s*\\(')
 UNION ALL SELECT page_id, 'addEventListener Without onUnmounted Cleanup' FROM b WHERE script LIKE '%addEventListener%' AND script NOT LIKE '%onUnmounted%'
 UNION ALL SELECT page_id, 'v-if + v-for on Same Element' FROM b WHERE regexp_matches(template, 'v-for[^>]+v-if|v-if[^>]+v-for')
 UNION ALL SELECT page_id, 'Missing :key on v-for' FROM b WHERE template LIKE '%v-for%' AND NOT regexp_matches(template, 'v-for[^>]+:key|:key[^>]+v-for'))
""")
def vue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.regexp_replace("html", "(?is)<script[^>]*>.*?</script>", ""), F.when(F.col("page_id") % 2 == 0, F.lit(_VUE_TAIL)).otherwise(""))
    return rules.framework_hits(table(spark, sf_dir, "pages").select("page_id", t.alias("text")), ["page_id"], "vue").select("page_id", "name")


_NG = "@Component({{ template: '<p></p>' }}) export class A{0} {{ x: any; y: any; z: any; w: any; load() {{ this.s.subscribe(v => v); document.getElementById('q') }} }} @Injectable() class S {{}}".format("")


@R.add(f"""
WITH x AS (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN '{_NG.replace("'", "''")}' ELSE '' END AS t FROM pages)
SELECT page_id, name FROM (
 SELECT page_id, 'Missing OnPush Change Detection' AS name FROM x WHERE regexp_matches(t, '@Component\\s*\\(') AND NOT regexp_matches(t, 'OnPush')
 UNION ALL SELECT page_id, 'Angular Standalone Migration Candidate' FROM x WHERE regexp_matches(t, '@Component\\s*\\(') AND NOT regexp_matches(t, 'standalone\\s*:\\s*true')
 UNION ALL SELECT page_id, 'Missing providedIn in @Injectable' FROM x WHERE regexp_matches(t, '@Injectable\\s*\\(') AND NOT regexp_matches(t, 'providedIn\\s*:')
 UNION ALL SELECT page_id, 'Observable Subscription Leak' FROM x WHERE regexp_matches(t, '\\.subscribe\\s*\\(') AND NOT regexp_matches(t, 'implements OnDestroy|ngOnDestroy\\s*\\(') AND NOT regexp_matches(t, 'takeUntil|takeUntilDestroyed|pipe\\s*\\(')
 UNION ALL SELECT page_id, 'Direct DOM Access in Angular Component' FROM x WHERE regexp_matches(t, 'document\\.getElementById')
 UNION ALL SELECT page_id, 'Excessive any in Angular Service/Component' FROM x WHERE len(regexp_extract_all(t, ':\\s*any\\b')) > 3)
""")
def angular_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("html", F.when(F.col("page_id") % 4 == 0, F.lit(_NG)).otherwise(""))
    return rules.framework_hits(table(spark, sf_dir, "pages").select("page_id", t.alias("text")), ["page_id"], "angular").select("page_id", "name")


@R.add("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, i, line, regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '\\s+', ' ', 'g') AS t FROM l),
w AS (SELECT doc_id, i, t || '|' || lead(t, 1) OVER o || '|' || lead(t, 2) OVER o AS c, len(line) + len(lead(line, 1) OVER o) + len(lead(line, 2) OVER o) AS z FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT sha256(c) AS fingerprint, count(DISTINCT doc_id) AS regions, min(doc_id) AS first, count(*) AS windows FROM w WHERE c IS NOT NULL AND z >= 60 GROUP BY c HAVING count(DISTINCT doc_id) > 1
""")
def repeated_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rules.repeated_fragments(lines, "doc_id", "i", "line")


_TOUCH_SQL = """touches AS (SELECT DISTINCT n_nationkey AS cls, s_suppkey AS method, l_partkey AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
  methods AS (SELECT s_nationkey AS cls, s_suppkey AS method FROM supplier)"""


@R.add(f"""WITH RECURSIVE {_TOUCH_SQL},
pr AS (SELECT DISTINCT x.cls, x.method AS m1, y.method AS m2 FROM touches x JOIN touches y ON x.cls = y.cls AND x.member = y.member AND x.method <> y.method),
reach AS (SELECT cls, method AS a, method AS b FROM methods UNION SELECT r.cls, r.a, p.m2 FROM reach r JOIN pr p ON r.cls = p.cls AND r.b = p.m1),
lab AS (SELECT cls, a AS method, min(b) AS label FROM reach GROUP BY cls, a), sz AS (SELECT cls, label, count(*) AS k FROM lab GROUP BY cls, label),
per AS (SELECT cls, CAST(sum(k) AS BIGINT) AS methods, count(*) AS lcom4, sum(k * (k - 1) / 2) AS same FROM sz GROUP BY cls), d AS (SELECT cls, count(*) / 2 AS direct FROM pr GROUP BY cls)
SELECT CAST(cls AS BIGINT) AS cls, methods, lcom4, CASE WHEN methods < 2 THEN 1e0 ELSE floor(coalesce(direct, 0) / (methods * (methods - 1) / 2) * 1000 + 0.5e0) / 1000 END AS tcc,
  CASE WHEN methods < 2 THEN 1e0 ELSE floor(same / (methods * (methods - 1) / 2) * 1000 + 0.5e0) / 1000 END AS lcc FROM per LEFT JOIN d USING (cls)""")
def class_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    touches = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("cls"), F.col("s_suppkey").alias("method"), F.col("l_partkey").alias("member"))
    methods = supplier.select(F.col("s_nationkey").alias("cls"), F.col("s_suppkey").alias("method"))
    found = cohesion.class_cohesion(methods, touches)
    return found.select("cls", "methods", "lcom4", half_up(F.col("tcc"), 3).alias("tcc"), half_up(F.col("lcc"), 3).alias("lcc"))


@R.add(r"""SELECT page_id, CASE WHEN url LIKE '%.vue' THEN 'vue' WHEN regexp_matches(t, '@Component\s*\(|@NgModule\s*\(|@Injectable\s*\(') THEN 'angular'
 WHEN regexp_matches(t, 'component\$\s*\(|useSignal\s*\(|useStore\s*\(|useTask\$\s*\(') THEN 'qwik' WHEN regexp_matches(t, 'from [''"]react[''"]|useState|useEffect') THEN 'react' ELSE 'none' END AS framework,
 regexp_matches(t, 'on[A-Z][A-Za-z]+\s*=') AS handlers, regexp_matches(t, 'export\s+(?:async\s+)?(?:function|const)\s+(loader|action|meta)\b') AS route
FROM (SELECT page_id, url, html || CASE page_id % 5 WHEN 0 THEN '@Component ({' WHEN 1 THEN 'useSignal(1)' WHEN 2 THEN 'import x from ''react'' onClick =' WHEN 3 THEN 'export async function loader' ELSE '' END AS t FROM pages)""")
def page_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.array(F.lit("@Component ({"), F.lit("useSignal(1)"), F.lit("import x from 'react' onClick ="), F.lit("export async function loader"), F.lit(""))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", F.element_at(tails, (F.col("page_id") % 5 + 1).cast("int"))).alias("t"))
    t = F.col("t")
    return pages.select("page_id", scans.framework_of(t, F.col("url")).alias("framework"), scans.has_event_handlers(t).alias("handlers"), scans.is_route_module(t).alias("route"))

"""Parsed source files, the metrics of their regions, and saves as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import metrics, text
from sparkloom.operators import aggregates, checks, joins, rules
from sparkloom.operators.session import shared_folder
from sparkloom.plans.registry import Registry, table
from sparkloom.plans.workspace_queries import _FILES_SQL, _files
from sparkloom.sources import parse
from sparkloom.streaming import saves

R = Registry()


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_files(_files(spark, sf_dir).select(F.col("page_id").alias("file_id"), "path", "text"))


@R.add(f"""WITH {_FILES_SQL}, ts AS (SELECT * FROM files WHERE path LIKE '%.ts'), py AS (SELECT * FROM files WHERE path LIKE '%.py')
SELECT CAST(page_id AS VARCHAR) AS file, 'aux_' || page_id AS name, 'constant-block' AS kind, true AS exported, CAST(1 AS BIGINT) AS start_line FROM ts WHERE page_id % 4 = 0
UNION ALL SELECT CAST(page_id AS VARCHAR), 'load_' || page_id, 'utility-function', true, 1 FROM ts WHERE page_id % 4 = 1
UNION ALL SELECT CAST(page_id AS VARCHAR), 'T' || (page_id % 9), 'class', true, 2 FROM files WHERE page_id % 4 = 1
UNION ALL SELECT CAST(page_id AS VARCHAR), 'hidden', 'constant-block', false, 1 FROM ts WHERE page_id % 4 = 3""")
def parsed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.regions_of(_parsed(spark, sf_dir)).select("file", "name", "kind", "exported", "start_line")


@R.add(f"""WITH {_FILES_SQL} SELECT CAST(page_id AS VARCHAR) AS file, CASE page_id % 4 WHEN 0 THEN './pkg' ELSE 'lib' END || (page_id % 9) AS specifier, CASE page_id % 4 WHEN 0 THEN 'x' ELSE 'a' END AS alias,
 CASE page_id % 4 WHEN 0 THEN 'default' ELSE 'named' END AS form, CAST(CASE page_id % 4 WHEN 0 THEN 2 ELSE 3 END AS BIGINT) AS line FROM files WHERE path LIKE '%.ts' AND page_id % 4 < 2""")
def parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.imports_of(_parsed(spark, sf_dir)).select("file", "specifier", "alias", "form", "line")


_UNIT = """import React, {{ useState }} from 'react';
export const LIMIT_{0} = {0};
export function useThing{0}(seed: number) {{
  const [value, setValue] = useState(seed);
  if (value > LIMIT_{0} && seed) {{ setValue(0); }} else {{ setValue(1); }}
  return value;
}}
export default function Panel{0}(props: Props{0}) {{
  const value = useThing{0}({0});
  return <div className="p">{{value ? <b>{{value}}</b> : null}}</div>;
}}
export interface Props{0} {{ title: string }}
class Store{0} extends Base{0} {{ get() {{ return helper{0}(this.x); }} }}
function debug{0}() {{ console.log({0}); useThing{0}(1); }}
function helper{0}(x) {{ for (const k of x) {{ if (k) {{ return k; }} }} return LIMIT_{0}; }}
"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component file for each nation, its names told apart by the nation's key."""
    first, *rest = _UNIT.replace("{{", "{").replace("}}", "}").split("{0}")
    key = F.col("n_nationkey").cast("string")
    code = F.concat(F.lit(first), *[x for part in rest for x in (key, F.lit(part))])
    return parse.parse_files(table(spark, sf_dir, "nation").select(key.alias("file_id"), F.lit("unit.tsx").alias("path"), code.alias("text")))


def _decls(parsed: DataFrame) -> DataFrame:
    return parse.regions_of(parsed).select("file", "region", "name", "kind", F.col("ordinal"), "exported")


@R.add("""WITH e AS (SELECT unnest(['useThing', 'Panel', 'Panel', 'Store', 'helper', 'debug']) AS f, unnest(['LIMIT_', 'useThing', 'Props', 'helper', 'LIMIT_', 'useThing']) AS t,
 unnest(['reference', 'call', 'type', 'call', 'reference', 'call']) AS edge_type, unnest([0.2, 0.42, 0.01, 0.27, 0.2, 0.42]) AS strength)
SELECT CAST(n_nationkey AS VARCHAR) AS file, f || n_nationkey AS f, t || n_nationkey AS t, edge_type, CAST(strength AS DOUBLE) AS strength FROM nation, e""")
def parsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text to dependency edges: parse, resolve and aggregate."""
    parsed = _units(spark, sf_dir)
    decls = _decls(parsed)
    edges = joins.aggregate_edges(joins.resolve_usages(parse.usages_of(parsed), parse.bindings_of(parsed), decls))
    names = decls.select(F.col("file").alias("nf"), F.col("region").alias("nr"), "name")
    out = edges.join(names.withColumnRenamed("name", "fn"), (F.col("file") == F.col("nf")) & (F.col("f") == F.col("nr"))).drop("nf", "nr")
    out = out.join(names.withColumnRenamed("name", "tn"), (F.col("file") == F.col("nf")) & (F.col("t") == F.col("nr")))
    return out.select("file", F.col("fn").alias("f"), F.col("tn").alias("t"), "edge_type", "strength")


@R.add("""WITH k AS (SELECT unnest(['LIMIT_', 'useThing', 'Panel', 'Props', 'Store', 'helper', 'debug']) AS name, unnest([0, 3, 1, 0, 0, 3, 0]) AS cognitive)
SELECT CAST(n_nationkey AS VARCHAR) AS file, name || n_nationkey AS name, CAST(cognitive AS BIGINT) AS cognitive FROM nation, k""")
def cognitive_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.regions_of(_units(spark, sf_dir)).select("file", "name", "cognitive")


@R.add()
def parsed_halstead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halstead numbers from scanned tokens; held against hand counts in the tests."""
    r = parse.regions_of(_units(spark, sf_dir))
    counts = [F.size(F.array_distinct("operators")), F.size(F.array_distinct("operands")), F.size("operators"), F.size("operands")]
    return r.select("file", "name", *[c.alias(n) for n, c in metrics.halstead(*counts).items()])


@R.add()
def parsed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from source text to a rating of each file."""
    r = parse.regions_of(_units(spark, sf_dir))
    measured = aggregates.region_metrics(r, "text", F.col("kind"), F.size("hook_flags"))
    return aggregates.file_metrics(measured, "file")


@R.add("""SELECT CAST(n_nationkey AS VARCHAR) AS file, 'debug' || n_nationkey AS region, unnest(['Console Logging', 'Hook Called Outside Component/Hook']) AS name, unnest(['low', 'critical']) AS severity FROM nation""")
def parsed_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = parse.regions_of(_units(spark, sf_dir))
    r = r.withColumns(
        {"line_count": F.col("end_line") - F.col("start_line") + 1, "loose_cc": metrics.loose_cyclomatic(F.col("text")), "nesting": text.max_bracket_depth(F.col("text")), "path": F.lit("unit.tsx"), "imports": F.array(F.lit("react"))}
    )
    found = rules.hits(r.withColumn("region_name", F.col("name")), ["file", "region_name"], rules.CODE_RULES).select("file", F.col("region_name").alias("region"), "name", "severity")
    hooks = r.select("file", F.col("name").alias("region"), F.explode("hook_flags").alias("name"), F.lit("critical").alias("severity"))
    return found.unionByName(hooks)


@R.add("""SELECT user_id AS key, event_id AS ord, coalesce(event_type = lag(event_type) OVER w AND epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000, false) AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stream_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, read as a stream of saves, against a keyed store with a time to live."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return saves.run_to_end(saves.cache_hits(stream, "user_id", "ts", "event_id", "event_type"), shared_folder(spark))


_HOLDERS = [
    # An object: two functions, of which one has a doc comment, and members that are none.
    "export const api{0} = {\n  base: '/v{0}',\n  /** Gets one.\n   *  @returns it */\n  get{0}: async (id: string) => {\n    const r = await fetch(id);\n    return r.json();\n  },\n"
    "  'put-it': function (x) {\n    return useThing(x);\n  },\n  short() { return 1; },\n  [computed]: () => 2,\n  nested: { deep: () => 3 },\n  list: [() => 4],\n};\n",
    # A namespace: an exported and an inner function, a constant and one that holds a function.
    "namespace Fmt{0} {\n  const unit = {0};\n\n  export function money(n: number) {\n    return n * unit;\n  }\n\n  export const withTax = (n: number) => {\n    return n + unit;\n  };\n\n"
    "  function hidden() {\n    return 0;\n  }\n}\n",
    # One function only, however long, and a short object.
    "export const one{0} = {\n  a: () => {\n" + "    step();\n" * 15 + "  },\n};\nexport const few{0} = { a: () => 1, b: () => 2 };\n",
    # A component, a provider and a hook; JSX alone would make all of it a component, which stays whole.
    "const views{0} = {\n" + "  // view\n" * 12 + "  Row: () => <tr><td>{x}</td></tr>,\n  rowProvider: (x) => x,\n  useRow: () => useState(1),\n};\n",
]


#: Files that a task parses; a small table of keys is few partitions and much work.
FILES_A_TASK = 2000


def _holder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with an object or namespace of functions for each customer; its form goes by the key."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(key)
    customers = customers.repartition(customers.count() // FILES_A_TASK + 1)
    code = F.element_at(F.array(*[F.replace(F.lit(h), F.lit("{0}"), key.cast("string")) for h in _HOLDERS]), (key % 4 + 1).cast("int"))
    return customers.select(key.cast("string").alias("file_id"), F.lit("holder.tsx").alias("path"), code.alias("text"))


_PARTS_SQL = """parts AS (SELECT * FROM (VALUES
 (0, 0, 'get#', 'utility-function', 3, 8, true, false, false, true), (0, 1, 'put-it', 'utility-function', 9, 11, true, false, true, false),
 (1, 0, 'Fmt#.money', 'utility-function', 4, 6, true, false, false, false), (1, 1, 'Fmt#.withTax', 'hoc', 8, 10, true, false, false, false), (1, 2, 'Fmt#.hidden', 'utility-function', 12, 14, false, false, false, false),
 (3, 0, 'Row', 'react-component', 14, 14, false, true, false, false), (3, 1, 'rowProvider', 'context-provider', 15, 15, false, false, false, false), (3, 2, 'useRow', 'hook', 16, 16, false, false, true, false)
) AS v(form, ordinal, name, kind, start_line, end_line, exported, has_jsx, has_hooks, has_async))"""


@R.add(f"""WITH {_PARTS_SQL} SELECT CAST(c_custkey AS VARCHAR) AS file, CAST(ordinal AS BIGINT) AS ordinal, replace(name, '#', CAST(c_custkey AS VARCHAR)) AS name, kind, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, exported, has_jsx, has_hooks, has_async
FROM customer JOIN parts ON c_custkey % 4 = form""")
def parsed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of objects and namespaces as regions of their own."""
    regions = parse.regions_of(parse.parse_files(_holder_files(spark, sf_dir))).withColumn("path", F.lit("holder.tsx"))
    return parse.parts_of(regions).select("file", "ordinal", "name", "kind", "start_line", "end_line", "exported", "has_jsx", "has_hooks", "has_async")


@R.add(f"""WITH {_PARTS_SQL}, k AS (SELECT c_custkey AS c, CAST(c_custkey AS VARCHAR) AS file FROM customer)
SELECT file, replace(name, '#', file) AS name FROM k JOIN parts ON c % 4 = form UNION ALL SELECT file, unnest(['one', 'few']) || file FROM k WHERE c % 4 = 2""")
def replaced_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of each file, those that hold several functions replaced by them."""
    return parse.replaced_regions(_holder_files(spark, sf_dir)).select("file", "name")


_COPIES = [
    # Renamed copies with other literals; copies but for an operator; runs of only two statements.
    ("const total = price * {0};\n  const label = 'total of the order';\n  report(total, label);", "const sum = cost * 77;\n  const name = 'another text altogether';\n  print(sum, name);"),
    ("const total = price * {0};\n  const label = 'total of the order';\n  report(total, label);", "const sum = cost + 77;\n  const name = 'another text altogether';\n  print(sum, name);"),
    ("const total = price * {0} + 'a long text to pass the bound of sixty';\n  report(total);", "const sum = cost * 77 + 'a long text to pass the bound of sixty';\n  print(sum);"),
]


@R.add("""SELECT CAST(c_custkey AS VARCHAR) AS file, 'Duplicate Logic Detected' AS name, 'high' AS severity, CAST(1 AS BIGINT) AS groups, 'left,right' AS affected FROM customer WHERE c_custkey % 3 = 0""")
def parsed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a file that share statements up to names and literals."""
    key = F.col("c_custkey")
    files = [f"function left() {{\n  {a}\n}}\nfunction right() {{\n  {b}\n}}\n" for a, b in _COPIES]
    code = F.element_at(F.array(*[F.replace(F.lit(t), F.lit("{0}"), key.cast("string")) for t in files]), (key % 3 + 1).cast("int"))
    parsed = parse.parse_files(table(spark, sf_dir, "customer").select(key.cast("string").alias("file_id"), F.lit("copy.ts").alias("path"), code.alias("text")))
    prints = parse.regions_of(parsed).select("file", F.col("name").alias("region"), F.explode("fingerprints").alias("fingerprint"))
    return checks.duplicate_logic(prints).withColumn("affected", F.array_join("affected", ","))

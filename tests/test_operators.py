"""Joins, graphs, rules, snapshots and the parser on small relations; permuted and empty inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, cohesion, graph, incremental, joins, rules, workspace
from sparkloom.sources import parse, scans, sinks

U = "file bigint, region bigint, symbol string, kind string"
D = "file bigint, region bigint, name string, kind string, ordinal bigint, exported boolean"


def edges_of(spark, usages, bindings=()):
    used = spark.createDataFrame(usages, U)
    bound = spark.createDataFrame(list(bindings), "file bigint, region bigint, symbol string")
    decls = spark.createDataFrame([(1, 1, "A", "hook", 1, True), (1, 2, "B", "utility-function", 2, True), (1, 3, "C", "class", 3, False), (1, 4, "B", "utility-function", 4, True)], D)
    found = joins.aggregate_edges(joins.resolve_usages(used, bound, decls))
    return {(r.f, r.t): (r.edge_type, r.strength, r.type_only) for r in found.collect()}


def test_edge_strengths(spark):
    usages = [(1, 1, "B", "call"), (1, 1, "C", "inheritance"), (1, 2, "C", "type"), (1, 3, "A", "call"), (1, 3, "A", "call"), (1, 3, "Z", "call"), (2, 1, "B", "call")]
    found = edges_of(spark, usages, [(1, 3, "Q")])
    assert found == {(1, 4): ("call", 0.27, False), (1, 3): ("inheritance", 0.4, False), (2, 3): ("type", 0.02, True), (3, 1): ("call", 0.84, False)}
    assert edges_of(spark, usages[:1], [(1, 1, "B")]) == {} and edges_of(spark, []) == {}
    assert edges_of(spark, usages[::-1]) == found


def reach(edges):
    out = set(edges)
    while True:
        new = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not new:
            return out
        out |= new


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = {(a, b) for a, b in [(rng.randrange(9), rng.randrange(9)) for _ in range(14)] if a != b}
    edges, nodes = spark.createDataFrame(sorted(pairs), "f bigint, t bigint"), spark.createDataFrame([(i,) for i in range(10)], "node bigint")
    want = reach(pairs)
    dist = graph.distances(edges)
    assert {(r.a, r.b) for r in dist.collect()} == want
    scc = {r.node: r.scc for r in graph.strong_components(nodes, edges).collect()}
    assert scc == {n: min([n, *[m for m in range(10) if (n, m) in want and (m, n) in want]]) for n in range(10)}
    for r in graph.shortest_paths(edges).collect():
        assert len(r.path) == r.d + 1 and all(p in pairs for p in zip(r.path, r.path[1:])) and (r.path[0], r.path[-1]) == (r.a, r.b)
    dag = {(a, b) for a, b in pairs if a < b}
    levels = {r.node: r.level for r in graph.topological_levels(nodes, edges.where("f < t")).collect()}
    assert all(levels[a] < levels[b] for a, b in dag) and None not in levels.values()
    cyclic = {n for n in range(10) if (n, n) in want}
    behind = {b for a, b in want if a in cyclic} | cyclic
    assert {r.node for r in graph.topological_levels(nodes, edges).where("level is null").collect()} == behind
    longest = [r.node for r in graph.longest_path(nodes, edges.where("f < t")).orderBy("position").collect()]
    best = max((p for k in range(1, 10) for p in itertools.combinations(range(10), k) if all(x in dag for x in zip(p, p[1:]))), key=len)
    assert len(longest) == len(best)


def test_cycle_and_termination(spark):
    edges = spark.createDataFrame([("A", "C"), ("C", "B"), ("B", "A")], "f string, t string")
    found = graph.indirect_cycles(graph.shortest_paths(edges)).collect()
    assert {(r.a, r.b) for r in found} == {("A", "B"), ("A", "C"), ("B", "C")} and all(r.path[0] == r.path[-1] == r.a for r in found)
    with pytest.raises(RuntimeError):
        graph.longest_path(spark.createDataFrame([("A",)], "node string"), edges, max_rounds=5)
    none = spark.createDataFrame([], "f string, t string")
    assert graph.distances(none).count() == 0


def test_band_join_and_ranges(spark):
    rng = random.Random(5)
    a, b = [(i, rng.randrange(60)) for i in range(60)], [(i, rng.randrange(60)) for i in range(60)]
    left, right = spark.createDataFrame(a, "i bigint, x bigint").withColumn("k", F.col("i") % 2), spark.createDataFrame(b, "j bigint, y bigint").withColumn("k", F.col("j") % 2)
    found = joins.band_join(left, right, ["k"], "x", "y", 3).select("i", "j").collect()
    assert sorted(map(tuple, found)) == sorted((i, j) for i, x in a for j, y in b if i % 2 == j % 2 and abs(x - y) <= 3)
    lines = spark.createDataFrame([(1, n) for n in range(200)] + [(2, 5)], "f bigint, n bigint")
    ranges = spark.createDataFrame([(1, 10, 20), (1, 15, 150), (1, 9, 3)], "f bigint, a bigint, z bigint")
    assert sorted(map(tuple, joins.outside_ranges(lines, ranges, "f", "n", "a", "z").collect())) == [(1, n) for n in range(200) if not 10 <= n <= 150] + [(2, 5)]


def test_cochange(spark):
    history = spark.createDataFrame([("A", c) for c in "123"] + [("B", c) for c in "12"] + [("C", "9"), ("A", "1"), (None, "1")], "region string, commit string")
    assert [(r.a, r.b, r.shared, round(r.coupling, 3)) for r in joins.cochange_pairs(history, 0.6).collect()] == [("A", "B", 2, 0.667)]
    edges = spark.createDataFrame([("A", "B", "call", 0.8)], "f string, t string, edge_type string, strength double")
    found = {(r.f, r.t): (r.edge_type, round(r.strength, 3)) for r in joins.upsert_cochange(edges, spark.createDataFrame([("A", "B", 0.6)], "a string, b string, coupling double")).collect()}
    assert found == {("A", "B"): ("call", 1.0), ("B", "A"): ("cochange", 0.6)}


def test_cohesion(spark):
    methods = spark.createDataFrame([("K", m) for m in "abcd"] + [("L", "z")], "cls string, method string")
    touches = spark.createDataFrame([("K", "a", "x"), ("K", "b", "x"), ("K", "c", "y")], "cls string, method string, member string")
    found = {r.cls: (r.methods, r.lcom4, round(r.tcc, 3), round(r.lcc, 3)) for r in cohesion.class_cohesion(methods, touches).collect()}
    assert found == {"K": (4, 3, 0.167, 0.167), "L": (1, 1, 1.0, 1.0)}
    calls = spark.createDataFrame([("K", "c", "a")], "cls string, method string, callee string")
    assert {r.cls: r.lcom4 for r in cohesion.class_cohesion(methods, touches, calls).collect()} == {"K": 2, "L": 1}
    groups = cohesion.suggested_groups(cohesion.method_components(methods, touches), touches)
    assert groups.where("array_contains(methods, 'a')").first().fields == ["x"]


def test_incremental(spark):
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    current = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2"), ("f", "c", "3"), ("g", "d", "4")], "file string, name string, hash string")
    old = spark.createDataFrame([("f", "a", "1", "2024-01-01 09:45:00"), ("f", "b", "x", "2024-01-01 09:59:00"), ("f", "c", "3", "2024-01-01 09:30:00")], "file string, name string, hash string, t string")
    old = old.select("file", "name", "hash", F.col("t").cast("timestamp").alias("last_read"))
    diff = incremental.cache_diff(current, old, now)
    assert {r.name: r.cached for r in diff.collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert incremental.cache_stats(diff).first().hit_rate == 0.25
    kept = incremental.store(old, old.where("name = 'a'").withColumn("hash", F.lit("9")), ["file", "name"])
    assert {r.name: r.hash for r in kept.collect()} == {"a": "9", "b": "x", "c": "3"}
    assert incremental.invalidate(kept, spark.createDataFrame([("f",)], "file string")).count() == 0
    files = spark.createDataFrame([("f", "1"), ("g", "2")], "file string, hash string")
    assert {r.file: r.graph_dirty for r in incremental.graph_dirty(files, files.where("file = 'f'")).collect()} == {"f": False, "g": True}


CODE = {
    "God Component": ("react-component", "useState useEffect fetch( x.map( "), "Magic Numbers": ("class", "a(100, 200, 300, 400, 500)"), "SetState Outside Effect": ("react-component", "<div/> setState(1)"),
    "Missing useEffect Dependency Array": ("hook", "useEffect(() => { x })"), "Prop Drilling": ("react-component", "props.a.b.c props.d.e.f"), "Async useEffect": ("hook", "useEffect(async () => {}, [])"),
    "Long Switch Statement": ("class", "case " * 9), "TODO/FIXME Debt": ("class", "// TODO\n// FIXME\n// XXX"), "Excessive `any` Usage": ("class", "a: any, b: any, c: any"), "Non-null Assertion Abuse": ("class", "a!.b a!.b a!.b a!.b"),
}


def test_code_rules(spark):
    rows = [(n, k, t, 10, 1, 0, "r", "a.ts", ["x"]) for n, (k, t) in CODE.items()] + [("clean", "class", "const a = 0.25", 10, 1, 0, "r", "a.ts", ["x"]), ("big", "class", "x", 201, 21, 9, "r", "a.ts", ["x"])]
    df = spark.createDataFrame(rows, "id string, kind string, text string, line_count int, loose_cc int, nesting int, name string, path string, imports array<string>")
    found = {}
    for r in rules.hits(df.withColumnRenamed("name", "name"), ["id"], rules.CODE_RULES).collect():
        found.setdefault(r.id, set()).add(r.name)
    assert all(n in found[n] for n in CODE) and "clean" not in found
    assert found["big"] == {"Oversized Module (>200 lines)", "Extreme Nesting (>8 levels)", "Extreme Cyclomatic Complexity (>20)"}
    assert len(rules.CODE_RULES) + 3 + 2 == 26 and len(rules.VUE_RULES + rules.ANGULAR_RULES + rules.SVELTE_RULES) == 30


def test_framework_rules(spark):
    vue = "<script>export default { data() { return {} }, methods: {}, computed: {}, watch: {}, props: {} }</script><template><i v-for='a in b'>{{ " + "x" * 70 + " }}</i></template>"
    ng = "@Component({ template: `\n\n\n\n\n\n` })\nclass A {\n  ngOnInit() {\n" + "    a();\n" * 16 + "  }\n}"
    svelte = "<script>" + "\n$: a = 1" * 7 + "</script><p/>"
    names = lambda t, k: {r.name for r in rules.framework_hits(spark.createDataFrame([(1, t)], "id int, text string"), ["id"], k).collect()}
    assert {"Options API God Component", "Vue Composition API Migration Guide", "Missing :key on v-for"} <= names(vue, "vue")
    assert {"Long Inline Angular Template", "Complex ngOnInit", "Missing OnPush Change Detection"} <= names(ng, "angular")
    assert names(svelte, "svelte") == {"Excessive $: Reactive Statements"} and names(vue, "react") == set()


SOURCE = """import React, { useState as us } from 'react';
import './side.css';
// a counter
export const MAX_N = 5, other = () => 3;
export interface Props { title: string }
enum Color { Red }
/** Doc */
export function useCounter(start: number) {
  if (start) { for (;;) { useThing(); } }
  return `v ${start + 1} y`;
}
export default function Card({ title }: Props) {
  const c = useCounter(1);
  return <div onClick={() => c.set(1)}>It's {title} <Row/> text</div>;
}
@Injectable({ a: 1 })
export class Service extends Base implements Thing { run() { return new Helper(); } }
const lazy = async () => { const m = await import('./mod'); return /ab+c'/g; };
"""


def test_parser(spark):
    files = spark.createDataFrame([("1", "a.tsx", SOURCE), ("2", "b.py", "class Foo {\n}\nx"), ("3", "c.svelte", "<p>it's</p>\n<script>\nexport const N_A = 1\n</script>"), ("4", None, None)], "file_id string, path string, text string")
    parsed = parse.parse_files(files)
    r = {(x.file, x.name): x for x in parse.regions_of(parsed).collect()}
    kinds = {n: x.kind for (f, n), x in r.items() if f == "1"}
    assert kinds == {"MAX_N": "constant-block", "other": "utility-function", "Props": "type-block", "Color": "enum", "useCounter": "hook", "Card": "react-component", "Service": "class", "lazy": "utility-function"}
    card, hook = r["1", "Card"], r["1", "useCounter"]
    assert card.is_default and card.has_jsx and card.has_hooks and not card.has_async and r["1", "lazy"].has_async and hook.comment == "Doc" and r["1", "MAX_N"].comment == "a counter"
    assert (r["1", "Service"].start_line, hook.start_line, hook.end_line) == (16, 8, 11) and hook.cognitive == 3 and "Hook Called Inside Loop" in hook.hook_flags and "Hook Called Inside Condition" in hook.hook_flags
    assert r["2", "Foo"].kind == "class" and r["3", "N_A"].start_line == 3
    used = {(x.symbol, x.kind) for x in parse.usages_of(parsed).where("file = '1'").collect()}
    assert {("Base", "inheritance"), ("Thing", "inheritance"), ("Helper", "call"), ("Props", "type"), ("useCounter", "call"), ("Row", "reference")} <= used and ("text", "reference") not in used
    assert {x.symbol for x in parse.bindings_of(parsed).where("region = 5 and file = '1'").collect()} == {"Card", "title", "c"}
    imports = {(x.specifier, x.alias, x.form) for x in parse.imports_of(parsed).collect()}
    assert imports == {("react", "React", "default"), ("react", "us", "named"), ("./side.css", None, "side_effect"), ("./mod", None, "dynamic")}
    assert parse.parse_files(files.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("function f() { return 1; }", 0), ("function f() { if (a) { x() } else { y() } }", 2), ("if (a && b || c) {}", 3), ("a && b && c", 1), ("for (;;) { if (x) { while (y) {} } }", 6), ("try {} catch (e) { if (a) {} }", 3),
        ("function f() { return a ? b : c; }", 1), ("if (!(a)) {}", 2), ("if (!a) {}", 1), ("switch (a) { case 1: if (b) {} }", 3), ("outer: for (;;) { break outer; }", 2), ("if (a) { xs.map(x => { if (x) {} }) }", 6),
    ],
)
def test_cognitive(code, want):
    assert parse.cognitive(code) == want


def test_fingerprints_ignore_names():
    body = "const {0} = load({1}, 'first part');\n  const {2} = {0}.map(({3}) => {3} + 1);\n  return combine({0}, {2}, 'second part');"
    a, b = (parse.parse_source("x.ts", "function f(" + n[1] + ") {\n  " + body.format(*n) + "\n}") for n in (("aaa", "bbb", "ccc", "ddd"), ("one", "two", "three", "four")))
    assert set(a["regions"][0]["fingerprints"]) & set(b["regions"][0]["fingerprints"])


def test_halstead_ignores_the_content_of_strings(spark):
    a, b = (parse.parse_source("x.ts", f"function f() {{ return g('{s}', 1); }}")["regions"][0] for s in ("x", "yy"))
    assert a["operators"] == b["operators"] and len(a["operands"]) == len(b["operands"])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text("export const q = 1\nimport { z } from 'w'\n")
    (tmp_path / "src" / "node_modules" / "b.ts").write_text("export const q = 1")
    found = scans.scan_workspace(scans.read_files(spark, str(tmp_path / "src"), "*.ts")).collect()
    assert [(r.exports, r.imports, r.line_count, r.is_barrel) for r in found] == [(["q"], ["w"], 3, False)]
    planned = spark.createDataFrame([("a.ts", "x"), ("n.ts", "y")], "path string, content string")
    existing = spark.createDataFrame([("a.ts",)], "path string")
    status = sinks.apply_plan(planned, existing, str(tmp_path / "out"))
    assert dict(status.collect()) == {"a.ts": "skipped", "n.ts": "created"} and spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        sinks.apply_plan(planned.where("path = 'a.ts'"), existing, str(tmp_path / "out2"))
    assert "&lt;" in sinks.html_table(spark.createDataFrame([("<",)], "c string"))


def test_merge_finds_what_a_full_cross_would(spark):
    files = spark.createDataFrame([("f1", ["loadUser"], [], ["hook"], 10, False, "react"), ("f2", ["x"], ["lib/useauth"], ["class"], 300, False, "none"), ("f3", ["useAuthX"], [], [], 10, True, "none")], "path string, exports array<string>, imports array<string>, kinds array<string>, line_count bigint, is_barrel boolean, framework string")
    regions = spark.createDataFrame([(1, "useAuth", "hook", ["loadUser", "x"], "s")], "region bigint, name string, kind string, used array<string>, source_path string")
    found = {r.path: (r.score, r.shared, r.too_long) for r in workspace.merge_suggestions(regions, files, least=0.2).collect()}
    assert found == {"f1": (0.55, 1, False), "f2": (0.25, 1, True)} or found["f1"][0] == 0.55
    assert workspace.merge_suggestions(regions.limit(0), files).count() == 0


def test_empty_aggregates(spark):
    none = spark.createDataFrame([], "source string, effort double, text string")
    assert aggregates.calibrated_thresholds(none, "source", "effort").count() == 0 and aggregates.repeated_words(none, "source", "text", "a").count() == 0

"""Files around a file, project files, parts of regions, duplicate logic, candidates to merge with, and saves as a stream."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import checks, graph, workspace
from sparkloom.sources import parse, projects
from sparkloom.streaming import saves


def test_globs(spark):
    paths = ["index.ts", "a/index.ts", "a/b/useX.tsx", "use.js", "a/x.test.ts", "a/node_modules/index.ts", "out/index.ts", "indexxts", None, ""]
    files = spark.createDataFrame([(p,) for p in paths * 2], "path string")
    found = lambda *p: sorted(r.path for r in projects.matching(files, list(p)).collect())
    assert found("**/index.ts") == ["a/index.ts", "index.ts"] and found("a/*/use*.{ts,tsx}", "use.?s") == ["a/b/useX.tsx", "use.js"]
    assert found("a/*") == ["a/index.ts", "a/x.test.ts"] and found("**/*.ts", "**/index.ts") == ["a/index.ts", "a/x.test.ts", "index.ts"]
    assert projects.near_files(files.limit(0), files).count() == 0 and projects.file_roles(files.where("path = ''")).count() == 0


@pytest.mark.parametrize("path, want", [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a/../..", "../.."), ("", ""), (".", ""), ("/a/../b", "/b"), ("a/b/../..", "")])
def test_normal_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(projects.normal_path(F.col("p"))).first()[0] == want


def test_configs(spark):
    rows = [("tsconfig.json", '{"extends": "./a", "compilerOptions": {}}'), ("a.json", '{"extends": "./tsconfig.json"}'), ("x/tsconfig.json", None), ("y/tsconfig.json", ""), ("y/z/other.json", "{}")]
    found = projects.nearest_configs(spark.createDataFrame([("x/f.ts", 1), ("q/r/f.ts", 2), ("y/z/f.ts", 3), (None, 4)], "path string, n int"), projects.read_configs(spark.createDataFrame(rows, "path string, text string")))
    assert {r.n: (r.config, r.base_url, r.strict) for r in found.collect()} == {1: ("x/tsconfig.json", "x", None), 2: ("tsconfig.json", "", None), 3: ("y/tsconfig.json", "y", None), 4: (None, None, None)}
    none = projects.nearest_configs(spark.createDataFrame([("f.ts",)], "path string"), projects.read_configs(spark.createDataFrame([], "path string, text string")))
    assert [r.config for r in none.collect()] == [None]


def test_git_logs(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    for text in ("a\nb\n", "a\nc\n"):
        (tmp_path / "f.ts").write_text(text)
        run("add", "f.ts")
        run("commit", "-q", "-m", "x")
    commits = run("log", "--format=%H").split()
    regions = spark.createDataFrame([("first", "f.ts", 1, 1), ("second", "f.ts", 2, 2), ("none", "g.ts", 1, 1)], "region string, path string, first int, last int")
    found = {(r.region, r.commit) for r in projects.region_commits(projects.git_logs(regions, str(tmp_path))).collect()}
    assert found == {("first", commits[1]), ("second", commits[0]), ("second", commits[1])}


def test_parts():
    lines = "\n".join(["  // x"] * 14)
    assert parse.region_parts("o", "utility-function", "o.ts", f"const o = {{\n{lines}\n a: () => 1,\n b: async x => {{ await x; }},\n}};", True)[1]["has_async"]
    assert parse.region_parts("o", "class", "o.ts", f"const o = {{\n{lines}\n a: () => 1, b: () => 2 }};", True) == []
    assert parse.region_parts("N", "namespace", "o.ts", f"namespace N {{\n{lines}\n function a() {{}}\n}}", True) == []
    assert parse.region_parts("N", "namespace", "o.ts", "", True) == [] and parse.region_parts("o", "constant-block", "o.ts", f"const o = {{{lines}", False) == []


def test_duplicate_logic(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 2, "a"), (1, 3, "b"), (1, 3, "b"), (2, 1, "a"), (1, 4, None), (1, 5, "c"), (1, 1, "c")]
    found = checks.duplicate_logic(spark.createDataFrame(rows, "file int, region int, fingerprint string"))
    assert [(r.file, r.groups, r.affected) for r in found.collect()] == [(1, 2, [1, 2, 5])]
    hits = spark.createDataFrame([(3, 1, "x", "low")], "file int, region int, name string, severity string")
    assert {(r.file, r.name, tuple(r.affected)) for r in checks.file_hits(found, hits).collect()} == {(1, checks.DUPLICATE_RULE, (1, 2, 5)), (3, "x", (1,))}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_long_chains_and_cycles(spark, seed):
    rng = random.Random(seed)
    ids = list(range(40))
    rng.shuffle(ids)
    pairs = [*zip(ids[:15], ids[1:16]), *zip(ids[16:26], [*ids[17:26], ids[16]]), (ids[3], ids[16]), *zip(ids[26:30], [*ids[27:30], ids[26]]), (ids[20], ids[26]), (ids[31], ids[31])]
    found = graph.strong_components(spark.createDataFrame([(i,) for i in ids], "node int"), spark.createDataFrame(pairs, "f int, t int")).collect()
    rings = [set(ids[16:26]), set(ids[26:30])]
    ring = lambda n: next((r for r in rings if n in r), {n})
    assert {(r.node, r.scc, r["size"]) for r in found} == {(n, min(ring(n)), len(ring(n))) for n in ids} and len(found) == 40
    assert graph.strong_components(spark.createDataFrame([], "node int"), spark.createDataFrame([], "f int, t int")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_suggestions_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    names, kinds = ["load", "save", "useThing", "Ab", "x"], ["hook", "class", "react-component"]
    files = [(f"f{i}", rng.sample(names, rng.randrange(4)), rng.sample(["./load", "./thing"], rng.randrange(3)), rng.sample(kinds, rng.randrange(4)), rng.choice([10, 100, 190]), i % 9 == 0, rng.choice(["react", "none"])) for i in range(25)]
    regions = [(i, rng.choice(names), rng.choice(kinds), rng.sample(names, 2), f"f{rng.randrange(25)}") for i in range(12)]
    want = {}
    for r, name, kind, used, own in regions:
        scored = []
        for path, exports, imports, has, lines, barrel, framework in files:
            if barrel or path == own or name in exports:
                continue
            near = any(name.lower()[:4] in e.lower() or e.lower()[:4] in name.lower() for e in exports)
            points = 30 * (kind in has) + 20 * near + min(30, 10 * len(set(used) & set(exports))) + 10 * (kind in ("hook", "react-component") and framework == "react") + 15 * any(name.lower() in i for i in imports) + 5 * (lines < 80)
            if points >= 25:
                scored.append((-min(points, 100), path))
        want[r] = [(p, -s) for s, p in sorted(scored)[:3]]
    found = workspace.merge_suggestions(
        spark.createDataFrame(regions, "region int, name string, kind string, used array<string>, source_path string"),
        spark.createDataFrame(files, "path string, exports array<string>, imports array<string>, kinds array<string>, line_count int, is_barrel boolean, framework string"),
    ).collect()
    got = {r[0]: [] for r in regions}
    for row in sorted(found, key=lambda x: x["rank"]):
        got[row.region].append((row.path, round(row.score * 100)))
    assert got == want


SAVES = "key bigint, ord bigint, at timestamp, hash string"


def saved(spark, folder, rows):
    spark.createDataFrame(rows, "key bigint, ord bigint, at string, hash string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_tombstones_and_silence(spark, tmp_path):
    folder = str(tmp_path / "in")
    saved(spark, folder, [(1, 1, "2024-01-01 10:00:00", "a"), (1, 2, "2024-01-01 10:01:00", "a"), (1, 3, "2024-01-01 10:02:00", None), (1, 4, "2024-01-01 10:03:00", "a"), (2, 5, "2024-01-01 10:00:00", None), (1, 6, "2024-01-01 10:40:00", "a")])
    stream = spark.readStream.schema(SAVES).parquet(folder)
    for n, lateness in enumerate((None, "5 minutes")):
        out = saves.run_to_end(saves.cache_hits(stream, "key", "at", "ord", "hash", lateness=lateness), str(tmp_path / f"out{n}"))
        assert {r.ord: r.hit for r in out.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_on_save_takes_each_file_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    count = lambda batch: batch.groupBy("hash").agg(F.count("*").alias("n"))
    schema = spark.createDataFrame([], SAVES).schema
    for rows in ([(1, 1, "2024-01-01 10:00:00", "a"), (1, 2, "2024-01-01 10:00:00", "a")], [(1, 3, "2024-01-01 10:00:00", "b")]):
        saved(spark, folder, rows)
        saves.on_save(spark, folder, schema, count, out, state).awaitTermination()
    assert {(r.hash, r.n) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 1)}
    assert saves.on_save(spark, folder, schema, count, out, state, enabled=False) is None

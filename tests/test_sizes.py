"""Copies must not be paired, and no file be parsed more often than once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import symbols, workspace
from sparkloom.plans import code_queries
from sparkloom.sources import parse

REGIONS = "region int, name string, kind string, used array<string>, source_path string"
FILES = "path string, exports array<string>, imports array<string>, kinds array<string>, line_count int, is_barrel boolean, framework string"


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    time.sleep(1)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_merge_suggestions_pair_no_copies(spark):
    # All files are alike and export another name that the regions use; half the regions are barred from all of them.
    files = [(f"f{i:04d}", ["alpha", "beta"], ["./alpha"], ["hook"], 10, False, "react") for i in range(1500)]
    regions = [(i, ("alpha", "alphabet")[i % 2], "hook", ["beta"], f"f{i:04d}") for i in range(1500)]
    before = shuffled(spark)
    found = workspace.merge_suggestions(spark.createDataFrame(regions, REGIONS), spark.createDataFrame(files, FILES)).collect()
    assert shuffled(spark) - before < 1_000_000
    want = {(i, f"f{p:04d}", rank) for i in range(1, 1500, 2) for rank, p in enumerate([p for p in range(4) if p != i][:3], 1)}
    assert {(r.region, r.path, r["rank"]) for r in found} == want and {(r.score, r.shared) for r in found} == {(0.75, 1)}


@pytest.mark.parametrize("seed", [4, 5])
def test_merge_suggestions_of_copies_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    names, kinds = ["load", "save", "useThing", "Ab", "x"], ["hook", "class", "react-component"]
    profiles = [(rng.sample(names, rng.randrange(4)), rng.sample(["./load", "./thing"], rng.randrange(3)), rng.sample(kinds, rng.randrange(4))) for _ in range(6)]
    files = [(f"f{rng.randrange(10**6)}", *rng.choice(profiles), rng.choice([10, 100, 190, 2001]), i % 9 == 0, rng.choice(["react", "none"])) for i in range(60)]
    regions = [(i, rng.choice([*names, None]), rng.choice([*kinds, None]), rng.sample(names, 2), rng.choice(files)[0]) for i in range(40)]
    want = {}
    for r, name, kind, used, own in regions:
        scored = []
        for path, exports, imports, has, lines, barrel, framework in files:
            if name is None or barrel or lines > 2000 or path == own or name in exports:
                continue
            near = any(name.lower()[:4] in e.lower() or e.lower()[:4] in name.lower() for e in exports)
            points = 30 * (kind in has) + 20 * near + min(30, 10 * len(set(used) & set(exports))) + 10 * (kind in ("hook", "react-component") and framework == "react") + 15 * any(name.lower() in i for i in imports) + 5 * (lines < 80)
            if points >= 25:
                scored.append((-min(points, 100), path, len(set(used) & set(exports)), lines > 180))
        want[r] = [(p, -s, shared, long) for s, p, shared, long in sorted(scored)[:3]]
    found = workspace.merge_suggestions(spark.createDataFrame(regions, REGIONS), spark.createDataFrame(files, FILES)).collect()
    got = {r[0]: [] for r in regions}
    for row in sorted(found, key=lambda x: x["rank"]):
        got[row.region].append((row.path, round(row.score * 100), row.shared, row.too_long))
    assert got == want


def test_replaced_regions_parse_a_file_once(spark, tmp_path):
    spark.range(5000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = code_queries.replaced_regions(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    # A small table is much work: it is dealt to tasks before it is parsed.
    assert found.rdd.getNumPartitions() == 3
    # Of each form: two parts; three; two regions that stay; three.
    assert found.count() == 1250 * (2 + 3 + 2 + 3)


def test_replaced_regions_are_what_the_relations_give(spark):
    texts = [h.replace("{0}", str(i)) for i, h in enumerate(code_queries._HOLDERS)]
    two = "\n".join(texts)
    odd = ["", None, "const a = 1\n\n\x1f \u00a0const b = () => 2 // c\n", two, two + two, "function f() {\n" + "  x();\n" * 20 + "}\n", "const é = {\n" + " //\n" * 15 + "'a': () => 1, b: function () {} };"]
    rows = [(str(i), path, t) for i, t in enumerate([*texts, *odd, texts[0]]) for path in ("a.tsx", "b.ts", "c.py", None)]
    rows.append(rows[0])
    files = spark.createDataFrame(rows, "file_id string, path string, text string")
    for path in ("a.tsx", "b.ts", "c.py"):
        some = files.where(F.col("path") == path).dropDuplicates(["file_id"])
        regions = parse.regions_of(parse.parse_files(some)).withColumns({"path": F.lit(path), "lines": F.col("end_line") - F.col("start_line") + 1})
        parts = parse.parts_of(regions).withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
        want = symbols.split_regions(regions.select("file", "ordinal", "name", "lines"), parts).select("file", "major", "minor", "name", "lines")
        assert sorted(map(tuple, parse.replaced_regions(some).collect())) == sorted(map(tuple, want.collect()))
    # Rows that repeat stay repeated; a null path is that of no language.
    assert parse.replaced_regions(files).where("file = '0' and name like 'get%'").count() == 3
    assert parse.replaced_regions(files.limit(0)).count() == 0

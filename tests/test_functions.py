"""Column functions and decisions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import decision, generate, metrics, numeric, text


def one(spark, value, f, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(f(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.kebab, "UserCardView", "user-card-view"), (text.kebab, "aBC", "a-b-c"), (text.kebab_words, "UserCard_view!", "user-card-view"), (text.pascal, "my-file_name.tsx", "MyFileName"),
        (text.title, "userCard", "User Card"), (text.basename, "a/b/c.ts", "c.ts"), (text.dirname, "a/b/c.ts", "a/b"), (text.dirname, "c.ts", "."), (text.extname, "x/.env", ""), (text.extname, "x/a.b.ts", ".ts"),
        (text.strip_extension, "a.tsx", "a"), (text.normal_path, ".\\a\\b", "a/b"), (text.language_of, "x.TSX", "TypeScript/React"), (text.language_of, "x.zig", "Unknown"),
        (text.html_escape, "<a b='c'>&\"", "&lt;a b=&#39;c&#39;&gt;&amp;&quot;"), (text.html_escape, None, ""), (text.djb2, "héllo|ts|x", "757cee34"), (text.max_bracket_depth, "}}({[a]})", 3), (text.max_bracket_depth, "", 0),
        (lambda c: text.truncate(c, 4), "abcdef", "abc…"), (text.has_chained_calls, "a.b().c()", True), (metrics.cyclomatic, "function f() { return 1; }", 1), (metrics.cyclomatic, "if (a) {} if (b) {}", 3),
        (metrics.cyclomatic, "a && b || c", 3), (metrics.cyclomatic, "éif if", 3), (metrics.loose_cyclomatic, "a && b", 1), (metrics.loose_cyclomatic, "a&&b if", 3),
        (metrics.nesting_line_score, "if (a) {\nif (b) {\n}\n}\nelse", 4),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("a", "b", "want"), [("hooks/useA.ts", "hooks/b.ts", "./b"), ("a/b/c.ts", "a/d/e.tsx", "../d/e"), ("x.ts", "y/z.ts", "./y/z"), ("a/b/c.ts", "z.js", "../../z")])
def test_relative_path(spark, a, b, want):
    assert spark.range(1).select(text.relative_path(F.lit(a), F.lit(b)).alias("o")).first().o == want


@pytest.mark.parametrize(("x", "want"), [(1.005, 1.0), (0.285, 0.28), (2.675, 2.68), (-0.5, 0.0)])
def test_half_up(spark, x, want):
    assert one(spark, x, lambda c: numeric.half_up(c, 2 if x > 0 else 0), "double") == want


@pytest.mark.parametrize(("m", "want"), [(59, "59m"), (60, "1h"), (61, "1h 1m"), (0, "0m")])
def test_minutes(spark, m, want):
    assert one(spark, m, numeric.format_minutes, "bigint") == want


def test_thresholds(spark):
    assert one(spark, 3000.0, decision.file_threshold, "double") == 0.425
    assert one(spark, None, decision.file_threshold, "double") == 0.35
    assert one(spark, 0.0, lambda c: decision.file_threshold(c, 0.6), "double") == 0.35
    assert [one(spark, x, decision.effort_band, "double") for x in (50.0, 3000.0, 12000.0)] == ["trivial-file", "typical-file", "highly-complex-file"]
    up = one(spark, 100.0, lambda c: decision.region_threshold(F.lit(0.4), c, F.lit(1000.0)), "double")
    down = one(spark, 9000.0, lambda c: decision.region_threshold(F.lit(0.4), c, F.lit(1000.0)), "double")
    assert up > 0.4 > down >= 0.1 and one(spark, 0.0, lambda c: decision.region_threshold(F.lit(0.4), c, F.lit(1000.0)), "double") == 0.4


def decided(spark, **given):
    values = {"kind": "class", "loc": 100, "cc": 5, "cog": 5, "mi": 60, "smells": [], "outbound": 0.0, "inbound": 0.0, "cohesion": 0.5, "dead": False, "cyclic": False, "threshold": 0.35} | given
    smells = F.array(*[F.lit(s) for s in values["smells"]]).cast("array<string>")
    args = {k: smells if k == "smells" else F.lit(v) for k, v in values.items()}
    return spark.range(1).select(decision.decide(**args).alias("d")).first().d


def test_decisions(spark):
    assert decided(spark, kind="type-block").confidence == "definitive" and not decided(spark, kind="type-block").should_extract
    assert decided(spark, loc=14).reasons == ["Too small to extract (14 lines < 15)"]
    assert decided(spark, loc=20, dead=True).confidence == "medium"
    big = decided(spark, kind="hook", loc=200, cc=25, cog=30, smells=["God Component"], outbound=0.7)
    assert big.should_extract and big.score == pytest.approx(0.25 + 0.25 + 0.17 + 0.15 + 0.1 + 0.025 + 0.05) and big.confidence == "definitive"
    assert decided(spark, cyclic=True).score == pytest.approx(decided(spark).score - 0.08)


def test_generated_text(spark):
    row = spark.range(1).select(
        generate.assemble(F.array(F.lit("a"), F.lit(""), F.lit(""), F.lit(None), F.lit("b"))).alias("a"),
        generate.exported_body(F.array(F.lit("  const x = 1"), F.lit("y"))).alias("b"),
        generate.import_statement(F.lit(None), F.lit("p"), F.array(F.lit("q")), F.lit("m")).alias("c"),
        generate.export_statement(F.lit("N"), F.lit(False), F.lit(False)).alias("d"),
        generate.prop_interface(F.lit("N"), F.lit("class"), F.array(F.lit("q"))).alias("e"),
        generate.test_suggestions(F.lit("hook"), F.lit(True), F.array().cast("array<string>"), F.lit("God Component")).alias("f"),
        generate.updated_source(F.lit("'use client';"), F.lit("H"), F.array(F.lit("I")), F.array(F.lit("'use client';"), F.lit("x"))).alias("g"),
        generate.header(F.lit("s.ts"), F.lit("N"), F.lit("hook"), F.lit(1), F.lit(9), F.lit(None).cast("string")).alias("h"),
        generate.import_rank(F.lit("import type { A } from './a';")).alias("i"),
    ).first()
    assert row.a == "a\n\nb" and row.b == "export const x = 1\ny" and row.c == "import * as p, { q } from 'm';" and row.d == "export { N };" and row.e is None
    assert row.f[-1] == "no regression: god component" and len(row.f) == 4 and row.g == "'use client';\nH\n\nI\n\nx" and row.h.count("\n") == 4 and row.i == 3

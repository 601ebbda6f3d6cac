"""Index of a workspace's exports, re-exports and places to merge regions into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.numeric import half_up
from sparkloom.operators.session import checkpointed

MERGE_LIMIT = 200
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", "/index.ts", "/index.js", ""]


def symbol_exporters(files: DataFrame) -> DataFrame:
    """(symbol, path) of every name that a file exports; files has path and exports."""
    return files.select(F.explode("exports").alias("symbol"), "path").distinct()


def resolve_specifiers(rows: DataFrame, paths: DataFrame, base: str) -> DataFrame:
    """rows with ``resolved``: of the path in ``base`` and the known suffixes, the first that exists; null without."""
    candidates = F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s, i: F.struct(i.alias("ord"), F.concat(F.col(base), s).alias("path")))
    tried = rows.select(base).distinct().select(base, F.explode(candidates).alias("c"))
    hits = tried.join(paths.select(F.col("path").alias("p")).distinct(), F.col("c.path") == F.col("p")).groupBy(F.col(base).alias("__b")).agg(F.min(F.struct("c.ord", "c.path")).alias("m"))
    return rows.join(hits, F.col(base) == F.col("__b"), "left").withColumn("resolved", F.col("m.path")).drop("__b", "m")


def with_reexports(exporters: DataFrame, reexported: DataFrame) -> DataFrame:
    """Exporters plus the files that re-export a symbol: named ones as they are, ``*`` for all that the source file exports itself.

    reexported(path, symbol, resolved): one hop, so what a barrel re-exports isn't passed on by another's ``*``.
    """
    known = reexported.where(F.col("resolved").isNotNull())
    named = known.where("symbol <> '*'").select("symbol", "path")
    source = exporters.select(F.col("symbol").alias("s"), F.col("path").alias("sp"))
    starred = known.where("symbol = '*'").select("path", "resolved").join(source, F.col("resolved") == F.col("sp")).select(F.col("s").alias("symbol"), "path")
    return exporters.unionByName(named).unionByName(starred).distinct()


def name_match(name: Column, exports: Column) -> Column:
    low = F.lower(name)
    return F.exists(exports, lambda e: F.contains(F.lower(e), F.substring(low, 1, 4)) | F.contains(low, F.substring(F.lower(e), 1, 4)))


def _kind_points(kind: Column) -> Column:
    """What a file with the region's kind scores by kind, framework and size."""
    react = kind.isin("hook", "react-component") & (F.col("framework") == "react")
    return F.lit(0.3) + F.when(react, 0.1).otherwise(0.0) + F.when(F.col("small"), 0.05).otherwise(0.0)


#: What a file's score depends on, whatever the region.
_PROFILE = ["exports", "imports", "kinds", "framework", "small"]


def _file_classes(files: DataFrame, most: int) -> DataFrame:
    """(fc, profile, first, rows): the files that score alike for any region, with the first path and the files that a region can keep.

    Of a class a region keeps its first paths only, ``most`` and one more for its own file; of a path that repeats, ``most`` rows.
    """
    usable = files.where(F.col("path").isNotNull() & ~F.col("is_barrel") & (F.col("line_count") <= 2000)).withColumn("small", F.col("line_count") < 80)
    path = F.dense_rank().over(Window.partitionBy(*_PROFILE).orderBy("path"))
    again = F.row_number().over(Window.partitionBy(*_PROFILE, "path").orderBy("line_count"))
    kept = usable.select("path", "line_count", *_PROFILE).withColumn("at", path).where(F.col("at") <= most + 1).withColumn("again", again).where(F.col("again") <= most)
    classes = kept.groupBy(*_PROFILE).agg(F.min("path").alias("first"), F.collect_list(F.struct("path", "line_count")).alias("rows"))
    return checkpointed(classes.withColumn("fc", F.monotonically_increasing_id()))


def _of_kind(asks: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(rc, fc): the first file classes of a kind that don't export the name, enough for ``most`` files beside the region's own.

    The classes of a kind are ranked once; a name meets as many of them as export it and as it may keep, so the
    rows are linear in names and exports.
    """
    exporting = classes.select("fc", F.explode(F.array_distinct("exports")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("barred"))
    # Classes that begin with one path: a region's own file can bar it from so many.
    own = classes.groupBy("first").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("own"))
    asked = asks.select("name", F.col("kind").alias("rk")).distinct().join(exporting, F.col("name") == F.col("symbol"), "left").crossJoin(F.broadcast(own))
    asked = checkpointed(asked.select("name", "rk", (F.coalesce("barred", F.lit(0)) + F.col("own") + most).cast("int").alias("depth"), (F.col("own") + most).alias("enough")))
    deepest = asked.agg(F.max("depth")).first()[0]
    if deepest is None:
        return asks.select("rc", F.lit(None).cast("bigint").alias("fc")).limit(0)
    listed = classes.select("fc", "first", "exports", "framework", "small", F.explode(F.array_distinct("kinds")).alias("fk"))
    order = Window.partitionBy("fk").orderBy(F.desc(_kind_points(F.col("fk"))), F.asc("first"), F.asc("fc"))
    listed = listed.withColumn("at", F.row_number().over(order)).where(F.col("at") <= deepest).select("fc", "exports", "fk", "at")
    steps = asked.select("name", "rk", "enough", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("step"))
    met = steps.join(listed, (F.col("rk") == F.col("fk")) & (F.col("step") == F.col("at"))).where(~F.array_contains("exports", F.col("name")))
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("name", "rk").orderBy("at"))).where(F.col("nth") <= F.col("enough"))
    met = met.select(F.col("name").alias("n"), "rk", "fc")
    return asks.join(met, (F.col("name") == F.col("n")) & (F.col("kind") == F.col("rk"))).select("rc", "fc")


def _class_pairs(asks: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(rc, fc) of the region and file classes of which the files may score enough."""
    starts = lambda c: F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    pieces = lambda c: F.flatten(F.transform(starts(c), lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: F.substring(c, i, n))))
    low = F.lower("name")
    keys_r = F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("a:"), F.substring(low, 1, 4))),
            F.transform("used", lambda u: F.concat(F.lit("s:"), u)),
            F.transform(pieces(low), lambda p: F.concat(F.lit("b:"), p)),
            F.array(F.concat(F.lit("i:"), F.substring(low, 1, 4))),
        )
    )
    lows = F.transform("exports", lambda e: F.lower(e))
    keys_f = F.array_distinct(
        F.concat(
            F.flatten(F.transform(lows, lambda e: F.transform(pieces(e), lambda p: F.concat(F.lit("a:"), p)))),
            F.transform("exports", lambda e: F.concat(F.lit("s:"), e)),
            F.transform(lows, lambda e: F.concat(F.lit("b:"), F.substring(e, 1, 4))),
            F.flatten(F.transform("imports", lambda m: F.transform(pieces(m), lambda p: F.concat(F.lit("i:"), p)))),
        )
    )
    left = asks.select("rc", F.explode(keys_r).alias("key"))
    right = classes.select("fc", F.explode(keys_f).alias("fkey"))
    pairs = left.join(right, F.col("key") == F.col("fkey")).select("rc", "fc")
    return pairs.unionAll(_of_kind(asks, classes, most)).distinct()


def merge_suggestions(regions: DataFrame, files: DataFrame, most: int = 3, least: float = 0.25) -> DataFrame:
    """(region, path, score, shared, wouldExceed as ``too_long``, rank): the best existing files for each region.

    regions(region, name, kind, used, source_path), files(path, exports, imports, kinds, line_count,
    is_barrel, framework). A score depends on a region's name, kind and used symbols and on a file's
    exports, imports, kinds, framework and size only, so regions and files alike in these are a class,
    classes are scored, and each region takes the first files of its class's list but its own: copies
    are never paired. A file scores 0.25 or more only if something beyond its size speaks for it:
    a common kind, a similar name, a shared symbol or an import of the name. Candidates for the last
    three are found by equality joins (used symbol; pieces of names and specifiers, of four letters or,
    as shorter names and exports are compared whole, fewer). A file with nothing but the kind in common
    has a score that depends on kind and file alone, so of those a region meets the best only.
    """
    classes = _file_classes(files, most)
    asking = regions.where(F.col("name").isNotNull() & F.col("source_path").isNotNull())
    asks = checkpointed(asking.select("name", "kind", "used").distinct().withColumn("rc", F.monotonically_increasing_id()))
    pairs = _class_pairs(asks, classes, most)
    both = pairs.join(asks.withColumnRenamed("rc", "r"), F.col("rc") == F.col("r")).join(classes.withColumnRenamed("fc", "f"), F.col("fc") == F.col("f"))
    both = both.where(~F.array_contains("exports", F.col("name")))
    shared = F.size(F.array_intersect("used", "exports"))
    react = F.col("kind").isin("hook", "react-component") & (F.col("framework") == "react")
    imports = F.exists("imports", lambda i: F.contains(i, F.lower("name")))
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    score = (
        yes(F.array_contains("kinds", F.col("kind")), 0.3)
        + yes(name_match(F.col("name"), F.col("exports")), 0.2)
        + F.least(F.lit(0.3), shared * 0.1)
        + yes(react, 0.1)
        + yes(imports, 0.15)
        + yes(F.col("small"), 0.05)
    )
    scored = both.withColumn("raw", F.least(F.lit(1.0), score)).where(F.col("raw") >= least)
    scored = scored.select("rc", half_up(F.col("raw"), 2).alias("score"), shared.alias("shared"), F.explode("rows").alias("x"))
    # Of the first 2 * most rows with most a path at the utmost, any path but one has most or all there are.
    again = F.row_number().over(Window.partitionBy("rc", "x.path").orderBy(F.desc("score")))
    best = scored.withColumn("again", again).where(F.col("again") <= most)
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("rc").orderBy(F.desc("score"), F.asc("x.path")))).where(F.col("at") <= 2 * most)
    suggested = F.struct("at", F.col("x.path").alias("path"), "score", "shared", (F.col("x.line_count") + 20 > MERGE_LIMIT).alias("too_long"))
    lists = best.groupBy("rc").agg(F.array_sort(F.collect_list(suggested)).alias("list"))
    lists = lists.join(asks.withColumnRenamed("rc", "r"), F.col("rc") == F.col("r")).select(F.col("name").alias("n"), F.col("kind").alias("k"), F.col("used").alias("u"), "list")
    same = (F.col("name") == F.col("n")) & F.col("kind").eqNullSafe(F.col("k")) & F.col("used").eqNullSafe(F.col("u"))
    mine = asking.select("region", "name", "kind", "used", "source_path").join(lists, same)
    mine = mine.select("region", F.explode(F.slice(F.filter("list", lambda x: x["path"] != F.col("source_path")), 1, most)).alias("x"))
    found = mine.select("region", "x.path", "x.score", "x.shared", "x.too_long")
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), F.asc("path")))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def barrel_lines(entries: DataFrame) -> DataFrame:
    """(grp, text): the export lines of each first path segment, by ordinal; entries(file_name, entry, ordinal)."""
    grouped = entries.groupBy(F.element_at(F.split("file_name", "/"), 1).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "entry"))).alias("rows"))
    return grouped.select("grp", F.concat(F.lit("// "), "grp", F.lit("/\n"), F.array_join(F.transform("rows", lambda x: x["entry"]), "\n")).alias("text"))


def barrel_additions(existing: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (grp, entry) whose line isn't there yet, with ``new_group``: their header isn't either."""
    missing = entries.join(existing.select(F.col("line").alias("entry")).distinct(), "entry", "left_anti")
    headers = existing.select(F.col("line").alias("h")).distinct()
    joined = missing.join(headers, F.concat(F.lit("// "), F.col("grp"), F.lit("/")) == F.col("h"), "left")
    return joined.select("grp", "entry", F.col("h").isNull().alias("new_group"))

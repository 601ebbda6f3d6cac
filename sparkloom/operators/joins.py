"""Joins of usages, declarations, imports and files.

Relations (see README): usages(file, region, symbol, kind), bindings(file, region, symbol),
decls(file, region, name, kind, ordinal), imports(file, specifier, alias, line, form).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.numeric import half_up

# Weight of each kind of usage, the order in which one names an edge, and factors of what is used.
USAGE_WEIGHT = {"call": 1.5, "type": 0.1, "reexport": 0.0, "inheritance": 2.0, "reference": 1.0, "cochange": 1.2}
PRECEDENCE = ["inheritance", "call", "reference", "type", "reexport", "cochange"]
TARGET_FACTOR = {"hook": 1.4, "context-provider": 1.3, "utility-function": 0.9, "type-block": 0.3}


def _case(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def last_declaration(decls: DataFrame) -> DataFrame:
    """One declaration a (file, name): the last one in source order."""
    return decls.groupBy("file", "name").agg(F.max(F.struct("ordinal", "region", "kind")).alias("d")).select("file", "name", "d.region", "d.kind")


def first_declaration(decls: DataFrame) -> DataFrame:
    return decls.groupBy("file", "name").agg(F.min(F.struct("ordinal", "region", "kind")).alias("d")).select("file", "name", "d.region", "d.kind")


def unbound(usages: DataFrame, bindings: DataFrame) -> DataFrame:
    """Usages of what the region doesn't bind itself."""
    return usages.join(bindings.select("file", "region", "symbol").distinct(), ["file", "region", "symbol"], "left_anti")


def resolve_usages(usages: DataFrame, bindings: DataFrame, decls: DataFrame) -> DataFrame:
    """(file, f, t, symbol, kind, to_kind): usages of another region's declaration in the same file."""
    d = last_declaration(decls).select(F.col("file").alias("df"), F.col("name"), F.col("region").alias("t"), F.col("kind").alias("to_kind"))
    found = unbound(usages, bindings).join(d, (F.col("file") == F.col("df")) & (F.col("symbol") == F.col("name")))
    return found.where("region <> t").select("file", F.col("region").alias("f"), "t", "symbol", "kind", "to_kind")


def edge_rank(kind: Column) -> Column:
    return _case({k: i for i, k in enumerate(PRECEDENCE)}, kind, 2)


def namespace_of(kind: Column) -> Column:
    """Interfaces, aliases and enums are types, the rest values."""
    return F.when(kind.isin("type-block", "enum"), "type").otherwise("value")


def aggregate_edges(resolved: DataFrame) -> DataFrame:
    """One edge a (file, f, t): symbols, type, strength and whether it is of types only.

    Strength: 0.2 x factor of the target x weight of each usage, summed; if that is 0, 0.2 x factor x
    symbols; 1 at most, two decimals. An edge of whose usages no kind is known is of types only if all
    it uses is declared as types.
    """
    factor = F.max(_case(TARGET_FACTOR, F.col("to_kind"), 1.0))
    out = resolved.groupBy("file", "f", "t").agg(
        F.array_sort(F.collect_set("symbol")).alias("symbols"),
        F.min(edge_rank(F.col("kind"))).alias("rank"),
        F.sum(_case(USAGE_WEIGHT, F.col("kind"), 1.0)).alias("weight"),
        factor.alias("factor"),
        F.coalesce(F.bool_and(F.col("kind") == "type"), F.bool_and(namespace_of(F.col("to_kind")) == "type")).alias("type_only"),
    )
    weighted = F.col("weight") * 0.2 * F.col("factor")
    raw = F.when(weighted > 0, weighted).otherwise(F.size("symbols") * 0.2 * F.col("factor"))
    names = F.array(*[F.lit(k) for k in PRECEDENCE])
    return out.select(
        "file", "f", "t", "symbols", F.element_at(names, F.col("rank") + 1).alias("edge_type"), half_up(F.least(F.lit(1.0), raw), 2).alias("strength"), "type_only"
    )


def external_coupling(usages: DataFrame, bindings: DataFrame, decls: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, region, packages, weight): 0.2 x weight of the choosing kind for each imported name that a region uses."""
    local = decls.select("file", F.col("name").alias("symbol")).distinct()
    free = unbound(usages, bindings).join(local, ["file", "symbol"], "left_anti")
    names = imports.select("file", F.col("alias").alias("symbol"), "specifier").distinct()
    kinds = free.groupBy("file", "region", "symbol").agg(F.min(edge_rank(F.col("kind"))).alias("rank"))
    weight = F.element_at(F.array(*[F.lit(USAGE_WEIGHT[k]) for k in PRECEDENCE]), F.col("rank") + 1) * 0.2
    found = kinds.join(names, ["file", "symbol"])
    return found.groupBy("file", "region").agg(F.array_sort(F.collect_set("specifier")).alias("packages"), F.sum(weight).alias("weight"))


def coupling(regions: DataFrame, edges: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(region, outbound, inbound, total): sums of strengths; total counts inbound by half, external weights are outbound."""
    out = edges.groupBy(F.col("f").alias("r1")).agg(F.sum("strength").alias("o"))
    inb = edges.groupBy(F.col("t").alias("r2")).agg(F.sum("strength").alias("i"))
    ext = (external if external is not None else edges.limit(0).select(F.col("f").alias("region"), F.col("strength").alias("weight"))).select(F.col("region").alias("r3"), F.col("weight").alias("e"))
    joined = regions.select("region").join(out, F.col("region") == F.col("r1"), "left").join(inb, F.col("region") == F.col("r2"), "left").join(ext, F.col("region") == F.col("r3"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select("region", (zero("o") + zero("e")).alias("outbound"), zero("i").alias("inbound"), (zero("o") + zero("i") * 0.5 + zero("e")).alias("total"))


def cohesion(used: Column, declared: Column) -> Column:
    return F.when(declared > 0, half_up(F.least(F.lit(1.0), used / (declared + 1)), 2)).otherwise(F.lit(0.5))


def dead_exports(decls: DataFrame, resolved: DataFrame) -> DataFrame:
    """Exported declarations that no other region of their file uses."""
    return decls.where("exported").join(resolved.select("file", F.col("t").alias("region")).distinct(), ["file", "region"], "left_anti")


def unresolved_symbols(usages: DataFrame, decls: DataFrame, specifiers: DataFrame) -> DataFrame:
    """(file, symbol): used names that are neither declared nor (by their specifier) imported."""
    known = decls.select("file", F.col("name").alias("symbol")).unionAll(specifiers.select("file", F.col("specifier").alias("symbol")))
    return usages.select("file", "symbol").distinct().join(known.distinct(), ["file", "symbol"], "left_anti")


def linkage(imported: DataFrame, decls: DataFrame, proposed: DataFrame) -> DataFrame:
    """(file, a, b, symbols, weight, circular) between proposed files.

    imported(file, region, symbol), proposed(file, region, target). A symbol belongs to its first
    declaration outside the region itself.
    """
    own = imported.join(proposed.select("file", "region", F.col("target").alias("a")), ["file", "region"])
    d = decls.select(F.col("file").alias("df"), "name", F.col("region").alias("dr"), F.col("ordinal").alias("o"))
    to = own.join(d, (F.col("file") == F.col("df")) & (F.col("symbol") == F.col("name")) & (F.col("region") != F.col("dr")))
    to = to.groupBy("file", "region", "a", "symbol").agg(F.min_by("dr", "o").alias("dr"))
    p = proposed.select(F.col("file").alias("pf"), F.col("region").alias("pr"), F.col("target").alias("b"))
    pairs = to.join(p, (F.col("file") == F.col("pf")) & (F.col("dr") == F.col("pr"))).where("a <> b")
    links = pairs.groupBy("file", "a", "b").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"), F.countDistinct("symbol").alias("weight"))
    back = links.select(F.col("file").alias("rf"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.lit(True).alias("yes"))
    joined = links.join(back, (F.col("file") == F.col("rf")) & (F.col("a") == F.col("rb")) & (F.col("b") == F.col("ra")), "left")
    return joined.select("file", "a", "b", "symbols", "weight", F.coalesce("yes", F.lit(False)).alias("circular"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, within: int) -> DataFrame:
    """Pairs of equal keys whose integer positions differ by ``within`` at most.

    Positions are cut into buckets of ``within + 1``; the right side goes into the three buckets around
    its own, so the join is an equi-join (no cross product) and each pair meets exactly once.
    """
    size = within + 1
    lb = left.withColumn("__lb", F.floor(F.col(left_at) / size))
    near = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(right_at) / size) + d))
    rb = right.withColumn("__rb", near)
    on = F.col("__lb") == F.col("__rb")
    for k in keys:
        rb = rb.withColumnRenamed(k, f"__r_{k}")
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    return lb.join(rb, on).where(F.abs(F.col(left_at) - F.col(right_at)) <= within).drop("__lb", "__rb", *[f"__r_{k}" for k in keys])


def outside_ranges(lines: DataFrame, ranges: DataFrame, key: str, at: str, first: str, last: str, bucket: int = 64) -> DataFrame:
    """Rows of lines at positions that no range [first, last] of the same key covers.

    Ranges are cut into buckets of positions, so the anti-join has an equality to hash by.
    """
    cut = ranges.where(F.col(first) <= F.col(last)).select(F.col(key).alias("__k"), F.col(first).alias("__a"), F.col(last).alias("__z"))
    cut = cut.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__a") / bucket), F.floor(F.col("__z") / bucket))))
    rows = lines.withColumn("__at", F.floor(F.col(at) / bucket))
    inside = (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__b")) & F.col(at).between(F.col("__a"), F.col("__z"))
    return rows.join(cut, inside, "left_anti").drop("__at")


def route_symbols(needed: DataFrame, decls: DataFrame, proposed: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, region, symbol, route, target): where each needed symbol comes from.

    In order: another region (its proposed file; without one the symbol is dropped, null route), a
    routed type, an import (the first by line). Others are null too.
    """
    d = decls.select(F.col("file").alias("df"), "name", F.col("region").alias("dr"), F.col("ordinal").alias("o"))
    found = needed.join(d, (F.col("file") == F.col("df")) & (F.col("symbol") == F.col("name")) & (F.col("region") != F.col("dr")), "left")
    found = found.groupBy("file", "region", "symbol").agg(F.min_by("dr", "o").alias("dr"))
    p = proposed.select(F.col("file").alias("pf"), F.col("region").alias("pr"), F.col("target").alias("to_file"))
    ty = types.select(F.col("file").alias("tf"), F.col("symbol").alias("ts"), F.col("target").alias("to_type"))
    im = imports.groupBy(F.col("file").alias("mf"), F.col("alias").alias("ma")).agg(F.min_by("specifier", "line").alias("to_import"))
    out = found.join(p, (F.col("file") == F.col("pf")) & (F.col("dr") == F.col("pr")), "left")
    out = out.join(ty, (F.col("file") == F.col("tf")) & (F.col("symbol") == F.col("ts")), "left")
    out = out.join(im, (F.col("file") == F.col("mf")) & (F.col("symbol") == F.col("ma")), "left")
    by_region = F.col("dr").isNotNull()
    route = F.when(by_region, F.when(F.col("to_file").isNotNull(), "region")).when(F.col("to_type").isNotNull(), "type").when(F.col("to_import").isNotNull(), "import")
    target = F.when(by_region, F.col("to_file")).when(F.col("to_type").isNotNull(), F.col("to_type")).otherwise(F.col("to_import"))
    return out.select("file", "region", "symbol", route.alias("route"), target.alias("target"))


def type_target(candidates: DataFrame, source_folder: Column, preferred: list[str]) -> DataFrame:
    """(file, target, is_new): same folder and preferred name, else preferred, else the first, else ./types.ts.

    candidates(file, path, ordinal); a file without candidates has a null path.
    """
    ends = F.exists(F.array(*[F.lit(p) for p in preferred]), lambda p: F.col("path").endswith(p))
    tier = F.when(ends & F.col("path").startswith(source_folder), 0).when(ends, 1).otherwise(2)
    out = candidates.groupBy("file").agg(F.min(F.when(F.col("path").isNotNull(), F.struct(tier.alias("tier"), "ordinal", "path"))).alias("best"))
    return out.select("file", F.coalesce("best.path", F.lit("./types.ts")).alias("target"), F.col("best").isNull().alias("is_new"))


def upsert_cochange(edges: DataFrame, records: DataFrame) -> DataFrame:
    """edges(f, t, edge_type, strength) with co-change: existing edges gain half the coupling (1 at most), others are new.

    records(a, b, coupling) count in both directions.
    """
    both = records.select("a", "b", "coupling").unionAll(records.select(F.col("b").alias("a"), F.col("a").alias("b"), "coupling"))
    both = both.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coupling"))).alias("c"))
    joined = edges.join(both, (F.col("f") == F.col("a")) & (F.col("t") == F.col("b")), "full_outer")
    strength = F.when(F.col("f").isNull(), F.col("c")).when(F.col("c").isNull(), F.col("strength")).otherwise(F.least(F.lit(1.0), F.col("strength") + F.col("c") * 0.5))
    return joined.select(F.coalesce("f", "a").alias("f"), F.coalesce("t", "b").alias("t"), F.coalesce("edge_type", F.lit("cochange")).alias("edge_type"), strength.alias("strength"), F.col("c").alias("cochange"))


def cochange_pairs(history: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, coupling): regions a < b by the Jaccard similarity of their sets of commits, at least so.

    history(region, commit). A commit of very many regions makes pairs of all of them: that is the
    relation asked for, so cap history at its source if it isn't wanted.
    """
    h = history.dropna().distinct()
    sizes = h.groupBy("region").agg(F.count("*").alias("n"))
    shared = h.toDF("a", "c").join(h.toDF("b", "c2"), F.col("c") == F.col("c2")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    joined = shared.join(sizes.toDF("ra", "na"), F.col("a") == F.col("ra")).join(sizes.toDF("rb", "nb"), F.col("b") == F.col("rb"))
    ratio = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return joined.select("a", "b", "shared", ratio.alias("coupling")).where(F.col("coupling") >= least)


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group in the order given."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= most).drop("__rn")

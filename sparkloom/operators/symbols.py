"""What regions export, import and use of packages and types; aliases of paths; regions split into parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.guidance import reimport
from sparkloom.functions.text import relative_path, strip_extension
from sparkloom.operators.joins import namespace_of, unbound


def exported_symbols(decls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file, region, name): declarations that some other region of the file uses."""
    return decls.select("file", "region", "name").join(resolved.select("file", F.col("t").alias("region")).distinct(), ["file", "region"], "left_semi")


def imported_symbols(usages: DataFrame, bindings: DataFrame, decls: DataFrame) -> DataFrame:
    """(file, region, symbols): used names that the region doesn't bind and another one declares."""
    own = decls.select(F.col("file").alias("df"), F.col("name").alias("dn"), F.col("region").alias("dr"))
    free = unbound(usages, bindings).select("file", "region", "symbol").distinct()
    found = free.join(own, (F.col("file") == F.col("df")) & (F.col("symbol") == F.col("dn")) & (F.col("region") != F.col("dr")), "left_semi")
    return found.groupBy("file", "region").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def import_source(imports: DataFrame) -> DataFrame:
    """(file, alias, specifier): the first static import, by line, that brings a name into scope."""
    static = imports.where("form <> 'dynamic' and alias is not null")
    return static.groupBy("file", "alias").agg(F.min(F.struct("line", "specifier")).alias("m")).select("file", "alias", "m.specifier")


def external_packages(usages: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, region, packages): packages (no relative paths) whose names a region uses."""
    src = import_source(imports).where(~F.col("specifier").startswith(".")).withColumnRenamed("alias", "symbol")
    joined = usages.select("file", "region", "symbol").distinct().join(src, ["file", "symbol"])
    return joined.groupBy("file", "region").agg(F.array_sort(F.collect_set("specifier")).alias("packages"))


def patched_namespaces(decls: DataFrame, resolved_types: DataFrame) -> DataFrame:
    """decls with ``namespace``, overridden by resolved_types(file, name, found): type before both before value."""
    rank = F.when(F.col("found") == "type", 0).when(F.col("found") == "both", 1).otherwise(2)
    best = resolved_types.groupBy("file", "name").agg(F.min_by("found", rank).alias("found"))
    return decls.join(best, ["file", "name"], "left").withColumn("namespace", F.coalesce("found", namespace_of(F.col("kind")))).drop("found")


def inline_types(usages: DataFrame, decls: DataFrame) -> DataFrame:
    """(file, region, types): used names that are declared as types in the file."""
    types = decls.where(namespace_of(F.col("kind")) == "type").select("file", F.col("name").alias("symbol")).distinct()
    return usages.join(types, ["file", "symbol"]).groupBy("file", "region").agg(F.array_sort(F.collect_set("symbol")).alias("types"))


def alias_path(target: Column, aliases: list[tuple[str, str]]) -> Column:
    """The first alias whose folder holds the path, with the rest of it; null without. aliases: (alias, folder), as of a project file."""
    out = F.lit(None).cast("string")
    for alias, folder in reversed(aliases):
        base = folder.rstrip("*").rstrip("/")
        inside = (target == base) | target.startswith(base + "/")
        rest = F.regexp_replace(F.substring(target, len(base) + 1, 2**30), "^/", "")
        mapped = F.concat(F.lit(alias.split("*")[0]), rest) if "*" in alias else F.when(rest == "", F.lit(alias)).otherwise(F.concat(F.lit(alias + "/"), rest))
        out = F.when(inside, strip_extension(mapped)).otherwise(out)
    return out


def import_path(start: Column, target: Column, folder: str, aliases: list[tuple[str, str]]) -> Column:
    """By alias if one covers the target below folder, else relative."""
    return F.coalesce(alias_path(F.concat(F.lit(folder.rstrip("/") + "/"), target), aliases), relative_path(start, target))


def reimport_lines(planned: DataFrame, folder: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """(source, file_name, line): the import that brings each region back which goes to a file of its own.

    planned(source, file_name, name, routed): paths below folder; regions routed to existing files need none.
    """
    line = reimport(F.col("name"), import_path(F.col("source"), F.col("file_name"), folder, aliases))
    return planned.where(~F.col("routed")).select("source", "file_name", line.alias("line"))


def split_regions(regions: DataFrame, parts: DataFrame, least_lines: int = 15) -> DataFrame:
    """Regions of at least so many lines replaced by their parts, in source order; others stay.

    regions(file, ordinal, name, lines), parts(file, parent, ordinal, name, lines): a region without
    parts stays whole.
    """
    large = regions.where(F.col("lines") >= least_lines).select("file", F.col("ordinal").alias("parent"))
    taken = parts.join(large, ["file", "parent"], "left_semi")
    split = taken.select("file", F.col("parent").alias("ordinal")).distinct()
    whole = regions.join(split, ["file", "ordinal"], "left_anti").select("file", F.col("ordinal").alias("major"), F.lit(-1).alias("minor"), "name", "lines")
    return whole.unionByName(taken.select("file", F.col("parent").alias("major"), F.col("ordinal").alias("minor"), "name", "lines"))

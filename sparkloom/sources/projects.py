"""What surrounds a file in its workspace: the files near it, their roles, its project file, the history of its regions."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import strip_extension, trim_all

# The patterns of each role and of what is passed over.
ROLES = {
    "types": "**/{types,interfaces,global.d}.ts",
    "hooks": "**/use*.{ts,tsx}",
    "utils": "**/utils/**/*.ts",
    "index": "**/index.ts",
    "tests": "**/*.{test,spec}.{ts,tsx}",
}
SOURCES = "**/*.{ts,tsx,js,jsx}"
PASSED = ["**/node_modules/**", "**/dist/**", "**/out/**"]
LOCK_FILES = {"pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "package-lock.json": "npm"}
MONOREPO_FILES = ["pnpm-workspace.yaml", "lerna.json", "nx.json"]
PROJECT_FILE = "tsconfig.json"
_CONFIG = "extends string, compilerOptions struct<baseUrl:string,strict:boolean,paths:map<string,array<string>>>"
_PACKAGE = "dependencies map<string,string>, devDependencies map<string,string>"


def glob_regex(pattern: str) -> str:
    """A glob of whole paths as a regex: ``**/`` any folders, ``*`` and ``?`` within a name, ``{a,b}`` one of several."""
    out, depth = [], 0
    for t in re.findall(r"\*\*/|\*\*|[*?{},]|[^*?{},]+", pattern):
        if t == "{":
            depth += 1
            out.append("(?:")
        elif t == "}" and depth:
            depth -= 1
            out.append(")")
        elif t == "," and depth:
            out.append("|")
        else:
            out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or re.escape(t))
    return f"^(?:{''.join(out)})\\z"


def matching(files: DataFrame, patterns: list[str], passed: list[str] = PASSED) -> DataFrame:
    """The files(path, ...) that some pattern takes and none passes over, each path once."""
    any_of = lambda found: F.col("path").rlike("|".join(map(glob_regex, found)))
    taken = files.where(any_of(patterns))
    return (taken.where(~any_of(passed)) if passed else taken).dropDuplicates(["path"])


def normal_path(path: Column) -> Column:
    """Without empty and dot parts; two dots take away the part before them."""

    def step(done: Column, part: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1), F.lit(".."))
        return F.when(part.isin("", "."), done).when((part == "..") & (last != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def folder_of(path: Column, up: int = 0) -> Column:
    """The folder of a path, or the one so many above it; '' at the top."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1 - up, F.lit(0))), "/")


def folders_of(folder: Column) -> Column:
    """The folder and all above it, '' included."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def near_files(files: DataFrame, sources: DataFrame, up: int = 2) -> DataFrame:
    """(source, path): the scripts in the folder of each source, up to so many folders above it, and below those.

    The widest of the folders holds the others, so each file stands for all its folders and meets the
    sources by equality; distinct by source and path. The number of files is not bounded.
    """
    scripts = matching(files.select("path"), [SOURCES]).select("path", F.explode(folders_of(folder_of(F.col("path")))).alias("__folder"))
    tops = sources.select(F.col("path").alias("source")).distinct().withColumn("__top", folder_of(F.col("source"), up))
    return tops.join(scripts, F.col("__top") == F.col("__folder")).select("source", "path")


def file_roles(files: DataFrame) -> DataFrame:
    """(path, role): what files are for by their names; several roles are several rows."""
    roles = F.array(*[F.when(F.col("path").rlike(glob_regex(p)), role) for role, p in ROLES.items()])
    return files.select("path", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("role")).distinct()


def workspace_facts(files: DataFrame) -> DataFrame:
    """(root, test_framework, package_manager, is_monorepo) of each root; files(root, path, text), paths from the root on."""
    here = lambda name: F.max(F.col("path") == name)
    package = F.from_json("text", _PACKAGE)
    named = lambda name: F.exists(F.array(package["dependencies"], package["devDependencies"]), lambda m: F.coalesce(F.element_at(m, name), F.lit("")) != "")
    needs = lambda *names: F.max((F.col("path") == "package.json") & F.coalesce(F.array_contains(F.array(*[F.coalesce(named(n), F.lit(False)) for n in names]), True), F.lit(False)))
    manager = F.coalesce(*[F.when(here(name), tool) for name, tool in LOCK_FILES.items()], F.lit("unknown"))
    known = files.where(F.col("path").isin("package.json", *LOCK_FILES, *MONOREPO_FILES))
    found = known.groupBy("root").agg(
        F.when(needs("vitest"), "vitest").when(needs("jest", "ts-jest"), "jest").otherwise("unknown").alias("test_framework"), manager.alias("package_manager"),
        F.max(F.col("path").isin(*MONOREPO_FILES)).alias("is_monorepo"),
    )
    return files.select("root").distinct().join(found, "root", "left").fillna({"test_framework": "unknown", "package_manager": "unknown", "is_monorepo": False})


def read_configs(files: DataFrame) -> DataFrame:
    """(path, folder, parent, base_url, strict, paths) of files(path, text) that are JSON with comments and trailing commas.

    base_url is a path of the workspace or absolute; parent is the file that ``extends`` names by a
    relative path (packages are not followed). What can't be read has only nulls.
    """
    clean = F.regexp_replace("text", r",(\s*[}\]])", "$1")
    rows = files.withColumn("__c", F.from_json(clean, _CONFIG, {"allowComments": "true"})).withColumn("folder", folder_of(F.col("path")))
    inside = lambda c: F.when(c.startswith("/"), normal_path(c)).otherwise(normal_path(F.concat_ws("/", "folder", c)))
    options, base = F.col("__c.compilerOptions"), F.col("__c.extends")
    named = F.when(base.rlike(r"^\.{0,2}/"), F.when(base.endswith(".json"), base).otherwise(F.concat(base, F.lit(".json"))))
    return rows.select("path", "folder", inside(named).alias("parent"), F.when(options["baseUrl"].isNotNull(), inside(options["baseUrl"])).alias("base_url"), options["strict"].alias("strict"), options["paths"].alias("paths"))


def with_bases(configs: DataFrame, most: int = 8) -> DataFrame:
    """configs whose open options are those of the files they extend, through at most so many of them."""
    kept = ["base_url", "strict", "paths"]
    base = configs.select(F.col("path").alias("__p"), F.col("parent").alias("__up"), *[F.col(c).alias(f"__{c}") for c in kept])
    for _ in range(most):
        if configs.where(F.col("parent").isNotNull()).isEmpty():
            break
        joined = configs.join(base, F.col("parent") == F.col("__p"), "left")
        configs = joined.select("path", "folder", F.col("__up").alias("parent"), *[F.coalesce(c, f"__{c}").alias(c) for c in kept])
    return configs


def nearest_configs(sources: DataFrame, configs: DataFrame) -> DataFrame:
    """sources(path, ...) with ``config``, ``base_url``, ``strict`` and ``paths`` of the project file in the closest folder above; nulls without.

    Only the distinct folders of the sources meet the configs. base_url is the config's own folder where it has none.
    """
    own = with_bases(configs).where(F.element_at(F.split("path", "/"), -1) == PROJECT_FILE)
    own = own.select(F.col("folder").alias("__in"), F.struct(F.col("path").alias("config"), F.coalesce("base_url", "folder").alias("base_url"), "strict", "paths").alias("__found"))
    folders = sources.select(folder_of(F.col("path")).alias("__folder")).distinct()
    met = folders.withColumn("__above", F.explode(folders_of(F.col("__folder")))).join(own, F.col("__above") == F.col("__in"))
    best = met.groupBy("__folder").agg(F.max_by("__found", F.length("__above")).alias("__found")).withColumnRenamed("__folder", "__of")
    return sources.join(best, folder_of(F.col("path")) == F.col("__of"), "left").select(*sources.columns, "__found.*")


def aliased(target: Column, base_url: Column, paths: Column) -> Column:
    """The first alias of a project file whose folder holds the target, with the rest of it and without an extension; null without."""
    folder = lambda f: normal_path(F.concat_ws("/", F.when(base_url != "", base_url), F.regexp_replace(f, r"/?\*$", "")))
    pairs = F.flatten(F.transform(F.map_entries(paths), lambda e: F.transform(e["value"], lambda f: F.struct(e["key"].alias("alias"), folder(f).alias("folder")))))
    first = F.get(F.filter(pairs, lambda p: (target == p["folder"]) | (p["folder"] == "") | target.startswith(F.concat(p["folder"], F.lit("/")))), F.lit(0))
    rest = F.regexp_replace(F.substring(target, F.length(first["folder"]) + 1, F.length(target)), "^/", "")
    plain = F.concat_ws("/", first["alias"], F.when(rest != "", rest))
    return F.when(first.isNotNull(), strip_extension(F.when(first["alias"].contains("*"), F.concat(F.split_part(first["alias"], F.lit("*"), F.lit(1)), rest)).otherwise(plain)))


def region_commits(logs: DataFrame) -> DataFrame:
    """(region, commit): the distinct commits in logs(region, output), one hash on a line; other lines, as of a diff, go."""
    lines = logs.select("region", F.explode(F.split("output", "\n")).alias("line")).select("region", trim_all(F.col("line")).alias("commit"))
    return lines.where(F.col("commit").rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")).distinct()


def git_logs(regions: DataFrame, repository: str) -> DataFrame:
    """(region, output) of regions(region string, path, first, last): the log of the lines of each.

    Tasks run git, so the repository has to be a clone that all of them reach. Regions without a
    history, as of unknown files, have an empty output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asked = ["git", "-C", repository, "log", "-s", "--format=%H", "-L", f"{r['first']},{r['last']}:{r['path']}"]
                done = subprocess.run(asked, capture_output=True, text=True, check=False)
                yield pa.RecordBatch.from_pydict({"region": [r["region"]], "output": [done.stdout if done.returncode == 0 else ""]}, pa.schema([("region", pa.string()), ("output", pa.string())]))

    return regions.select("region", "path", "first", "last").mapInArrow(run, "region string, output string")

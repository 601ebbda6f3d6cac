"""Scans of source files, and of what a text exports, imports and re-exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import NOT_BEFORE_WORD, extname, trim_all

SUPPORTED = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]
# Folders that are passed over.
IGNORED = ["node_modules", "dist", "out", "build", ".next", ".nuxt", "coverage", ".git", ".vscode", "__pycache__", ".turbo"]
MOST_LINES = 2000
EXPORT = r"(?m)^export\s+(?:default\s+)?(?:const|function|class|interface|type|enum|abstract\s+class)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
IMPORT = r"from\s+['\"]([^'\"]+)['\"]"
NAMED_REEXPORT = r"export\s*\{([^}]+)\}\s*from\s*['\"]([^'\"]+)['\"]"
STAR_REEXPORT = r"export\s*\*(?:\s+as\s+\w+)?\s+from\s*['\"]([^'\"]+)['\"]"


def read_files(spark: SparkSession, paths: list[str] | str, pattern: str = "*") -> DataFrame:
    """(path, mtime, text) of every file below paths whose name fits; read by the executors, one row a file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    return found.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, r"[\\/]"), F.array(*[F.lit(x) for x in IGNORED]))


def supported(path: Column) -> Column:
    return extname(path).isin(*SUPPORTED)


def framework_of(text: Column, path: Column) -> Column:
    """By extension, then by decorators and calls of the frameworks."""
    return (
        F.when(path.endswith(".vue"), "vue")
        .when(path.endswith(".svelte"), "svelte")
        .when(text.rlike(r"@Component\s*\(|@NgModule\s*\(|@Injectable\s*\("), "angular")
        .when(text.rlike(r"component\$\s*\(|useSignal\s*\(|useStore\s*\(|useTask\$\s*\("), "qwik")
        .when(text.rlike(r"from ['\"]react['\"]|useState|useEffect"), "react")
        .otherwise("none")
    )


def workspace_framework(text: Column, ext: Column) -> Column:
    """The looser test of the workspace scan."""
    return (
        F.when(ext == ".vue", "vue")
        .when(ext == ".svelte", "svelte")
        .when(text.rlike("@Component|@NgModule|@Injectable"), "angular")
        .when(text.rlike(r"component\$\s*\(|useSignal\s*\(|useStore\s*\(|useTask\$\s*\("), "qwik")
        .when(text.rlike(r"from ['\"]react['\"]|jsx|useState"), "react")
        .otherwise("none")
    )


def exports_of(text: Column, regex: str = EXPORT) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(1))


def imports_of(text: Column, regex: str = IMPORT) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(1))


def is_barrel(path: Column, exports: Column, imports: Column) -> Column:
    return path.rlike(r"index\.[jt]sx?$") | ((F.size(exports) > 5) & (F.size(imports) == 0))


def scan_workspace(files: DataFrame, export_regex: str = EXPORT, import_regex: str = IMPORT) -> DataFrame:
    """files(path, text) with ext, line_count, exports, imports, is_barrel and framework; too long files and ignored folders go."""
    out = files.where(supported(F.col("path")) & ~ignored(F.col("path")))
    out = out.withColumns({"ext": extname(F.col("path")), "line_count": F.size(F.split("text", "\n")), "exports": exports_of(F.col("text"), export_regex), "imports": imports_of(F.col("text"), import_regex)})
    out = out.where(F.col("line_count") <= MOST_LINES)
    out = out.withColumn("is_barrel", is_barrel(F.col("path"), F.col("exports"), F.col("imports")))
    return out.withColumn("framework", workspace_framework(F.col("text"), F.col("ext")))


def reexports(files: DataFrame) -> DataFrame:
    """(path, specifier, symbol): each re-exported name by its original name; ``*`` for all of a module."""
    named = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(NAMED_REEXPORT), F.lit(1)).alias("names"), F.regexp_extract_all("text", F.lit(NAMED_REEXPORT), F.lit(2)).alias("specifier")
    )
    rows = files.select("path", F.explode(named).alias("r")).select("path", F.col("r.specifier").alias("specifier"), F.explode(F.split("r.names", ",")).alias("n"))
    rows = rows.select("path", "specifier", trim_all(F.element_at(F.split(trim_all(F.col("n")), r"\s+as\s+"), 1)).alias("symbol")).where("symbol <> ''")
    stars = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(STAR_REEXPORT), F.lit(1))).alias("specifier"))
    return rows.unionByName(stars.withColumn("symbol", F.lit("*")))


def directive_of(text: Column) -> Column:
    """'use client' or 'use server' if that is the first line that is neither blank nor comment, else null."""

    def step(s: Column, line: Column) -> Column:
        t = trim_all(line)
        closes = t.contains("*/")
        opens = t.startswith("/*")
        skip = (t == "") | t.startswith("//") | opens | s["inside"]
        inside = F.when(s["inside"], ~closes).otherwise(opens & ~closes)
        first = F.coalesce(s["first"], F.when(~skip, t))
        return F.struct(F.when(s["first"].isNotNull(), s["inside"]).otherwise(inside).alias("inside"), first.alias("first"))

    begin = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("string").alias("first"))
    first = F.aggregate(F.split(text, "\n"), begin, step, lambda s: s["first"])
    return F.when(first.rlike("^['\"]use client['\"];?$"), "use client").when(first.rlike("^['\"]use server['\"];?$"), "use server")


def is_route_module(text: Column) -> Column:
    return text.rlike(r"export\s+(?:async\s+)?(?:function|const)\s+(loader|action|meta)" + NOT_BEFORE_WORD)


def has_event_handlers(text: Column) -> Column:
    return text.rlike(r"on[A-Z][A-Za-z]+\s*=")


def is_store(text: Column) -> Column:
    return text.rlike(r"(?<![A-Za-z0-9_])const\s+\w+\s*=\s*(writable|readable)\s*\(")


def block(text: Column, tag: str) -> Column:
    """What stands inside the first such element, '' if there is none."""
    return F.regexp_extract(text, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def without_blocks(text: Column) -> Column:
    """The template of a single-file component: all but its scripts and styles."""
    return trim_all(F.regexp_replace(F.regexp_replace(text, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", ""))

"""Scalar functions over names, paths and source text, as Column expressions.

Regular expressions spell word boundaries as lookarounds over [A-Za-z0-9_]: Java's own \\b also
counts letters beyond ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AFTER_WORD = "(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = "(?![A-Za-z0-9_])"
#: Distinct identifiers of a text: words, and names that begin at a $ inside a word.
IDENTIFIER = r"(?<![A-Za-z0-9_])[a-zA-Z_][A-Za-z0-9_]*|(?<=[A-Za-z0-9_])\$[A-Za-z0-9_]+"

# The names of languages by extension.
LANGUAGES = {
    "ts": "TypeScript",
    "tsx": "TypeScript/React",
    "js": "JavaScript",
    "jsx": "JavaScript/React",
    "mts": "TypeScript (ESM)",
    "cts": "TypeScript (CJS)",
    "mjs": "JavaScript (ESM)",
    "cjs": "JavaScript (CJS)",
    "py": "Python",
    "java": "Java",
    "cs": "C#",
    "go": "Go",
    "rs": "Rust",
}


def word(name: str) -> str:
    return NOT_AFTER_WORD + name + NOT_BEFORE_WORD


def matches(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def lookup_text(values: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key), F.lit(default))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def html_escape(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(text, F.lit("")))


def kebab(name: Column) -> Column:
    """A dash before every capital, lower case, without a dash in front."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "([A-Z])", "-$1")), "^-", "")


def kebab_words(name: Column) -> Column:
    """A dash only where a capital follows a lower-case letter or digit; what is no letter or digit is a dash too."""
    parted = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2")
    return F.lower(F.regexp_replace(F.regexp_replace(parted, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))


def pascal(name: Column) -> Column:
    """Without extension; the first letter of each part after -, _ or space is raised, all but letters and digits goes."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]+$", ""), r"[-_\s]+")
    raised = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**30)))
    return F.regexp_replace(F.array_join(raised, ""), "[^a-zA-Z0-9]", "")


def title(name: Column) -> Column:
    spaced = F.regexp_replace(name, "([A-Z])", " $1")
    return trim_all(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 2**30)))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    parts = F.split(path, "/")
    up = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return F.when(up == "", F.lit(".")).otherwise(up)


def extname(path: Column) -> Column:
    """From the last dot of the base name, unless that is its first character."""
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[jt]sx?$", "")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def relative_path(start: Column, target: Column) -> Column:
    """From the folder of one relative path to another path, without a script extension."""
    own = F.split(start, "/")
    folders = F.slice(own, F.lit(1), F.size(own) - 1)
    parts = F.split(target, "/")
    most = F.least(F.size(folders), F.size(parts) - 1)
    same = F.when(most > 0, F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.get(folders, i - 1) == F.get(parts, i - 1)))
    first_other = F.array_position(same, F.lit(False))
    common = F.when(most <= 0, F.lit(0)).when(first_other > 0, first_other.cast("int") - 1).otherwise(most)
    up = F.size(folders) - common
    prefix = F.when(up == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), up))
    return strip_extension(F.concat(prefix, F.array_join(F.slice(parts, common + 1, F.greatest(F.size(parts) - common, F.lit(0))), "/")))


def has_chained_calls(text: Column) -> Column:
    return matches(text, r"\.[A-Za-z_$][A-Za-z0-9_$]*\s*\(") >= 2


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def djb2(text: Column) -> Column:
    """hash = hash * 33 xor code, in 32 bits, as 8 hexadecimal digits."""
    step = lambda h, c: (h * 33).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.ascii(c).cast("bigint"))
    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(5381).cast("bigint"), step)
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def region_hash(kind: Column, ext: Column, text: Column) -> Column:
    return djb2(F.concat_ws("|", kind, ext, text))


def max_bracket_depth(text: Column) -> Column:
    """Deepest nesting of { ( [ over all three kinds; a closing one at depth 0 changes nothing."""
    brackets = F.split(F.regexp_replace(text, r"[^{}()\[\]]", ""), "")

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c.isin("{", "(", "["), s["depth"] + 1).when(c.isin("}", ")", "]"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.greatest(s["most"], depth).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")), step, lambda s: s["most"])


def language_of(path: Column) -> Column:
    names = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(names, F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit("Unknown"))


def severity_rank(severity: Column) -> Column:
    ranks = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), severity), F.lit(0))


def confidence_percent(confidence: Column) -> Column:
    of = {"definitive": 97, "high": 85, "medium": 65, "low": 40, "speculative": 20}
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.lit(v))]), confidence), F.lit(0))

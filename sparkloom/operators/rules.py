"""Rules as data: a name, a severity and a predicate over columns; all rules of a set are evaluated in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, matches, word
from sparkloom.sources.scans import block, without_blocks


@dataclass(frozen=True)
class Rule:
    """when: predicate over the columns of the table that the rule is for. Texts are this project's own."""

    name: str
    severity: str
    when: Callable[[], Column]
    advice: str = ""
    fixable: bool = False


def hits(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(*keys, ordinal, name, severity, advice, fixable): a row for each rule that applies, in the order of the rules.

    One projection and one explode, however many rules; a predicate that is null does not apply.
    """
    found = [
        F.when(
            r.when(),
            F.struct(F.lit(i).alias("ordinal"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), F.lit(r.advice).alias("advice"), F.lit(r.fixable).alias("fixable")),
        )
        for i, r in enumerate(rules)
    ]
    if not found:
        none = F.array().cast("array<struct<ordinal:int,name:string,severity:string,advice:string,fixable:boolean>>")
        return df.select(*keys, F.explode(none).alias("hit")).select(*keys, "hit.*")
    return df.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("hit")).select(*keys, "hit.*")


def _t() -> Column:
    return F.col("text")


def _has(regex: str) -> Callable[[], Column]:
    return lambda: _t().rlike(regex)


def _count(regex: str) -> Column:
    return matches(_t(), regex)


def _kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


# Fixed patterns: the six concerns of a component.
CONCERNS = [r"useState|useReducer", r"useEffect", r"fetch|axios|useSWR|useQuery", r"\.(map|filter|reduce)\(", r"styled\.|css`|className", r"dispatch|createSlice|useSelector"]


def concerns() -> Column:
    return reduce(lambda a, b: a + b, [_t().rlike(c).cast("int") for c in CONCERNS])


def _component(p: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: _kind("react-component", "context-provider") & p()


def _hook(p: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: _kind("hook") & p()


MAGIC_NUMBER = r"(?<![A-Za-z0-9_])(?<!['\"./])(?!0\.)\d{2,}(?![A-Za-z0-9_])(?!['\"./])"

#: For regions(kind, name, text, line_count, loose_cc, nesting, path, imports), one after the other as they are reported.
CODE_RULES = [
    Rule("God Component", "critical", _component(lambda: concerns() >= 4), "Give each concern a hook or component of its own", True),
    Rule("Prop Drilling", "high", _component(lambda: _count(r"props\.\w+\.\w+\.\w+") >= 2), "Share state by context or a hook"),
    Rule("Mixed Concerns — API + Render", "high", _component(lambda: _t().rlike(r"fetch\(|axios\.|\.then\(") & _t().rlike(r"<[A-Z]\w*")), "Move data access into a hook", True),
    Rule("Excessive Inline Styles", "low", _component(lambda: _count(r"style\s*=\s*\{\{") > 3), "Move styles out of the markup"),
    Rule(
        "Missing Memoisation on Mapped JSX",
        "medium",
        _component(lambda: ~_t().rlike("useCallback|useMemo") & _t().rlike(r"\.map\(.*=>\s*<") & (F.col("line_count") > 40)),
        "Memoise the mapped elements",
    ),
    Rule("Direct DOM Manipulation", "high", _component(_has(r"document\.(getElementById|querySelector|createElement)")), "Use references instead of the document"),
    Rule(
        "SetState Outside Effect",
        "critical",
        _component(lambda: _t().rlike(r"setState\(|useState") & _t().rlike(r"<\w") & _t().rlike(r"setState\([^)]*\)(?!\s*,\s*\(\))") & ~_t().rlike("useEffect")),
        "Set state in effects or handlers",
    ),
    Rule("Missing useEffect Dependency Array", "high", _hook(lambda: _t().rlike(r"useEffect\s*\(\s*(?:async\s*)?\(\s*\)\s*=>") & ~_t().rlike(r",\s*\[")), "Name the effect's dependencies"),
    Rule("Async useEffect", "medium", _hook(_has(r"useEffect\s*\(\s*async")), "Call an async function inside the effect"),
    Rule("Oversized Module (>200 lines)", "critical", lambda: F.col("line_count") > 200, "Split into modules", True),
    Rule("Large Module (>100 lines)", "high", lambda: (F.col("line_count") > 100) & (F.col("line_count") <= 200), "Consider splitting", True),
    Rule("Extreme Nesting (>8 levels)", "critical", lambda: F.col("nesting") > 8, "Return early or extract functions"),
    Rule("Deep Nesting (>5 levels)", "medium", lambda: (F.col("nesting") > 5) & (F.col("nesting") <= 8), "Return early or extract functions"),
    Rule("Extreme Cyclomatic Complexity (>20)", "critical", lambda: F.col("loose_cc") > 20, "Break into smaller functions", True),
    Rule("High Cyclomatic Complexity (>10)", "high", lambda: (F.col("loose_cc") > 10) & (F.col("loose_cc") <= 20), "Name the conditions", True),
    Rule("Magic Numbers", "low", lambda: _count(MAGIC_NUMBER) > 4, "Name the constants"),
    Rule("Long Switch Statement", "medium", lambda: _count(word("case")) > 8, "Use a lookup table"),
    Rule("TODO/FIXME Debt", "low", lambda: _count(r"//.*(?:TODO|FIXME|HACK|XXX)") > 2, "Resolve or track the remarks"),
    Rule(
        "Console Logging",
        "low",
        lambda: (_count(NOT_AFTER_WORD + r"console\.(?:log|warn|error|debug|info)" + NOT_BEFORE_WORD) > 0)
        & ~F.col("path").rlike("(?i)test|spec|__tests__")
        & ~F.col("name").rlike("(?i)api|middleware|server|route")
        & ~F.arrays_overlap(F.col("imports"), F.array(F.lit("pino"), F.lit("winston"))),
        "Use a logger",
    ),
    Rule("Excessive `any` Usage", "medium", lambda: (_count(r":\s*any" + NOT_BEFORE_WORD) > 2) & ~F.col("name").rlike("(?i)isRecord|assertIs|typeGuard|isType"), "Use precise types"),
    Rule("Non-null Assertion Abuse", "medium", lambda: _count(r"[^!]!\s*[.\[(]") > 3, "Check for null"),
]

SECTIONS = [r"(?<![A-Za-z0-9_])data\s*\(", *[NOT_AFTER_WORD + s + r"\s*:" for s in ("methods", "computed", "watch", "props", "emits")]]


def with_vue_blocks(df: DataFrame) -> DataFrame:
    """Adds script_setup, script_legacy, script and template of single-file components in ``text``."""
    setup = F.regexp_extract("text", r"(?is)<script\s[^>]*setup[^>]*>(.*?)</script>", 1)
    legacy = F.regexp_extract("text", r"(?is)<script(?!\s[^>]*setup)[^>]*>(.*?)</script>", 1)
    out = df.withColumns({"script_setup": setup, "script_legacy": legacy, "template": F.regexp_extract("text", r"(?is)<template>(.*?)</template>", 1)})
    return out.withColumn("script", F.when(F.col("script_setup") != "", F.col("script_setup")).otherwise(F.col("script_legacy")))


def _sections() -> Column:
    return reduce(lambda a, b: a + b, [F.col("script_legacy").rlike(s).cast("int") for s in SECTIONS])


def _refs() -> Column:
    regex = r"const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:ref|computed|reactive|shallowRef|readonly)\s*\("
    return F.size(F.array_distinct(F.regexp_extract_all("script_setup", F.lit(regex), F.lit(1))))


def _in(column: str, regex: str) -> Column:
    return F.col(column).rlike(regex)


def _lines(column: Column) -> Column:
    return F.size(F.split(column, "\n"))


VUE_RULES = [
    Rule("Vue Composable Candidate", "medium", lambda: (_refs() >= 3) | ((_refs() >= 2) & (matches(F.col("script_setup"), NOT_AFTER_WORD + r"watch(?:Effect)?\s*\(") > 0)), "Move the state into a composable"),
    Rule("Untyped defineProps", "medium", lambda: _in("script", r"defineProps\s*\(\s*\["), "Give the props types"),
    Rule("watch Without Cleanup", "high", lambda: _in("script", NOT_AFTER_WORD + r"watch\s*\(") & ~_in("script", "onWatcherCleanup|onCleanup") & _in("script", r"setTimeout|setInterval|fetch\(|addEventListener"), "Clean up in the watcher"),
    Rule("addEventListener Without onUnmounted Cleanup", "high", lambda: _in("script", "addEventListener") & ~_in("script", "onUnmounted"), "Remove the listener on unmount"),
    Rule("Vue Composition API Migration Guide", "medium", lambda: (F.col("script_legacy") != "") & (_sections() >= 3), "Migrate section by section"),
    Rule("Fat data() Function", "medium", lambda: _lines(F.regexp_extract("script_legacy", r"(?s)data\s*\(\s*\)\s*\{(.*?)\}", 1)) > 20, "Use single references"),
    Rule("Options API God Component", "critical", lambda: (F.col("script_legacy") != "") & (_sections() >= 5), "Extract composables"),
    Rule("v-if + v-for on Same Element", "high", lambda: _in("template", "v-for[^>]+v-if|v-if[^>]+v-for"), "Filter before the loop"),
    Rule("Direct Prop Mutation in Template", "critical", lambda: ~_in("template", r"\$emit\s*\(") & _in("template", NOT_AFTER_WORD + r"props\.\w+\s*="), "Emit an event instead"),
    Rule("Missing :key on v-for", "medium", lambda: _in("template", "v-for") & ~_in("template", "v-for[^>]+:key|:key[^>]+v-for"), "Add a key"),
    Rule("Heavy Inline Template Expressions", "low", lambda: matches(F.col("template"), r"\{\{[^}]{60,}\}\}") > 2, "Use computed properties"),
    Rule("Oversized Vue SFC (>300 lines)", "high", lambda: _lines(_t()) > 300, "Extract components", True),
]

_INIT = r"(?s)ngOnInit\s*\(\s*\)\s*\{(.*?)(?=\n\s{2}\w|\n\})"


def _init_lines() -> Column:
    body = F.regexp_extract("text", _INIT, 1)
    return F.size(F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\s+", "") != ""))


def _inline_template() -> Column:
    one = lambda q: F.regexp_extract("text", rf"(?s)template\s*:\s*{q}(.*?){q}", 1)
    found = lambda q: _t().rlike(rf"(?s)template\s*:\s*{q}.*?{q}")
    return F.when(found("`"), one("`")).when(found("'"), one("'")).otherwise(one('"'))


def _angular(p: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: _t().rlike(r"@Component\s*\(") & p()


ANGULAR_RULES = [
    Rule("Long Inline Angular Template", "medium", _angular(lambda: _lines(_inline_template()) > 5), "Use a template file"),
    Rule("Inline Angular Styles", "low", _angular(_has(r"styles\s*:\s*\[`")), "Use a style file"),
    Rule("Missing OnPush Change Detection", "medium", _angular(lambda: ~_t().rlike(r"changeDetection\s*:\s*ChangeDetectionStrategy\.OnPush")), "Set OnPush"),
    Rule(
        "Angular Service Extraction Candidate",
        "medium",
        _angular(lambda: _t().rlike(_INIT) & ((_init_lines() > 10) | (_count(r"\n\s{2}[A-Za-z_$][\w$]*\s*\(") >= 4))),
        "Move the logic into a service",
    ),
    Rule("Angular Standalone Migration Candidate", "medium", _angular(lambda: ~_t().rlike(r"standalone\s*:\s*true")), "Make it standalone"),
    Rule("Missing providedIn in @Injectable", "high", lambda: _t().rlike(r"@Injectable\s*\(") & ~_t().rlike(r"providedIn\s*:"), "Say where it is provided"),
    Rule("Observable Subscription Leak", "critical", lambda: _t().rlike(r"\.subscribe\s*\(") & ~_t().rlike(r"implements OnDestroy|ngOnDestroy\s*\(") & ~_t().rlike(r"takeUntil|takeUntilDestroyed|pipe\s*\("), "Unsubscribe on destroy"),
    Rule("Complex ngOnInit", "high", lambda: _t().rlike(_INIT) & (_init_lines() > 15), "Extract methods"),
    Rule("Direct DOM Access in Angular Component", "high", _has(r"document\.getElementById|document\.querySelector(?!All)"), "Use view references"),
    Rule("Excessive any in Angular Service/Component", "medium", lambda: _count(r":\s*any" + NOT_BEFORE_WORD) > 3, "Use precise types"),
    Rule("Oversized Angular Class (>250 lines)", "high", lambda: _lines(_t()) > 250, "Extract services", True),
]


def with_svelte_blocks(df: DataFrame) -> DataFrame:
    return df.withColumns({"script": block(_t(), "script"), "template": without_blocks(_t())})


SVELTE_RULES = [
    Rule("Excessive $: Reactive Statements", "medium", lambda: matches(F.col("script"), r"(?m)^\s*\$:") > 6, "Group the statements"),
    Rule("Store Subscription Without onDestroy", "critical", lambda: _in("script", r"\.subscribe\s*\(") & ~_in("script", r"import\s*\{[^}]*onDestroy|onDestroy\s*\(") & ~_in("template", r"\$\w+"), "Unsubscribe on destroy"),
    Rule("Direct Writable Store Assignment in Template", "low", lambda: _in("template", r"\$\w+\s*=\s*") & _in("script", "writable"), "Use set() or update()"),
    Rule("Missing key on {#each}", "medium", lambda: _in("template", r"\{#each") & ~_in("template", r"\{#each[^}]+(key)"), "Add a key"),
    Rule("getContext Without setContext in Tree", "high", lambda: _in("script", "getContext") & ~_t().rlike("setContext"), "Set the context above"),
    Rule("Excessive Inline Event Handlers", "low", lambda: matches(F.col("template"), r"on:\w+\s*=\s*\{[^}]{40,}\}") > 3, "Name the handlers"),
    Rule("Oversized Svelte Component (>200 lines)", "high", lambda: _lines(_t()) > 200, "Extract components", True),
]


def framework_hits(files: DataFrame, keys: list[str], framework: str) -> DataFrame:
    """Hits of the framework's rules over files of it; files has ``text``. React, qwik and none have no rules here."""
    if framework == "vue":
        return hits(with_vue_blocks(files), keys, VUE_RULES)
    if framework == "angular":
        return hits(files, keys, ANGULAR_RULES)
    if framework == "svelte":
        return hits(with_svelte_blocks(files), keys, SVELTE_RULES)
    return hits(files, keys, [])


def repeated_fragments(lines: DataFrame, region: str, order: str, text: str, width: int = 3, least_length: int = 60) -> DataFrame:
    """(fingerprint, regions, at): windows of so many consecutive lines that occur in more than one region.

    Letters are lower-cased and numbers and white space made alike before hashing; names stay, for renamed
    copies see ``checks.duplicate_logic`` over the parser's fingerprints. A window is built by
    lead() within its region; only digests are shuffled between regions, counted before they meet.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(region).orderBy(order)
    normal = F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), "[0-9]+", "0"), r"\s+", " ")
    ahead = [F.lead(normal, i).over(w) if i else normal for i in range(width)]
    length = reduce(lambda a, b: a + b, [F.length(F.lead(F.col(text), i).over(w)) if i else F.length(F.col(text)) for i in range(width)])
    windows = lines.select(region, order, length.alias("__len"), *[a.alias(f"__l{i}") for i, a in enumerate(ahead)])
    windows = windows.where(F.col("__len") >= least_length).select(region, F.sha2(F.concat_ws("|", *[f"__l{i}" for i in range(width)]).cast("binary"), 256).alias("fingerprint"))
    return windows.groupBy("fingerprint").agg(F.countDistinct(region).alias("regions"), F.min(region).alias("first"), F.count("*").alias("windows")).where("regions > 1")

"""Texts and flags that accompany results: explanations, colours, names taken from files, flags of symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.numeric import whole
from sparkloom.functions.text import lookup_text, pascal, trim_all

# The colours of grades and severities.
GRADE_COLOR = {
    "S": "var(--vscode-terminal-ansiGreen,#4caf50)",
    "A": "var(--vscode-terminal-ansiGreen,#88c057)",
    "B": "var(--vscode-terminal-ansiYellow,#c5c022)",
    "C": "var(--vscode-editorWarning-foreground,#cca700)",
    "D": "var(--vscode-terminal-ansiRed,#e06c75)",
    "F": "var(--vscode-editorError-foreground,#f14c4c)",
}
SEVERITY_COLOR = {
    "critical": "var(--vscode-editorError-foreground,#f14c4c)",
    "high": "var(--vscode-editorWarning-foreground,#cca700)",
    "medium": "var(--vscode-editorInfo-foreground,#3794ff)",
    "low": "var(--vscode-descriptionForeground,#888)",
    "info": "var(--vscode-descriptionForeground,#666)",
}
OTHER_COLOR = "#888"
# Bits of a symbol's flags, as the language's public compiler API numbers them.
TYPE_BITS = {"enum member": 1 << 3, "interface": 1 << 6, "type literal": 1 << 11, "type parameter": 1 << 18, "type alias": 1 << 19}
VALUE_BITS = {"function variable": 1 << 0, "block variable": 1 << 1, "function": 1 << 4, "class": 1 << 5, "value module": 1 << 9, "namespace module": 1 << 10}
DUAL_BITS = {"const enum": 1 << 7, "enum": 1 << 8}
#: What each band of a file says, before and after its threshold.
BAND_TEXT = {
    "trivial-file": ("trivial", "raised to", "only very strong signals lead to extraction"),
    "simple-file": ("simple", "is", "extraction needs moderate signals"),
    "typical-file": ("typical", "is", "the usual criteria apply"),
    "complex-file": ("complex", "lowered to", "more regions qualify for extraction"),
    "highly-complex-file": ("highly complex", "lowered to", "extraction is strongly encouraged"),
}


def grade_color(grade: Column) -> Column:
    return lookup_text(GRADE_COLOR, grade, OTHER_COLOR)


def severity_color(severity: Column) -> Column:
    return lookup_text(SEVERITY_COLOR, severity, OTHER_COLOR)


def explain_threshold(band: Column, threshold: Column, p75: Column, bias: Column) -> Column:
    """A sentence on a file's threshold; the bias of the setting is named if there is one."""
    percent = lambda x: whole(x * 100.0).cast("string")
    part = lambda i: lookup_text({k: v[i] for k, v in BAND_TEXT.items()}, band, "")
    sign = F.when(bias > 0, "+").otherwise("")
    setting = F.when(bias != 0, F.concat(F.lit(" (with "), sign, percent(bias), F.lit("% from settings)"))).otherwise("")
    return F.concat(
        F.lit("P75 effort "), whole(p75).cast("string"), F.lit(": "), part(0), F.lit(" file, threshold "), part(1), F.lit(" "), percent(threshold), F.lit("%; "), part(2), setting
    )


def symbol_namespaces(flags: Column) -> Column:
    """STRUCT<is_type, is_value> of a symbol's flags; an enumeration is a value whose members are types."""
    bits = lambda table: sum(table.values())
    has = lambda mask: flags.bitwiseAND(F.lit(mask)) != 0
    return F.struct(has(bits(TYPE_BITS)).alias("is_type"), has(bits(VALUE_BITS) + bits(DUAL_BITS)).alias("is_value"))


def is_strict(text: Column, configured: Column) -> Column:
    """Whether the configuration says so or a line of the source does."""
    return F.coalesce(configured, F.lit(False)) | text.rlike(r"(^|\n)\s*['\"]use strict['\"];")


def component_base_name(path: Column) -> Column:
    """The last part of a path in Pascal case; Component without one."""
    base = pascal(F.element_at(F.split(path, r"[\\/]"), -1))
    return F.when(F.coalesce(base, F.lit("")) == "", F.lit("Component")).otherwise(base)


def class_name(text: Column) -> Column:
    """The first exported class, else Component."""
    found = F.regexp_extract(text, r"export\s+class\s+([A-Za-z0-9_]+)", 1)
    return F.when(found == "", F.lit("Component")).otherwise(found)


def reimport(name: Column, relative: Column) -> Column:
    """The line that brings an extracted region back."""
    return F.concat(F.lit("import { "), name, F.lit(" } from '"), relative, F.lit("';"))


# Fixed texts: previews and guides of a migration, the name in the place of %s.
COMPOSABLE = ["export function use%s() {", "  // Related state and watchers, extracted into a composable."]
SERVICE = [
    "import { Injectable } from '@angular/core';",
    "",
    "@Injectable({ providedIn: 'root' })",
    "export class %s {",
    "  // Move data loading, orchestration, and transformation logic here.",
    "}",
]
STANDALONE_GUIDE = [
    "# Standalone migration guide for %s",
    "",
    "1. Add standalone: true to the @Component decorator.",
    "2. Move module dependencies into the component imports array.",
    "3. Delete the NgModule declaration after the component compiles.",
    "4. Keep services injectable via providedIn: 'root' or feature providers.",
]
COMPOSITION_GUIDE = [
    "# Vue Composition API migration guide for %s",
    "",
    "1. Move data() state into ref() / reactive().",
    "2. Convert computed options into computed() declarations.",
    "3. Move watchers into watch() or watchEffect() with cleanup.",
    "4. Split repeated state or logic into useX() composables.",
    "5. Keep the template focused on presentation only.",
]
MOST_RETURNED = 6


def _filled(lines: list[str], name: Column) -> Column:
    return F.replace(F.lit("\n".join(lines)), F.lit("%s"), name)


def composable_preview(name: Column, bindings: Column) -> Column:
    """A composable that returns the first few distinct bindings."""
    names = F.slice(F.array_distinct(bindings), 1, MOST_RETURNED)
    returned = F.when(F.size(names) > 0, F.concat(F.lit("  return { "), F.array_join(names, ", "), F.lit(" };"))).otherwise("  return {};")
    return F.concat(_filled(COMPOSABLE, name), F.lit("\n"), returned, F.lit("\n}"))


def service_preview(name: Column) -> Column:
    service = F.regexp_replace(name, r"Component\z", "Service")
    return _filled(SERVICE, F.when(service == "", "ComponentService").otherwise(service))


def standalone_guide(name: Column) -> Column:
    return _filled(STANDALONE_GUIDE, name)


def composition_guide(name: Column) -> Column:
    return _filled(COMPOSITION_GUIDE, name)


def svelte_updated_source(retained: Column, imports: Column) -> Column:
    """The retained lines with the imports that their script lacks put at its top; without a script, one goes in front."""
    script = F.array_position(F.transform(retained, lambda x: x.rlike(r"(?i)<script(?![A-Za-z0-9_])")), True)
    after = F.slice(retained, (script + 1).cast("int"), F.size(retained))
    closes = F.array_position(F.transform(after, lambda x: x.rlike(r"(?i)</script>")), True)
    inside = F.transform(F.slice(after, 1, F.greatest(closes - 1, F.lit(0)).cast("int")), trim_all)
    missing = F.filter(imports, lambda x: ~F.array_contains(inside, trim_all(x)))
    block = F.concat(F.array(F.lit("<script>")), imports, F.array(F.lit("</script>"), F.lit("")), retained)
    inserted = F.concat(F.slice(retained, F.lit(1), script.cast("int")), missing, F.array(F.lit("")), after)
    whole_script = (script > 0) & (closes > 0)
    return F.array_join(F.when(~whole_script, block).when(F.size(missing) == 0, retained).otherwise(inserted), "\n")

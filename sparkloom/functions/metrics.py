"""Code metrics of a text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.numeric import clamp, half_up, whole
from sparkloom.functions.text import IDENTIFIER, matches, trim_all, word

# Weight of each kind of region in a bundle.
KIND_WEIGHT = {
    "react-component": 2.0,
    "hook": 1.5,
    "context-provider": 1.8,
    "hoc": 1.6,
    "class": 1.8,
    "utility-function": 1.0,
    "constant-block": 0.5,
    "type-block": 0.1,
    "enum": 0.4,
    "namespace": 1.2,
}
BRANCH_WORDS = ["if", "else", "for", "while", "do", "switch", "case", "catch"]


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(float(default)))


def line_stats(text: Column) -> dict[str, Column]:
    """loc, blank_lines, comment_lines and code_lines; a comment line starts with // or *.

    Lines are counted where they start, without splitting the text.
    """
    start = r"(?<![^\n])[ \t\x0B\f\r]*"
    loc = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    blank = matches(text, start + r"(?![^\n])")
    comment = matches(text, start + r"(?://|\*)")
    return {"loc": loc, "blank_lines": blank, "comment_lines": comment, "code_lines": loc - blank - comment}


def cyclomatic(text: Column) -> Column:
    """1 and one for each branch word and operator. They share no characters, so one pass counts them all."""
    return F.lit(1) + matches(text, word(f"(?:{'|'.join(BRANCH_WORDS)})") + r"|\?\?|\?\.|&&|\|\|")


def loose_cyclomatic(text: Column) -> Column:
    """The coarser count that the rules look at; && and || count only between word characters."""
    between = r"(?<=[A-Za-z0-9_])(?:&&|\|\|)(?=[A-Za-z0-9_])"
    return F.lit(1) + matches(text, f"{word('(?:if|for|while)')}|{between}")


def nesting_line_score(text: Column) -> Column:
    """Line-wise cognitive score: structural lines cost 1 plus the nesting so far, flat ones and logical connectives 1."""
    opens = r"^(?:if|else\s+if|for|while|do|switch|catch|(?:function|=>\s*\{))"
    flat = r"^(?:else|case|default|break\s+\w|continue|goto)"

    def step(s: Column, line: Column) -> Column:
        t = trim_all(line)
        nest = t.rlike(opens)
        score = s["score"] + F.when(nest, 1 + s["nesting"]).when(t.rlike(flat), 1).otherwise(0) + matches(line, r"&&|\|\||!(?!=)")
        nesting = s["nesting"] + nest.cast("int")
        nesting = F.when(t.startswith("}") & (nesting > 0), nesting - 1).otherwise(nesting)
        return F.struct(score.alias("score"), nesting.alias("nesting"))

    return F.aggregate(F.split(text, "\n"), F.struct(F.lit(0).alias("score"), F.lit(0).alias("nesting")), step, lambda s: s["score"])


def maintainability(text: Column, loc: Column, cc: Column) -> Column:
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))).cast("double")
    volume = F.when(distinct > 1, distinct * F.log2(distinct)).otherwise(F.lit(1.0))
    raw = 171.0 - 5.2 * F.ln(volume) - 0.23 * cc - 16.2 * F.ln(F.greatest(F.lit(1), loc).cast("double"))
    return clamp(whole(raw * 100.0 / 171.0), F.lit(0), F.lit(100))


def halstead(n1: Column, n2: Column, t1: Column, t2: Column) -> dict[str, Column]:
    """From distinct and total operators and operands; zeros count as 1."""
    n1, n2, t1, t2 = (F.when(x > 0, x.cast("double")).otherwise(F.lit(1.0)) for x in (n1, n2, t1, t2))
    volume = (t1 + t2) * F.log2(n1 + n2)
    difficulty = n1 / 2.0 * (t2 / n2)
    effort = difficulty * volume
    return {
        "volume": whole(volume),
        "effort": whole(effort),
        "difficulty": half_up(difficulty, 1),
        "time": whole(effort / 18.0),
        "bugs": half_up(F.pow(effort, F.lit(2.0 / 3.0)) / 3000.0, 2),
    }


def testability(cc: Column, nesting: Column, is_async: Column, has_jsx: Column, kind: Column) -> Column:
    score = 100 - F.least(F.lit(40), cc * 3) - F.least(F.lit(20), nesting * 4)
    score = score - F.when(is_async, 10).otherwise(0) - F.when(has_jsx, 5).otherwise(0)
    score = score + F.when(kind == "hook", 10).otherwise(0) + F.when((kind == "utility-function") & ~is_async, 15).otherwise(0)
    return clamp(score, F.lit(0), F.lit(100))


def bundle_weight(kind: Column, code_lines: Column) -> Column:
    return half_up(code_lines * lookup(KIND_WEIGHT, kind, 1.0), 1)


def debt_minutes(cc: Column, mi: Column, loc: Column, smells: Column) -> Column:
    over = lambda x: F.greatest(F.lit(0), x)
    return whole(over(cc - 10) * 5 + over(50 - mi) * 2 + over(loc - 100) * 0.5 + smells * 15)


def health_grade(mi: Column, cc: Column) -> Column:
    steps = [("S", 85, 4), ("A", 70, 6), ("B", 55, 9), ("C", 40, 13), ("D", 25, 18)]
    out = F.lit("F")
    for grade, least, most in reversed(steps):
        out = F.when((mi > least) & (cc < most), F.lit(grade)).otherwise(out)
    return out


def comment_quality(text: Column) -> Column:
    s = line_stats(text)
    return whole(s["comment_lines"] / F.greatest(F.lit(1), s["code_lines"]) * 100.0)

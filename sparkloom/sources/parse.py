"""Top-level regions of source files with what they use, bind and import, parsed on the executors.

``parse_files`` turns files(file_id, path, text) into one row a file with nested arrays; the functions
below it explode those into the relations that the operators take. Accuracy: regions are top-level
declarations found by brackets and keywords; the kind of a usage follows from neighbouring tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.lexer import JSX, KEYWORDS, NAME, NUMBER, OPERATOR, REGEX, STRING, TEMPLATE, Scanner, Token

SCRIPTS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs", "svelte")
_OPEN, _CLOSE = {"{", "(", "["}, {"}", ")", "]"}
_TYPE_WORDS = frozenset("any unknown never string number boolean symbol object void null undefined true false".split())
_DECLARING = ("function", "class", "interface", "type", "enum", "namespace", "module", "const", "let", "var", "import", "export", "abstract", "async", "declare")

SCHEMA = """file_id string, engine string,
regions array<struct<ordinal:int,name:string,kind:string,start_line:int,end_line:int,exported:boolean,is_default:boolean,has_jsx:boolean,has_hooks:boolean,has_async:boolean,
 text:string,comment:string,used:array<struct<symbol:string,kind:string>>,bindings:array<string>,operators:array<string>,operands:array<string>,cognitive:int,hook_flags:array<string>,fingerprints:array<string>>>,
imports array<struct<specifier:string,alias:string,name:string,form:string,line:int,statement:string>>"""


PARTS_SCHEMA = "file string, parent int, ordinal int, name string, kind string, start_line int, end_line int, exported boolean, has_jsx boolean, has_hooks boolean, has_async boolean, text string"
LEAST_SPLIT_LINES = 15


def classify(name: str, jsx: bool, hooks: bool) -> str:
    if name.endswith("$") and (jsx or hooks):
        return "react-component" if jsx else "hook"
    if re.match("use[A-Z]", name):
        return "hook"
    if re.match("with[A-Z]", name):
        return "hoc"
    if name.endswith("Provider"):
        return "context-provider"
    if re.match("[A-Z]", name) or (jsx and not hooks):
        return "react-component"
    return "utility-function"


def default_name(path: str) -> str:
    base = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    joined = "".join(p[:1].upper() + p[1:] for p in re.split("[^A-Za-z0-9]+", base) if p)
    return "DefaultExport" if not joined else joined if re.match("[A-Za-z_$]", joined) else f"Export{joined}"


def svelte_script(text: str) -> str:
    """Only the lines of the script, in their places."""
    out, inside = [], False
    for line in text.split("\n"):
        if not inside:
            m = re.search(r"<script\b", line, re.I)
            inside = bool(m)
            out.append(re.sub("<script[^>]*>", "", line[m.start() :], count=1, flags=re.I) if m else "")
        else:
            m = re.search("</script>", line, re.I)
            inside = not m
            out.append(line[: m.start()] if m else line)
    return "\n".join(out)


def _statements(tokens: list[Token]) -> Iterator[tuple[int, int]]:
    """Ranges of the top-level statements: to a semicolon, or a line or brace after which none goes on."""
    start, depth, i = 0, 0, 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == OPERATOR and t.text in _OPEN:
            depth += 1
        elif t.kind == OPERATOR and t.text in _CLOSE:
            depth = max(0, depth - 1)
        following = tokens[i + 1] if i + 1 < len(tokens) else None
        ends = depth == 0 and (
            t.text == ";"
            or following is None
            or (following.line > t.line and _breaks(t, following, tokens, start))
            or (t.text == "}" and _block_statement(tokens, start, i) and following.text not in (";", ",", ".", "?.", "(", "as", "satisfies", "from", "else", "catch", "finally", "while", "=", "|", "&", "=>"))
        )
        if ends:
            yield start, i + 1
            start = i + 1
        i += 1


def _head(tokens: list[Token], start: int) -> int:
    """The first token after decorators and modifiers."""
    i = start
    while i < len(tokens):
        if tokens[i].text == "@":
            i += 2
            while i < len(tokens) and tokens[i].text == ".":
                i += 2
            if i < len(tokens) and tokens[i].text == "(":
                i = _match(tokens, i) + 1
        elif tokens[i].text in ("export", "default", "declare", "abstract", "async"):
            i += 1
        else:
            break
    return i


def _match(tokens: list[Token], i: int) -> int:
    """The bracket that closes the one at i (the last token if none does)."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j].kind == OPERATOR:
            depth += (tokens[j].text in _OPEN) - (tokens[j].text in _CLOSE)
            if depth <= 0:
                return j
    return len(tokens) - 1


def _block_statement(tokens: list[Token], start: int, i: int) -> bool:
    head = _head(tokens, start)
    return head < len(tokens) and tokens[head].text in ("function", "class", "interface", "enum", "namespace", "module", "if", "for", "while", "switch", "try", "{")


def _breaks(t: Token, following: Token, tokens: list[Token], start: int) -> bool:
    if t.text == "@" or tokens[start].text == "@" and _head(tokens, start) > tokens.index(t, start):
        return False
    if t.kind == OPERATOR and t.text not in (")", "]", "}", "++", "--"):
        return False
    if t.kind == NAME and t.text in ("export", "default", "abstract", "async", "declare", "const", "let", "var", "type", "extends", "implements", "from", "import", "return", "new", "function", "class"):
        return False
    return not (following.kind == OPERATOR and following.text not in ("{", "@", "++", "--", "(", "[", "!") or following.text in ("extends", "implements", "instanceof", "in", "as", "satisfies", "from", "else", "catch", "finally"))


def _is_function(tokens: list[Token]) -> bool:
    i = 1 if tokens and tokens[0].text == "async" else 0
    if i >= len(tokens):
        return False
    if tokens[i].text == "function":
        return True
    if tokens[i].text == "(":
        after = _match(tokens, i) + 1
        while after < len(tokens) and tokens[after].text not in ("=>", ";", "{") and after < i + 400:
            if tokens[after].text in _OPEN:
                after = _match(tokens, after)
            after += 1
        return after < len(tokens) and tokens[after].text == "=>"
    return tokens[i].kind == NAME and i + 1 < len(tokens) and tokens[i + 1].text == "=>"


def _usages(tokens: list[Token]) -> list[tuple[str, str]]:
    found: dict[tuple[str, str], None] = {}
    heritage, in_type = False, False
    for i, t in enumerate(tokens):
        before, after = (tokens[i - 1].text if i else ""), (tokens[i + 1].text if i + 1 < len(tokens) else "")
        if t.text in ("extends", "implements"):
            heritage = True
        elif t.text == "{":
            heritage = in_type = False
        elif t.kind == OPERATOR and t.text in (":", "<") and (t.text == "<" or i and tokens[i - 1].kind == NAME or before in (")", "]", "}", "?")):
            in_type = t.text == ":" and not _in_object(tokens, i)
        elif t.kind == OPERATOR and t.text in (",", ";", "=", ")", "=>", "}"):
            in_type = False
        if t.kind != NAME or t.text in KEYWORDS or re.fullmatch("[a-z]{1,3}", t.text) or before in (".", "?."):
            continue
        if heritage:
            kind = "inheritance"
        elif after == "(" or before == "new":
            kind = "call"
        elif in_type or before in ("as", "satisfies", "keyof", "is") or (before == "<" and after in (">", ",")):
            kind = "type"
        else:
            kind = "reference"
        found[t.text, kind] = None
    return list(found)


def _in_object(tokens: list[Token], i: int) -> bool:
    """Whether the colon at i stands between a key and a value: the brace around opens an object, or a ? came before."""
    depth = 0
    for j in range(i - 1, max(-1, i - 200), -1):
        text = tokens[j].text
        if tokens[j].kind != OPERATOR:
            if depth == 0 and text in ("case", "default"):
                return True
            continue
        if text in _CLOSE:
            depth += 1
        elif text in _OPEN:
            if depth == 0:
                return text == "{" and j > 0 and tokens[j - 1].text in ("=", "(", ",", "return", "[", ":", "=>", "?")
            depth -= 1
        elif text == "?" and depth == 0:
            return True
    return False


def _bindings(tokens: list[Token]) -> list[str]:
    """Names that the region binds: declared variables and functions, parameters, destructured names."""
    found: dict[str, None] = {}

    def names(part: list[Token]) -> None:
        depth = 0
        for k, x in enumerate(part):
            if x.kind == OPERATOR and x.text in _OPEN:
                depth += 1
            elif x.kind == OPERATOR and x.text in _CLOSE:
                depth -= 1
            elif x.kind == NAME and x.text not in KEYWORDS and (k == 0 or part[k - 1].text in ("{", "[", "(", ",", "...", ":") and not (part[k - 1].text == ":" and depth == 0)):
                if not (k + 1 < len(part) and part[k + 1].text == ":" and depth):
                    found[x.text] = None

    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.text in ("const", "let", "var") and i + 1 < len(tokens):
            j = _match(tokens, i + 1) if tokens[i + 1].text in _OPEN else i + 1
            names(tokens[i + 1 : j + 1])
        elif t.text == "function":
            j = i + 1
            if j < len(tokens) and tokens[j].text == "*":
                j += 1
            if j < len(tokens) and tokens[j].kind == NAME:
                found[tokens[j].text] = None
                j += 1
            if j < len(tokens) and tokens[j].text == "(":
                names(tokens[j + 1 : _match(tokens, j)])
        elif t.text == "(":
            j = _match(tokens, i)
            if j + 1 < len(tokens) and tokens[j + 1].text == "=>":
                names(tokens[i + 1 : j])
        elif t.text == "=>" and i and tokens[i - 1].kind == NAME:
            found[tokens[i - 1].text] = None
        i += 1
    return list(found)


class Cognitive:
    """Cognitive complexity by walking statements: structures cost 1 plus their nesting, else, jumps and runs of one logical operator 1."""

    def __init__(self, tokens: list[Token], multiplier: int = 1):
        self.t, self.score, self.multiplier = tokens, 0, multiplier
        self.walk(0, len(tokens), 0)

    def _structure(self, nesting: int) -> None:
        self.score += (1 + nesting) * self.multiplier

    def _body(self, i: int, end: int) -> int:
        """The end of the statement that begins at i."""
        if i < end and self.t[i].text == "{":
            return min(end, _match(self.t, i) + 1)
        if i < end and self.t[i].text in ("if", "for", "while"):
            j = i + 1
            if j < end and self.t[j].text == "(":
                j = self._body(_match(self.t, j) + 1, end)
            while j < end and self.t[j].text == "else":
                j = self._body(j + 1, end)
            return j
        depth = 0
        for j in range(i, end):
            text = self.t[j].text if self.t[j].kind == OPERATOR else ""
            if text in _OPEN:
                depth += 1
            elif text in _CLOSE:
                if depth == 0:
                    return j
                depth -= 1
            elif text == ";" and depth == 0:
                return j + 1
            elif depth == 0 and j + 1 < end and self.t[j + 1].text == "else":
                return j + 1
        return end

    def walk(self, i: int, end: int, nesting: int) -> None:
        operator, t = "", self.t
        while i < end:
            text = t[i].text if t[i].kind in (OPERATOR, NAME) else ""
            property_ = i > 0 and t[i - 1].text in (".", "?.")
            if t[i].kind == NAME and property_:
                i += 1
                continue
            if text == "if" and i + 1 < end and t[i + 1].text == "(":
                self._structure(nesting)
                i = self._if(i, end, nesting)
                operator = ""
            elif text in ("for", "while", "switch", "catch") and i + 1 < end and (t[i + 1].text in ("(", "await") or text == "catch"):
                self._structure(nesting)
                j = i + 1
                while j < end and t[j].text == "await":
                    j += 1
                if j < end and t[j].text == "(":
                    close = _match(t, j)
                    self.walk(j + 1, close, nesting + (text != "switch"))
                    j = close + 1
                stop = self._body(j, end)
                self.walk(j, stop, nesting + 1)
                i, operator = stop, ""
            elif text == "do" and i + 1 < end and t[i + 1].text == "{":
                self._structure(nesting)
                stop = self._body(i + 1, end)
                self.walk(i + 1, stop, nesting + 1)
                i, operator = stop, ""
                if i < end and t[i].text == "while":
                    close = _match(t, i + 1)
                    self.walk(i + 2, close, nesting + 1)
                    i = close + 1
            elif text in ("break", "continue") and i + 1 < end and t[i + 1].kind == NAME and t[i + 1].line == t[i].line and t[i + 1].text not in KEYWORDS:
                self.score += 1
                i += 2
            elif text == "?" and i + 1 < end and t[i + 1].text not in (":", ",", ")", ";", "=") and i > 0:
                self._structure(nesting)
                stop = self._body(i + 1, end)
                self.walk(i + 1, stop, nesting + 1)
                i, operator = stop, ""
            elif text == "=>" and i + 1 < end:
                stop = self._body(i + 1, end) if t[i + 1].text == "{" else self._expression(i + 1, end)
                if nesting > 0:
                    self._structure(nesting)
                self.walk(i + 1, stop, nesting + 1 if nesting > 0 else 0)
                i, operator = stop, ""
            elif text == "function" and nesting > 0:
                self._structure(nesting)
                j = i + 1
                while j < end and t[j].text != "{":
                    j = _match(t, j) + 1 if t[j].text == "(" else j + 1
                stop = self._body(j, end)
                self.walk(j, stop, nesting + 1)
                i, operator = stop, ""
            elif text in ("&&", "||", "??"):
                self.score += text != operator
                operator = text
                i += 1
            elif text == "!" and i + 1 < end and not (t[i + 1].kind in (NUMBER, STRING) or t[i + 1].kind == NAME and (i + 2 >= end or t[i + 2].text not in (".", "?.", "(", "["))) and not (i and (t[i - 1].kind == NAME and t[i - 1].text not in KEYWORDS or t[i - 1].text in (")", "]"))):
                self.score += 1
                i += 1
            elif text in _OPEN:
                close = min(end, _match(t, i))
                self.walk(i + 1, close, nesting)
                i = close + 1
                if text == "{":
                    operator = ""
            else:
                if text in (";", ",", "="):
                    operator = ""
                i += 1

    def _expression(self, i: int, end: int) -> int:
        depth = 0
        for j in range(i, end):
            text = self.t[j].text if self.t[j].kind == OPERATOR else ""
            if text in _OPEN:
                depth += 1
            elif text in _CLOSE:
                if depth == 0:
                    return j
                depth -= 1
            elif depth == 0 and text in (",", ";"):
                return j
        return end

    def _if(self, i: int, end: int, nesting: int) -> int:
        close = _match(self.t, i + 1)
        self.walk(i + 2, close, nesting)
        stop = self._body(close + 1, end)
        self.walk(close + 1, stop, nesting + 1)
        while stop < end and self.t[stop].text == "else":
            self.score += 1
            nxt = stop + 1
            if nxt < end and self.t[nxt].text == "if":
                self._structure(nesting)
                close = _match(self.t, nxt + 1)
                self.walk(nxt + 2, close, nesting)
                stop = self._body(close + 1, end)
                self.walk(close + 1, stop, nesting + 1)
            else:
                stop = self._body(nxt, end)
                self.walk(nxt, stop, nesting + 1)
        return stop


def cognitive(text: str, multiplier: int = 1) -> int:
    return Cognitive(Scanner(text, "</" in text or "/>" in text).tokens, multiplier).score


def _hook_flags(tokens: list[Token], kind: str) -> list[str]:
    """Which hook rules are broken: called in a branch, in a loop, or in a region that is neither component nor hook."""
    flags: set[str] = set()

    def walk(i: int, end: int, branch: bool, loop: bool) -> None:
        while i < end:
            t = tokens[i]
            if t.kind == NAME and re.match("use[A-Z]", t.text) and i + 1 < end and tokens[i + 1].text == "(" and not (i and tokens[i - 1].text in (".", "?.", "function")):
                flags.update(["call"] + ["branch"] * branch + ["loop"] * loop)
            if t.text in ("if", "switch", "for", "while") and i + 1 < end and tokens[i + 1].text == "(":
                close = _match(tokens, i + 1)
                b, o = branch or t.text in ("if", "switch"), loop or t.text in ("for", "while")
                walk(i + 2, close, b, o)
                stop = Cognitive.__new__(Cognitive)
                stop.t = tokens
                j = stop._body(close + 1, end)
                walk(close + 1, j, b, o)
                while j < end and tokens[j].text == "else":
                    k = stop._body(j + 1, end)
                    walk(j + 1, k, True, o)
                    j = k
                i = j
                continue
            if t.text == "do" and i + 1 < end and tokens[i + 1].text == "{":
                close = _match(tokens, i + 1)
                walk(i + 2, close, branch, True)
                i = close
            if t.kind == OPERATOR and t.text == "?" and i + 1 < end and tokens[i + 1].text not in (":", ")", ",", ";"):
                branch = True
            if t.text in (";", "}"):
                pass
            i += 1

    walk(0, len(tokens), False, False)
    out = [n for n, f in (("Hook Called Inside Condition", "branch"), ("Hook Called Inside Loop", "loop")) if f in flags]
    if "call" in flags and kind not in ("hook", "react-component", "context-provider", "hoc"):
        out.append("Hook Called Outside Component/Hook")
    return out


def _fingerprints(tokens: list[Token], width: int = 3) -> list[str]:
    """Digests of each run of three statements of a block, names numbered by first use and literals alike."""
    import hashlib

    out: dict[str, None] = {}
    parts: list[list[list[Token]]] = [[[]]]
    blocks: list[list[list[Token]]] = []
    for t in tokens:
        if t.kind == OPERATOR and t.text == "{":
            for p in parts:
                p[-1].append(t)
            parts.append([[]])
            continue
        if t.kind == OPERATOR and t.text == "}" and len(parts) > 1:
            blocks.append(parts.pop())
            for p in parts:
                p[-1].append(t)
            parts[-1].append([])
            continue
        for p in parts:
            p[-1].append(t)
        if t.text == ";":
            parts[-1].append([])
    for b in [*blocks, *parts]:
        statements = [s for s in b if s]
        for i in range(len(statements) - width + 1):
            run = statements[i : i + width]
            if sum(s[-1].end - s[0].start for s in run) < 60:
                continue
            ids: dict[str, str] = {}
            text = " ".join(
                ids.setdefault(t.text, f"#{len(ids)}") if t.kind == NAME and t.text not in KEYWORDS else "LIT" if t.kind in (NUMBER, STRING, TEMPLATE, REGEX) else t.text for s in run for t in s
            )
            if len(text) >= 40:
                out[hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()] = None
    return list(out)


def _outline(ordinal: int, name: str, kind: str | None, tokens: list[Token], first: int, last: int, scan: Scanner, lines: list[str], exported: bool, is_default: bool, comment: str | None) -> dict:
    """A region's place, kind and text, without what it uses and holds."""
    jsx = any(t.kind == JSX for t in tokens)
    calls = lambda k: tokens[k].kind == NAME and re.match("use[A-Z]", tokens[k].text) and k + 1 < len(tokens) and tokens[k + 1].text == "(" and not (k and tokens[k - 1].text in (".", "?.", "function"))
    hooks = any(calls(k) for k in range(len(tokens)))
    is_async = any(t.text in ("await", "async") or t.text == "then" and k and tokens[k - 1].text == "." for k, t in enumerate(tokens) if t.kind == NAME)
    plain = kind in ("type-block", "enum", "namespace", "constant-block")
    kind = kind or classify(name, jsx, hooks)
    return {
        "ordinal": ordinal, "name": name, "kind": kind, "start_line": first, "end_line": last, "exported": exported, "is_default": is_default,
        "has_jsx": jsx and not plain, "has_hooks": hooks and not plain and kind != "class", "has_async": is_async and not plain,
        "text": "\n".join(lines[first - 1 : last]), "comment": comment, "calls_hooks": hooks,
    }


def _region(ordinal: int, name: str, kind: str | None, tokens: list[Token], first: int, last: int, scan: Scanner, lines: list[str], exported: bool, is_default: bool, comment: str | None) -> dict:
    outline = _outline(ordinal, name, kind, tokens, first, last, scan, lines, exported, is_default, comment)
    hooks = outline.pop("calls_hooks")
    operand = lambda t: t.kind in (NUMBER, STRING, TEMPLATE, REGEX) or t.text in ("true", "false", "null") or t.kind == NAME and t.text not in KEYWORDS
    return {
        **outline, "used": [{"symbol": s, "kind": k} for s, k in _usages(tokens)], "bindings": _bindings(tokens),
        "operators": [t.text for t in tokens if not operand(t)], "operands": [t.text for t in tokens if operand(t)], "cognitive": Cognitive(tokens).score,
        "hook_flags": _hook_flags(tokens, outline["kind"]) if hooks or re.match("use[A-Z]", name) else [], "fingerprints": _fingerprints(tokens),
    }


def _imports(tokens: list[Token], text: str) -> list[dict]:
    """Rows of one import statement: one a name, or one without name for a side effect."""
    strings = [t for t in tokens if t.kind == STRING]
    if not strings:
        return []
    spec, line = strings[-1].text[1:-1], tokens[0].line
    row = lambda alias, name, form: {"specifier": spec, "alias": alias, "name": name, "form": form, "line": line, "statement": None}
    out, i = [], 1
    if i < len(tokens) and tokens[i].text == "type" and i + 1 < len(tokens) and tokens[i + 1].text != "from":
        i += 1
    while i < len(tokens) and tokens[i].kind != STRING and tokens[i].text != "from":
        t = tokens[i]
        if t.text == "*":
            out.append(row(tokens[min(i + 2, len(tokens) - 1)].text, "*", "namespace"))
            i += 3
        elif t.text == "{":
            end, part = _match(tokens, i), []
            for x in [*tokens[i + 1 : end], None]:
                if x is None or x.text == ",":
                    part = part[1:] if len(part) > 1 and part[0].text == "type" and part[1].text != "as" else part
                    if part:
                        out.append(row(part[-1].text, part[0].text, "named"))
                    part = []
                else:
                    part.append(x)
            i = end + 1
        elif t.kind == NAME:
            out.append(row(t.text, "default", "default"))
            i += 1
        else:
            i += 1
    return out or [row(None, None, "side_effect")]


def parse_source(path: str, text: str, whole: bool = True) -> dict:
    """Engine, regions and imports of a file; if not ``whole`` the outlines of the regions only."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in SCRIPTS:
        return {"engine": "bracket-depth-fallback", "regions": fallback_regions(text), "imports": []}
    source = svelte_script(text) if ext == "svelte" else text
    scan = Scanner(source, ext in ("tsx", "jsx", "js", "mjs", "cjs"))
    tokens, lines = scan.tokens, source.split("\n")
    regions, imports = [], {}
    previous_end = 0
    for a, z in _statements(tokens):
        part = tokens[a:z]
        comment = _comment(source, scan, previous_end, part[0].start) if whole else None
        previous_end = part[-1].end
        head = _head(tokens, a)
        rest = tokens[head:z]
        if not rest:
            continue
        mods = {t.text for t in tokens[a:head]}
        exported, is_default, word = "export" in mods, "default" in mods, rest[0].text
        add = lambda name, kind, toks, first=part[0].line, last=source.count("\n", 0, part[-1].end) + 1: regions.append((_region if whole else _outline)(len(regions), name, kind, toks, first, last, scan, lines, exported, is_default, comment))  # noqa: E731, B023
        named = next((t.text for t in rest[1:] if t.kind == NAME), None)
        if word == "import" and not exported and len(rest) > 1 and rest[1].text not in ("(", "."):
            rows = _imports(rest, source)
            if rows:
                imports[rows[0]["specifier"]] = rows
        elif word == "function" and (not is_default or named and rest[1].text != "("):
            add(named or default_name(path), None, part)
        elif word == "class" and named and (not is_default or rest[1].kind == NAME and rest[1].text != "extends"):
            add(rest[1].text if rest[1].kind == NAME else "DefaultExport", "class", part)
        elif word == "interface" or word == "type" and len(rest) > 1 and rest[1].kind == NAME:
            add(named, "type-block", part)
        elif word == "enum" or word == "const" and len(rest) > 2 and rest[1].text == "enum":
            add(rest[1 + (word == "const")].text, "enum", part)
        elif word in ("namespace", "module") and len(rest) > 1 and rest[1].kind in (NAME, STRING):
            add(rest[1].text.strip("'\""), "namespace", part)
        elif word in ("const", "let", "var"):
            for name, init, toks in _declarators(rest[1:]):
                literal = len(init) == 1 and init[0].kind in (NUMBER, STRING)
                constant = init and not _is_function(init) and (literal or re.fullmatch("[A-Z_][A-Z0-9_]{2,}", name))
                component = bool(init) and init[0].text == "component$" or len(init) > 2 and init[1].text == "." and init[2].text == "component$"
                kind = "react-component" if component else "constant-block" if constant else None
                add(name, kind, toks, toks[0].line, source.count("\n", 0, toks[-1].end) + 1)
        elif is_default:
            single = rest[0].text if rest[0].kind == NAME and len([t for t in rest if t.text != ";"]) == 1 else None
            own = rest[1].text if word in ("function", "class") and len(rest) > 1 and rest[1].kind == NAME else None
            jsx = any(t.kind == JSX for t in rest)
            name = single or own or (default_name(path) if jsx and (word == "function" or _is_function(rest)) else "DefaultExport")
            add(name, None, part)
    for i, t in enumerate(tokens if whole else []):
        if t.text in ("import", "require") and t.kind == NAME and i + 2 < len(tokens) and tokens[i + 1].text == "(" and tokens[i + 2].kind == STRING:
            first = next(((tokens[a], tokens[z - 1]) for a, z in _statements(tokens) if a <= i < z), (t, t))
            imports.setdefault(f"{tokens[i + 2].text}:{first[0].line}", [{"specifier": tokens[i + 2].text[1:-1], "alias": None, "name": None, "form": "dynamic", "line": first[0].line, "statement": source[first[0].start : first[1].end]}])
    return {"engine": "scanner", "regions": regions, "imports": [r for rows in imports.values() for r in rows]}


def _declarators(tokens: list[Token]) -> Iterator[tuple[str, list[Token], list[Token]]]:
    """(name, tokens of the initialiser, all tokens) of each declarator; patterns have no name and are passed over."""
    start, depth = 0, 0
    for i, t in enumerate([*tokens, Token(OPERATOR, ",", 0, 0, 0)]):
        if t.kind == OPERATOR:
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
        if depth == 0 and t.kind == OPERATOR and t.text in (",", ";"):
            part = tokens[start:i]
            start = i + 1
            if part and part[0].kind == NAME:
                eq = next((k for k, x in enumerate(part) if x.kind == OPERATOR and x.text == "="), None)
                yield part[0].text, part[eq + 1 :] if eq is not None else [], part


def _comment(source: str, scan: Scanner, begin: int, end: int) -> str | None:
    found = [source[a:z] for a, z in scan.comments if a >= begin and z <= end]
    doc = next((c for c in found if c.startswith("/**")), None)
    if doc:
        return re.sub(r"\n\s*\*\s?", "\n", doc[3:-2]).strip()
    return next((c[2:].strip() for c in found if c.startswith("//")), None)


# Fixed patterns of the line-wise parser, in the order in which they are tried.
FALLBACK = [
    (r"^(?:export\s+)?(?:const|function)\s+([A-Z][A-Za-z0-9_]*Provider)\b", "context-provider"),
    (r"^(?:export\s+)?(?:const|function)\s+(with[A-Z][A-Za-z0-9_]*)\b", "hoc"),
    (r"^(?:export\s+)?(?:const|function)\s+(use[A-Z][A-Za-z0-9_]*)(?:\s*[:=]|\s*\()", "hook"),
    (r"^(?:export\s+(?:default\s+)?)?(?:const|function)\s+([A-Z][A-Za-z0-9_]*)(?:\s*[:=]|\s*\()", "react-component"),
    (r"^(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)", "class"),
    (r"^(?:export\s+)?(?:async\s+)?function\s+([a-z_][A-Za-z0-9_]*)\s*\(", "utility-function"),
    (r"^(?:export\s+)?const\s+([a-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\(", "utility-function"),
    (r"^(?:export\s+)?(?:type|interface)\s+([A-Za-z_][A-Za-z0-9_]*)", "type-block"),
    (r"^(?:export\s+)?(?:const|enum|let)\s+([A-Z_][A-Z0-9_]{3,})\s*(?:=|:)", "constant-block"),
]


def fallback_regions(text: str) -> list[dict]:
    """Regions of other languages: a line that looks like a declaration, up to where its brackets close."""
    lines, out = text.split("\n"), []
    # open_before[i]: brackets opened less brackets closed in all lines before line i.
    signs = dict.fromkeys("{([", 1) | dict.fromkeys("})]", -1)
    open_before = [0, *accumulate(sum(signs.get(c, 0) for c in line) for line in lines)]
    end = 0
    for at, line in enumerate(lines):
        head = line.strip()
        if at < end or not head or head.startswith(("//", "*", "/*")):
            continue
        hit = next(((m[1], kind) for m, kind in ((re.match(p, head), kind) for p, kind in FALLBACK) if m), None)
        if hit is None:
            continue
        # A region has two lines at least, and ends with the first one after which no bracket of its own is open.
        end = next((e for e in range(at + 2, len(lines) + 1) if open_before[e] <= open_before[at]), len(lines))
        body = "\n".join(lines[at:end])
        out.append(
            {
                "ordinal": len(out), "name": hit[0], "kind": hit[1], "start_line": at + 1, "end_line": end, "exported": bool(re.match(r"export\s", head)), "is_default": bool(re.match(r"export\s+default\s", head)),
                "has_jsx": bool(re.search("<[A-Z]", body)), "has_hooks": bool(re.search(r"\buse[A-Z]", body)), "has_async": bool(re.search(r"\b(?:async|await)\b", body)), "text": body, "comment": None,
                "used": [], "bindings": [], "operators": [], "operands": [], "cognitive": 0, "hook_flags": [], "fingerprints": [],
            }
        )
    return out


def classify_part(name: str, jsx: bool) -> str:
    """The kind of a function inside an object or namespace; hooks go by their name alone."""
    for pattern, kind in (("use[A-Z]", "hook"), ("with[A-Z]", "hoc"), (".*Provider$", "context-provider")):
        if re.match(pattern, name):
            return kind
    return "react-component" if jsx and re.match("[A-Z]", name) else "utility-function"


def _split_at_commas(tokens: list[Token]) -> Iterator[list[Token]]:
    start, depth = 0, 0
    for i, t in enumerate([*tokens, Token(OPERATOR, ",", 0, 0, 0)]):
        if t.kind == OPERATOR:
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
            if depth == 0 and t.text == ",":
                if tokens[start:i]:
                    yield tokens[start:i]
                start = i + 1


def _object_functions(members: list[Token]) -> Iterator[tuple[str, None, list[Token]]]:
    """(name, None, tokens) of the members of an object that are written as a key with a function."""
    for m in _split_at_commas(members):
        if len(m) > 2 and m[0].kind in (NAME, STRING) and m[1].text == ":" and _is_function(m[2:]):
            yield m[0].text if m[0].kind == NAME else m[0].text[1:-1], None, m


def _namespace_functions(body: list[Token]) -> Iterator[tuple[str, bool, list[Token]]]:
    """(name, whether it is exported, tokens) of the statements of a namespace that declare a function."""
    for a, z in _statements(body):
        head = _head(body, a)
        rest, exported = body[head:z], any(t.text == "export" for t in body[a:head])
        if len(rest) > 1 and rest[0].text == "function":
            found = [rest[1].text] if rest[1].kind == NAME else []
        elif rest and rest[0].text in ("const", "let", "var"):
            found = [name for name, init, _ in _declarators(rest[1:]) if _is_function(init)]
        else:
            found = []
        if found:
            yield found[-1], exported, body[a:z]


def region_parts(name: str, kind: str, path: str, text: str, exported: bool) -> list[dict]:
    """The functions of a region that is an object or namespace of at least two, with their lines in its text.

    Regions of other kinds or of fewer than LEAST_SPLIT_LINES lines have none. A part begins with its doc comment.
    """
    if kind not in ("utility-function", "namespace", "constant-block") or text.count("\n") + 1 < LEAST_SPLIT_LINES:
        return []
    scan = Scanner(text, path.rsplit(".", 1)[-1].lower() in ("tsx", "jsx", "js", "mjs", "cjs"))
    tokens, lines, found = scan.tokens, text.split("\n"), []
    for a, z in _statements(tokens):
        rest = tokens[_head(tokens, a) : z]
        if kind == "namespace":
            if len(rest) > 2 and rest[0].text in ("namespace", "module") and rest[2].text == "{":
                body = rest[3 : _match(rest, 2)]
                found = list(_namespace_functions(body)) if len(list(_statements(body))) > 1 else []
        elif rest and rest[0].text in ("const", "let", "var"):
            for _, init, _ in _declarators(rest[1:]):
                if init and init[0].text == "{":
                    found = list(_object_functions(init[1 : _match(init, 0)]))
    if len(found) < 2:
        return []
    out = []
    for part, own, toks in found:
        before = max([t.end for t in tokens if t.end <= toks[0].start], default=0)
        doc = next((c for c, end in scan.comments if before <= c and end <= toks[0].start and text.startswith("/**", c)), toks[0].start)
        first, last = scan.line(doc), scan.line(toks[-1].end - 1)
        source = "\n".join(lines[first - 1 : last])
        jsx = any(t.kind == JSX for t in toks)
        out.append(
            {
                "ordinal": len(out), "name": f"{name}.{part}" if kind == "namespace" else part, "kind": classify_part(part, jsx), "start_line": first, "end_line": last, "exported": exported if own is None else own, "has_jsx": jsx,
                "has_hooks": bool(re.search(r"\buse[A-Z]", source, re.A)), "has_async": bool(re.search(r"\b(async|await)\b", source, re.A)), "text": source,
            }
        )
    return out


def parts_of(regions: DataFrame) -> DataFrame:
    """(file, parent, ordinal, name, kind, start_line, ...) of the parts of regions(file, region, path, name, kind, start_line, exported, text); lines are those of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(i, 64).to_pylist():
                    for p in region_parts(r["name"] or "", r["kind"] or "", r["path"] or "", r["text"] or "", bool(r["exported"])):
                        up = (r["start_line"] or 1) - 1
                        rows.append({"file": r["file"], "parent": r["region"], **p, "start_line": p["start_line"] + up, "end_line": p["end_line"] + up})
                yield pa.RecordBatch.from_pylist(rows, schema=PARTS_ARROW)

    large = regions.where(F.col("kind").isin("utility-function", "namespace", "constant-block"))
    return large.select(F.col("file").cast("string"), "region", "path", "name", "kind", "start_line", "exported", "text").mapInArrow(run, PARTS_SCHEMA)


def replaced_regions(files: DataFrame, least_lines: int = LEAST_SPLIT_LINES) -> DataFrame:
    """(file, major, minor, name, lines) of files(file_id, path, text): regions of at least so many lines replaced by their parts, others whole (minor -1).

    What ``parts_of`` and ``symbols.split_regions`` give over the regions of ``parse_files``, in one pass over a file and without a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = []
                for file, path, text in zip(*(batch.slice(i, 64).column(c).to_pylist() for c in range(3))):
                    for r in parse_source(path or "", text or "", whole=False)["regions"]:
                        lines = r["end_line"] - r["start_line"] + 1
                        parts = region_parts(r["name"] or "", r["kind"], path or "", r["text"], r["exported"]) if lines >= least_lines else []
                        rows += [(file, r["ordinal"], p["ordinal"], p["name"], p["end_line"] - p["start_line"] + 1) for p in parts] or [(file, r["ordinal"], -1, r["name"], lines)]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, REPLACED_ARROW)]
                yield pa.RecordBatch.from_arrays(columns, schema=REPLACED_ARROW)

    return files.select(F.col("file_id").cast("string").alias("file_id"), "path", "text").mapInArrow(run, "file string, major int, minor int, name string, lines int")


def parse_files(files: DataFrame) -> DataFrame:
    """files(file_id, path, text) parsed, one row a file; nulls are empty files. Files are parsed one by one, so memory follows the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                rows = []
                for r in batch.slice(i, 16).to_pylist():
                    found = parse_source(r["path"] or "", r["text"] or "")
                    rows.append({"file_id": r["file_id"], **found})
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.select(F.col("file_id").cast("string").alias("file_id"), "path", "text").mapInArrow(run, SCHEMA)


_REGION = pa.struct(
    [
        ("ordinal", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_()), ("is_default", pa.bool_()),
        ("has_jsx", pa.bool_()), ("has_hooks", pa.bool_()), ("has_async", pa.bool_()), ("text", pa.string()), ("comment", pa.string()),
        ("used", pa.list_(pa.struct([("symbol", pa.string()), ("kind", pa.string())]))), ("bindings", pa.list_(pa.string())), ("operators", pa.list_(pa.string())), ("operands", pa.list_(pa.string())),
        ("cognitive", pa.int32()), ("hook_flags", pa.list_(pa.string())), ("fingerprints", pa.list_(pa.string())),
    ]
)
_IMPORT = pa.struct([("specifier", pa.string()), ("alias", pa.string()), ("name", pa.string()), ("form", pa.string()), ("line", pa.int32()), ("statement", pa.string())])
PARTS_ARROW = pa.schema(
    [
        ("file", pa.string()), ("parent", pa.int32()), ("ordinal", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
        ("exported", pa.bool_()), ("has_jsx", pa.bool_()), ("has_hooks", pa.bool_()), ("has_async", pa.bool_()), ("text", pa.string()),
    ]
)
REPLACED_ARROW = pa.schema([("file", pa.string()), ("major", pa.int32()), ("minor", pa.int32()), ("name", pa.string()), ("lines", pa.int32())])
ARROW = pa.schema([("file_id", pa.string()), ("engine", pa.string()), ("regions", pa.list_(_REGION)), ("imports", pa.list_(_IMPORT))])


def regions_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("file_id").alias("file"), F.explode("regions").alias("r")).select("file", F.col("r.ordinal").alias("region"), "r.*")


def usages_of(parsed: DataFrame) -> DataFrame:
    return regions_of(parsed).select("file", "region", F.explode("used").alias("u")).select("file", "region", "u.symbol", "u.kind")


def bindings_of(parsed: DataFrame) -> DataFrame:
    return regions_of(parsed).select("file", "region", F.explode("bindings").alias("symbol"))


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("file_id").alias("file"), F.explode("imports").alias("i")).select("file", "i.*")

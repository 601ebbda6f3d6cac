"""Tokens of JavaScript and TypeScript sources, JSX included, for the region parser.

No compiler is at hand on the executors, so this is a scanner with just enough context: it tells
comments, strings, templates, regular expressions and JSX from code. Limits: a ``<`` after an operand is
taken as an operator, generics included, and JSX is recognised where an operand may start.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

NAME, NUMBER, STRING, TEMPLATE, REGEX, OPERATOR, JSX = "name", "number", "string", "template", "regex", "operator", "jsx"
_NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_OPERATORS = sorted(
    ">>>= === !== **= <<= >>= >>> &&= ||= ??= ... => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << >> { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split(),
    key=len,
    reverse=True,
)
_OPERATOR = re.compile("|".join(map(re.escape, _OPERATORS)))
_BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new else do await yield default extends instanceof".split())
KEYWORDS = frozenset(
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in "
    "instanceof interface is keyof let module namespace never new null number object of package private protected public readonly require return set static string super switch symbol this throw true "
    "try type typeof undefined unique unknown var void while with yield".split()
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


class Scanner:
    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx, self.tokens, self.comments = text, jsx, [], []
        self._lines = [0, *[i + 1 for i, c in enumerate(text) if c == "\n"]]
        self._code(0, None)

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at)

    def _put(self, kind: str, start: int, end: int) -> None:
        self.tokens.append(Token(kind, self.text[start:end], start, end, self.line(start)))

    def _operand_next(self) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == OPERATOR:
            return last.text not in (")", "]", "}", "++", "--")
        return last.kind == NAME and last.text in _BEFORE_OPERAND

    def _code(self, i: int, closing: str | None) -> int:
        """Scans to the end of the text or past the bracket that closes, which isn't reported."""
        text, depth, end_of_text = self.text, 0, len(self.text)
        while i < end_of_text:
            c = text[i]
            if c.isspace():
                i = _SPACE.match(text, i).end()
            elif m := _NAME.match(text, i):
                self._put(NAME, i, m.end())
                i = m.end()
            elif text.startswith("//", i):
                end = text.find("\n", i)
                end = len(text) if end < 0 else end
                self.comments.append((i, end))
                i = end
            elif text.startswith("/*", i):
                end = text.find("*/", i + 2)
                end = len(text) if end < 0 else end + 2
                self.comments.append((i, end))
                i = end
            elif c in "'\"":
                i = self._string(i, c)
            elif c == "`":
                i = self._template(i)
            elif c.isdigit() or (c == "." and text[i + 1 : i + 2].isdigit()):
                m = _NUMBER.match(text, i)
                self._put(NUMBER, i, m.end())
                i = m.end()
            elif c == "/" and self._operand_next() and (end := self._regex(i)):
                self._put(REGEX, i, end)
                i = end
            elif c == "<" and self.jsx and self._operand_next() and re.match(r"<[A-Za-z_$>]", text[i : i + 2]) and not re.match(r"<\w+(?:\s+extends\b[^>]*|\s*,[^>]*)?>\s*\(", text[i : i + 80]):
                i = self._element(i)
            elif m := _OPERATOR.match(text, i):
                if closing and m[0] == "{":
                    depth += 1
                if closing and m[0] == "}":
                    if not depth:
                        return m.end()
                    depth -= 1
                self._put(OPERATOR, i, m.end())
                i = m.end()
            else:
                i += 1
        return i

    def _string(self, i: int, quote: str) -> int:
        j = i + 1
        while j < len(self.text) and self.text[j] not in (quote, "\n"):
            j += 2 if self.text[j] == "\\" else 1
        end = min(len(self.text), j + 1)
        self._put(STRING, i, end)
        return end

    def _template(self, i: int) -> int:
        start = i
        i += 1
        while i < len(self.text):
            if self.text[i] == "\\":
                i += 2
            elif self.text[i] == "`":
                self._put(TEMPLATE, start, i + 1)
                return i + 1
            elif self.text.startswith("${", i):
                self._put(TEMPLATE, start, i + 2)
                i = self._code(i + 2, "}")
                start = i - 1
            else:
                i += 1
        self._put(TEMPLATE, start, len(self.text))
        return len(self.text)

    def _regex(self, i: int) -> int | None:
        j, inside = i + 1, False
        while j < len(self.text) and self.text[j] != "\n":
            c = self.text[j]
            if c == "\\":
                j += 1
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "/" and not inside:
                return re.compile(r"[A-Za-z]*").match(self.text, j + 1).end()
            j += 1
        return None

    def _element(self, i: int) -> int:
        """A JSX element or fragment: names and the code in braces are reported, its text isn't."""
        self._put(JSX, i, i + 1)
        i += 1
        is_open, closed = True, False
        while i < len(self.text) and is_open:
            c = self.text[i]
            if c == ">":
                i += 1
                is_open = False
            elif self.text.startswith("/>", i):
                return i + 2
            elif c in "'\"":
                end = self.text.find(c, i + 1)
                end = len(self.text) if end < 0 else end + 1
                self._put(STRING, i, end)
                i = end
            elif c == "{":
                self._put(OPERATOR, i, i + 1)
                i = self._code(i + 1, "}")
                self._put(OPERATOR, i - 1, i)
            elif m := _NAME.match(self.text, i):
                self._put(NAME, i, m.end())
                i = m.end()
            else:
                i += 1
        while i < len(self.text) and not closed:
            if self.text.startswith("</", i):
                end = self.text.find(">", i)
                return len(self.text) if end < 0 else end + 1
            if self.text[i] == "{":
                self._put(OPERATOR, i, i + 1)
                i = self._code(i + 1, "}")
                self._put(OPERATOR, i - 1, i)
            elif re.match(r"<[A-Za-z_$>]", self.text[i : i + 2]):
                i = self._element(i)
            else:
                i += 1
        return i

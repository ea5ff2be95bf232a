"""Syntax of chat templates: text to a tree of tuples, which is interpreted row by row or compiled to Column expressions.

Expressions: ("const", value) ("name", n) ("attr", x, n) ("item", x, key) ("slice", x, from, to, step) ("call", n, args, named)
("method", x, n, args, named) ("filter", x, n, args, named) ("test", x, n, negated) ("not", x) ("neg", x) ("and", a, b) ("or", a, b)
("op", sign, a, b) ("in", a, b, negated) ("choose", value, when, other) ("list", items) ("dict", pairs).
Statements: ("text", t) ("out", x) ("for", names, x, body) ("if", [(when or None, body)]) ("set", name, attribute, x)
("capture", name, attribute, body) ("macro", name, [(parameter, default)], body).
"""

from __future__ import annotations

import re


class TemplateError(ValueError):
    pass


# fixed values: the tests of the dialect
TESTS = frozenset("defined undefined none true false boolean string number integer float mapping iterable sequence callable even odd eq ne equalto".split())
CONSTANTS = {"True": True, "true": True, "False": False, "false": False, "None": None, "none": None, "null": None}
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
#: Binary signs by how closely they bind, loosest first, above comparison.
_LEVELS = (("~",), ("+", "-"), ("*", "/", "//", "%"))
_COMPARED = ("==", "!=", "<", ">", "<=", ">=")

_TAGS = re.compile(r"\{\{-?|\{%-?|\{#-?")
_STRINGS = r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|"
_CLOSE = {"}}": re.compile(_STRINGS + r"\}\}"), "%}": re.compile(_STRINGS + "%}"), "#}": re.compile("#}")}
_LEX = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<op>\*\*|//|==|!=|<=|>=|[-+*/%~<>=()\[\]{},.:|]))", re.S)


def _blocks(source: str) -> list[tuple[str, str]]:
    """(kind, content): text, expression, statement; with white space control, lstrip_blocks and trim_blocks."""
    out, at, eat = [], 0, False
    while True:
        m = _TAGS.search(source, at)
        end = None
        if m:
            close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
            # a closing tag within a string isn't one
            end = next((x.start() for x in _CLOSE[close].finditer(source, m.end()) if x[0] == close), None)
        text = source[at : m.start() if end is not None else len(source)]
        if eat == "all":
            text = text.lstrip()
        elif eat == "line" and text[:1] == "\n":
            text = text[1:]
        if end is None:
            out.append(("text", text))
            return [b for b in out if b[1] or b[0] != "text"]
        if m[0][-1] == "-":
            text = text.rstrip()
        elif m[0][:2] != "{{":
            line = text.rpartition("\n")[2]
            if not line.strip(" \t") and ("\n" in text or at == 0 or eat == "line"):
                text = text[: len(text) - len(line)]
        out.append(("text", text))
        body = source[m.end() : end]
        minus = body.endswith("-")
        out.append(({"{{": "expression", "{%": "statement", "{#": "comment"}[m[0][:2]], body[: len(body) - minus].strip()))
        at, eat = end + 2, "all" if minus else "line" if m[0][:2] != "{{" else False


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise TemplateError(f"unexpected {text[at:at+10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out

Node = tuple


class Expression:
    """Recursive descent; what follows a whole expression is ignored."""

    def __init__(self, text: str):
        self.tokens, self.at = _lex(text), 0

    def sees(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def took(self, *values: str) -> str | None:
        if not self.sees(*values):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, value: str) -> None:
        if not self.took(value):
            raise TemplateError(f"{value!r} expected")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        value = self.joined("or", lambda: self.joined("and", self.negated))
        if not self.took("if"):
            return value
        when = self.joined("or", lambda: self.joined("and", self.negated))
        return "choose", value, when, self.whole() if self.took("else") else None

    def joined(self, word: str, below) -> Node:
        a = below()
        while self.took(word):
            a = (word, a, below())
        return a

    def negated(self) -> Node:
        return ("not", self.negated()) if self.took("not") else self.compared()

    def compared(self) -> Node:
        a = self.binary(0)
        while True:
            if sign := self.took(*_COMPARED):
                a = ("op", sign, a, self.binary(0))
            elif self.sees("in") or self.sees("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                negated = bool(self.took("not"))
                self.need("in")
                a = ("in", a, self.binary(0), negated)
            elif self.took("is"):
                negated, test = bool(self.took("not")), self.word()
                if test.lower() not in TESTS:
                    raise TemplateError(f"unknown test {test}")
                if self.took("("):
                    self.arguments()
                a = ("test", a, test.lower(), negated)
            else:
                return a

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.signed()
        a = self.binary(level + 1)
        while sign := self.took(*_LEVELS[level]):
            a = ("op", sign, a, self.binary(level + 1))
        return a

    def signed(self) -> Node:
        if self.took("-"):
            return "neg", self.signed()
        a = self.postfix()
        while self.took("|"):
            name = self.word()
            args, named = self.arguments() if self.took("(") else ([], {})
            a = ("filter", a, name, args, named)
        return ("op", "**", a, self.signed()) if self.took("**") else a

    def arguments(self) -> tuple[list[Node], dict[str, Node]]:
        args: list[Node] = []
        named: dict[str, Node] = {}
        while not self.took(")"):
            if self.tokens[self.at][0] == "name" and self.tokens[self.at + 1 : self.at + 2] == [("op", "=")]:
                key = self.word()
                self.at += 1
                named[key] = self.whole()
            else:
                args.append(self.whole())
            self.separated(")")
        return args, named

    def separated(self, end: str) -> None:
        if not self.took(",") and not self.sees(end):
            raise TemplateError(f"{end!r} expected")

    def postfix(self) -> Node:
        a = self.primary()
        while True:
            if self.took("."):
                key = self.word()
                a = ("method", a, key, *self.arguments()) if self.took("(") else ("attr", a, key)
            elif self.took("["):
                a = self.index(a)
            elif self.took("("):
                if a[0] != "name":
                    raise TemplateError("only names can be called")
                a = ("call", a[1], *self.arguments())
            else:
                return a

    def index(self, a: Node) -> Node:
        parts: list[Node | None] = []
        while True:
            parts.append(None if self.sees(":", "]") else self.whole())
            if not self.took(":"):
                break
        self.need("]")
        if len(parts) == 1:
            if parts[0] is None:
                raise TemplateError("index expected")
            return "item", a, parts[0]
        return "slice", a, *(parts + [None])[:3]

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("expression expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return "const", float(value) if "." in value else int(value)
        if kind == "str":
            text = _unquoted(value)
            while self.at < len(self.tokens) and self.tokens[self.at][0] == "str":  # strings that follow each other are one
                text += _unquoted(self.tokens[self.at][1])
                self.at += 1
            return "const", text
        if kind == "name":
            return ("const", CONSTANTS[value]) if value in CONSTANTS else ("name", value)
        if value == "(":
            first = self.whole()
            if not self.took(","):
                self.need(")")
                return first
            return "list", [first, *self.listed(")")]
        if value == "[":
            return "list", self.listed("]")
        if value == "{":
            pairs = []
            while not self.took("}"):
                key = self.whole()
                self.need(":")
                pairs.append((key, self.whole()))
                self.separated("}")
            return "dict", pairs
        raise TemplateError(f"unexpected {value!r}")

    def listed(self, end: str) -> list[Node]:
        items = []
        while not self.took(end):
            items.append(self.whole())
            self.separated(end)
        return items


def _unquoted(literal: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), literal[1:-1], flags=re.S)


class _Statements:
    def __init__(self, source: str):
        self.blocks, self.at = _blocks(source), 0

    def until(self, *ends: str) -> list[Node]:
        """Statements up to one of the ends, which stays."""
        out: list[Node] = []
        while self.at < len(self.blocks):
            kind, content = self.blocks[self.at]
            word = content.split(None, 1)[0] if kind == "statement" and content else ""
            if word in ends:
                return out
            self.at += 1
            if kind == "text":
                out.append(("text", content))
            elif kind == "expression":
                out.append(("out", Expression(content).whole()))
            elif kind == "statement":
                out.append(self.statement(word, content[len(word) :].strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} missing")
        return out

    def tag(self) -> tuple[str, str]:
        word, _, rest = self.blocks[self.at][1].partition(" ")
        self.at += 1
        return word, rest.strip()

    def enclosed(self, end: str) -> list[Node]:
        body = self.until(end)
        self.tag()
        return body

    def statement(self, word: str, rest: str) -> Node:
        if word == "for":
            m = re.match(r"([\w\s,]+?)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError("for needs 'in'")
            return "for", [n.strip() for n in m[1].split(",")], Expression(m[2]).whole(), self.enclosed("endfor")
        if word == "if":
            branches: list[tuple[Node | None, list[Node]]] = [(Expression(rest).whole(), self.until("elif", "else", "endif"))]
            while (tag := self.tag())[0] != "endif":
                branches.append((Expression(tag[1]).whole() if tag[0] == "elif" else None, self.until("elif", "else", "endif")))
            return "if", branches
        if word == "set":
            m = re.match(r"([\w.]+)\s*=(?!=)\s*(.*)", rest, re.S)
            name, _, attribute = (m[1] if m else rest).partition(".")
            return ("set", name, attribute, Expression(m[2]).whole()) if m else ("capture", name, attribute, self.enclosed("endset"))
        if word == "macro":
            m = re.match(r"(\w+)\s*\((.*)\)\s*$", rest, re.S)
            if not m:
                raise TemplateError("macro needs a name and arguments")
            e, parameters = Expression(m[2] + ")"), []
            while not e.took(")"):
                parameters.append((e.word(), e.whole() if e.took("=") else None))
                e.took(",")
            return "macro", m[1], parameters, self.enclosed("endmacro")
        raise TemplateError(f"Unknown block tag: {word}")


def parse(source: str) -> list[Node]:
    """The statements of a template."""
    return _Statements(source).until()

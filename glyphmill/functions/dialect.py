"""The regular-expression dialect of pipeline specs, turned into Java's (for Column expressions) and Python's `regex` (for kernels).

The dialect: Unicode classes, `$` at the very end only, `[` literal within classes, no captures, no back-references, no
atomic groups or possessive quantifiers, bounds up to 1024, look-behind of fixed length.
"""

from __future__ import annotations

import re

import regex

MAX_BOUND = 1024
_GENERAL = frozenset("L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po S Sm Sc Sk So Z Zs Zl Zp C Cc Cf Co Cn Cs".split())
_LONG = {
    "letter": "L", "uppercase_letter": "Lu", "lowercase_letter": "Ll", "titlecase_letter": "Lt", "modifier_letter": "Lm", "other_letter": "Lo",
    "mark": "M", "nonspacing_mark": "Mn", "spacing_mark": "Mc", "enclosing_mark": "Me", "number": "N", "decimal_number": "Nd",
    "letter_number": "Nl", "other_number": "No", "punctuation": "P", "symbol": "S", "separator": "Z", "space_separator": "Zs", "other": "C", "control": "Cc", "format": "Cf",
}


class PatternError(ValueError):
    pass


def _property(name: str, negated: bool, java: bool) -> str:
    p = "P" if negated else "p"
    bare = re.sub(r"^(gc|sc|general_category|script)=", "", name.strip(), flags=re.I)
    key = _LONG.get(bare.lower(), bare)
    if key in _GENERAL:
        return rf"\{p}{{{key}}}"
    low = bare.lower()
    if low in ("white_space", "space"):
        return rf"\{p}{{IsWhite_Space}}" if java else rf"\{p}{{White_Space}}"
    if low in ("alphabetic", "alpha"):
        return rf"\{p}{{IsAlphabetic}}" if java else rf"\{p}{{Alphabetic}}"
    if low == "any":
        return r"[\s\S]" if not negated else r"[^\s\S]"
    if low == "ascii":
        return rf"[{'^' if negated else ''}\x00-\x7f]"
    try:
        regex.compile(rf"\p{{Script={bare}}}")
    except regex.error as e:
        raise PatternError(f"unknown property {name}") from e
    return rf"\{p}{{Is{bare}}}" if java else rf"\{p}{{Script={bare}}}"


_WORD = {True: r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}", False: r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍"}


def _shorthand(c: str, java: bool, inside: bool) -> str:
    space = r"\p{IsWhite_Space}" if java else r"\p{White_Space}"
    positive = {"s": space, "d": r"\p{Nd}", "w": _WORD[java]}[c.lower()]
    if c.islower():
        return positive if inside else f"[{positive}]"
    return f"[^{positive}]" if not inside or java else {"S": r"\P{White_Space}", "D": r"\P{Nd}", "W": f"[^{positive}]"}[c]


def _code(n: int, java: bool) -> str:
    return rf"\x{{{n:x}}}" if java else re.escape(chr(n)) if n > 32 else rf"\x{n:02x}"


class _Reader:
    def __init__(self, pattern: str, java: bool):
        self.p, self.i, self.java = pattern, 0, java
        self.flags = [set()]

    def fail(self, why: str):
        raise PatternError(f"{why} at {self.i} in {self.p!r}")

    def escape(self, inside: bool) -> str:
        if self.i >= len(self.p):
            self.fail("trailing backslash")
        c = self.p[self.i]
        self.i += 1
        if c in "sSdDwW":
            return _shorthand(c, self.java, inside)
        if c in "pP":
            m = re.compile(r"\{(\^?)([^}]+)\}|([A-Z])").match(self.p, self.i)
            if not m:
                self.fail("property name missing")
            self.i = m.end()
            return _property(m[2] or m[3], (c == "P") != bool(m[1]), self.java)
        if c in "xuU":
            m = re.compile(r"\{([0-9a-fA-F]{1,6})\}|([0-9a-fA-F]{%d})" % {"x": 2, "u": 4, "U": 8}[c]).match(self.p, self.i)
            if not m or int(m[1] or m[2], 16) > 0x10FFFF:
                self.fail("bad code point")
            self.i = m.end()
            return _code(int(m[1] or m[2], 16), self.java)
        if c in "ntrfv0ae":
            return _code({"n": 10, "t": 9, "r": 13, "f": 12, "v": 11, "0": 0, "a": 7, "e": 27}[c], self.java)
        if not inside and c in "AbB":
            return "\\" + c
        if not inside and c == "z":
            return r"\z" if self.java else r"\Z"
        if c.isalnum():
            self.fail(f"\\{c} is not supported")
        return "\\" + c

    def charclass(self) -> str:
        out, first, closed = "[", True, False
        if self.p.startswith("^", self.i):
            out, self.i = "[^", self.i + 1
        last = None
        while self.i < len(self.p):
            c = self.p[self.i]
            self.i += 1
            if c == "]" and not first:
                closed = True
                break
            if c == "-" and last and self.i < len(self.p) and self.p[self.i] != "]":
                end = self.p[self.i]
                if end != "\\" and len(last) == 1 and ord(end) < ord(last):
                    self.fail("reversed range")
                out, last = out + "-", None
            elif c == "\\":
                out, last = out + self.escape(True), "\\x"
            else:
                out, last = out + ("\\" + c if c in "[]&-~^|" else c), c
            first = False
        if not closed:
            self.fail("unclosed class")
        return out + "]"

    def width(self, body: str) -> None:
        if re.search(r"(?<!\\)[*+]|(?<!\\)\?(?![=!<:])|\{\d+,\d*\}", re.sub(r"\[(?:\\.|[^\]])*\]", "x", body)):
            self.fail("look-behind of variable length")

    def read(self) -> str:
        out, depth, atom = [], 0, False
        while self.i < len(self.p):
            c = self.p[self.i]
            self.i += 1
            if c == "\\":
                e = self.escape(False)
                out.append(e)
                atom = e not in (r"\A", r"\b", r"\B", r"\z", r"\Z")
            elif c == "[":
                out.append(self.charclass())
                atom = True
            elif c == "(":
                m = re.compile(r"\?(?:([:=!])|<([=!])|([imsu]*(?:-[imsu]+)?)([:)]))").match(self.p, self.i)
                if self.p.startswith("?", self.i) and not m:
                    self.fail("unsupported group")
                if m and m[2]:
                    level, j = 1, m.end()
                    while j < len(self.p) and level:
                        level += (self.p[j] == "(") - (self.p[j] == ")") if self.p[j - 1] != "\\" else 0
                        j += 1
                    self.width(self.p[m.end() : j - 1])
                if m and m[3] is not None:
                    on, _, off = m[3].partition("-")
                    flags = (self.flags[-1] | set(on)) - set(off)
                    extra = "u" if self.java and "i" in on else ""
                    text = "".join(sorted(set(on) - {"u"})) + extra + (("-" + "".join(sorted(set(off) - {"u"}))) if set(off) - {"u"} else "")
                    self.i = m.end()
                    if m[4] == ")":
                        self.flags[-1] = flags
                        if text:
                            out.append(f"(?{text})" if self.java else f"(?{text}:")
                            if not self.java:  # to the end of the group that holds it
                                self.open[-1] += 1
                        atom = False
                        continue
                    out.append(f"(?{text}:")
                elif m:
                    out.append("(" + m[0])
                    self.i = m.end()
                    flags = set(self.flags[-1])
                else:
                    out.append("(?:")
                    flags = set(self.flags[-1])
                self.flags.append(flags)
                self.open.append(0)
                depth += 1
                atom = False
            elif c == ")":
                if not depth:
                    self.fail("unopened group")
                depth -= 1
                self.flags.pop()
                out.append(")" * (1 + self.open.pop()))
                atom = True
            elif c in "*+?" or (c == "{" and re.compile(r"\d+(,\d*)?\}").match(self.p, self.i)):
                if not atom:
                    self.fail("nothing to repeat")
                text = c
                if c == "{":
                    m = re.compile(r"(\d+)(,?)(\d*)\}").match(self.p, self.i)
                    low, high = int(m[1]), int(m[3] or m[1])
                    if max(low, high) > MAX_BOUND or high < low:
                        self.fail("bad bounds")
                    self.i, text = m.end(), c + m[0]
                if self.p.startswith("?", self.i):
                    self.i, text = self.i + 1, text + "?"
                elif self.p.startswith("+", self.i):
                    self.fail("possessive quantifier")
                out.append(text)
                atom = False
            elif c == "|":
                out.append("|")
                atom = False
            elif c == "$" and "m" not in self.flags[-1]:
                out.append(r"\z" if self.java else r"\Z")
                atom = False
            elif c == "^":
                out.append("^" if "m" in self.flags[-1] else r"\A")
                atom = False
            else:
                out.append("\\" + c if c in "{}" else c)
                atom = c not in "$"
        if depth:
            self.fail("unclosed group")
        return "".join(out) + ")" * self.open[0]

    def translate(self) -> str:
        self.open = [0]
        body = self.read()
        return f"(?Ud){body}" if self.java else body


def to_java(pattern: str) -> str:
    return _Reader(pattern, True).translate()


def to_python(pattern: str) -> regex.Pattern:
    text = _Reader(pattern, False).translate()
    try:
        return regex.compile(text, regex.V0)
    except regex.error as e:
        raise PatternError(str(e)) from e

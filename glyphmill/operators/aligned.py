"""Strings that know, for each character, which bytes of the original they come from; patterns; splits."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import regex

from ..functions.dialect import to_python

Span = tuple[int, int]
#: (first character, after the last, is a match): slices that cover a text in order.
Slices = list[tuple[int, int, bool]]

# fixed values: Unicode White_Space
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0   　  " + "".join(map(chr, range(0x2000, 0x200B))) + "  ")
MARKS = ("Mn", "Mc", "Me")
REMOVED, ISOLATED, PREVIOUS, NEXT, CONTIGUOUS = "Removed", "Isolated", "MergedWithPrevious", "MergedWithNext", "Contiguous"


@dataclass
class Aligned:
    chars: list[str]
    spans: list[Span]
    original: str = ""
    first: bool = True  # does it begin where the original begins?

    @classmethod
    def of(cls, text: str) -> Aligned:
        at, spans = 0, []
        for c in text:
            n = len(c.encode("utf-8", "surrogatepass"))
            spans.append((at, at + n))
            at += n
        return cls(list(text), spans, text)

    @property
    def text(self) -> str:
        return "".join(self.chars)

    def edit(self, script: list[tuple[str, int]], skip: int = 0) -> Aligned:
        """script: (character, change); 0 replaces the next character, +1 inserts, -n replaces and drops n more. skip: dropped first."""
        at, chars, spans = skip, [], []
        for c, change in script:
            chars.append(c)
            if change > 0:
                spans.append(self.spans[at - 1] if at else (0, 0))
            else:
                spans.append(self.spans[at])
                at += 1 - change
        return Aligned(chars, spans, self.original, self.first)

    def each(self, f: Callable[[str], str]) -> Aligned:
        """Characters by their images; one without an image is dropped."""
        chars, spans = [], []
        for c, s in zip(self.chars, self.spans):
            new = f(c)
            chars.extend(new)
            spans.extend([s] * len(new))
        return Aligned(chars, spans, self.original, self.first)

    def keep(self, f: Callable[[str], bool]) -> Aligned:
        return self.each(lambda c: c if f(c) else "")

    def decomposed(self, form: str) -> Aligned:
        return self.each(lambda c: unicodedata.normalize(form, c))

    def composed(self, form: str) -> Aligned:
        """Each character with the marks after it."""
        script, i, n = [], 0, len(self.chars)
        while i < n:
            j = i + 1
            while j < n and unicodedata.category(self.chars[j]) in MARKS:
                j += 1
            new = unicodedata.normalize(form, "".join(self.chars[i:j]))
            old = j - i
            if not new:
                i = j
                continue
            for k, c in enumerate(new):
                script.append((c, 1 if k >= old else -(old - len(new)) if k == len(new) - 1 and len(new) < old else 0))
            i = j
        return self.edit(script)

    def strip(self, left: bool, right: bool) -> Aligned:
        a, b = 0, len(self.chars)
        while left and a < b and self.chars[a] in WHITE:
            a += 1
        while right and b > a and self.chars[b - 1] in WHITE:
            b -= 1
        return self.slice(a, b)

    def slice(self, a: int, b: int) -> Aligned:
        return Aligned(self.chars[a:b], self.spans[a:b], self.original, self.first and a == 0)

    def prepend(self, text: str) -> Aligned:
        return Aligned([*text, *self.chars], [self.spans[0]] * len(text) + self.spans, self.original, self.first) if self.chars and text else self

    def append(self, text: str) -> Aligned:
        return Aligned([*self.chars, *text], self.spans + [self.spans[-1]] * len(text), self.original, self.first) if self.chars else self

    def replace(self, pattern: Pattern, content: str) -> Aligned:
        chars, spans = [], []
        for a, b, hit in pattern.slices(self.text):
            if hit:
                chars += content
                spans += [self.spans[b - 1] if b else (0, 0)] * len(content)
            else:
                chars += self.chars[a:b]
                spans += self.spans[a:b]
        return Aligned(chars, spans, self.original, self.first)

    def split(self, pattern: Pattern, behavior: str) -> list[Aligned]:
        return [self.slice(a, b) for a, b in grouped(pattern.slices(self.text), behavior) if b > a]

    def bytes_of(self) -> list[int]:
        """For each byte of the text its character."""
        return [i for i, c in enumerate(self.chars) for _ in range(len(c.encode("utf-8", "surrogatepass")))]


def grouped(slices: Slices, behavior: str) -> list[tuple[int, int]]:
    """What a split leaves of matches and gaps."""
    if behavior == REMOVED:
        return [(a, b) for a, b, hit in slices if not hit]
    out: list[list] = []
    joined = False
    if behavior == NEXT:
        held = None  # a match that waits for what follows
        for a, b, hit in slices:
            if hit:
                if held is not None:
                    out.append([held[0], held[1]])
                held = (a, b)
            else:
                out.append([held[0] if held else a, b])
                held = None
        return [(a, b) for a, b in ([*out, list(held)] if held else out)]
    before = None
    for a, b, hit in slices:
        if out and (behavior == CONTIGUOUS and hit == before or behavior == PREVIOUS and hit and not before and not joined):
            out[-1][1] = b
            joined = behavior == PREVIOUS
        else:
            out.append([a, b])
            joined = False
        before = hit
    return [(a, b) for a, b in out]


@dataclass
class Pattern:
    """A pattern of a spec: {"String": s} or {"Regex": r}, a set of characters, or a condition on one."""

    string: str | None = None
    expression: str | None = None
    condition: Callable[[str], bool] | None = None
    invert: bool = False
    compiled: regex.Pattern | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        if self.expression is not None:
            self.compiled = to_python(self.expression)

    @classmethod
    def of(cls, spec, invert: bool = False) -> Pattern:
        if isinstance(spec, str):
            return cls(string=spec, invert=invert)
        if "Regex" in spec:
            return cls(expression=spec["Regex"], invert=invert)
        return cls(string=spec["String"], invert=invert)

    def _matches(self, text: str) -> list[Span]:
        if self.compiled is not None:
            return [m.span() for m in self.compiled.finditer(text)]
        if self.condition is not None:
            return [(i, i + 1) for i, c in enumerate(text) if self.condition(c)]
        found, at = [], 0
        while self.string and (i := text.find(self.string, at)) >= 0:
            at = i + len(self.string)
            found.append((i, at))
        return found

    def slices(self, text: str) -> Slices:
        out, at = [], 0
        for a, b in self._matches(text):
            if a > at:
                out.append((at, a, False))
            out.append((a, b, True))
            at = b
        if at < len(text) or not out:
            out.append((at, len(text), False))
        return [(a, b, hit != self.invert) for a, b, hit in out] if self.invert else out

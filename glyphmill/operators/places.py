"""Pieces of texts as a whole, with an array of which character of the original each character comes from.

In steps that replace, drop or repeat characters one by one, and in matches, whose replacement stands for their last character, each
character comes from one of the original. So a step is one of the interpreter's own functions over the text, and one of numpy's over
the array. The results are those of Aligned, which knows the other steps.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from .aligned import WHITE, Aligned, Pattern
from .stages import _Images, normalizer

#: A text and the places of its characters.
Step = Callable[[str, np.ndarray], tuple[str, np.ndarray]]
#: Texts of pieces, and the first bytes in the original and those after the last.
Pieces = tuple[list[str], np.ndarray, np.ndarray]


class EmptyMatch(Exception):
    """A pattern that matches nothing at all, at some place of a text."""


def _each(spec: dict) -> Step:
    aligned = normalizer(spec)
    images = _Images(lambda c: aligned(Aligned.of(c)).text)

    def run(text, at):
        if any(len(images[ord(c)]) != 1 for c in set(text)):
            at = np.repeat(at, np.fromiter((len(images[ord(c)]) for c in text), np.int64, len(text)))
        return text.translate(images), at

    return run


def _strip(left: bool, right: bool) -> Step:
    white = "".join(WHITE)

    def run(text, at):
        a = len(text) - len(text.lstrip(white)) if left else 0
        b = len(text.rstrip(white)) if right else len(text)
        return text[a : max(a, b)], at[a : max(a, b)]

    return run


def _replace(pattern: Pattern, content: str) -> Step:
    def run(text, at):
        found = pattern._matches(text)
        if not found:
            return text, at
        begins, ends = zip(*found)
        text = content.join([text[a:b] for a, b in zip((0, *ends), (*begins, len(text)))])
        a, b = np.array(begins), np.array(ends)
        if (a == b).any():
            raise EmptyMatch
        times = np.zeros(len(at) + 1, np.int64)
        times[a] += 1
        times[b] -= 1
        times = 1 - np.cumsum(times[:-1])
        times[b - 1] = len(content)
        return text, np.repeat(at, times)

    return run


def _prepend(content: str) -> Step:
    return lambda text, at: (content + text, np.r_[np.repeat(at[:1], len(content)), at]) if text else (text, at)


def _steps(spec: dict | None) -> list[Step] | None:
    """None, if a step isn't one of these."""
    kind = spec["type"] if spec else "Precompiled"
    if kind == "Precompiled":
        return []
    if kind == "Sequence":
        parts = [_steps(s) for s in spec.get("normalizers", [])]
        return None if None in parts else [s for p in parts for s in p]
    if kind in ("Lowercase", "StripAccents", "Nmt", "ByteLevel", "NFD", "NFKD"):
        return [_each(spec)]
    if kind == "Strip":
        return [_strip(spec.get("strip_left", True), spec.get("strip_right", True))]
    if kind == "Replace":
        return [_replace(Pattern.of(spec["pattern"]), spec.get("content", ""))]
    return [_prepend(spec.get("prepend", ""))] if kind == "Prepend" else None


#: What pre-tokenizers keep.
_KEPT = {None: re.compile("(?s:.)+"), "WhitespaceSplit": re.compile("[^ \t\n\r]+"), "Whitespace": Pattern(expression=r"\w+|[^\w\s]+").compiled}


def pieces(normal: dict | None, pre: dict | None) -> Callable[[str], Pieces] | None:
    """The function of a text, if these steps are all known here. It raises EmptyMatch of a text that only Aligned can do."""
    steps, kept = _steps(normal), _KEPT.get(pre["type"] if pre else None)
    if steps is None or kept is None:
        return None

    def run(original: str) -> Pieces:
        text, at = original, np.arange(len(original), dtype=np.int32)
        for step in steps:
            text, at = step(text, at)
        spans = np.array([m.span() for m in kept.finditer(text)], np.int64).reshape(-1, 2)
        begin, end = at[spans[:, 0]], at[spans[:, 1] - 1]
        if not original.isascii():
            data = np.frombuffer(original.encode(), np.uint8)
            first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int32)
            return kept.findall(text), first[begin], first[end + 1]
        return kept.findall(text), begin, end + np.int32(1)

    return run

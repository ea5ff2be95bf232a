"""Normalizers and pre-tokenizers of a spec as one Column expression of a text's pieces.

Unsupported tells what only kernels can do: normal forms (Spark has no function for them), the BERT normalizer that needs one, scripts with the
kernels' table, chunks by bytes, and splits that merge matches of a pattern with their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..operators.stages import BYTE_PATTERN, SpecError
from . import expr
from .dialect import to_java

Step = Callable[[Column], Column]


class Unsupported(SpecError):
    """There is no expression for this."""


def _literal(pattern: dict | str) -> str | None:
    return pattern if isinstance(pattern, str) else pattern.get("String")


def normalizer(spec: dict | None) -> Step:
    kind = spec["type"] if spec else "Precompiled"
    if kind == "Sequence":
        steps = [normalizer(s) for s in spec.get("normalizers", [])]

        def run(t: Column) -> Column:
            for step in steps:
                t = step(t)
            return t

        return run
    if kind == "Replace":
        literal, content = _literal(spec["pattern"]), spec.get("content", "")
        return (lambda t: expr.replace(t, literal, content)) if literal is not None else (lambda t: expr.replace_regex(t, spec["pattern"]["Regex"], content))
    known: dict[str, Step] = {
        "Precompiled": lambda t: t, "Nmt": expr.nmt, "StripAccents": expr.strip_accents, "ByteLevel": expr.byte_level, "Strip": lambda t: expr.strip(t, spec.get("strip_left", True), spec.get("strip_right", True)),
        "Prepend": lambda t: expr.prepend(t, spec.get("prepend", "")), "Lowercase": expr.lowercase_each,
    }
    if kind not in known:
        raise Unsupported(f"no expression for the normalizer {kind}")
    return known[kind]


def _split(spec: dict) -> Step:
    behavior, invert, literal = spec.get("behavior", "Isolated").lower(), spec.get("invert", False), _literal(spec["pattern"])
    if literal is not None and len(literal) == 1 and not invert:
        names = {b.lower(): b for b in ("Removed", "Isolated", "Contiguous", "MergedWithPrevious", "MergedWithNext")}
        return lambda t: expr.split_on(t, literal, names.get(behavior, "Isolated"))
    java = expr.quote(literal) if literal is not None else to_java(spec["pattern"]["Regex"])
    if behavior == "removed":
        return (lambda t: expr.pieces(t, java)) if invert else (lambda t: F.filter(F.split(t, java, -1), lambda x: x != ""))
    if behavior in ("mergedwithprevious", "mergedwithnext", "contiguous"):
        raise Unsupported(f"no expression for splits of a pattern with {spec['behavior']}")
    # matches and what lies between: a match, or characters up to the next one
    return lambda t: F.filter(expr.pieces(t, rf"(?:{java})|(?s:(?!(?:{java})).)+"), lambda x: x != "")


def pre_tokenizer(spec: dict | None) -> tuple[Step, bool]:
    """An expression of the pieces, and whether the model wants their bytes in the byte alphabet, which is left to where a word is
    looked up once."""
    kind = spec["type"] if spec else None
    if kind == "Sequence":
        steps = [pre_tokenizer(s) for s in spec.get("pretokenizers", [])]
        if any(mapped for _, mapped in steps[:-1]):
            raise Unsupported("no expression for steps after ByteLevel")

        def run(t: Column) -> Column:
            pieces = F.filter(F.array(t), lambda x: x != "")
            for step, _ in steps:
                pieces = F.flatten(F.transform(pieces, step))
            return pieces

        return run, bool(steps) and steps[-1][1]
    if kind == "ByteLevel":
        spaced = (lambda t: F.when(t.startswith(" "), t).otherwise(F.concat(F.lit(" "), t))) if spec.get("add_prefix_space", True) else (lambda t: t)
        cut = expr.byte_level_pieces if spec.get("use_regex", True) else (lambda t: F.filter(F.array(t), lambda x: x != ""))
        return lambda t: cut(F.when(t == "", t).otherwise(spaced(t))), True
    if kind == "Metaspace":
        scheme = spec.get("prepend_scheme", "always" if spec.get("add_prefix_space", True) else "never")
        return lambda t: expr.metaspace(t, spec.get("replacement", "▁"), scheme != "never", spec.get("split", True)), False
    if kind == "Split":
        return _split(spec), False
    simple: dict[str | None, Step] = {
        None: lambda t: F.filter(F.array(t), lambda x: x != ""), "Whitespace": expr.whitespace, "WhitespaceSplit": expr.whitespace_split, "BertPreTokenizer": expr.bert, "Punctuation": expr.punctuation,
        "Digits": lambda t: expr.digits(t, spec.get("individual_digits", False)), "CharDelimiterSplit": lambda t: expr.char_delimiter(t, spec.get("delimiter", " ")),
    }
    if kind not in simple:
        raise Unsupported(f"no expression for the pre-tokenizer {kind}")
    return simple[kind], False


def pieces(normal: dict | None, pre: dict | None) -> tuple[Step, bool]:
    """An expression of a text's pieces (null for null, none empty) and whether they are yet to be put into the byte alphabet."""
    step, mapped = pre_tokenizer(pre)
    clean = normalizer(normal)
    return (lambda t: step(clean(t))), mapped

"""Encodings as columns: struct<ids, type_ids, special_tokens_mask, attention_mask>, made, processed, cut and filled by expressions.

A post-processor is gone through when the plan is made, over parts that are sequences (arrays of ids) or special tokens; what is left is
one concatenation for each field. Null sequences give null.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

from ..operators.tokenizer import Processor
from . import expr

FIELDS = ("ids", "type_ids", "special_tokens_mask", "attention_mask")


@dataclass(frozen=True)
class Part:
    """A sequence's ids, or a special token's."""

    ids: Column
    type_id: int = 0
    special: bool = False

    def fields(self) -> tuple[Column, ...]:
        n = F.size(self.ids)
        return self.ids, F.array_repeat(F.lit(self.type_id), n), F.array_repeat(F.lit(int(self.special)), n), F.array_repeat(F.lit(1), n)


def _special(ids: list[int], type_id: int = 0) -> Part:
    return Part(F.array(*(F.lit(i) for i in ids)), type_id, True)


def _template(p: Processor, parts: list[Part], add: bool) -> list[Part]:
    out = []
    for name, kind, type_id in p.single if len(parts) < 2 else p.pair:
        if kind == "SpecialToken":
            out += [_special(p.specials[name]["ids"], type_id)] if add and name in p.specials else []
        elif (at := "AB".index(name)) < len(parts):
            out.append(replace(parts[at], type_id=type_id))
    return out


def _parts(p: Processor, parts: list[Part], add: bool) -> list[Part]:
    if p.kind == "Sequence":
        for step in p.steps:
            parts = _parts(step, parts, add)
        return parts
    if p.kind == "TemplateProcessing":
        return _template(p, parts, add)
    if p.kind not in ("BertProcessing", "RobertaProcessing") or not add:
        return parts
    sep, bert = p.sep[1], p.kind == "BertProcessing"
    out = [_special([p.cls[1]]), parts[0], _special([sep])]
    for more in parts[1:]:  # the one marks what ends the second sequence as its own, the other begins it with one more
        out += [more, _special([sep], 1)] if bert else [_special([sep]), more, _special([sep])]
    return out


def processed(post_processor: dict | None, first: Column, second: Column | None = None, add_special: bool = True) -> Column:
    """The encoding of one or two sequences of ids."""
    given = [Part(first)] + ([] if second is None else [Part(second, 1)])
    parts = _parts(Processor(post_processor), given, add_special)
    known = first.isNotNull() if second is None else first.isNotNull() & second.isNotNull()
    columns = [F.concat(*c) for c in zip(*(p.fields() for p in parts))] if parts else [F.array().cast("array<int>")] * len(FIELDS)
    return F.when(known, F.struct(*(c.alias(n) for c, n in zip(columns, FIELDS))))


def truncated(e: Column, n: int, left: bool = False) -> Column:
    return F.when(e.isNotNull(), F.struct(*(expr.truncate(e[f], n, left).alias(f) for f in FIELDS)))


def padded(e: Column, n: Column | int, pad_id: int = 0, pad_type_id: int = 0, left: bool = False) -> Column:
    """Filled up to a length; what fills counts as special and isn't attended to."""
    fill = dict(zip(FIELDS, (pad_id, pad_type_id, 1, 0)))
    return F.when(e.isNotNull(), F.struct(*(expr.pad(e[f], n, fill[f], left).alias(f) for f in FIELDS)))

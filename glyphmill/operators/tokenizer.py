"""The pipeline: added tokens, normalizer, pre-tokenizer, model, post-processor, truncation, padding; and back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from . import stages
from ..functions.dialect import to_python
from .aligned import Aligned

Span = tuple[int, int]


@dataclass
class Encoding:
    """Arrays of equal length; words is None for special tokens. overflowing stays empty."""

    ids: list[int] = field(default_factory=list)
    type_ids: list[int] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    words: list[int | None] = field(default_factory=list)
    offsets: list[Span] = field(default_factory=list)
    special_tokens_mask: list[int] = field(default_factory=list)
    attention_mask: list[int] = field(default_factory=list)
    overflowing: list = field(default_factory=list)
    sequence_ranges: dict[int, Span] = field(default_factory=dict)

    ARRAYS = ("ids", "type_ids", "tokens", "words", "offsets", "special_tokens_mask", "attention_mask")

    def __len__(self) -> int:
        return len(self.ids)

    @classmethod
    def special(cls, i: int, token: str, type_id: int = 0) -> Encoding:
        return cls([i], [type_id], [token], [None], [(0, 0)], [1], [1])

    @property
    def n_sequences(self) -> int:
        return len(self.sequence_ranges) or 1

    def set_sequence_id(self, n: int) -> None:
        if len(self):
            self.sequence_ranges = {n: (0, len(self))}

    def merge_with(self, other: Encoding, growing: bool) -> None:
        shift, base = len(self), self.offsets[-1][1] if growing and self.offsets else 0
        for name in self.ARRAYS:
            if name != "offsets":
                getattr(self, name).extend(getattr(other, name))
        self.offsets += [(a + base, b + base) for a, b in other.offsets]
        self.sequence_ranges = self.sequence_ranges | {k: (a + shift, b + shift) for k, (a, b) in other.sequence_ranges.items()}

    @classmethod
    def merge(cls, parts: Iterable[Encoding], growing: bool = False) -> Encoding:
        out = cls()
        for p in parts:
            out.merge_with(p, growing)
        return out

    def truncate(self, length: int, left: bool = False) -> None:
        if len(self) > length:
            for name in self.ARRAYS:
                values = getattr(self, name)
                setattr(self, name, values[len(values) - length :] if left else values[:length])

    def pad(self, length: int, pad_id: int = 0, pad_type_id: int = 0, pad_token: str = "[PAD]", left: bool = False) -> None:
        n = length - len(self)
        if n > 0:
            filling = dict(ids=pad_id, type_ids=pad_type_id, tokens=pad_token, words=None, offsets=(0, 0), special_tokens_mask=1, attention_mask=0)
            for name, value in filling.items():
                values = getattr(self, name)
                setattr(self, name, [value] * n + values if left else values + [value] * n)


# ------------------------------------------------------------ post-processors
class Processor:
    def __init__(self, spec: dict | None):
        self.spec, self.kind = spec or {}, (spec or {}).get("type")
        if self.kind == "Sequence":
            self.steps = [Processor(s) for s in spec["processors"]]
        elif self.kind == "TemplateProcessing":
            self.single, self.pair = map(self._template, (spec.get("single", "$A"), spec.get("pair", "$A $B")))
            self.specials = spec.get("special_tokens", {})
        elif self.kind in ("BertProcessing", "RobertaProcessing"):
            self.cls, self.sep = spec["cls"], spec["sep"]
        elif self.kind not in (None, "ByteLevel"):
            raise stages.SpecError(f"unknown post-processor {self.kind}")

    @staticmethod
    def _template(spec) -> list[tuple[str, str, int]]:
        """(A, B or a special token's name; kind; type id)"""
        out = []
        for piece in spec.split() if isinstance(spec, str) else spec:
            if isinstance(piece, dict):
                kind, value = next(iter(piece.items()))
                out.append((value["id"], kind, value.get("type_id", 0)))
            else:
                name, _, type_id = piece.partition(":")
                sequence = name.startswith("$")
                if sequence and name[1:].isdigit():
                    name, type_id = "$A", name[1:]
                out.append((name[1:] or "A" if sequence else name, "Sequence" if sequence else "SpecialToken", int(type_id or 0)))
        return out

    def added(self, pair: bool) -> int:
        if self.kind == "Sequence":
            return sum(s.added(pair) for s in self.steps)
        if self.kind == "BertProcessing":
            return 3 if pair else 2
        if self.kind == "RobertaProcessing":
            return 4 if pair else 2
        if self.kind == "TemplateProcessing":
            return sum(len(self.specials[name]["ids"]) for name, kind, _ in (self.pair if pair else self.single) if kind == "SpecialToken" and name in self.specials)
        return 0

    def parts(self, parts: list[Encoding], add: bool) -> list[Encoding]:
        if self.kind == "Sequence":
            for step in self.steps:
                parts = step.parts(parts, add)
            return parts
        if self.kind in ("BertProcessing", "RobertaProcessing"):
            if not add:
                return parts
            bert = self.kind == "BertProcessing"
            special = lambda x, t=0: Encoding.special(x[1], x[0], t)
            out = [special(self.cls), parts[0], special(self.sep)]
            for p in parts[1:]:
                out += [p, special(self.sep, 1)] if bert else [special(self.sep), p, special(self.sep)]
            return out
        if self.kind == "TemplateProcessing":
            out = []
            for name, kind, type_id in self.single if len(parts) < 2 else self.pair:
                if kind == "Sequence":
                    i = 0 if name == "A" else 1
                    if i < len(parts):
                        parts[i].type_ids = [type_id] * len(parts[i])
                        out.append(parts[i])
                elif add and name in self.specials:
                    special = self.specials[name]
                    out += [Encoding.special(i, t, type_id) for i, t in zip(special["ids"], special["tokens"])]
            return out
        return parts

    def __call__(self, first: Encoding, second: Encoding | None, add: bool) -> Encoding:
        first.set_sequence_id(0)
        parts = [first]
        if second is not None:
            second.set_sequence_id(1)
            second.type_ids = [1] * len(second)
            parts.append(second)
        return Encoding.merge(self.parts(parts, add))


@dataclass(frozen=True)
class AddedToken:
    content: str
    special: bool = False
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool | None = None


@dataclass(frozen=True)
class Padding:
    length: int | None = None
    left: bool = False
    multiple: int = 0
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"


@dataclass(frozen=True)
class Truncation:
    max_length: int = 512
    left: bool = False
    stride: int = 0
    strategy: str = "LongestFirst"


@dataclass(frozen=True)
class Spec:
    """A pipeline as read from JSON; immutable, so that it can be sent to workers."""

    model: dict
    normalizer: dict | None = None
    pre_tokenizer: dict | None = None
    post_processor: dict | None = None
    decoder: dict | None = None
    truncation: Truncation | None = None
    padding: Padding | None = None
    added: tuple[AddedToken, ...] = ()

    @classmethod
    def of(cls, j: dict) -> Spec:
        if not isinstance(j, dict) or not isinstance(j.get("model"), dict):
            raise stages.SpecError("a pipeline needs a model")
        t, p = j.get("truncation"), j.get("padding")
        truncation = Truncation(t.get("max_length", 512), str(t.get("direction", "Right")).lower() == "left", t.get("stride", 0), t.get("strategy", "LongestFirst")) if t else None
        padding = None
        if p:
            # only a length makes it fixed; a strategy isn't read
            padding = Padding(p.get("length"), str(p.get("direction", "Right")).lower() == "left", p.get("pad_to_multiple_of") or 0, p.get("pad_id", 0), p.get("pad_type_id", 0), p.get("pad_token", "[PAD]"))
        added = tuple(AddedToken(a["content"], a.get("special", False), a.get("single_word", False), a.get("lstrip", False), a.get("rstrip", False), a.get("normalized", not a.get("special", False))) for a in j.get("added_tokens") or [])
        spec = cls(j["model"], j.get("normalizer"), j.get("pre_tokenizer"), j.get("post_processor"), j.get("decoder"), truncation, padding, added)
        Tokenizer(spec)  # every part is known and every pattern right
        return spec

    @classmethod
    def parse(cls, text: str) -> Spec:
        try:
            return cls.of(json.loads(text))
        except json.JSONDecodeError as e:
            raise stages.SpecError(f"no JSON: {e}") from e

    def to_json(self, pretty: bool = False) -> str:
        t, p = self.truncation, self.padding
        drop = lambda s: {k: v for k, v in s.items() if k != "precompiled_charsmap"} if s else None
        j = {
            "version": "1.0", "model": self.model, "normalizer": drop(self.normalizer), "pre_tokenizer": self.pre_tokenizer, "post_processor": self.post_processor, "decoder": self.decoder,
            "truncation": t and {"max_length": t.max_length, "direction": "Left" if t.left else "Right", "stride": t.stride, "strategy": t.strategy},
            "padding": p and {k: v for k, v in {"length": p.length, "direction": "Left" if p.left else "Right", "pad_to_multiple_of": p.multiple or None, "pad_id": p.pad_id, "pad_type_id": p.pad_type_id, "pad_token": p.pad_token}.items() if k != "length" or v is not None},
            "added_tokens": [{"content": a.content, "special": a.special, "single_word": a.single_word, "lstrip": a.lstrip, "rstrip": a.rstrip, "normalized": not a.special if a.normalized is None else a.normalized} for a in self.added],
        }
        return json.dumps(j, ensure_ascii=False, sort_keys=True, indent=2 if pretty else None)

    def with_added(self, *tokens: AddedToken) -> Spec:
        return replace(self, added=self.added + tokens)


class Tokenizer:
    """Runs a spec; one per worker."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.normalize, self.pre_tokenize = stages.normalizer(spec.normalizer), stages.pre_tokenizer(spec.pre_tokenizer)
        self.model, self.decoder, self.process = stages.model(spec.model), stages.decoder(spec.decoder), Processor(spec.post_processor)
        self.added: dict[str, int] = {}
        self.special: set[str] = set()
        new = 0
        for a in spec.added:
            if not a.content:
                continue
            if a.content not in self.added:
                if a.content in self.model.ids:
                    self.added[a.content] = self.model.ids[a.content]
                else:
                    self.added[a.content] = len(self.model.ids) + new
                    new += 1
            if a.special:
                self.special.add(a.content)
        # byte-level pieces of a text that isn't normalized don't depend on what stands around them: their ids are remembered
        first = spec.pre_tokenizer or {}
        fast = spec.normalizer is None and first.get("type") == "ByteLevel" and first.get("use_regex", True)
        self.division = to_python(stages.BYTE_PATTERN) if fast else None
        self.leading, self.known = first.get("add_prefix_space", True), {}
        self.new, self.back = new, {i: t for t, i in self.added.items()}
        # at each place the longest; ties can't be, as contents differ
        self.finder = re.compile("|".join(map(re.escape, sorted(self.added, key=lambda t: (-len(t.encode()), t))))) if self.added else None

    @property
    def size(self) -> int:
        return len(self.model.ids) + self.new

    def token_to_id(self, token: str) -> int | None:
        return self.model.ids.get(token, self.added.get(token))

    def id_to_token(self, i: int) -> str | None:
        return self.model.tokens.get(i, self.back.get(i))

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Texts between added tokens, and these with their ids."""
        out, at = [], 0
        for m in self.finder.finditer(text) if self.finder else ():
            if m.start() > at:
                out.append((text[at : m.start()], None))
            out.append((m[0], self.added[m[0]]))
            at = m.end()
        if at < len(text) or not (out or self.finder):
            out.append((text[at:], None))
        return out

    def pieces(self, text: str) -> list[Aligned]:
        return [p for p in self.pre_tokenize(self.normalize(Aligned.of(text))) if p.chars]

    def segment(self, text: str) -> Encoding:
        out = Encoding()
        for word, piece in enumerate(self.pieces(text)):
            owner = piece.bytes_of()
            for i, token, a, b in self.model.tokenize(piece.text):
                span = (piece.spans[owner[a]][0], piece.spans[owner[b - 1]][1]) if b > a else (0, 0)
                for values, value in zip((out.ids, out.type_ids, out.tokens, out.words, out.offsets, out.special_tokens_mask, out.attention_mask), (i, 0, token, word, span, 0, 1)):
                    values.append(value)
        return out

    def single(self, text: str) -> Encoding:
        out = Encoding()
        for part, i in self.segments(text):
            if i is None:
                out.merge_with(self.segment(part), True)
            else:
                own = Encoding.special(i, part)
                own.offsets = [(0, len(part.encode()))]
                out.merge_with(own, True)
        return out

    def ids(self, text: str) -> list[int]:
        """Ids only, without special tokens, truncation and padding."""
        out: list[int] = []
        for part, i in self.segments(text):
            if i is not None:
                out.append(i)
            elif self.division is not None:
                if self.leading and part and part[0] != " ":
                    part = " " + part
                known = self.known
                if len(known) > 500_000:
                    known.clear()
                for piece in self.division.findall(part):
                    found = known.get(piece)
                    if found is None:
                        found = known[piece] = [t[0] for t in self.model.tokenize(stages.byte_level(piece))]
                    out += found
            else:
                for piece in self.pieces(part):
                    out += [t[0] for t in self.model.tokenize(piece.text)]
        return out

    def _finished(self, e: Encoding) -> Encoding:
        t, p = self.spec.truncation, self.spec.padding
        if t:
            e.truncate(t.max_length, t.left)
        if p:
            # without a fixed length the target is the row's own
            length = p.length if p.length is not None else len(e)
            if p.multiple:
                length = -(-length // p.multiple) * p.multiple
            e.pad(length, p.pad_id, p.pad_type_id, p.pad_token, p.left)
        return e

    def encode(self, text: str, add_special: bool = True) -> Encoding:
        return self._finished(self.process(self.single(text), None, add_special) if self.process.kind else self.single(text))

    def encode_pair(self, a: str, b: str, add_special: bool = True) -> Encoding:
        first, second = self.single(a), self.single(b)
        if self.process.kind:
            return self._finished(self.process(first, second, add_special))
        return self._finished(Encoding.merge([first, second]))

    def decode(self, ids: Iterable[int], skip_special: bool = True) -> str:
        tokens = [t for t in map(self.id_to_token, ids) if t is not None and not (skip_special and t in self.special)]
        return " ".join(tokens) if self.decoder is None else "".join(self.decoder(tokens))

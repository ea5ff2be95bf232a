"""Normalizers, pre-tokenizers, models, post-processors and decoders of a pipeline, by the type names of its JSON."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import groupby

import regex
from regex import _regex_core as regex_core

from .aligned import CONTIGUOUS, ISOLATED, MARKS, NEXT, REMOVED, WHITE, Aligned, Pattern

# fixed values: the pattern and the byte alphabet of byte-level tokenizers
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
NMT_DROPPED = frozenset(map(chr, [*range(1, 9), 0xB, *range(0xE, 0x20), 0x7F, 0x8F, 0x9F]))
NMT_BLANK = frozenset(map(chr, [9, 10, 12, 13, 0x1680, 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD, *range(0x200B, 0x2010)]))


class SpecError(ValueError):
    pass


def byte_level(text: str) -> str:
    """A text's bytes in the byte alphabet."""
    return "".join(map(BYTE_CHARS.__getitem__, text.encode("utf-8", "surrogatepass")))


# ---------------------------------------------------------------- normalizers
def _byte_level(c: str) -> str:
    return "".join(BYTE_CHARS[b] for b in c.encode("utf-8", "surrogatepass"))


def _bert(spec: dict) -> Callable[[Aligned], Aligned]:
    lower = spec.get("lowercase", True)
    accents = spec.get("strip_accents")

    def clean(c: str) -> str:
        if c in "\0�" or unicodedata.category(c) in ("Cc", "Cf", "Co") and c not in "\t\n\r":
            return ""
        return " " if c in WHITE else c

    def run(a: Aligned) -> Aligned:
        if spec.get("clean_text", True):
            a = a.each(clean)
        if spec.get("handle_chinese_chars", True):
            a = a.each(lambda c: f" {c} " if any(x <= ord(c) <= y for x, y in CJK) else c)
        if lower if accents is None else accents:
            a = a.decomposed("NFD").keep(lambda c: unicodedata.category(c) != "Mn")
        return a.each(str.lower) if lower else a

    return run


def normalizer(spec: dict | None) -> Callable[[Aligned], Aligned]:
    kind = spec["type"] if spec else None
    if kind is None or kind == "Precompiled":
        return lambda a: a
    if kind == "Sequence":
        steps = [normalizer(s) for s in spec.get("normalizers", [])]

        def run(a):
            for step in steps:
                a = step(a)
            return a

        return run
    if kind == "BertNormalizer":
        return _bert(spec)
    if kind in ("NFC", "NFKC"):
        return lambda a: a.composed(kind)
    if kind in ("NFD", "NFKD"):
        return lambda a: a.decomposed(kind)
    if kind == "Nmt":
        return lambda a: a.each(lambda c: "" if c in NMT_DROPPED else " " if c in NMT_BLANK else c)
    if kind == "Lowercase":
        return lambda a: a.each(str.lower)
    if kind == "Strip":
        return lambda a: a.strip(spec.get("strip_left", True), spec.get("strip_right", True))
    if kind == "StripAccents":
        return lambda a: a.keep(lambda c: unicodedata.category(c) != "Mn")
    if kind == "Replace":
        pattern, content = Pattern.of(spec["pattern"]), spec.get("content", "")
        return lambda a: a.replace(pattern, content)
    if kind == "Prepend":
        return lambda a: a.prepend(spec.get("prepend", ""))
    if kind == "ByteLevel":
        return lambda a: a.each(_byte_level)
    raise SpecError(f"unknown normalizer {kind}")


class _Images(dict):
    """Code point -> image, by a function of a character, once; for str.translate."""

    def __init__(self, f: Callable[[str], str]):
        super().__init__()
        self.f = f

    def __missing__(self, i: int) -> str:
        found = self[i] = self.f(chr(i))
        return found


def _ranges(characters: list[int]) -> str:
    """Code points in order as what stands in a class of a pattern."""
    runs: list[list[int]] = []
    for i in characters:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_CLUSTERS: re.Pattern | None = None


def _composed(form: str) -> Callable[[str], str]:
    """As Aligned.composed: each character with the marks after it. What has a form is that of its parts."""
    global _CLUSTERS
    if _CLUSTERS is None:
        marks = _ranges([i for i in range(0x110000) if unicodedata.category(chr(i)) in MARKS])
        _CLUSTERS = re.compile(f"(?s:.)[{marks}]+|[^\\x00-\\x7F]")
    clusters = _CLUSTERS

    def run(text: str) -> str:
        return text if unicodedata.is_normalized(form, text) else clusters.sub(lambda m: unicodedata.normalize(form, m[0]), text)

    return run


def text_normalizer(spec: dict | None) -> Callable[[str], str]:
    """What normalizer() makes of a text, for when nobody asks where its characters come from: texts as a whole, images of characters once."""
    kind = spec["type"] if spec else None
    if kind is None or kind == "Precompiled":
        return lambda t: t
    if kind == "Sequence":
        steps = [text_normalizer(s) for s in spec.get("normalizers", [])]

        def run(t: str) -> str:
            for step in steps:
                t = step(t)
            return t

        return run
    if kind in ("NFC", "NFKC"):
        return _composed(kind)
    aligned = normalizer(spec)
    if kind in ("BertNormalizer", "NFD", "NFKD", "Nmt", "Lowercase", "StripAccents", "ByteLevel"):  # character by character
        images = _Images(lambda c: aligned(Aligned.of(c)).text)
        return lambda t: t.translate(images)
    return lambda t: aligned(Aligned.of(t)).text


# ------------------------------------------------------------- pre-tokenizers
def _is_punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P"


def _is_bert_punctuation(c: str) -> bool:
    return c.isascii() and (33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126) or _is_punctuation(c)


def _fixed_length(a: Aligned, size: int) -> list[Aligned]:
    """Chunks of so many bytes; a chunk that would begin or end within a character is left out."""
    owner = a.bytes_of()
    n = len(owner)
    starts = {0: 0} | {i: owner[i] for i in range(1, n) if owner[i] != owner[i - 1]} | {n: len(a.chars)}
    return [a.slice(starts[i], starts[j]) for i in range(0, n, size) if i in starts and (j := min(i + size, n)) in starts]


#: First code points of runs of one script, and the scripts; built once from the Unicode property of `regex`.
_SCRIPTS: tuple[list[int], list[str]] | None = None


def _script_names() -> list[str]:
    """One name for each script that `regex` knows."""
    values = regex_core.PROPERTIES["SCRIPT"][1]
    return sorted({number: name for name, number in sorted(values.items(), key=lambda x: len(x[0]))}.values())


def script(c: str) -> str:
    """The script for splitting: kana count as Han; the space and what is unassigned join either side."""
    global _SCRIPTS
    if c == " ":
        return "Any"
    if c == "ー":
        return "HAN"
    if _SCRIPTS is None:
        text = "".join(chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000)
        found = sorted((ord(m[0][0]), ord(m[0][-1]), name) for name in _script_names() if name not in ("UNKNOWN", "ZZZZ") for m in regex.finditer(rf"\p{{Script={name}}}+", text))
        firsts, names, end = [0], ["Any"], -1
        for a, b, name in found:
            if a > end + 1:
                firsts.append(end + 1)
                names.append("Any")
            firsts.append(a)
            names.append("HAN" if name in ("HIRAGANA", "KATAKANA", "HANI") else name)
            end = b
        _SCRIPTS = ([*firsts, end + 1], [*names, "Any"])
    return _SCRIPTS[1][bisect_right(_SCRIPTS[0], ord(c)) - 1]


def _scripts(a: Aligned) -> list[Aligned]:
    out, start, now = [], 0, None
    for i, c in enumerate(a.chars):
        s = script(c)
        if s != "Any":
            if now is not None and s != now:
                out.append(a.slice(start, i))
                start = i
            now = s
    return [*out, a.slice(start, len(a.chars))] if a.chars else []


def _metaspace(spec: dict) -> Callable[[Aligned], list[Aligned]]:
    mark = spec.get("replacement", "▁")
    scheme = spec.get("prepend_scheme", "always" if spec.get("add_prefix_space", True) else "never")
    pattern = Pattern(string=mark)

    def run(a: Aligned) -> list[Aligned]:
        a = a.each(lambda c: mark if c == " " else c)
        if not a.text.startswith(mark) and (scheme == "always" or scheme == "first" and a.first):
            a = a.prepend(mark)
        return a.split(pattern, NEXT) if spec.get("split", True) else [a]

    return run


def pre_tokenizer(spec: dict | None) -> Callable[[Aligned], list[Aligned]]:
    kind = spec["type"] if spec else None
    if kind is None:
        return lambda a: [a] if a.chars else []
    if kind == "Sequence":
        steps = [pre_tokenizer(s) for s in spec.get("pretokenizers", [])]

        def run(a):
            pieces = [a]
            for step in steps:
                pieces = [q for p in pieces for q in step(p)]
            return pieces

        return run
    if kind == "BertPreTokenizer":
        white, marks = Pattern(condition=WHITE.__contains__), Pattern(condition=_is_bert_punctuation)
        return lambda a: [q for p in a.split(white, REMOVED) for q in p.split(marks, ISOLATED)]
    if kind == "ByteLevel":
        pattern = Pattern(expression=BYTE_PATTERN)

        def run(a):
            if spec.get("add_prefix_space", True) and not a.text.startswith(" "):
                a = a.prepend(" ")
            pieces = a.split(pattern, ISOLATED) if spec.get("use_regex", True) else [a]
            return [p.each(_byte_level) for p in pieces]

        return run
    if kind == "Metaspace":
        return _metaspace(spec)
    if kind == "UnicodeScripts":
        return _scripts
    if kind == "FixedLength":
        if spec.get("length", 5) <= 0:
            raise SpecError("length must be positive")
        return lambda a: _fixed_length(a, spec.get("length", 5))
    if kind == "Split":
        pattern = Pattern.of(spec["pattern"], spec.get("invert", False))
        behavior = spec.get("behavior", ISOLATED)
        known = {b.lower(): b for b in (REMOVED, ISOLATED, "MergedWithPrevious", NEXT, CONTIGUOUS)}
        return lambda a: a.split(pattern, known.get(behavior.lower(), ISOLATED))
    simple = {
        "WhitespaceSplit": (Pattern(condition=" \t\n\r".__contains__), REMOVED),
        "Whitespace": (Pattern(expression=r"\w+|[^\w\s]+", invert=True), REMOVED),
        "Digits": (Pattern(condition="0123456789".__contains__), ISOLATED if spec.get("individual_digits") else CONTIGUOUS),
        "Punctuation": (Pattern(condition=_is_punctuation), ISOLATED),
        "CharDelimiterSplit": (Pattern(string=spec.get("delimiter", " ")), REMOVED),
    }
    if kind not in simple:
        raise SpecError(f"unknown pre-tokenizer {kind}")
    return lambda a: a.split(*simple[kind])


# --------------------------------------------------------------------- models
#: Words whose tokens a BPE model remembers; the frequent ones come back soon.
REMEMBERED = 1 << 16
#: (id, text, first byte, after the last) of a token in its piece.
Token = tuple[int, str, int, int]


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


@dataclass
class Vocabulary:
    ids: dict[str, int]
    tokens: dict[int, str] = field(default_factory=dict)

    def __post_init__(self):
        self.tokens = self.tokens or {i: t for t, i in self.ids.items()}


class WordLevel(Vocabulary):
    def __init__(self, spec: dict):
        super().__init__(dict(spec["vocab"]))
        self.unknown = spec.get("unk_token", "[UNK]")

    def tokenize(self, text: str) -> list[Token]:
        if not text:
            return []
        if text in self.ids:
            return [(self.ids[text], text, 0, _size(text))]
        if self.unknown not in self.ids:
            raise SpecError("no unknown token in the vocabulary")
        return [(self.ids[self.unknown], self.unknown, 0, _size(text))]


class WordPiece(Vocabulary):
    def __init__(self, spec: dict):
        super().__init__(dict(spec["vocab"]))
        self.unknown, self.prefix = spec.get("unk_token", "[UNK]"), spec.get("continuing_subword_prefix", "##")
        self.most, self.fuse = spec.get("max_input_chars_per_word", 100), spec.get("fuse_unk", True)
        self.longest = max(map(len, self.ids), default=1)

    def _unk(self, a: int, b: int) -> Token:
        if self.unknown not in self.ids:
            raise SpecError("no unknown token in the vocabulary")
        return (self.ids[self.unknown], self.unknown, a, b)

    def tokenize(self, text: str) -> list[Token]:
        if not text:
            return []
        if len(text) > self.most:
            return [self._unk(0, _size(text))]
        out, at, byte = [], 0, 0
        while at < len(text):
            head = self.prefix if at else ""
            for end in range(min(len(text), at + self.longest), at, -1):
                if head + text[at:end] in self.ids:
                    break
            else:
                if self.fuse:
                    return [self._unk(0, _size(text))]
                end = at + 1
                out.append(self._unk(byte, byte + _size(text[at:end])))
                at, byte = end, byte + _size(text[at:end])
                continue
            size = _size(text[at:end])
            out.append((self.ids[head + text[at:end]], head + text[at:end], byte, byte + size))
            at, byte = end, byte + size
        return out


class BPE(Vocabulary):
    def __init__(self, spec: dict):
        super().__init__(dict(spec["vocab"]))
        self.unknown, self.fuse = spec.get("unk_token"), spec.get("fuse_unk", False)
        self.prefix, self.suffix = spec.get("continuing_subword_prefix") or "", spec.get("end_of_word_suffix") or ""
        self.fallback, self.whole = spec.get("byte_fallback", False), spec.get("ignore_merges", False)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec.get("merges", [])):
            a, b = merge.split(" ", 1) if isinstance(merge, str) else merge
            made = a + (b[len(self.prefix) :] if self.prefix and b.startswith(self.prefix) else b)
            if a in self.ids and b in self.ids and made in self.ids:
                self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[made]))
        self.cache: dict[str, list[Token]] = {}

    def _symbols(self, text: str) -> list[list]:
        """[id, bytes, unknown] of each character."""
        out: list[list] = []
        for i, c in enumerate(text):
            name = (self.prefix if i else "") + c + (self.suffix if i == len(text) - 1 else "")
            size = _size(c)
            if name in self.ids:
                out.append([self.ids[name], size])
                continue
            parts = [f"<0x{b:02X}>" for b in c.encode("utf-8", "surrogatepass")]
            if self.fallback and all(p in self.ids for p in parts):
                out += [[self.ids[p], 1] for p in parts]
            elif self.unknown is not None and self.unknown in self.ids:
                out.append([self.ids[self.unknown], size])
        return out

    def _merged(self, symbols: list[list]) -> list[list]:
        n, merges = len(symbols), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((symbols[i][0], symbols[i + 1][0])))]
        heapify(heap)
        while heap:
            rank, i, new = heappop(heap)
            if not alive[i] or (j := after[i]) >= n or merges.get((symbols[i][0], symbols[j][0])) != (rank, new):
                continue
            symbols[i] = [new, symbols[i][1] + symbols[j][1]]
            alive[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get((symbols[x][0], symbols[y][0]))):
                    heappush(heap, (m[0], x, m[1]))
        return [s for s, a in zip(symbols, alive) if a]

    def tokenize(self, text: str) -> list[Token]:
        if not text:
            return []
        found = self.cache.get(text)
        if found is None:
            if self.whole and text in self.ids:
                found = [(self.ids[text], text, 0, _size(text))]
            else:
                found, at, unk = [], 0, self.ids.get(self.unknown)
                for i, size in self._merged(self._symbols(text)):
                    if self.fuse and i == unk and found and found[-1][0] == unk:
                        found[-1] = (i, found[-1][1], found[-1][2], at + size)
                    else:
                        found.append((i, self.tokens.get(i, ""), at, at + size))
                    at += size
            if len(text) < 64:
                if len(self.cache) >= REMEMBERED:
                    self.cache.clear()
                self.cache[text] = found
        return found


class Unigram(Vocabulary):
    def __init__(self, spec: dict):
        rows = spec["vocab"]
        super().__init__({}, {i: t for i, (t, _) in enumerate(rows)})
        self.ids |= {t: i for i, (t, _) in enumerate(rows)}  # of a piece that comes twice the last
        self.scores = {t: s for t, s in rows}
        self.unknown, self.fallback = spec.get("unk_id"), spec.get("byte_fallback", False)
        self.unknown_score = min((s for _, s in rows), default=0.0) - 10
        self.longest = max(map(len, self.scores), default=1)

    def _ending(self, text: str, end: int) -> list[tuple[float, int, str | None]]:
        """(score, start, piece) of what may end a path at `end`, the longest first: pieces, and an unknown character where it is no piece."""
        starts = range(max(0, end - self.longest), end)
        found = [(self.scores[text[i:end]], i, text[i:end]) for i in starts if text[i:end] in self.scores]
        return found if found and found[-1][1] == end - 1 else [*found, (self.unknown_score, end - 1, None)]

    def pieces(self, text: str) -> list[str]:
        """The path of the highest score; runs of unknown characters are one piece. Of equal scores the longest last piece."""
        paths: list[tuple[float, int, str | None]] = [(0.0, 0, None)]
        for end in range(1, len(text) + 1):
            paths.append(max(((paths[start][0] + score, start, piece) for score, start, piece in self._ending(text, end)), key=lambda p: p[0]))
        steps, end = [], len(text)
        while end:
            _, start, piece = paths[end]
            steps.append((piece is None, text[start:end]))
            end = start
        return [part for unknown, run in groupby(reversed(steps), key=lambda s: s[0]) for part in (["".join(s[1] for s in run)] if unknown else [s[1] for s in run])]

    def tokenize(self, text: str) -> list[Token]:
        out, at = [], 0
        for piece in self.pieces(text):
            size = _size(piece)
            parts = [f"<0x{b:02X}>" for b in piece.encode("utf-8", "surrogatepass")]
            if piece in self.ids:
                out.append((self.ids[piece], piece, at, at + size))
            elif self.fallback and all(p in self.ids for p in parts):
                out += [(self.ids[p], p, at, at + size) for p in parts]
            elif self.unknown is not None:
                out.append((self.unknown, piece, at, at + size))
            else:
                raise SpecError("a piece is unknown and the model has no unk_id")
            at += size
        return out


def model(spec: dict) -> Vocabulary:
    kind = spec.get("type")
    if kind is None:
        kind = "BPE" if "merges" in spec else "WordPiece" if "continuing_subword_prefix" in spec else "Unigram" if isinstance(spec.get("vocab"), list) else "BPE"
    kinds = {"WordLevel": WordLevel, "WordPiece": WordPiece, "BPE": BPE, "Unigram": Unigram}
    if kind not in kinds:
        raise SpecError(f"unknown model {kind}")
    return kinds[kind](spec)


# ------------------------------------------------------------------- decoders
def _nonempty(value: str, what: str) -> str:
    if not value:
        raise SpecError(f"{what} must not be empty")
    return value


def _bytes_back(tokens: list[str]) -> list[str]:
    out, held = [], bytearray()

    def flush():
        if held:
            try:
                out.append(held.decode("utf-8"))
            except UnicodeDecodeError:
                out.extend("�" * len(held))
            held.clear()

    for t in tokens:
        if re.fullmatch(r"<0x[0-9A-Fa-f]{2}>", t):
            held.append(int(t[3:5], 16))
        else:
            flush()
            out.append(t)
    flush()
    return out


def _ctc(spec: dict) -> Callable[[list[str]], list[str]]:
    pad, delimiter = _nonempty(spec.get("pad_token", "<pad>"), "pad_token"), _nonempty(spec.get("word_delimiter_token", "|"), "word_delimiter_token")

    def run(tokens):
        out = []
        for i, t in enumerate(tokens):
            if i and tokens[i - 1] == t:
                continue
            t = t.replace(pad, "")
            if spec.get("cleanup", True):
                for mark in (" .", " ?", " !", " ,", " '", " )", " ]", " }", " :", " ;"):
                    t = t.replace(mark, mark[1])
                t = t.replace(delimiter, " ")
            if t:
                out.append(t)
        return out

    return run


def _strip_decoder(spec: dict) -> Callable[[list[str]], list[str]]:
    c, start, stop = spec.get("content", " "), spec.get("start", 0), spec.get("stop", 0)

    def one(t):
        a = 0
        while a < min(start, len(t)) and t[a] == c:
            a += 1
        b = len(t)
        while b > a and len(t) - b < stop and t[b - 1] == c:
            b -= 1
        return t[a:b]

    return lambda tokens: [one(t) for t in tokens]


def decoder(spec: dict | None) -> Callable[[list[str]], list[str]] | None:
    """The chain: tokens to pieces that are then joined without a separator."""
    kind = spec["type"] if spec else None
    if kind is None:
        return None
    if kind == "Sequence":
        steps = [decoder(s) for s in spec.get("decoders", [])]

        def run(tokens):
            for step in steps:
                tokens = step(tokens)
            return tokens

        return run
    if kind == "WordPiece":
        prefix = spec.get("prefix", "##")
        return lambda tokens: [t if not i else t[len(prefix) :] if prefix and t.startswith(prefix) else " " + t for i, t in enumerate(tokens)]
    if kind in ("BPE", "BPEDecoder"):
        suffix = _nonempty(spec.get("suffix", "</w>"), "suffix")
        return lambda tokens: [t.replace(suffix, " " if i < len(tokens) - 1 else "") for i, t in enumerate(tokens)]
    if kind == "ByteLevel":
        known: dict[str, bytes] = {}  # of the vocabulary's tokens

        def joined(tokens):
            for t in set(tokens) - known.keys():
                known[t] = b"".join(bytes([CHAR_BYTES[c]]) if c in CHAR_BYTES else c.encode() for c in t)
            return [b"".join(map(known.__getitem__, tokens)).decode("utf-8", "replace")]

        return joined
    if kind == "ByteFallback":
        return _bytes_back
    if kind == "CTC":
        return _ctc(spec)
    if kind == "Fuse":
        return lambda tokens: ["".join(tokens)]
    if kind == "Strip":
        return _strip_decoder(spec)
    if kind == "Metaspace":
        mark = _nonempty(spec.get("replacement", "▁"), "replacement")
        return lambda tokens: [(x[1:] if not i and (x := t.replace(mark, " ")).startswith(" ") else t.replace(mark, " ")) for i, t in enumerate(tokens)]
    if kind == "Replace":
        pattern = spec.get("pattern", "")
        pattern = pattern if isinstance(pattern, str) else pattern.get("String", "")
        return lambda tokens: [t.replace(pattern, spec.get("content", "")) for t in tokens] if pattern else tokens
    raise SpecError(f"unknown decoder {kind}")

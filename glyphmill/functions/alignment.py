"""Normalized texts that know, in the JVM, which bytes of the original each of their bytes comes from.

An aligned text is a struct of the text and of two arrays with an entry for each of its bytes: where in the original the character that it comes from
begins, and where that ends. A step of normalization makes the same two arrays against its own input; steps are put together by
looking positions up in the arrays before: of what a step leaves as long as it is, whole runs are taken over (a slice), of the rest
each piece's place, so any number of steps takes time in proportion to the text. Running
offsets, which a prefix sum would give, are where the first bytes of pieces stand among all bytes: filter() finds them by their
index, in one pass and without an accumulator that grows.

As in the kernels: what replaces a match stands for the match's last character, a prepended text for the first one, each byte of a
mapped character for all of it. Null texts stay null, empty ones are empty. Long texts hold two numbers a byte while they are
worked on, one text at a time. Patterns that match nothing at all, and normal forms, raise Unsupported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import expr
from .dialect import to_java, to_python
from .pipeline import Unsupported, pre_tokenizer

INTS = "array<int>"


#: Pieces whose running sum is one fold; of the folds' sums another is made, and so on.
_FOLD, _LEVELS = 32, 3


def _once(value: Column, use) -> Column:
    """An expression of a value that is used more than once, as the only one of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts(lengths: Column) -> Column:
    """Where each piece of these lengths begins: the running sum before it, in folds of few pieces, whose arrays stay short."""

    def fold(first: Column, values: Column) -> Column:
        return F.aggregate(values, F.array(first), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))

    def running(values: Column, levels: int) -> Column:
        n = F.size(values)
        if not levels:
            return fold(F.lit(0), F.slice(values, 1, n - 1))
        parts = F.sequence(F.lit(0), F.floor((n - 1) / _FOLD).cast("int"))
        totals = F.transform(parts, lambda k: F.aggregate(F.slice(values, k * _FOLD + 1, _FOLD), F.lit(0), lambda a, b: a + b))
        first = _once(totals, lambda t: running(t, levels - 1))
        folds = F.zip_with(parts, first, lambda k, at: fold(at, F.slice(values, k * _FOLD + 1, F.least(F.lit(_FOLD), n - k * _FOLD) - 1)))
        return F.when(n <= _FOLD, fold(F.lit(0), F.slice(values, 1, n - 1))).otherwise(F.flatten(folds))

    return _once(lengths, lambda v: F.when(F.size(v) == 0, F.array().cast(INTS)).when(v.isNotNull(), running(v, _LEVELS - 1)))


def _sizes(pieces: Column) -> Column:
    return F.transform(pieces, F.octet_length)


#: Runs of characters that are a byte each, and other characters one by one.
_RUNS = r"[\x00-\x7F]+|(?s:.)"


class Aligned:
    """A DataFrame with columns of an aligned text under a name; each step adds columns, which later ones look up.

    Before the first step a byte's place is its own, so that the arrays are made only where there is a step.
    """

    def __init__(self, df: DataFrame, text: str, name: str = "__a"):
        self.name, self.n, self.own = name, 0, True
        self.df = df.withColumn(f"{name}0_text", F.col(text))

    def column(self, part: str) -> Column:
        """Of text, from and to, after all steps so far."""
        return F.col(f"{self.name}{self.n}_{part}")

    def _parts(self) -> list[str]:
        return [f"{self.name}{self.n}_{p}" for p in (("text",) if self.own else ("text", "from", "to"))]

    def _places(self) -> None:
        """The arrays of a text that no step has changed."""
        if not self.own:
            return
        text, name = self.column("text"), f"{self.name}{self.n}"
        df = self.df.withColumn("__runs", expr.pieces(text, _RUNS)).withColumn("__at", starts(_sizes(F.col("__runs"))))

        def spread(first: Column, n: Column, run: Column) -> Column:
            return F.when(n == F.char_length(run), F.sequence(first, first + n - 1))

        begin = F.zip_with("__runs", "__at", lambda r, at: F.coalesce(spread(at, F.octet_length(r), r), F.array_repeat(at, F.octet_length(r))))
        end = F.zip_with("__runs", "__at", lambda r, at: F.coalesce(spread(at + 1, F.octet_length(r), r), F.array_repeat(at + F.octet_length(r), F.octet_length(r))))
        self.df, self.own = df.withColumns({f"{name}_from": F.flatten(begin), f"{name}_to": F.flatten(end)}).drop("__runs", "__at"), False

    def _step(self, pieces: Column, begin) -> None:
        """Input pieces, what is made of each, and whether it is plain: byte by byte as long as before. Else it stands for the piece from
        a byte on (begin) to its end."""
        self._places()
        now, name = f"{self.name}{self.n}", f"{self.name}{self.n + 1}"
        df = self.df.withColumn("__pieces", pieces).withColumn("__at", starts(F.transform("__pieces", lambda x: F.octet_length(x["p"]))))

        def into(side: str, stands) -> Column:
            places = F.col(f"{now}_{side}")
            return F.flatten(F.zip_with("__pieces", "__at", lambda x, at: F.when(x["plain"], F.slice(places, at + 1, F.octet_length(x["p"]))).otherwise(F.array_repeat(F.get(places, at + stands(x["p"])), F.octet_length(x["made"])))))

        df = df.withColumns({f"{name}_text": F.array_join(F.transform("__pieces", lambda x: x["made"]), ""), f"{name}_from": into("from", begin), f"{name}_to": into("to", lambda p: F.octet_length(p) - 1)})
        self.df, self.n = df.drop("__pieces", "__at", *self._parts()), self.n + 1

    def each(self, image, run: str, runs=lambda p: p) -> Aligned:
        """Characters by their images, an expression of one character; those without an image are dropped. Images of a class of characters
        (run) are as long as they are: a run of them is one piece, whose image is an expression of it."""
        found = F.transform(expr.pieces(self.column("text"), rf"{run}+|(?s:.)"), lambda p: F.struct(p.alias("p"), F.when(F.char_length(p) > 1, runs(p)).otherwise(image(p)).alias("made"), (F.char_length(p) > 1).alias("plain")))
        self._step(found, lambda p: F.lit(0))
        return self

    def replace(self, java: str, content: str, literal: str | None = None) -> Aligned:
        """Matches of a pattern, none of them empty; what lies between them stays as it is."""
        text = self.column("text")
        piece = lambda p, made, plain: F.struct(p.alias("p"), made.alias("made"), F.lit(plain).alias("plain"))
        between = F.split(text, java, -1)
        matches = expr.pieces(text, java) if literal is None else F.array_repeat(F.lit(literal), F.size(between) - 1)
        both = F.flatten(F.zip_with(between, matches, lambda b, m: F.array(piece(b, b, True), piece(m, F.lit(content), False))))
        self._step(F.filter(both, lambda x: x["p"] != ""), lambda p: F.octet_length(p) - F.octet_length(F.right(p, F.lit(1))))
        return self

    def prepend(self, content: str) -> Aligned:
        self._places()
        now, name, size = f"{self.name}{self.n}", f"{self.name}{self.n + 1}", len(content.encode())
        text = F.col(f"{now}_text")
        more = lambda side: F.when(text != "", F.concat(F.array_repeat(F.get(F.col(f"{now}_{side}"), F.lit(0)), size), F.col(f"{now}_{side}"))).otherwise(F.col(f"{now}_{side}"))
        self.df = self.df.withColumns({f"{name}_text": expr.prepend(text, content), f"{name}_from": more("from"), f"{name}_to": more("to")}).drop(*(f"{now}_{p}" for p in ("text", "from", "to")))
        self.n += 1
        return self

    def strip(self, left: bool, right: bool) -> Aligned:
        self._places()
        now, name = f"{self.name}{self.n}", f"{self.name}{self.n + 1}"
        text = F.col(f"{now}_text")
        head = expr.strip(text, True, False) if left else text
        kept = expr.strip(text, left, right)
        begin, size = F.octet_length(text) - F.octet_length(head) + 1, F.octet_length(kept)
        self.df = self.df.withColumns({f"{name}_text": kept, f"{name}_from": F.slice(f"{now}_from", begin, size), f"{name}_to": F.slice(f"{now}_to", begin, size)}).drop(*(f"{now}_{p}" for p in ("text", "from", "to")))
        self.n += 1
        return self

    def normalize(self, spec: dict | None) -> Aligned:
        kind = spec["type"] if spec else "Precompiled"
        if kind == "Sequence":
            for step in spec.get("normalizers", []):
                self.normalize(step)
            return self
        if kind == "Precompiled":
            return self
        if kind == "Strip":
            return self.strip(spec.get("strip_left", True), spec.get("strip_right", True))
        if kind == "Prepend":
            return self.prepend(spec.get("prepend", ""))
        if kind == "Replace":
            pattern = spec["pattern"] if isinstance(spec["pattern"], str) else spec["pattern"].get("String")
            if pattern == "" or pattern is None and to_python(spec["pattern"]["Regex"]).match(""):
                raise Unsupported("no expression for a pattern that matches nothing at all")
            return self.replace(expr.quote(pattern) if pattern is not None else to_java(spec["pattern"]["Regex"]), spec.get("content", ""), pattern)
        images = {
            "Lowercase": (expr.lowercase_each, r"[\x00-\x7F]", F.lower), "StripAccents": (expr.strip_accents, r"\P{Mn}"), "ByteLevel": (expr.byte_level, "[!-~]"),
            "Nmt": (expr.nmt, r"[\x00\x20-\x7E\x{A0}-\x{167F}]"),
        }
        if kind not in images:
            raise Unsupported(f"no expression for the normalizer {kind}")
        return self.each(*images[kind])

    def pieces(self, spec: dict | None, out: str = "pieces") -> DataFrame:
        """df with array<struct<text, start, end>>: pieces, and the bytes of the original that they come from."""
        covering, mapped, kept = _covering(spec)
        own, sides = self.own, [self.column(p) for p in ("from", "to")]
        df = self.df.withColumn("__pieces", covering(self.column("text"))).withColumn("__at", starts(_sizes(F.col("__pieces"))))
        image = expr.byte_level if mapped else (lambda t: t)

        def found(p: Column, at: Column) -> Column:
            begin, end = (at, at + F.octet_length(p)) if own else (F.get(sides[0], at), F.get(sides[1], at + F.octet_length(p) - 1))
            return F.when(kept(p), F.struct(image(p).alias("text"), begin.alias("start"), end.alias("end")))

        shown = F.filter(F.zip_with("__pieces", "__at", found), lambda x: x.isNotNull())
        return df.withColumn("__out", shown).drop(out, "__pieces", "__at", *self._parts()).withColumnRenamed("__out", out)


#: Java patterns of what is left out between pieces, and its characters.
_BLANKS = {"WhitespaceSplit": (r"[ \t\n\r]+", " \t\n\r"), "Whitespace": (r"(?U:\s)+", expr.WHITE), "BertPreTokenizer": (r"(?U:\s)+", expr.WHITE)}
#: Those of the pieces.
_KEPT = {
    None: r"(?s:.)+", "WhitespaceSplit": r"[^ \t\n\r]+", "Whitespace": rf"[{expr.WORD}]+|(?U:[^\s{expr.WORD}])+", "Punctuation": r"\p{P}|\P{P}+", "BertPreTokenizer": r"[!-/:-@\[-\x60{-~\p{P}]|(?U:[^\s!-/:-@\[-\x60{-~\p{P}])+",
}


def _covering(spec: dict | None):
    """An expression of the pieces that cover a text, whether they are yet to be put into the byte alphabet, and which are kept."""
    kind, all_ = spec["type"] if spec else None, lambda p: F.lit(True)
    if kind == "ByteLevel" and not spec.get("add_prefix_space", True):
        return *pre_tokenizer(spec), all_
    if kind == "Digits":
        return (lambda t: expr.digits(t, spec.get("individual_digits", False))), False, all_
    if kind not in _KEPT:
        raise Unsupported(f"no offsets by expression for the pre-tokenizer {kind}")
    if kind not in _BLANKS:
        return (lambda t: expr.pieces(t, _KEPT[kind])), False, all_
    blank, white = _BLANKS[kind]
    return (lambda t: expr.pieces(t, f"{_KEPT[kind]}|{blank}")), False, lambda p: F.btrim(p, F.lit(white)) != ""


def pre_tokenize(df: DataFrame, normal: dict | None, pre: dict | None, text: str = "text", out: str = "pieces") -> DataFrame:
    """df with the pieces of the normalized text, each with the bytes of the original that it comes from."""
    return Aligned(df, text).normalize(normal).pieces(pre, out)

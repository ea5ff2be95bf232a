"""Stages as Column expressions: what needs no offsets stays in generated code."""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, SparkSession, functions as F

from ..operators.stages import BYTE_CHARS, BYTE_PATTERN, CHAR_BYTES
from .dialect import to_java

# fixed values: Unicode White_Space, and the characters that the Nmt normalizer drops and blanks
WHITE = "\t\n\x0b\x0c\r \x85\xa0   　  " + "".join(map(chr, range(0x2000, 0x200B))) + "  "
WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"


def quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}&~#-])", r"\\\1", text)


# normalizers
def lowercase(t: Column) -> Column:
    """Exact for texts without a capital sigma."""
    return F.lower(t)


def lowercase_each(t: Column) -> Column:
    """Character by character: a capital sigma has one small form, wherever it stands."""
    return F.array_join(F.transform(F.split(t, "Σ", -1), F.lower), "σ")


def strip(t: Column, left: bool = True, right: bool = True) -> Column:
    f = F.btrim if left and right else F.ltrim if left else F.rtrim if right else (lambda x, _: x)
    return f(t, F.lit(WHITE))


def replace(t: Column, old: str, new: str) -> Column:
    return F.replace(t, F.lit(old), F.lit(new))


def replace_regex(t: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(t, to_java(pattern), new.replace("\\", "\\\\").replace("$", "\\$"))


def prepend(t: Column, text: str) -> Column:
    return F.when(t != "", F.concat(F.lit(text), t)).otherwise(t)


def strip_accents(t: Column) -> Column:
    return F.regexp_replace(t, r"\p{Mn}", "")


def nmt(t: Column) -> Column:
    dropped = F.regexp_replace(t, r"[\x01-\x08\x0B\x0E-\x1F\x7F\x{8F}\x{9F}]", "")
    return F.regexp_replace(dropped, r"[\t\n\x0C\r\x{1680}\x{2028}\x{2029}\x{2581}\x{FEFF}\x{FFFD}\x{200B}-\x{200F}]", " ")


_MOVED = [(chr(b), c) for b, c in sorted(BYTE_CHARS.items()) if chr(b) != c]


def byte_level(t: Column) -> Column:
    return F.translate(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"), "".join(a for a, _ in _MOVED), "".join(b for _, b in _MOVED))


def byte_level_back(t: Column) -> Column:
    """For texts of mapped characters only."""
    return F.make_valid_utf8(F.encode(F.translate(t, "".join(b for _, b in _MOVED), "".join(a for a, _ in _MOVED)), "ISO-8859-1").cast("string"))


# pre-tokenizers: arrays of pieces
def pieces(t: Column, java: str) -> Column:
    return F.regexp_extract_all(t, F.lit(java), F.lit(0))


def whitespace(t: Column) -> Column:
    return pieces(t, rf"[{WORD}]+|(?U:[^\s{WORD}])+")


def whitespace_split(t: Column) -> Column:
    return F.filter(F.split(t, "[ \t\n\r]"), lambda x: x != "")


def digits(t: Column, individual: bool = False) -> Column:
    return pieces(t, "[0-9]|[^0-9]+" if individual else "[0-9]+|[^0-9]+")


def punctuation(t: Column) -> Column:
    return pieces(t, r"\p{P}|\P{P}+")


def bert(t: Column) -> Column:
    return pieces(t, r"[!-/:-@\[-\x60{-~\p{P}]|(?U:[^\s!-/:-@\[-\x60{-~\p{P}])+")


def char_delimiter(t: Column, delimiter: str) -> Column:
    return F.filter(F.split(t, quote(delimiter)), lambda x: x != "")


def metaspace(t: Column, mark: str = "▁", prepend: bool = True, split: bool = True) -> Column:
    marked = replace(t, " ", mark)
    if prepend:
        marked = F.when(marked.startswith(mark) | (marked == ""), marked).otherwise(F.concat(F.lit(mark), marked))
    return pieces(marked, f"{quote(mark)}?(?:(?!{quote(mark)})(?s:.))+|{quote(mark)}") if split else F.filter(F.array(marked), lambda x: x != "")


def byte_level_pieces(t: Column) -> Column:
    """Not yet in the byte alphabet."""
    return pieces(t, to_java(BYTE_PATTERN))


# fixed values: what counts as Han beside its own characters, and the scripts that most texts are in, which are tried first
_HAN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}"
_FREQUENT = ("LATIN", "COMMON", "HAN", "CYRILLIC", "ARABIC", "GREEK", "HANGUL", "DEVANAGARI", "INHERITED")


def scripts_pattern(names: list[str]) -> str:
    """A pattern of runs of one script out of those named: one character decides, and the rest is a loop over a class.

    The space and what has no script join what is before them, at the beginning what follows.
    """
    known = [n for n in _FREQUENT if n in names] + sorted(set(names) - {*_FREQUENT, "UNKNOWN", "HIRAGANA", "KATAKANA"})
    neither = r"\x20\p{IsUnknown}"
    classes = {"HAN": _HAN, "COMMON": r"\p{IsCommon}&&[^\x20\x{30FC}]"}
    runs = [f"[{c}](?:[{c}]|[{neither}])*+" if "&&" in c else f"[{c}][{c}{neither}]*+" for c in (classes.get(n, rf"\p{{Is{n}}}") for n in known)]
    return f"[{neither}]*+(?:{'|'.join(runs)})|[{neither}]++"


def script_names() -> list[str]:
    """Those that this session's JVM knows."""
    jvm = SparkSession.active().sparkContext._jvm
    return [s.name() for s in jvm.java.lang.Character.UnicodeScript.values()]


def unicode_scripts(t: Column, names: list[str]) -> Column:
    """Pieces of one script; names are those that the JVM knows (Character.UnicodeScript)."""
    return pieces(t, scripts_pattern(names))


def lookup(values: dict[str, object], kind: str):
    """An expression of struct<key, value> of a string, null for what is no key: a constant table of short rows by the string's CRC."""
    rows: list[list[dict]] = [[] for _ in range(max(1, len(values)))]
    for key, value in values.items():
        rows[zlib.crc32(key.encode()) % len(rows)].append({"key": key, "value": value})
    table = F.from_json(F.lit(json.dumps(rows)), f"array<array<struct<key:string,value:{kind}>>>")
    return lambda t: F.get(F.filter(F.get(table, (F.crc32(t) % len(rows)).cast("int")), lambda row: row["key"] == t), F.lit(0))


def trie(words: list[str]) -> str:
    """A pattern of the longest of many words: they share the patterns of their beginnings, so each character is looked at once."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        ends = "" in node
        ways = [quote(c) + of(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 and not ends else f"(?:{'|'.join(ways)})"
        return one + "?" if ends else one

    return of(root)


def added_tokens(t: Column, ids: dict[str, int]) -> Column:
    """array<struct<text, id>>: the text between added tokens with a null id, and these; at each place the longest counts."""
    tokens = [w for w in ids if w]
    if not tokens:
        return F.when(t.isNotNull(), F.transform(F.filter(F.array(t), lambda x: x != ""), lambda x: F.struct(x.alias("text"), F.lit(None).cast("int").alias("id"))))
    known, table = trie(tokens), lookup({w: ids[w] for w in tokens}, "int")
    # what lies between tokens holds none, so that a piece that is one has been found as one
    return F.transform(pieces(t, f"{known}|(?:(?!{known})(?s:.))+"), lambda piece: F.struct(piece.alias("text"), table(piece)["value"].alias("id")))


def split_on(t: Column, c: str, behavior: str) -> Column:
    """At a character."""
    q = quote(c)
    java = {"Removed": f"[^{q}]+", "Isolated": f"{q}|[^{q}]+", "Contiguous": f"{q}+|[^{q}]+", "MergedWithPrevious": f"[^{q}]+{q}?|{q}", "MergedWithNext": f"{q}?[^{q}]+|{q}"}[behavior]
    return pieces(t, java)


# encodings: arrays of ids
def bert_ids(a: Column, b: Column | None, cls: int, sep: int) -> Column:
    parts = [F.array(F.lit(cls)), a, F.array(F.lit(sep))] + ([b, F.array(F.lit(sep))] if b is not None else [])
    return F.concat(*parts)


def roberta_ids(a: Column, b: Column | None, cls: int, sep: int) -> Column:
    one, two = F.array(F.lit(cls)), F.array(F.lit(sep))
    return F.concat(one, a, two) if b is None else F.concat(one, a, two, two, b, two)


def truncate(a: Column, n: int, left: bool = False) -> Column:
    return F.when(F.size(a) <= n, a).otherwise(F.slice(a, -n if left else 1, n))


def pad(a: Column, n: Column | int, value: int = 0, left: bool = False) -> Column:
    more = F.array_repeat(F.lit(value), F.greatest(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - F.size(a)))
    return F.concat(more, a) if left else F.concat(a, more)


def rounded(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


# decoders: arrays of tokens
def decode_wordpiece(a: Column, prefix: str = "##") -> Column:
    return F.array_join(F.transform(a, lambda t, i: F.when(i == 0, t).when(t.startswith(prefix), F.substring(t, len(prefix) + 1, 1 << 30)).otherwise(F.concat(F.lit(" "), t))), "")


def decode_bpe(a: Column, suffix: str = "</w>") -> Column:
    most = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    last = F.coalesce(F.replace(F.try_element_at(a, F.lit(-1)), F.lit(suffix), F.lit("")), F.lit(""))
    return F.concat(F.array_join(F.transform(most, lambda t: F.replace(t, F.lit(suffix), F.lit(" "))), ""), last)


def decode_metaspace(a: Column, mark: str = "▁") -> Column:
    return F.array_join(F.transform(a, lambda t, i: F.regexp_replace(replace(t, mark, " "), F.when(i == 0, F.lit(r"\A ")).otherwise(F.lit(r"\z\A ")), F.lit(""))), "")


def decode_strip(a: Column, c: str, start: int, stop: int) -> Column:
    q = quote(c)
    return F.array_join(F.transform(a, lambda t: F.regexp_replace(F.regexp_replace(t, rf"\A{q}{{0,{start}}}", ""), rf"{q}{{0,{stop}}}\z", "")), "")


def decode_replace(a: Column, old: str, new: str) -> Column:
    return F.array_join(F.transform(a, lambda t: F.replace(t, F.lit(old), F.lit(new))), "")


def byte_fallback(a: Column) -> Column:
    """Runs of byte tokens as texts, or as U+FFFD for each byte of a run that is no UTF-8; other tokens as they are.

    All tokens are written in hexadecimal digits behind a letter, so that one pattern finds the runs, and a run is turned back as a whole.
    """
    digit = "(?![46][07-9])[346][0-9]"
    token = f"y3C3078{digit}{digit}3E(?![0-9A-F])"
    row = F.array_join(F.transform(a, lambda t: F.concat(F.lit("y"), F.hex(t))), "")

    def text(run: Column) -> Column:
        return F.unhex(F.replace(run, F.lit("y"), F.lit(""))).cast("string")

    def back(run: Column) -> Column:
        made = F.unhex(F.replace(F.replace(text(run), F.lit("<0x"), F.lit("")), F.lit(">"), F.lit(""))).cast("string")
        valid = F.transform(F.array(made), lambda m: F.when(F.is_valid_utf8(m), m))
        whole = F.flatten(F.transform(valid, lambda m: F.when(m.isNotNull(), F.array(m)).otherwise(F.array_repeat(F.lit("\ufffd"), (F.length(run) / 13).cast("int")))))
        return F.when(run.startswith("y3C3078") & run.rlike(rf"\A{token}"), whole).otherwise(F.array(F.unhex(F.substring(run, 2, 1 << 30)).cast("string")))

    return F.flatten(F.transform(pieces(row, f"(?:{token})+|y[0-9A-F]*"), back))


def decode_byte_fallback(a: Column) -> Column:
    return F.array_join(byte_fallback(a), "")


def decode_ctc(a: Column, pad: str = "<pad>", delimiter: str = "|") -> Column:
    # beside each token the one before it: looked up in a lambda, the array would be made again for each
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    once = F.filter(F.zip_with(a, before, lambda t, p: F.when(p.isNull() | (t != p), t)), lambda t: t.isNotNull())
    clean = F.transform(once, lambda t: F.replace(F.regexp_replace(F.replace(t, F.lit(pad), F.lit("")), r" ([.?!,')\]}:;])", "$1"), F.lit(delimiter), F.lit(" ")))
    return F.array_join(F.filter(clean, lambda t: t != ""), "")


assert CHAR_BYTES["Ġ"] == 32

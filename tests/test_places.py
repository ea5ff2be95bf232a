"""Pieces of whole texts against the kernels, and that norm_offsets takes this way."""

import random

import pytest

from glyphmill.operators import places
from glyphmill.operators.frames import TextPipeline
from glyphmill.operators.tokenizer import Spec, Tokenizer

RNG = random.Random(8)
CHARS = [*"abthTH  \t\n.,!_12", "é", "É", "ß", "中", "😀", "́", "\xa0", "İ", "Σ", "\x07"]
TEXTS = ["", " ", "th", "  the  ", "th" * 9, *("".join(RNG.choices(CHARS, k=RNG.randint(1, 40))) for _ in range(300)), "The é  " * 500]
RE, STRING = (lambda r, c: {"type": "Replace", "pattern": {"Regex": r}, "content": c}), (lambda s, c: {"type": "Replace", "pattern": {"String": s}, "content": c})
NORMAL = [
    None, {"type": "Lowercase"}, {"type": "Strip"}, {"type": "Strip", "strip_left": False}, {"type": "StripAccents"}, {"type": "Nmt"}, {"type": "NFD"}, {"type": "ByteLevel"}, {"type": "Prepend", "prepend": "é▁"}, RE(r"\s+", " "), RE("[ath]", "\\1é"), RE("[^ ]+", ""),
    RE("a*", "b"), STRING("th", "þþ"), STRING("", "x"), STRING(" ", ""),
    {"type": "Sequence", "normalizers": [{"type": "Strip"}, {"type": "Lowercase"}, RE(r"\s+", " "), STRING("th", "þ"), STRING(".", ""), {"type": "NFD"}, {"type": "StripAccents"}, {"type": "Prepend", "prepend": "▁▁"}]},
]


def _spec(normal, pre):
    return Spec.of({"model": {"type": "WordLevel", "vocab": {"[UNK]": 0}}, "normalizer": normal, "pre_tokenizer": pre})


@pytest.mark.parametrize("at", range(len(NORMAL)))
def test_equals_aligned(at):
    for pre in (None, {"type": "WhitespaceSplit"}, {"type": "Whitespace"}):
        t, whole = Tokenizer(_spec(NORMAL[at], pre)), places.pieces(NORMAL[at], pre)
        for text in TEXTS:
            try:
                got = whole(text)
            except places.EmptyMatch:
                assert at == 12
                continue
            assert list(zip(got[0], got[1].tolist(), got[2].tolist())) == [(p.text, p.spans[0][0], p.spans[-1][1]) for p in t.pieces(text)], (pre, text)


def test_in_frames(spark):
    assert places.pieces({"type": "BertNormalizer"}, None) is None and places.pieces(None, {"type": "Digits"}) is None
    rows = [(k, x) for k, x in enumerate([None, *TEXTS, None])]
    for normal, pre in ((NORMAL[-1], {"type": "WhitespaceSplit"}), (NORMAL[12], {"type": "Whitespace"}), ({"type": "NFC"}, {"type": "Digits"})):
        t = Tokenizer(_spec(normal, pre))
        for r in TextPipeline(_spec(normal, pre)).pre_tokenize(spark.createDataFrame(rows, "k int, text string")).collect():
            assert (r["pieces"] if r["text"] is None else [tuple(p) for p in r["pieces"]]) == (None if r["text"] is None else [(p.text, p.spans[0][0], p.spans[-1][1]) for p in t.pieces(r["text"])])


def test_a_step_doesn_t_go_character_by_character(monkeypatch):
    """The kernel's steps see single characters only, to learn their images, however long the text."""
    from glyphmill.operators.aligned import Aligned

    seen, of = [], Aligned.of.__func__
    monkeypatch.setattr(Aligned, "of", classmethod(lambda cls, text: (seen.append(len(text)), of(cls, text))[1]))
    texts, start, end = places.pieces(NORMAL[-1], {"type": "WhitespaceSplit"})("The é  " * 5000)
    assert len(texts) == len(start) == len(end) == 10_000 and max(seen) == 1 and len(seen) < 50

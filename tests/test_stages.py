"""Kernels of single stages; inputs are this suite's own, expected values follow from each stage's definition."""

import pytest
from hypothesis import given, settings, strategies as st

from glyphmill.operators.aligned import CONTIGUOUS, ISOLATED, NEXT, PREVIOUS, REMOVED, Aligned, Pattern
from glyphmill.operators.stages import BPE, BYTE_PATTERN, SpecError, Unigram, WordLevel, WordPiece, decoder, normalizer, pre_tokenizer, text_normalizer


def cut(kind, text, **more):
    return [(p.text, p.spans[0][0], p.spans[-1][1]) for p in pre_tokenizer({"type": kind, **more})(Aligned.of(text)) if p.chars]


def texts(kind, text, **more):
    return [p[0] for p in cut(kind, text, **more)]


def test_pre_tokenizers():
    assert cut("BertPreTokenizer", "two, três?!  ok") == [("two", 0, 3), (",", 3, 4), ("três", 5, 10), ("?", 10, 11), ("!", 11, 12), ("ok", 14, 16)]
    assert cut("WhitespaceSplit", "red; blue\tgreen.") == [("red;", 0, 4), ("blue", 5, 9), ("green.", 10, 16)]
    assert texts("Whitespace", "one-two $3.5") == ["one", "-", "two", "$", "3", ".", "5"] and texts("Whitespace", " \t") == []
    assert texts("CharDelimiterSplit", "a|bc||d", delimiter="|") == ["a", "bc", "d"]
    assert cut("Metaspace", "ab cd") == [("▁ab", 0, 2), ("▁cd", 2, 5)]
    assert texts("Metaspace", "ab  cd ") == ["▁ab", "▁", "▁cd", "▁"]
    assert texts("Metaspace", "ab cd", prepend_scheme="never") == ["ab", "▁cd"]
    assert cut("Split", "k1=v2;k3", pattern={"Regex": r"\d"}, behavior="Removed", invert=True) == [("1", 1, 2), ("2", 4, 5), ("3", 7, 8)]
    assert cut("UnicodeScripts", "абв中ーのx") == [("абв", 0, 6), ("中ーの", 6, 15), ("x", 15, 16)]
    assert texts("FixedLength", "1234567", length=3) == ["123", "456", "7"] and texts("FixedLength", "xßy", length=2) == []
    assert texts("ByteLevel", "it's naïve", add_prefix_space=False) == ["it", "'s", "ĠnaÃ¯ve"]


@pytest.mark.parametrize(("behavior", "expected"), [(REMOVED, "a b c"), (ISOLATED, "a / b / / c"), (PREVIOUS, "a/ b/ / c"), (NEXT, "a /b / /c"), (CONTIGUOUS, "a / b // c")])
def test_split_behaviors(behavior, expected):
    assert [p.text for p in Aligned.of("a/b//c").split(Pattern(string="/"), behavior)] == expected.split()


def test_patterns():
    assert Pattern(expression=r"\d+").slices("x12y") == [(0, 1, False), (1, 3, True), (3, 4, False)]
    assert Pattern(expression=r"\b").slices("") in ([], [(0, 0, False)])
    assert Pattern(expression=BYTE_PATTERN).slices("so  it's") == [(0, 2, True), (2, 3, True), (3, 6, True), (6, 8, True)]
    for bad in ("(x", "x)", "[x", "[9-0]", "+x", "x{3,1}", "x{1025}", "x\\", r"\p{Nothing}", "(?<=x*)y", "^*", r"(x)\1", "x*+"):
        with pytest.raises(ValueError):
            Pattern(expression=bad)


def test_alignment():
    a = Aligned.of("öx").decomposed("NFD")
    assert [a.spans[i] for i in a.bytes_of()] == [(0, 2)] * 3 + [(2, 3)]
    assert Aligned.of("ﬁ①").composed("NFKC").text == "fi1"
    assert Aligned.of("yz").prepend("12").spans[:2] == [(0, 1)] * 2 and Aligned.of("yz").append("12").spans[-2:] == [(1, 2)] * 2
    assert Aligned.of("xoox").replace(Pattern(string="oo"), "0").text == "x0x"
    assert normalizer({"type": "StripAccents"})(Aligned.of("õ")).text == "õ" and normalizer({"type": "BertNormalizer"})(Aligned.of("Ü文Q")).text == "u 文 q"


@given(st.text(max_size=60))
def test_covering_splits_keep_the_text(text):
    assert "".join(p.text for p in pre_tokenizer({"type": "Punctuation"})(Aligned.of(text))) == text
    pieces = pre_tokenizer({"type": "ByteLevel", "add_prefix_space": False})(Aligned.of(text))
    assert "".join(decoder({"type": "ByteLevel"})([p.text for p in pieces])) == text


def test_models():
    m = WordPiece({"vocab": {"[UNK]": 0, "re": 1, "##play": 2, "##s": 3, "play": 4, "##pla": 5}})
    assert m.tokenize("replays") == [(1, "re", 0, 2), (2, "##play", 2, 6), (3, "##s", 6, 7)] and m.tokenize("rex") == [(0, "[UNK]", 0, 3)]
    m = BPE({"vocab": {"x": 0, "y": 1, "z": 2, "yz": 3, "xyz": 4}, "merges": ["y z", "x yz"]})
    assert m.tokenize("xyzy") == [(4, "xyz", 0, 3), (1, "y", 3, 4)]
    assert [t[0] for t in BPE({"vocab": {"<0xE2>": 7, "<0x82>": 8, "<0xAC>": 9}, "merges": [], "byte_fallback": True}).tokenize("€")] == [7, 8, 9]
    assert BPE({"vocab": {"k": 0, "?": 1}, "merges": [], "unk_token": "?", "fuse_unk": True}).tokenize("mnk") == [(1, "?", 0, 2), (0, "k", 2, 3)]
    assert WordLevel({"vocab": {"[UNK]": 5}}).tokenize("ü") == [(5, "[UNK]", 0, 2)]
    with pytest.raises(SpecError):
        WordLevel({"vocab": {}}).tokenize("q")
    u = Unigram({"vocab": [["<unk>", -9], ["t", -2], ["o", -2], ["to", -3], ["oto", -4.5]], "unk_id": 0})
    assert u.pieces("toto") == ["t", "oto"] or u.pieces("toto") == ["to", "to"]
    assert u.pieces("to!?to") == ["to", "!?", "to"]


def test_decoders():
    run = lambda kind, tokens, **more: decoder({"type": kind, **more})(tokens)
    assert "".join(run("WordPiece", ["re", "##do", "it"])) == "redo it"
    assert "".join(run("BPE", ["go</w>", "on</w>"])) == "go on"
    assert "".join(run("ByteFallback", ["<0xe2>", "<0x82>", "<0xAC>", "5"])) == "€5" and "".join(run("ByteFallback", ["<0xE2>", "<0x82>", "5"])) == "��5"
    assert run("CTC", "_ t t _ o _ o _".split(), pad_token="_") == list("too")
    assert run("Fuse", []) == [""] and run("Strip", ["xxa", "x", "ax"], content="x", start=1) == ["xa", "", "ax"]
    assert "".join(run("Metaspace", ["▁go", "▁on"])) == "go on"
    with pytest.raises(SpecError):
        decoder({"type": "BPE", "suffix": ""})


FORMS = [*({"type": t} for t in ("NFC", "NFKC", "NFD", "NFKD", "BertNormalizer", "Nmt", "Lowercase", "StripAccents", "ByteLevel", "Strip")), {"type": "BertNormalizer", "lowercase": False, "strip_accents": True}, None]
FORMS.append({"type": "Sequence", "normalizers": [{"type": "Prepend", "prepend": "x"}, {"type": "NFD"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": "e"}, {"type": "NFC"}]})
ODD = "aẹ́ ̀ÅÅ각가ﬁ①̈́क़\x07\t\xa0中İΣẛ\U0001d15e\U0001f600‍"


@settings(deadline=None)  # the first builds tables
@given(st.text(st.sampled_from(ODD) | st.characters(exclude_categories=["Cs"])))
def test_texts_as_a_whole_equal_aligned_ones(text):
    for spec in FORMS:
        assert text_normalizer(spec)(text) == normalizer(spec)(Aligned.of(text)).text, spec

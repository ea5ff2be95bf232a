"""Operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
import xxhash
from pyspark.sql import Row, functions as F

from glyphmill.llm import classify, common, language, neighbours, packing, private, quality, sentencepiece, simhash, wrappers

RNG = random.Random(7)
WORDS = [" ".join(RNG.choice("the of and in to river stone bright morning walked slowly under old bridge".split()) for _ in range(n)) for n in (3, 60, 400)]
TEXTS = [None, "", " \t\n", "a", "one two", *WORDS, WORDS[1] + " end", WORDS[1], "x " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "k", 1.0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, "k", None), (5, WORDS[0], "en", "k", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, score double").repartition(3)


def test_stratified(spark):
    rows = [(i, "hot" if i % 5 else "rare") for i in range(2000)] + [(3, "hot"), (None, "hot"), (9999, None)]
    df = spark.createDataFrame(rows, "key long, kind string").repartition(7)
    for bound in (1, 10, 500):
        got = sorted(common.stratified(df, "key", "kind", bound).collect(), key=str)
        digest = {(r["key"], r["kind"]): r["h"] for r in df.withColumn("h", F.xxhash64("key")).collect()}
        expected = []
        for kind in ("hot", "rare", None):
            own = sorted((r for r in rows if r[1] == kind), key=lambda r: (digest[r], r[0] is not None, r[0] or 0))
            expected += own[:bound]
        assert [tuple(r) for r in got] == sorted(expected, key=lambda r: str(spark_row(*r)))


def spark_row(key, kind):
    return Row(key=key, kind=kind)


def test_sentencepiece(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, known = sentencepiece.load(path), library.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["ids"] for r in sentencepiece.encode(docs, vocabulary).collect()}
    assert got[0] is None and all(got[i] == known.encode(t) for i, t in enumerate(TEXTS) if t is not None)
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(sentencepiece.encode(docs, vocabulary), vocabulary).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    codec = sentencepiece.Codec(vocabulary)
    odd = ["".join(RNG.choice("abcdehilnorst  \n▁éüß.,日😀") for _ in range(RNG.randint(1, 120))) for _ in range(200)] + ["internationalisation" * 40]
    assert all(np.frombuffer(codec.encode(t), "<i4").tolist() == known.encode(t) and codec.decode(codec.encode(t)) == known.decode(known.encode(t)) for t in odd)


def test_unigram_streams_like_whole():
    v = sentencepiece.Vocabulary(["<unk>", "a", "b", "ab", "aba", "▁", "bb"], [0.0, -2.0, -2.5, -3.0, -4.0, -1.0, -3.5], [2, 1, 1, 1, 1, 1, 1], 1)
    codec = sentencepiece.Codec(v)
    for _ in range(50):
        text = "".join(RNG.choice("ab") for _ in range(RNG.randint(1, 60)))
        best = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 3), end):
                if text[start:end] in codec.score:
                    s = best[start][0] + codec.score[text[start:end]]
                    if end not in best or s > best[end][0] + 1e-12:
                        best[end] = (s, best[start][1] + [text[start:end]])
        assert list(codec.pieces(text)) == best[len(text)][1]


@pytest.mark.parametrize("n", [0, 1, 400])
def test_neighbours(spark, n):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, 8))
    x[n // 2 :] = x[n // 2] if n else 0  # a large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("key") % 20 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = total = 0
    for q in range(0, n, 20):
        s = np.round(x @ x[q], 9)
        expected = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:20]
        hits, total = hits + len(set(expected) & set(found.get(q, []))), total + len(expected)
        assert len(found.get(q, [])) == len(expected)
    assert hits >= 0.9 * total


def test_language(spark, docs):
    base = [("en", "the river and the stone were bright in the morning"), ("de", "der fluss und die steine waren hell am morgen"), ("ru", "река и камни были светлыми утром")]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(base * 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labeller = language.Labeller(model)
    assert labeller.label(None)[0] == labeller.label("12 !?")[0] == "und" and labeller.label("камни утром")[0] == "ru"
    mixed = labeller.label(" ".join([base[0][1]] * 4 + [base[1][1]] * 3))
    assert mixed[0] == "en" and [s[2] for s in mixed[2]] == ["en", "de"]
    assert language.identify(docs, model, spans=True).count() == docs.count()
    empty = language.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}
    scores = np.random.default_rng(0).uniform(-6, 0, (200, 3))
    best = scores[0]
    for t in range(1, 200):
        best = np.maximum(best, best.max() - language.SWITCH) + scores[t]
    path = labeller.path(scores)
    assert np.isclose(scores[np.arange(200), path].sum() - language.SWITCH * np.count_nonzero(np.diff(path)), best.max())


def test_packing(spark, docs):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        file = f.read()
    rows = packing.pack(docs, file).collect()
    tokenizer = packing.Tokens(file).tokenizer
    length, last = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == length.get(r["sequence_id"], 0)
        length[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in length.values())
    for i, t in enumerate(TEXTS):
        if i == 5:
            continue  # comes twice
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_classifiers(spark, docs):
    clean = [" ".join("".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 7))) for _ in range(60)) for _ in range(150)]
    noisy = [t.replace(" ", "### ") for t in clean[:60]]
    model = classify.train_subwords([(1, t) for t in clean[:90]] + [(0, t) for t in noisy[:40]])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(clean[90:] + noisy[40:])], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in classify.score_quality(rows, model).collect()}
    assert all(got[i] == 1 for i in range(60)) and all(got[i] == 0 for i in range(60, 80))
    bad = [t + " idiot" for t in clean[:60]]
    marks = classify.train_marks(bad[:40], clean[60:] + bad[40:45], 0.1)
    rows = spark.createDataFrame([(0, "walked IDIOT!! home"), (1, "walked home"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in classify.score_marks(rows, marks).collect()} == {0: 1, 1: 0, 2: 0}
    for scored in (classify.score_quality(docs, model), classify.score_marks(docs, marks), classify.score_marks(docs, classify.train_marks([], [], 0.1))):
        assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == docs.count()


def test_pii(spark, docs):
    p = private.Pseudonyms(b"a key")
    text = "a.b7@mail.example.com 4111 1111 1111 1111 4111111111111112 +1 (017) 555-7713 10.20.30.40 999.1.1.1 1999-02-28 1999-02-31 DE89370400440532013000 078-05-1120 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" version 4.0."
    new, found = p.replace(text)
    assert len(new) == len(text) and sorted(f[0] for f in found) == sorted(["email", "card", "phone", "ipv4", "date", "iban", "ssn", "secret"])
    assert "4111111111111112" in new and "999.1.1.1" in new and "1999-02-31" in new and "version 4.0." in new
    assert private.luhn(re.sub(" ", "", re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0])) and private._mod97(re.search(r"DE\d{20}", new)[0]) == 1
    assert p.replace(text) == (new, found) and private.Pseudonyms(b"other").replace(text)[0] != new
    for n in (1, 2, 10, 97, 1000):
        assert sorted(p.permute(i, n, "t") for i in range(n)) == list(range(n))
    out = private.pseudonymise(docs, b"a key")
    assert out.columns[:5] == docs.columns and out.count() == docs.count()


def test_quality_rules(spark, docs):
    lines = "same line of words\n" * 20 + "other"
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, lines), (51, "WORD### " * 80), (52, WORDS[2])], "doc_id long, text string"))
    for r in quality.judge(more.withColumn("kept", F.lit("clash"))).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {g: grams.count(g) for g in set(grams)} if len(grams) < 2000 else {g: 2 for g in set(grams)}
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        rows = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), len(rows) - len(set(rows)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and (not r["kept"] or not r["base_failed"])
    assert quality.judge(docs.where("false")).count() == 0


def test_wrappers(spark):
    page = lambda t, body: f"<html><head><title>x</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul></nav><div class='top'>Site name</div>{body.format(t)}<div class='comments'>c</div><footer>&copy; f</footer></body></html>"
    article = "<article><h1>T{0}</h1><p><b>one &amp;  two {0}<br>x<p>three&nbsp;four</p></article>"
    plain = "<div class='box'><h2>Head {0}</h2><p>body text of page {0} that goes on</p></div>"
    rows = [(i, "http://h.example/a", page(i, article)) for i in range(4)] + [(10 + i, "http://g.example:80/b", page(i, plain)) for i in range(5)] + [(90, None, None), (91, "x", ""), (92, "http://g.example/c", "<p>cut <b")]
    got = {r["page_id"]: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2]["text"] == "T2\none & two 2 x\nthree four" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[12]["text"] == "Head 2\nbody text of page 2 that goes on" and got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "cut"
    found = wrappers.infer([page(i, plain) for i in range(4)])
    assert "Site name" in found["template"] and ")+" in found["regex"]


def test_simhash(spark, docs):
    base = [RNG.getrandbits(64) for _ in range(20)]
    fps = {b ^ (1 << RNG.randrange(64)) ^ (RNG.getrandbits(1) << RNG.randrange(64)) for b in base for _ in range(60)} | set(base)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    found = {(r["node"], r["root"]) for r in simhash.components(simhash.links(spark.createDataFrame([(f, i) for i, f in rows], "fp long, rep long"))).collect()}
    u = np.array(sorted(fps), np.uint64)
    root = list(range(len(u)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(u ^ x) <= 2) for x in u]
    while changed:
        new = [min(root[j] for j in n) for n in near]
        changed, root = new != root, new
    assert found == {(i, root[i]) for i in range(len(u)) if root[i] != i}
    for r in simhash.near_duplicates(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = (r["text"] or "").lower().split()
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert int(r["fingerprint"], 16) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}


def test_pipeline(spark, sf):
    """Each stage by other means: labels one by one, rules in DuckDB, near copies of five words by all pairs, pseudonyms and ids text by text."""
    import duckdb

    import corpus_pipeline
    from tests.llm.test_advice import _brute

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labeller = language.Labeller(language.fit(documents, learns=language.learnable()))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = {i: labeller.label(t) for i, t in texts.items()}
    kept = {i for i, (lang, score, *_) in found.items() if lang != "und" and score >= corpus_pipeline.LEAST_SHARE}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    kept &= {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    first = {i for _, i in _brute([(i, texts[i]) for i in sorted(kept)])}
    spark.conf.set(private.KEY_SETTING, "of the test")
    try:
        rows = corpus_pipeline.run(spark, sf).collect()
    finally:
        spark.conf.unset(private.KEY_SETTING)
    assert {r["doc_id"] for r in rows} == first and len(first) < len(texts)
    pseudonyms, tokenizer = private.Pseudonyms(b"of the test"), packing.Tokens(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()).tokenizer
    for i in first:
        ids = np.array([*tokenizer.encode(pseudonyms.replace(texts[i])[0], add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_streaming_window_is_bounded(monkeypatch):
    codec = sentencepiece.Codec(sentencepiece.load(public_tokenizers.path("piece_bpe_32k.model")))
    windows, path = [], sentencepiece.Codec._path
    monkeypatch.setattr(sentencepiece.Codec, "_path", staticmethod(lambda came, last, base, end: windows.append((len(came), end - base)) or path(came, last, base, end)))
    text = "".join(RNG.choices("abcdefghilmnoprstu", k=20_000))
    parts = list(codec.pieces(text))
    assert "".join(parts) == text and len(windows) > 500 and max(w for w, _ in windows) <= 4 * codec.longest and sum(n for _, n in windows) == len(text)
    windows.clear()
    codec.encode("a word or two")
    assert windows  # words are searched the same way

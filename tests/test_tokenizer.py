import json

import pyarrow as pa
import pytest

from glyphmill.operators import frames
from glyphmill.operators.chat import Template, TemplateError
from glyphmill.operators.frames import TextPipeline, observed
from glyphmill.operators.stages import SpecError
from glyphmill.operators.tokenizer import Encoding, Spec, Tokenizer
from glyphmill.sources import spec as sources

BASE = {"model": {"type": "WordLevel", "vocab": {"hello": 0, "world": 1}, "unk_token": "hello"}, "pre_tokenizer": {"type": "Whitespace"}}
ADDED = [{"content": c, "special": s} for c, s in (("<bos>", True), ("<eos>", True), ("<start>", False), ("<end>", False))]


def test_encoding_algebra():
    a = Encoding([0], [0], ["Hello"], [0], [(0, 5)], [0], [1])
    a.merge_with(Encoding([1], [0], ["World"], [0], [(0, 5)], [0], [1]), True)
    assert a.offsets == [(0, 5), (5, 10)]
    a.pad(4)
    assert a.attention_mask == [1, 1, 0, 0]
    a.truncate(3, left=True)
    assert a.ids == [1, 0, 0] and len({len(getattr(a, n)) for n in Encoding.ARRAYS}) == 1


def test_added_tokens_and_processors():
    t = Tokenizer(Spec.of(BASE | {"added_tokens": ADDED}))
    assert t.encode("world<start>hello<bos>").ids == [1, 4, 0, 2] and t.decode([2, 0, 1, 99]) == "hello world"
    bert = Tokenizer(Spec.of(BASE | {"post_processor": {"type": "BertProcessing", "cls": ["[CLS]", 101], "sep": ["[SEP]", 102]}}))
    assert bert.encode("hello world").ids == [101, 0, 1, 102] and bert.encode_pair("hello", "world").type_ids == [0, 0, 0, 1, 1]
    cut = Tokenizer(Spec.of(BASE | {"truncation": {"max_length": 1}, "padding": {"pad_to_multiple_of": 4}}))
    assert cut.encode("hello world").ids == [0, 0, 0, 0]


def test_spec_round_trip_and_errors(spark, tmp_path):
    s = Spec.of(BASE | {"added_tokens": ADDED})
    assert Spec.parse(s.to_json(True)) == s
    sources.save(s, str(tmp_path / "tokenizer.json"))
    assert sources.load(spark, str(tmp_path)) == s
    assert sources.vocabulary(spark, s).count() == 6
    for bad in ("{", "{}", json.dumps({"model": {"type": "Nope", "vocab": {}}})):
        with pytest.raises(SpecError):
            Spec.parse(bad)


def test_frames_and_sql(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z")], "id long, text string, ids string")
    p = TextPipeline(Spec.of(BASE))
    got = {r["id"]: r for r in p.encode(df).collect()}
    assert got[1]["encoding"]["ids"] == [0, 1] and got[2]["encoding"] is None and got[3]["encoding"]["ids"] == []
    p.register_sql(spark, "t_")
    assert spark.sql("select t_count_tokens('hello world') n, t_decode(array(0, 1)) d").first() == (2, "hello world")
    assert {(r["id"], r["n"]) for r in p.token_frequencies(df.where("text is not null")).collect()} == {(0, 1), (1, 1)}


def test_errors_of_rows(spark):
    strict = Spec.of({"model": {"type": "WordLevel", "vocab": {"a": 0, "b": 1}, "unk_token": "none"}, "pre_tokenizer": {"type": "WhitespaceSplit"}})
    df = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, None), (4, "")], "id int, text string").repartition(2)
    with pytest.raises(Exception, match="no unknown token"):
        TextPipeline(strict).ids(df).collect()
    found, counts = observed(TextPipeline(strict, errors="permissive").ids(df), "ids")
    got = {r["id"]: r["ids"] for r in found.collect()}
    assert got[1] == ([0, 1], None) and got[2]["value"] is None and "no unknown token" in got[2]["error"] and got[3] is None and got[4] == ([], None)
    assert counts.get == {"rows": 4, "errors": 1}
    assert {r["id"]: r["n"] and r["n"]["value"] for r in TextPipeline(strict, errors="permissive").count_tokens(df, out="n").collect()} == {1: 2, 2: None, 3: None, 4: 0}
    with pytest.raises(ValueError):
        TextPipeline(strict, errors="ignore")


def test_long_texts_come_in_portions(monkeypatch):
    monkeypatch.setattr(frames, "PORTION", 1000)
    batch = pa.RecordBatch.from_pydict({"id": list(range(100)), "t": ["x" * 200] * 100})
    parts = list(frames._portions(batch, [1]))
    assert sum(p.num_rows for p in parts) == 100 and max(p.num_rows for p in parts) <= 5
    assert list(frames._portions(batch.slice(0, 0), [1])) == [] and len(list(frames._portions(batch, [0]))) == 1


def test_streaming(spark, tmp_path):
    from glyphmill.streaming.encode import encode_stream

    spark.createDataFrame([("hello world",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = encode_stream(stream, Spec.of(BASE)).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("streamed").first()["ids"] == [0, 1]


def render(source, *messages, **args):
    return Template(source).render(list(messages), **args)


def test_templates():
    assert render("{% set row = ['x', 'y', 'z'] %}{% for c in row[::-1] %}{{ c }}{% endfor %}-{{ row[1] }}-{{ row[-1:]|length }}-{% for c in row[1:] %}{{ c }}{% endfor %}") == "zyx-y-1-yz"
    assert render("{% macro times(word, n) %}{% if n > 0 %}{{ word }}{{ times(word, n - 1) }}{% endif %}{% endmacro %}<{{ times('ab', 3) }}>") == "<ababab>"
    assert render("{% for k, v in {'B':1,'a':2,'C':3}|dictsort %}{{ k }};{% endfor %}") == "a;B;C;"
    assert render("{{ '}}' }}{{ none }}{{ true }}{{ x }}{{ 7 // -2 }}") == "}}True-3"
    for bad, why in (("{% macro f() %}{{ f() }}{% endmacro %}{{ f() }}", "recursion too deep"), ("{{ raise_exception('no') }}", "no"), ("{% break %}", "Unknown block tag")):
        with pytest.raises(TemplateError, match=why):
            render(bad)
    with pytest.raises(TemplateError, match="reserved"):
        Template("").render([], args={"messages": 1})

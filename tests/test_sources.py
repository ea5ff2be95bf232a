"""Specs as files and tables, and the converter's command."""

import json

import pytest

from glyphmill.operators.stages import SpecError
from glyphmill.operators.tokenizer import Spec, Tokenizer
from glyphmill.sources import convert, spec as sources, tables

HEAD = '#{"scheme": "bpe", "total": %d}'
ROWS = ["0\t<unk>\t-1\t0", "1\t▁\t0\t9", "2\tn\t0\t5", "3\to\t0\t5", "4\tno▁\t1\t4\t2 3 1"]
BASE = Spec.of({"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": [{"content": "<s>", "special": True}, {"content": "b"}]})


def _model(rows, **more):
    return "\n".join([HEAD % len(rows) if not more else "#" + json.dumps(more), *rows]) + "\n"


def test_converted_models():
    t = Tokenizer(sources.from_nlcodec(_model(ROWS)))
    assert t.ids(" no  on ") == [4, 3, 2, 1] and t.decode([4, 3, 2, 1]) == "no on"
    twice = sources.from_nlcodec(_model([*ROWS, "5\tno▁\t1\t1"]))
    t = Tokenizer(twice)
    assert t.ids("no") == [4] and t.decode([5, 4]) == "no no" and len(twice.model["vocab"]) == 6
    assert sources.from_nlcodec(_model(ROWS, max_level=1)).model["vocab"]["no▁"] == 4


@pytest.mark.parametrize("text", ["", "0\t<unk>\t0\t1", "#{bad", _model(ROWS, scheme="char"), _model(ROWS, scheme="bpe", total=9), _model([*ROWS, "7\tx\t0\t1"]), _model([*ROWS, "5\tx\t0"]), _model([*ROWS, "5\tx\t0\t1\t5"]), _model(ROWS[:1]), _model([ROWS[1].replace("1", "0", 1)]), _model(ROWS, levels=2), HEAD % 0])
def test_what_is_no_model(text):
    with pytest.raises(SpecError):
        sources.from_nlcodec(text)


def test_command(tmp_path, capsys):
    model, out = tmp_path / "m.model", tmp_path / "new" / "tokenizer.json"
    model.write_text(_model([*ROWS, "5\tn\t0\t1"]), encoding="utf-8")
    assert convert.main([str(model), str(out), "--pretty"]) == 0 and "1 of them" in capsys.readouterr().err
    assert Spec.parse(out.read_text(encoding="utf-8")).model["vocab"]["no▁"] == 4 and [p.name for p in out.parent.iterdir()] == ["tokenizer.json"]
    assert convert.main([str(model)]) == 0 and json.loads(capsys.readouterr().out) == json.loads(out.read_text(encoding="utf-8"))
    for bad in ([str(model), str(model)], [str(tmp_path / "none")], [str(model), "--unk-token", "[UNK]"]):
        assert convert.main(bad) == 2 and "error" in capsys.readouterr().err
    assert model.read_text(encoding="utf-8").startswith("#{")


def test_tables(spark, tmp_path):
    spark.dataSource.register(tables.TokenizerSource)
    sources.save(BASE, str(tmp_path / "tokenizer.json"))
    read = lambda table: sorted(map(tuple, spark.read.format("tokenizer").option("table", table).load(str(tmp_path)).collect()))
    assert read("vocabulary") == [("a", 0), ("ab", 2), ("b", 1)] and read("merges") == [(0, "a", "b")] and read("added") == [(1, "b", False), (3, "<s>", True)]
    rows = [(t, i) for i, t in enumerate(["a", "b", "ab", *(f"word{k}" for k in range(500))])]
    df = spark.createDataFrame(rows, "token string, id int").repartition(7)
    df.write.format("tokenizer").mode("overwrite").option("base", str(tmp_path / "tokenizer.json")).save(str(tmp_path / "more.json"))
    assert Tokenizer(sources.load(spark, str(tmp_path / "more.json"))).model.ids == dict(rows)
    before = (tmp_path / "more.json").read_text(encoding="utf-8")
    for bad in (df.unionByName(df.limit(1)), spark.createDataFrame([(None, 1)], "token string, id int")):
        with pytest.raises(Exception, match="twice|null"):
            bad.write.format("tokenizer").mode("overwrite").save(str(tmp_path / "more.json"))
    assert (tmp_path / "more.json").read_text(encoding="utf-8") == before
    with pytest.raises(Exception, match="no table"):
        spark.read.format("tokenizer").option("table", "nope").load(str(tmp_path)).collect()

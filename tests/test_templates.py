"""Templates as Column expressions against the interpreter, over arrays of structs and over JSON text."""

import json

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import templates
from glyphmill.operators.chat import Template, TemplateError
from glyphmill.operators.frames import TextPipeline
from glyphmill.operators.tokenizer import Spec
from glyphmill.sources.spec import Config

PLAIN = [
    [], [{"role": "user", "content": "x,y"}], [{"role": "assistant", "content": "a"}, {"role": "assistant", "content": "b"}],
    [{"role": "system", "content": "Be  brief. "}, {"role": "user", "content": " Hi\n"}, {"role": "assistant", "content": "Ünï"}, {"role": "user", "content": ""}],
]
MIXED = [
    *PLAIN, [{"role": "tool", "content": 7, "n": -2, "x": 0.1}],
    [{"role": "user", "content": [{"type": "text", "text": "Hi "}, {"type": "image"}, {"type": "text", "text": "there"}]}, {"role": "assistant", "content": None, "tool_calls": [{"name": "f", "arguments": {"b": 1, "a": [1.5, True, None, "ü\n"]}}], "n": 3, "x": 2.50, "big": 1234567.5}],
]
# over messages of texts
TEXTS = [
    "{% for m in messages %}{{ '<|' + m.role + '|>\n' + m['content'] + '<|end|>\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|assistant|>\n' }}{% endif %}",
    "{% for m in messages %}{{ loop.index }}/{{ loop.length }} {{ m.role|upper }}: {{ m.content|trim }}{% if not loop.last %}{{ ' ~ ' }}{% endif %}{% endfor %}",
    "{% set ns = namespace(n=0, last='') %}{% for m in messages %}{% if m.role == 'user' %}{% set ns.n = ns.n + 1 %}{% set ns.last = m.content %}{% endif %}[{{ ns.n }}]{{ m.content }}{% endfor %}|{{ ns.n }}|{{ ns.last }}",
    "{% if messages[0].role == 'system' %}{% set rest = messages[1:] %}{% set sys = messages[0].content|trim %}{% else %}{% set rest = messages %}{% set sys = '' %}{% endif %}{% for m in rest %}{% if loop.index0 == 0 and sys %}<<{{ sys }}>>{% endif %}{{ m.content }};{% endfor %}",
    "{% for m in messages[::-1] %}{{ m.role }}{% if loop.previtem is defined %}<{{ loop.previtem.role }}{% endif %}{% if loop.nextitem %}>{{ loop.nextitem.role }}{% endif %};{% endfor %}",
    "{% for m in messages %}{% if m.role == 'system' %}{% set s = m.content %}{% elif m.role == 'user' %}{{ s }}+{{ m.content }}|{% set s = '' %}{% endif %}{% endfor %}",
    "{% macro tag(name, body='-') %}<{{ name }}>{{ body }}</{{ name }}>{% endmacro %}{% for m in messages %}{{ tag(m.role, m.content) }}{{ tag('x') }}{% endfor %}",
    "{{ messages|length }} {{ messages|map(attribute='role')|join(', ') }} {{ (messages|selectattr('role', 'eq', 'user')|list)|length }} {{ 'system' in (messages|map(attribute='role')|list) }}",
    "{% for m in messages %}{% set c = m.content %}{% if c is string and c %}{{ c.strip().split(' ')[0] }}{% else %}none{% endif %}{{ ',' if not loop.last }}{% endfor %}",
    "{% for r in ['user', 'assistant'] %}{{ r }}:{% for m in messages %}{% if m.role == r %}{{ loop.index0 }} {% endif %}{% endfor %}{% endfor %}",
    "{% for m in messages %}{{ m.content|replace('b','B')|tojson }}{{ m.content|length }}{{ m.content.startswith('x') }}{{ m.name is defined }}{{ m.name|default('anon') }}{% endfor %}",
    "{% for m in messages %}{{ loop.index % 2 == 0 }}{{ loop.index * 2 - 1 }}{{ loop.index / 2 }} {{ loop.revindex }}{{ m.role ~ loop.index }}{{ m.content|title }} {{ m.role in ['user','x'] }}{% endfor %}",
    "{% macro rep(w, n) %}{% if n > 0 %}{{ w }}{{ rep(w, n - 1) }}{% endif %}{% endmacro %}{% for m in messages %}{{ rep(m.role, 2) }}{% for i in range(loop.index) %}{{ i }}{% endfor %};{% endfor %}",
    "{% set ns = namespace(prev=none) %}{% for m in messages %}{% if ns.prev != m.role %}{% if ns.prev is not none %}</{{ ns.prev }}>{% endif %}<{{ m.role }}>{% endif %}{{ m.content }}{% set ns.prev = m.role %}{% endfor %}{% if ns.prev %}</{{ ns.prev }}>{% endif %}",
    "{% set x %}{% for m in messages %}{{ m.role[0] }}{{ m.role|first }}{% endfor %}{% endset %}{{ x|upper }}{{ messages[-1].role }}{{ messages|last }}{{ messages }}",
    "{% for m in messages %}{{ 'u' if m.role == 'user' else m.role }}{{ m.content or 'empty' }}{{ m.content and 'full' }}{{ not m.content }}{{ m.content < 'c' }}{{ {'user': 1, 'system': 2}[m.role] }}{% endfor %}",
]
# over messages of anything
ANYTHING = [
    "{% for m in messages %}{% if m.content is string %}{{ m.content|trim }}{% elif m.content is iterable %}{% for c in m.content %}{% if c.type == 'image' %}<img>{% elif c['type'] == 'text' %}{{ c['text']|trim }}{% endif %}{% endfor %}{% else %}({{ m.content is none }}{{ m.content is number }}){% endif %}|{% endfor %}",
    "{% for m in messages %}{% if m.tool_calls is defined and m.tool_calls %}{% for t in m.tool_calls %}{{ t.name }}({% for k, v in t.arguments|items %}{{ k }}={{ v|tojson }}{% if not loop.last %}, {% endif %}{% endfor %}){% endfor %}{% endif %}{{ m.n }}{{ m.x }}{{ m.n is number }}{{ m.big }}{{ m.x * 2 if m.x is number else 'no' }};{% endfor %}",
    "{% for m in messages %}{% for k, v in m|dictsort %}{{ k }}:{{ v is mapping }}{{ v is sequence }}{{ v is integer }}{{ v is float }}{{ v is string }},{% endfor %}{{ m.n is even }}{{ m.n is odd }}{{ m.content == 7 }}{{ m.content == none }}{{ m.n == -2 }}{{ m.get('role', 'x') }}{{ m.get('nope', 'x') }}\n{% endfor %}{{ messages|tojson }}",
    "{% set ns = namespace(first=true, text='') %}{% for m in messages %}{% set t = m.content if m.content is string else '' %}{% if ns.first %}{% set ns.first = false %}{% set ns.text = t %}{% else %}{% set ns.text = ns.text ~ '/' ~ t %}{% endif %}{% endfor %}{{ ns.text }}{{ ns.first }}",
    "{% macro show(x) %}{% if x is string %}{{ x }}{% else %}{% for p in x %}{{ p.text }}{% endfor %}{% endif %}{% endmacro %}{% for m in messages %}{{ show(m.content) }};{% endfor %}",
    "{% for m in messages %}{{ 'content' in m }}{{ 'Hi' in m.content }}{{ m.content|length }}{{ m|length }}{{ m.keys()|join(',') }}{% endfor %}",
]


def _rendered(df, sources, kind):
    columns = [templates.render(t, F.col("m"), kind).alias(f"t{k}") for k, t in enumerate(sources)]
    return [list(r)[1:] for r in df.select("id", *columns).orderBy("id").collect()]


def _parsed(spark, conversations):
    rows = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(conversations)], "id int, messages string")
    return rows.select("id", "messages", F.parse_json("messages").alias("m"))


@pytest.mark.parametrize("at", range(0, len(TEXTS), 4))
def test_texts_equal_the_interpreter(spark, at):
    sources = TEXTS[at : at + 4]
    expected = [[Template(t).render(c) for t in sources] for c in PLAIN]
    parsed = _parsed(spark, PLAIN)
    assert _rendered(parsed, sources, templates.ANY) == expected
    typed = parsed.select("id", F.from_json("messages", "array<struct<role:string,content:string,name:string>>").alias("m"))
    assert _rendered(typed, sources, typed.schema["m"].dataType) == expected


@pytest.mark.parametrize("at", range(0, len(ANYTHING), 2))
def test_values_of_any_type_equal_the_interpreter(spark, at):
    sources = ANYTHING[at : at + 2]
    assert _rendered(_parsed(spark, MIXED), sources, templates.ANY) == [[Template(t).render(c) for t in sources] for c in MIXED]


def test_what_the_template_alone_decides_is_no_expression(spark):
    source = "{% set names = {'de': 'German', 'en': 'English'} %}{% macro say(k) %}{{ names[k]|upper }}{% endmacro %}{% for k in ['en', 'de'] %}{{ loop.index }}{{ say(k) }}{% if k == 'de' %}!{% endif %}{% endfor %}{% for i in range(3) %}{{ i * i }}{% endfor %}"
    df = templates.apply_chat(_parsed(spark, PLAIN), source)
    assert {r["prompt"] for r in df.collect()} == {Template(source).render([])} == {"1ENGLISH2GERMAN!014"}
    assert "transform" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_no_python_in_the_plan(spark):
    df = templates.apply_chat(_parsed(spark, PLAIN), TEXTS[2])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "aggregate" in plan


def test_arguments_and_other_columns(spark):
    rows = [(1, None, "own"), (2, "[]", "own"), (3, '[{"role": "user", "content": "Hi"}]', "own")]
    df = spark.createDataFrame(rows, "id int, messages string, prompt string").withColumn("generate", F.col("id") == 3)
    source = "{{ bos_token }}{{ tools|length }}{% for m in messages %}{{ m.content }}{% endfor %}{% if add_generation_prompt %}>{% endif %}{{ eos_token }}"
    got = templates.apply_chat(df, source, add_generation_prompt=F.col("generate"), bos="<s>", eos="</s>", args={"tools": [1, 2]})
    assert got.columns == ["id", "messages", "generate", "prompt"] and [r["prompt"] for r in got.orderBy("id").collect()] == [None, "<s>2</s>", "<s>2Hi></s>"]
    assert templates.apply_chat(df.where("false"), source, args={"tools": []}).count() == 0


def test_errors(spark):
    df = _parsed(spark, PLAIN)
    for bad, why in (("{% macro f(x) %}{{ f(x) }}{% endmacro %}{% for m in messages %}{{ f(m) }}{% endfor %}", "recursion"), ("{% break %}", "Unknown block tag"), ("{{ nope() }}", "unknown function"), ("{{ x is nope }}", "unknown test"), ("{{ {messages[0].role: 1} }}", "constant keys")):
        with pytest.raises(TemplateError, match=why):
            templates.apply_chat(df, bad)
    with pytest.raises(TemplateError, match="reserved"):
        templates.apply_chat(df, "", args={"messages": 1})
    checked = "{% for m in messages %}{% if m.role == 'tool' %}{{ raise_exception('a role ' 'too many: ' + m.role) }}{% endif %}{{ m.role }}{% endfor %}"
    assert [r["prompt"] for r in templates.apply_chat(df, checked).orderBy("id").collect()] == [Template(checked).render(c) for c in PLAIN]
    with pytest.raises(Exception, match="a role too many: tool"):
        templates.apply_chat(_parsed(spark, MIXED), checked).collect()


def test_encode_chat_by_name(spark):
    config = Config.parse(json.dumps({"bos_token": "<s>", "chat_template": [{"name": "default", "template": "{{ bos_token }}{% for m in messages %} {{ m.content }}{% endfor %}"}, {"name": "roles", "template": "{% for m in messages %}{{ m.role }} {% endfor %}"}]}))
    p = TextPipeline(Spec.of({"model": {"type": "WordLevel", "vocab": {"[UNK]": 0, "<s>": 1, "a": 2, "b": 3, "assistant": 4}}, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
    df = spark.createDataFrame([(json.dumps(PLAIN[2]),)], "messages string")
    assert p.encode_chat(df, config).first()["encoding"]["ids"] == [1, 2, 3] and p.encode_chat(df, config, name="roles").first()["encoding"]["ids"] == [4, 4]
    with pytest.raises(KeyError):
        p.encode_chat(df, config, name="none")

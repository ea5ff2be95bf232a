"""The automaton against regular expressions, pattern by pattern."""

import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from glyphmill.llm import globs

CHARS = "ab./?"


def _rule(rule):
    host, path = rule.split("/", 1)
    return re.compile(f"(?:[^/]*\\.)?{re.escape(host)}/{re.escape(path)}.*", re.S)


def _glob(glob):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.S)


def _brute(rules, patterns, url):
    fits = [k for k, (_, r) in enumerate(rules) if _rule(r).fullmatch(url)]
    if fits:
        best = min(fits, key=lambda k: (-len(rules[k][1]), k))
        return rules[best][1], rules[best][0]
    return None, next((v for v, g in patterns if _glob(g).fullmatch(url)), "allow")


def _said(automaton, urls):
    return [(None, "allow") if k < 0 else (automaton.names[k], automaton.verdicts[k]) for k in automaton.match(urls)]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.builds("{}/{}".format, st.text("ab.é", min_size=1, max_size=4), st.text("ab/.", max_size=20))), max_size=8),
    st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.text("ab./*?é", max_size=30)), max_size=8),
    st.lists(st.text("ab./é𝔸", max_size=24), max_size=12),
)
def test_equals_regular_expressions(rules, patterns, urls):
    # rules and patterns of several words of 64 states
    urls = urls + [r.replace("*", "ab").replace("?", "b") for _, r in [*rules, *patterns]] + ["a." + r + "b" for _, r in rules]
    assert _said(globs.Automaton(rules, patterns), urls) == [_brute(rules, patterns, u) for u in urls]


def test_many_rules():
    rules = [("block" if k % 3 else "allow", f"host{k}.example/{'x' * (k % 90)}") for k in range(400)]
    automaton = globs.Automaton(rules, [("block", "*/q?r*")])
    urls = [f"www.host{k}.example/{'x' * (k % 100)}" for k in range(400)] + ["a/qxr", "a/qr", ""]
    assert automaton.words > 100 and _said(automaton, urls) == [_brute(rules, [("block", "*/q?r*")], u) for u in urls]


def test_long_urls_take_linear_time():
    began = time.perf_counter()
    urls = ["ads." + "a" * 1_000_000, "x/" + "/login" * 100_000, "x." * 300_000 + "net/", "x" * 1_000_000 + ".exe", *["x" * 1000 + ".exe"] * 500]
    assert _said(globs.Automaton(), urls) == [(None, "block"), (None, "block"), ("net/", "block"), *[(None, "block")] * 501]
    assert time.perf_counter() - began < 20


def test_rules_need_a_path():
    with pytest.raises(ValueError):
        globs.Automaton([("block", "net")])


def test_rows(spark):
    urls = [
        ("http://Example.NET/en/x?y=/a", "example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/EN/x", "example.net", "/EN/x", "net/", "block"),
        ("https://a.b.org/fr/#/x", "a.b.org", "/fr/", "org/fr/", "allow"), ("https://a.b.org/f", "a.b.org", "/f", None, "allow"), ("x://notexample.com/de/a", "notexample.com", "/de/a", None, "allow"),
        ("x://example.com/de/a://b.net/", "example.com", "/de/a://b.net/", "example.com/de/", "block"), ("x://net", "net", "", None, "allow"), ("x://net?/", "net", "", None, "allow"), ("x://.net/", ".net", "/", "net/", "block"),
        ("net/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x://", "", "", None, "allow"), ("x:///de/", "", "/de/", None, "allow"), ("x://h/a.exe?z", "h", "/a.exe", None, "block"),
        ("x://ÄÖ.org/fr/", "ÄÖ.org", "/fr/", "org/fr/", "allow"), ("x://h\n.net/\n", "h\n.net", "/\n", "net/", "block"), ("x://foo.org/a.net/b", "foo.org", "/a.net/b", None, "allow"),
    ]
    urls += urls[:2]
    df = spark.createDataFrame([(k, u[0], "own", 5) for k, u in enumerate(urls)], "page_id long, url string, verdict string, n int")
    got = globs.judge(df).orderBy("page_id").collect()
    assert [tuple(r[c] for c in ("url", *globs.OWN)) for r in got] == urls and all(r["n"] == 5 for r in got)
    assert globs.judge(df.where("false")).count() == 0 and globs.judge(df).columns == ["page_id", "url", "n", *globs.OWN]

"""Wrappers against hand-made truth, on pages that have neither <article> nor <main>."""

import random
import time

import pandas as pd
import pytest

from glyphmill.llm import wrappers

RNG = random.Random(11)
WORDS = "stone river bright morning walked slowly under old bridge field cloud window".split()


def _some(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def _page(i, long=True):
    """A page of a template without telling names, and its main text."""
    head, body = f"Title {i} {_some(3)}", [_some(RNG.randint(30, 60) if long else 2) for _ in range(RNG.randint(1, 4) if long else 1)]
    rows = "".join(f"<div><a href='/{k}'>{_some(2)}</a></div>" for k in range(RNG.randint(3, 9)))
    extra = f"<table><tr><td>{_some(3)}<td>{_some(2)}</table>" if i % 3 == 0 else ""
    html = (
        f"<html><body><div class='x1'>{rows}</div><div class='x2'>Our site since 1999 &amp; on</div><div class='x3'><h2>{head}</h2><p>This text is on every page of ours.</p>"
        f"<div class='y'>{''.join(f'<p>{b}' for b in body)}{extra}</div></div><div class='x4'>Terms, imprint and contact of this company, which stand below every page</div></body></html>"
    )
    table = [t for t in extra.replace("</table>", "").replace("<table><tr>", "").split("<td>") if t]
    return html, "\n".join([*body, *table])


def test_pages_without_telling_names():
    pages = [_page(i, long=i % 5 > 0) for i in range(40)]
    found = wrappers.Wrapper(wrappers.aligned([wrappers.parse(h)[0] for h, _ in pages]))
    texts = [wrappers.extract(h, found) for h, _ in pages]
    assert texts == [t for _, t in pages]
    # what a page alone says isn't enough: the template's texts outweigh short articles
    alone = [wrappers.extract(h, None) for h, _ in pages]
    assert sum(a != t for a, (_, t) in zip(alone, pages)) >= 8
    spelt = wrappers.infer([h for h, _ in pages])
    assert spelt["region"] == ["div.x3", "div.y"] and "Our site since 1999 & on" in spelt["template"] and "This text is on every page of ours." in spelt["template"]
    assert "( <div <a" not in spelt["regex"] and "( <div # >div )+" in spelt["regex"] and ")?" in spelt["regex"] and "( <p # >p )+" in spelt["regex"]


def test_two_templates_of_a_host():
    other = [f"<div class=z><div class=w><h3>{_some(2)}</h3><pre>{_some(80)}</pre></div><div class=v>Powered by us, all rights are reserved</div></div>" for _ in range(6)]
    pages = [_page(i) for i in range(30)]
    found = wrappers.Wrapper(wrappers.aligned([wrappers.parse(h)[0] for h in [*other, *(h for h, _ in pages)]]))
    assert [wrappers.extract(h, found) for h, _ in pages] == [t for _, t in pages]
    assert all("Powered" not in wrappers.extract(h, found) and wrappers.extract(h, found).count("\n") == 1 for h in other)


def test_order_is_of_no_effect():
    trees = lambda: [wrappers.parse(h)[0] for h in pages]
    pages = [_page(i)[0] for i in range(20)]
    first = wrappers.expression(wrappers.aligned(trees()), texts=True)
    RNG.shuffle(pages)
    assert wrappers.expression(wrappers.aligned(trees()), texts=True) == first
    assert wrappers.dumps(wrappers.loads(wrappers.dumps(wrappers.aligned(trees())))) == wrappers.dumps(wrappers.aligned(trees()))


def test_names_are_not_needed(sf, monkeypatch):
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    by_host = pages.assign(host=pages.url.str.extract(r"://([^/:?#]+)")[0]).groupby("host")["html"].apply(list)
    monkeypatch.setattr(wrappers, "NOISE_NAMES", frozenset())
    for sources in by_host:
        found = wrappers.Wrapper(wrappers.aligned([wrappers.parse(s)[0] for s in sources]))
        for s in sources:
            inside = wrappers.parse(s[s.index("<article>") + 9 : s.index("</article>")])[1]
            assert wrappers.extract(s, found) == "\n".join(x for x in map(wrappers.clean, inside) if x)


@pytest.mark.parametrize("source", ["<div>" * 30_000 + "deep", "<p>" * 30_000 + "wide", "<div><p>x</div>" * 30_000, "word " * 400_000, "<li><a href='x'>y" * 30_000])
def test_very_long_pages(source):
    began = time.perf_counter()
    text = wrappers.extract(source, None)
    assert text and time.perf_counter() - began < 10


def test_footer_behind_a_long_list():
    end = "<div class='last'>All of this is ours and stays so, whoever reads it</div>"
    pages = ["<div class=l>" + "".join(f"<div><a href=q>{_some(1)}</a></div>" for _ in range(900)) + f"</div><div class=b><p>{_some(50)}</p></div>" + end for _ in range(6)]
    assert "All of this is ours and stays so, whoever reads it" in wrappers.infer(pages)["template"]


def test_edge_rows(spark):
    rows = [(1, None, None, "a"), (2, "http://h/1", "", "b"), (3, "http://h/2", "<script>x</script>", "c"), (3, "http://h/2", "<script>x</script>", "c"), (4, "http://h/3", "<p>one</p>", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in wrappers.main_text(pages).collect()) == [(1, "", 0), (2, "", 0), (3, "", 0), (3, "", 0), (4, "one", 3)]
    assert wrappers.main_text(pages.where("false")).count() == 0
    same = spark.createDataFrame([(i, "http://k/1", "<div><p>one copy</p></div>") for i in range(5)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.main_text(same).collect()} == {"one copy"}


def test_join_instead_of_broadcast_and_parts(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    expected = sorted(map(tuple, wrappers.main_text(pages).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST", 0)
    monkeypatch.setattr(wrappers, "PART", 2)
    monkeypatch.setattr(wrappers.common, "HOT_ROWS", 2)
    assert sorted(map(tuple, wrappers.main_text(pages.repartition(7)).collect())) == expected

"""The audit against every order gone through document by document."""

import re
from fractions import Fraction
from itertools import permutations

from hypothesis import given, settings, strategies as st

from glyphmill.llm import interactions

ROWS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def _fails(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), copy]


def _brute(docs, labels):
    good, bad = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    seen = [(d, t or "", p or "") for d, t, p, *_ in docs]
    first = {}
    for d, t, _ in seen:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    rows = [(p, _fails(t, d is not None and d > first[t]), d is not None and d in good, d is not None and d in bad) for d, t, p in seen]
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations(range(5)):
            left = mine
            for step, i in enumerate(order, 1):
                gone = [r for r in left if r[1][i]]
                left = [r for r in left if not r[1][i]]
                failing = sum(r[1][i] for r in mine)
                alone = sum(r[1][i] and sum(r[1]) == 1 for r in mine)
                out[part, "".join("ABCDE"[k] for k in order), step] = [len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, i] = total.get((part, i), 0) + len(gone)
    return {k: (*v, total[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def _rows(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_equals_every_order(spark):
    prose = " ".join(f"w{k}" for k in range(120))
    docs = [
        (1, prose, "en", "a"), (2, prose, "en", "a"), (3, prose, "de", "a"), (3, prose, "de", "a"), (9, prose, None, "a"), (4, "SHOUT " * 150, "en", "b"), (5, "a & b", "en", "b"),
        (6, None, "en", "b"), (7, "", None, "b"), (None, prose, "en", "b"), (None, None, "en", None), (8, "w " * 100_000 + "#", "de", "c"), (10, "\u2003A\u00a0B", "de", "c"), (10, "SHOUT " * 150, "", "c"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, 0, 1), (5, None, 1), (5, 1, None), (6, 1, 0), (99, 1, 1), (None, 1, 1)]
    got = interactions.audit(spark.createDataFrame(docs, ROWS), spark.createDataFrame(labels, LABELS))
    assert _rows(got) == _brute(docs, labels)
    # names of columns that the audit makes itself don't clash
    clashing = spark.createDataFrame([(*d, 7, "x", True) for d in docs], ROWS + ", mask int, digest string, first boolean")
    assert _rows(interactions.audit(clashing, spark.createDataFrame(labels, LABELS))) == _brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], ROWS), spark.createDataFrame([], LABELS)
    assert interactions.audit(docs, labels).count() == 0
    one = [(1, "A", "en", "a")]
    assert _rows(interactions.audit(spark.createDataFrame(one, ROWS), labels)) == _brute(one, [])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=32, max_size=32))
def test_polynomial(counts):
    f = interactions.Removal(counts, 5)
    for corner in range(32):
        assert f.at(corner) == sum(c for m, c in enumerate(counts) if m & corner)
    for i in range(5):
        assert f.shapley(i) == sum((Fraction(c, m.bit_count()) for m, c in enumerate(counts) if m >> i & 1), Fraction(0))
    assert sum(f.shapley(i) for i in range(5)) == f.at(31)

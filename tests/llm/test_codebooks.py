"""Codes against plain loops over whole Python numbers."""

import hashlib
import math
import random

import pytest

from glyphmill.llm import codebooks

SCHEMA = "vec_id long, label int, embedding array<double>"


def _brute(rows, rounds=6):
    ok = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    ok = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(ok[0][2]) if ok else 0
    if not length or length % 8:
        return [(r[0], None, None, None, None) for r in ok]
    width, fit = length // 8, [r for r in ok if len(r[2]) == length]
    cut = lambda v: [[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(8)]
    books = [[cut(r[2])[p] for r in fit[:16]] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda e: (gap(books[p][e], v), e))
    for _ in range(rounds):
        took = [[[] for _ in books[p]] for p in range(8)]
        for r in fit:
            for p, v in enumerate(cut(r[2])):
                took[p][nearest(p, v)].append(v)
        books = [[[sum(c) // len(t) for c in zip(*t)] if t else e for e, t in zip(books[p], took[p])] for p in range(8)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for r in ok:
        at = [nearest(p, v) for p, v in enumerate(cut(r[2]))] if len(r[2]) == length else None
        error = sum(gap(books[p][e], v) for p, (e, v) in enumerate(zip(at, cut(r[2])))) if at else None
        out.append((r[0], "".join(f"{e:02x}" for e in at) if at else None, error, r[1]))
        if error is not None:
            total[r[1]] = total.get(r[1], 0) + error
    long = lambda x: x if x is not None and x < 1 << 63 else None
    return [(i, c, long(e), long(total.get(label)) if all(long(x[2]) is not None or x[2] is None for x in out if x[3] == label) else None, sha) for i, c, e, label in out]


def _got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codebooks.compress(df).collect()), key=str)


def _vectors(n, length=16, seed=1, scale=1.0):
    pick = random.Random(seed)
    return [(k * 3 % 101 if k < 101 else k * 3, pick.choice([None, 1, 2]), [pick.gauss(0, scale) for _ in range(length)]) for k in range(n)]


@pytest.mark.parametrize("rows", [_vectors(300), _vectors(5), _vectors(1), _vectors(40, 8), _vectors(30) * 3, [(k, 1, [0.25] * 16) for k in range(30)]], ids=["many", "few", "one", "narrow", "repeated", "equal"])
def test_equals_loops(spark, rows):
    assert _got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == sorted(_brute(rows), key=str)


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = _vectors(60) + [(1, 1, None), (2, None, [nan] * 16), (3, 1, [inf] * 16), (4, 1, [None] + [0.0] * 15), (None, 2, [0.5] * 16), (500, 1, [0.5] * 8), (501, None, []), (502, 3, [0.5] * 17)]
    df = spark.createDataFrame([(*r, "own", 9) for r in rows], SCHEMA + ", code string, __n int")
    assert _got(df.drop("__n")) == sorted(_brute(rows), key=str)
    none = spark.createDataFrame([(1, 1, [0.5] * 12), (2, None, [0.25] * 16)], SCHEMA)
    assert _got(none) == [(1, None, None, None, None), (2, None, None, None, None)]
    assert _got(df.where("false").select("vec_id", "label", "embedding")) == []


def test_large_numbers_are_exact(spark):
    rows = _vectors(60, scale=1e12) + [(1000, 2, [1e300] * 16), (1001, 2, [-1e300] * 16)]
    assert _got(spark.createDataFrame(rows, SCHEMA)) == sorted(_brute(rows), key=str)


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = _vectors(250)
    expected = _got(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert expected == _got(spark.createDataFrame(rows, SCHEMA).repartition(17))

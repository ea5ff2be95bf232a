"""Near copies of the pipeline come by SimHash; what fingerprints don't show comes by bands."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import nearcopies, simhash

RNG = random.Random(11)


def _words(n):
    return [RNG.choice(["stone", "river", "bridge", "field", "cloud", "morning"]) + str(RNG.randrange(900)) for _ in range(n)]


def test_fingerprints_find_near_copies(spark):
    rows = []
    for i in range(30):
        words = _words(400)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:200], "edited", *words[201:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = {k: nearcopies.fingerprint(nearcopies.shingles(nearcopies._words(t))) for k, t in rows}
    within = {2 * i for i in range(30) if np.bitwise_count(np.uint64((prints[2 * i] ^ prints[2 * i + 1]) & (1 << 64) - 1)) <= nearcopies.LEFT}
    # one band of 400 min-hashes is shared by equal sets only, so that what goes was found by its fingerprint
    kept = {r["doc_id"] for r in nearcopies.deduplicate(df, bands=1, width=400).collect()}
    assert len(within) >= 15 and {k for k, _ in rows if k % 2 == 0} <= kept and not {k + 1 for k in within} & kept
    assert {r["doc_id"] for r in nearcopies.deduplicate(df).collect()} == set(range(0, 60, 2))


@pytest.mark.parametrize("chunk", [7, 1 << 17])
def test_near_joins_all_that_its_grids_hold(spark, monkeypatch, chunk):
    base = [RNG.getrandbits(64) for _ in range(40)]
    fps = {*base, 0, (1 << 64) - 1}
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << j for j in RNG.sample(range(64), RNG.randint(1, 9))))
    fps = np.array(sorted(fps), np.uint64).view(np.int64)
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    try:
        got = [(r["a"], r["b"]) for r in simhash.near(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 8, 4, 12).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    apart = {(int(a), int(b)): int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))) for a in fps for b in fps if a < b}
    assert len(got) == len(set(got)) and all(apart[p] <= 12 for p in got)
    assert {p for p, d in apart.items() if d <= 4} <= set(got)


def test_crowded_cells_are_stars():
    fp = np.arange(100, dtype=np.int64)
    cell = np.repeat(np.array([1, 2, 3]), [40, 20, 40])
    pairs = lambda *a: set(zip(*(x.tolist() for x in simhash._meeting(*a))))
    inner = {(i, j) for i in range(40, 60) for j in range(i + 1, 60)}
    assert pairs(cell, fp, 64, None) == {(0, i) for i in range(1, 40)} | inner | {(60, i) for i in range(61, 100)}
    assert pairs(cell, fp, 64, -5) == {(-5, i) for i in range(40)} | inner | {(60, i) for i in range(61, 100)}


def test_no_words_and_equal_fingerprints(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "A  b c"), (5, "a b d"), (6, "a b")]
    kept = nearcopies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6]


@pytest.mark.parametrize("chunk", [7, 1 << 17])
def test_stars_leave_no_near_pair_out(spark, monkeypatch, chunk):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {*base, 0}
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << j for j in rng.sample(range(64), rng.randint(1, 9))))
    fps |= {base[0] ^ sum(1 << j for j in rng.sample(range(8), 3)) for _ in range(60)}  # in crowded cells
    fps = np.array(sorted(fps), np.uint64).view(np.int64)
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    try:
        known = spark.createDataFrame([(int(f),) for f in fps], "fp long")
        got, pairs = simhash.stars(known, 8, 4, 12).collect(), {(r["a"], r["b"]) for r in simhash.near(known, 8, 4, 12).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    assert len(got) == len({(r["cell"], r["b"]) for r in got}) and len({r["cell"] for r in got}) == len({(r["cell"], r["a"]) for r in got})
    cells = {}
    for r in got:
        assert r["close"] == (int(np.bitwise_count(np.uint64((r["a"] ^ r["b"]) & (1 << 64) - 1))) <= 12) and (r["close"] or r["open"])
        if r["open"]:
            cells.setdefault(r["cell"], []).append(r["b"])
    assert max(map(len, cells.values())) > simhash.CELL
    held = {(r["a"], r["b"]) for r in got if r["close"]}
    assert len(held) < len(pairs)
    held |= {(a, b) for c in cells.values() for a in c for b in c if a < b}
    apart = {(int(a), int(b)): int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))) for a in fps for b in fps if a < b}
    assert pairs <= held and {p for p, d in apart.items() if d <= 4} <= held


def _family(n):
    """Texts of one family: each has a few words of its own, so that many are alike enough and many aren't."""
    rng = random.Random(7)
    words = [rng.choice(["stone", "river", "bridge", "field"]) + str(rng.randrange(900)) for _ in range(300)]
    return [(i, " ".join(f"new{i}" if j in at else w for j, w in enumerate(words))) for i in range(n) for at in [set(rng.sample(range(300), rng.randint(1, 5)))]]


def test_pairs_grow_with_a_family(spark, monkeypatch):
    made, verified = [], nearcopies._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    rows = _family(400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # one band of 400 min-hashes is shared by equal sets only, so that all pairs come by fingerprints
    kept = {r["doc_id"] for r in nearcopies.deduplicate(df, bands=1, width=400).collect()}
    prints = {k: nearcopies.fingerprint(nearcopies.shingles(nearcopies._words(t))) for k, t in rows}
    pairs = simhash.near(spark.createDataFrame([(f,) for f in set(prints.values())], "fp long"), nearcopies.GROUPS, nearcopies.LEFT, nearcopies.REACH)
    pairs = [(r["a"], r["b"]) for r in pairs.collect()]
    assert made[0] < 15 * len(rows) < len(pairs) and len(made) == 2 and not made[1]
    # whatever all pairs that meet in a cell would link is linked
    sets = {prints[k]: nearcopies.shingles(nearcopies._words(t)) for k, t in rows}
    root = {f: f for f in sets}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in pairs:
        if nearcopies.similarity(sets[a], sets[b]) >= nearcopies.LEAST:
            root[find(a)] = find(b)
    least = {}
    for k in sorted(prints):
        least.setdefault(find(prints[k]), k)
    assert len(least) < len(rows) and kept <= set(least.values())

"""Audit of how filters interact: what each removes in every order of application, and its Shapley value.

A document's failures are a mask, one bit a filter. All that the audit tells follows from how many documents of a part have
each mask. The number removed by a set of filters, as a function of each filter's presence x, is a polynomial that is linear in
every x (the multilinear extension of the set function): a document with failures M is removed to 1 - prod(1 - x_i, i in M). Its
value at a corner of the cube is what that set of filters removes, so that differences of corners are survivors, removals and
losses of a step. The integral of the derivative by x_i along the diagonal is the filter's Shapley value, computed in exact
rationals; times the number of orders it is the whole number of documents that it removes over all of them.

Texts are read once, in built-in expressions. Only ids, digests and masks are shuffled, aggregated first; what is left is one row
of counts a part, and the polynomials of different parts are made in different tasks.

Null texts count as empty, null parts as the empty string. Identical texts are told by two digests of 192 bits in all. Of
identical texts those with the smallest doc_id pass, all rows of it alike; a row without doc_id never fails for being a copy and
makes none of another. A document without a label is neither good nor toxic; where labels repeat an id, one row that says so is
enough. Every row counts for itself, repeated ones too. Very long texts are read whole. No documents give no rows. Other columns
of the tables aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\x20\x09-\x0D]"
#: Letters of the filters that judge a text by itself; a document that fails the last one, COPY, has the text of a smaller id.
OWN, COPY = "ABCD", "E"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Removal:
    """The multilinear polynomial of how many are removed, from counts by mask over n filters."""

    def __init__(self, counts: Sequence[int], n: int):
        # the coefficient of prod(x_i, i in T) is (-1)^(|T| + 1) times the number of documents that fail all of T
        above = list(counts)
        for i in range(n):
            for mask in range(1 << n):
                if not mask >> i & 1:
                    above[mask] += above[mask | 1 << i]
        self.n, self.terms = n, {t: above[t] if t.bit_count() % 2 else -above[t] for t in range(1, 1 << n) if above[t]}

    def at(self, corner: int) -> int:
        """How many a set of filters removes: the value where their variables are 1 and the others 0."""
        return sum(c for t, c in self.terms.items() if t & corner == t)

    def shapley(self, i: int) -> Fraction:
        """The derivative by x_i is a polynomial in t on the diagonal; its integral from 0 to 1."""
        powers = [0] * self.n
        for t, c in self.terms.items():
            if t >> i & 1:
                powers[t.bit_count() - 1] += c
        return sum((Fraction(c, k + 1) for k, c in enumerate(powers)), Fraction(0))


def report(part: str, counts: dict[int, tuple[int, int, int]], letters: str) -> list[tuple]:
    """Rows of SCHEMA for a part: counts has all, good and toxic documents by mask."""
    n = len(letters)
    total, good, toxic = (Removal([counts.get(m, (0, 0, 0))[k] for m in range(1 << n)], n) for k in range(3))
    rows, every = sum(c[0] for c in counts.values()), (1 << n) - 1
    corners = [(total.at(s), good.at(s), toxic.at(s)) for s in range(1 << n)]
    shapley = [total.shapley(i) * math.factorial(n) for i in range(n)]
    assert all(s.denominator == 1 for s in shapley)
    out = []
    for order in permutations(range(n)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good_lost, toxic_lost = (b - a for a, b in zip(corners[before], corners[after]))
            failing, unique = corners[1 << i][0], corners[every][0] - corners[every ^ 1 << i][0]
            out.append((part, name, step, rows - corners[after][0], removed, failing - removed, unique, good_lost, toxic_lost, int(shapley[i])))
            before = after
    return out


def text_failures(text: Column) -> dict[str, Column]:
    """The filters over a text alone."""
    words = F.filter(F.split(text, BLANK + "+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def masks(docs: DataFrame, part: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """part, doc_id, mask, n: rows of docs by what they fail, at most one row for each of the combinations."""
    whole = F.coalesce(F.col(text), F.lit(""))
    fails = text_failures(F.col("t"))
    mask = sum((F.when(fails[letter], 1 << i).otherwise(0) for i, letter in enumerate(OWN)), F.lit(0))
    read = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("t"))
    rows = read.select("doc_id", "part", F.md5("t").alias("digest"), F.xxhash64("t").alias("more"), mask.alias("mask")).groupBy("doc_id", "digest", "more", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest", "more").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    # joined by the text and its smallest id together: however many copies a text has, they have different ids
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << len(OWN)).otherwise(0)
    told = rows.join(first, ["digest", "more", "doc_id"], "left").select("part", "doc_id", (F.col("mask") + copy).alias("mask"), "n")
    return told.groupBy("part", "doc_id", "mask").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """SCHEMA: for each part, order of the filters and step, what the step's filter does there."""
    says = labels.groupBy(F.col(key).alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    told = masks(docs, part, text, key).join(says.where("good OR bad"), "doc_id", "left")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    counts = told.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("bad").alias("bad"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("counts"))  # 32 entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for name, found in zip(*(batch.column(c).to_pylist() for c in ("part", "counts"))):
                rows = report(name, {c["mask"]: (c["n"], c["good"], c["bad"]) for c in found}, OWN + COPY)
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return parts.mapInArrow(run, SCHEMA)


#: DuckDB SQL for the same rows: every order is gone through, step by step, over the counts by mask.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
        (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN f.doc_id > first THEN 16 ELSE 0 END) AS mask
      FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good::INT)::BIGINT AS g, sum(bad::INT)::BIGINT AS x FROM m GROUP BY ALL),
b AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
o AS (SELECT b1.i AS i1, b2.i AS i2, b3.i AS i3, b4.i AS i4, b5.i AS i5 FROM b b1, b b2, b b3, b b4, b b5
      WHERE len(list_distinct([b1.i, b2.i, b3.i, b4.i, b5.i])) = 5),
s AS (SELECT substr('ABCDE', i1 + 1, 1) || substr('ABCDE', i2 + 1, 1) || substr('ABCDE', i3 + 1, 1) || substr('ABCDE', i4 + 1, 1) || substr('ABCDE', i5 + 1, 1) AS filter_order,
        unnest([{'step': 1, 'bit': 1 << i1, 'before': 0}, {'step': 2, 'bit': 1 << i2, 'before': 1 << i1},
          {'step': 3, 'bit': 1 << i3, 'before': (1 << i1) + (1 << i2)}, {'step': 4, 'bit': 1 << i4, 'before': (1 << i1) + (1 << i2) + (1 << i3)},
          {'step': 5, 'bit': 1 << i5, 'before': 31 - (1 << i5)}]) AS z FROM o),
r AS (SELECT part, filter_order, z.step AS step, z.bit AS bit,
        sum(CASE WHEN mask & (z.before | z.bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & z.before = 0 AND mask & z.bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & z.before <> 0 AND mask & z.bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = z.bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & z.before = 0 AND mask & z.bit <> 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & z.before = 0 AND mask & z.bit <> 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

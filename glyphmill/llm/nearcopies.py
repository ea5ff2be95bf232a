"""Near copies by the similarity of their texts: Jaccard of word shingles, at least 0.8 over five words by default.

Candidates are texts whose SimHash fingerprints (64 bits over the distinct shingles) meet in a cell of simhash's grids over
segment counts and differ in REACH bits at most: all within LEFT bits do, and many others. The Jaccard similarity of their
whole shingle sets then decides. Each is first compared with the smallest fingerprint of its cells, so that pairs grow with a
family's size and not with its square; others of a cell that this leaves in more than one component meet in blocks, below.

No reach of 64 bits holds all texts of similarity 0.8 (they differ in 10 bits on average, in 22 at most of those measured), so the links that
fingerprints can't show are sought among the components they leave: by texts that agree in all min-hashes of one of BANDS bands. Two texts at the
least similarity s share no band with a chance of (1 - s ** WIDTH) ** BANDS, here 5e-8; more similar ones with less.

Texts with the same words are one class from the start. In each cell of a band, every class is first compared with one
leader of another component, another for each cell. Where other classes of a cell, of a grid or a band, are in more than one component then, they
are compared across components, in blocks, so that no link is missed, no pair is a row, and families that a leader links aren't compared in full. A
large family of which few are alike enough (many texts of similarity 0.5 to 0.8) is: its comparisons grow with the square of
its size, what is shuffled with that of its number of blocks.

Empty tables give empty ones; very long texts are read block by block; ties go to the smaller key. All columns of the table stay. A text
of fewer words than a shingle is one shingle; texts without words are one class. Rows are told apart by key and
text, so that rows without a key, or with a key that another text has too, are rows like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common, simhash

WORDS, LEAST = 5, 0.8
#: Groups of axes, how many of them a grid leaves out, and bits in which compared fingerprints differ at most.
GROUPS, LEFT, REACH = 8, 4, 12
BANDS, WIDTH = 32, 4
SEED = 42
#: Members of a cell that meet as many others in one task.
PART = 500


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def shingles(found: list[bytes], words: int = WORDS) -> np.ndarray:
    """The XXH64 of the distinct shingles, sorted."""
    if not found:
        return np.zeros(0, np.uint64)
    line, width = b" ".join(found), min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, len(starts)))


def fingerprint(found: np.ndarray) -> int:
    """Signed: bit j is set if more than half of the shingles have it."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):  # a very long text block by block
        total += simhash.ones(found[at : at + (1 << 16)])
    bits = simhash.majority(total, len(found))
    return bits - (1 << 64) if bits >> 63 else bits


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


class Bands:
    """The cell of a set in each band, from bands * width min-hashes."""

    def __init__(self, bands: int, width: int):
        rng = np.random.default_rng(SEED)
        self.factor = rng.integers(0, 1 << 63, bands * width, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, bands * width, np.uint64) * np.uint64(2)
        self.bands = bands

    def __call__(self, found: np.ndarray) -> list[int]:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 4096):  # a very long text block by block
            np.minimum(least, (found[at : at + 4096, None] * self.factor + self.shift).min(axis=0), out=least)
        return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(self.bands, -1))]


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose similarity is at least `least`."""

    def start():
        def each(batch):
            sets = common.Memo(lambda text: shingles(_words(text), words))  # of this batch: a leader comes many times
            ok = [similarity(sets[x], sets[y]) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            return {"a": kept.column(0), "b": kept.column(1)}

        return each

    one, other = texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), texts.select(F.col("cls").alias("b"), F.col("text").alias("y"))
    return common.arrow_map(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y"), "a binary, b binary", start)


def _fingerprint_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of classes (cls, fp): pairs (a, b) to compare first, and the members (cell, cls) of cells that may hold further near ones.

    In the grids the smallest class stands for all of equal fingerprints. These are a cell of their own.
    """
    known = classes.where("fp IS NOT NULL").groupBy("fp").agg(F.min("cls").alias("rep"), F.count("*").alias("n"))
    known = common.cut(known)
    same = common.join_hot(classes.select("cls", "fp"), known.where("n > 1"), "fp", "n").where("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b"))
    same = common.cut(same)
    met = common.cut(simhash.stars(known.select("fp"), GROUPS, LEFT, REACH))
    one, other = known.select(F.col("fp").alias("a"), F.col("rep").alias("x")), known.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    close = met.where("close").select("a", "b").distinct().join(one, "a").join(other, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    cells = met.where("open").select("cell", "b").join(other, "b").select("cell", F.col("y").alias("cls"))
    return same.unionByName(close), cells.unionByName(same.select(F.xxhash64("a").alias("cell"), F.col("b").alias("cls")))


def _across(open_: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) between components of a cell, given the members (cell, cls, component): as many as join what is alike.

    Only cells with several components take part. Their members meet in blocks of PART by PART, whose texts are in one task, so
    that no pair is a row; what a block has joined already isn't compared again.
    """
    mixed = open_.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
    mixed = common.cut(mixed.select("cell", "n", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    member = common.join_hot(open_.select("cell", "cls", "component"), mixed, "cell", "n")
    part, other = F.pmod(F.xxhash64("cls", "cell"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    member = member.withColumn("part", part).withColumn("other", other).select("cell", "cls", "component", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[bytes, bytes]] = []
        if group["component"].nunique() > 1:
            group = group.sort_values("cls", ignore_index=True)
            sets = [shingles(_words(t), words) for t in group["text"]]
            sizes = np.array([len(x) for x in sets])
            begins = np.cumsum(sizes) - sizes
            values, flat = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(values), bool)  # the shingles of one member
            own = pd.factorize(group["component"])[0].copy()
            side, cls = group["part"].to_numpy(), group["cls"].tolist()
            apart = group["one"].iloc[0] != group["two"].iloc[0]  # blocks of two parts: pairs within one are another task's
            counts = np.bincount(own)
            # members of smaller components look for a partner in others
            for i in np.argsort(counts[own], kind="stable").tolist():
                if (own == own[i]).all():
                    break
                ok = (own != own[i]) & (sizes + 1e-6 >= least * sizes[i]) & (sizes * least <= sizes[i] + 1e-6)
                if apart:
                    ok &= side != side[i]
                if not ok.any():
                    continue
                mine = flat[begins[i] : begins[i] + sizes[i]]
                mark[mine] = True
                both = np.add.reduceat(mark[flat], begins, dtype=np.int64)
                mark[mine] = False
                for j in np.flatnonzero(ok & (both / (sizes + sizes[i] - both) >= least)).tolist():
                    if own[j] != own[i]:
                        found.append((cls[i], cls[j]))
                        own[own == own[j]] = own[i]
        return pd.DataFrame({"a": [min(x) for x in found], "b": [max(x) for x in found]}, columns=["a", "b"])

    rows = member.join(texts, "cls")
    return rows.groupBy("cell", "one", "two").applyInPandas(meet, "a binary, b binary").distinct()


def classes_of(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """Of each class: cls, component, and its first row: without (no key), key, digests, n (how often this row is there).

    Rows are pre-aggregated by class before anything is joined, so that no class, however many copies it has, is one task's.
    """

    def start():
        common.release()
        cells = Bands(bands, width)

        def each(batch):
            names, prints, found = [], [], []
            for text in batch.column(3):  # one text's words at a time
                own = _words(text.as_py())
                names.append(xxhash.xxh3_128_digest(b" ".join(own)))
                # a text without words is in no cell: its class is all of its component
                own = shingles(own, words)
                prints.append(fingerprint(own) if len(own) else None)
                found.append(cells(own) if len(own) else [])
            return {
                "key": batch.column(0), common.DIGEST[0]: batch.column(1), common.DIGEST[1]: batch.column(2),
                "cls": pa.array(names, pa.binary()), "fp": pa.array(prints, pa.int64()), "cells": pa.array(found, pa.list_(pa.int64())),
            }

        return each

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), *common.digests(df[key], df[text]), df[text].alias("text"))
    rows = common.cut(common.arrow_map(rows, f"key {kind}, {common.DIGEST[0]} long, {common.DIGEST[1]} int, cls binary, fp long, cells array<long>", start))
    # equal rows first, so that the first row of a class comes with its number
    once = rows.groupBy("cls", F.isnull("key").alias("without"), "key", *common.DIGEST).agg(F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("cells").alias("cells"))
    first = F.min(F.struct("without", "key", *common.DIGEST, "n")).alias("row")
    classes = common.cut(once.groupBy("cls").agg(first, F.first("fp").alias("fp"), F.first("cells").alias("cells")))
    close, cells = map(common.cut, _fingerprint_pairs(classes))
    member = classes.select("cls", F.explode("cells").alias("cell"))
    sizes = member.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("cls", "cell").alias("h"), "cls")).alias("leader")).where("n > 1")
    shared = common.cut(common.join_hot(member, common.cut(sizes.select("cell", "n", F.col("leader.cls").alias("leader"))), "cell", "n"))
    compared = shared.select("cls").unionByName(close.select(F.explode(F.array("a", "b")).alias("cls"))).unionByName(cells.select("cls")).distinct()
    needed = classes.join(compared, "cls", "left_semi").select("cls", "row.*")
    needed = common.cut(needed.select("cls", *common.DIGEST, "n"))
    whole = df.select(df[key].alias("__k"), df[text].alias("text"))
    texts = common.cut(common.chosen_rows(whole, needed, "n", F.col("__k"), F.col("text")).select("cls", "text"))
    edges = common.cut(_verified(close, texts, words, least))
    roots = common.cut(simhash.components(edges))

    def root(rows: DataFrame, cls: str = "cls", component: str = "component") -> DataFrame:
        return rows.join(roots, rows[cls] == roots["node"], "left").withColumn(component, F.coalesce("root", cls)).drop("node", "root")

    # the rest, which fingerprints don't show: what shares a band with a leader that isn't of its component yet
    rest = shared.where("cls <> leader").select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
    rest = common.cut(root(root(rest, "a", "of_a"), "b", "of_b").where("of_a <> of_b").select("a", "b"))
    edges = common.cut(edges.unionByName(_verified(rest, texts, words, least)))
    roots = common.cut(simhash.components(edges))
    # cells that still hold several components: all members across components, but for leaders, which have met all members (in grids, those near them)
    open_ = root(shared.where("cls <> leader").select("cell", "cls").unionByName(cells))
    more = common.cut(_across(open_, texts, words, least))
    if not more.isEmpty():
        roots = common.cut(simhash.components(edges.unionByName(more)))
    return root(classes.select("cls", "row.*"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """df with one row of each component: that of the smallest key (of rows without one only if no other is there)."""
    found = classes_of(df, key, text, **bounds)
    first = found.groupBy("component").agg(F.min(F.struct("without", "key", *common.DIGEST, "n")).alias("row")).select("row.*")
    wanted = common.cut(first.select(*common.DIGEST, "n"))
    aside = df.withColumn("__k", df[key]).withColumn("__t", df[text])
    return common.chosen_rows(aside, wanted, "n", F.col("__k"), F.col("__t")).select(df.columns)

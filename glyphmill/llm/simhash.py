"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors is never more than the Hamming distance of the fingerprints, so a range join on a grid over the vectors finds a
superset of the links, which the Hamming distance then verifies.

The grid: the 32 axes stand in six groups. Vectors within distance two differ in two groups at most, so they agree in
four at least and meet in a cell of one of the 15 grids that leave two groups out. Such a cell fixes at least 20 axes, so
unlike fingerprints hardly ever share one. A cell with more than CELL members (a large family of near copies) isn't
paired out: there each member is sent to the 65 fingerprints within one bit of it. Two members within two bits meet at
one of these, all that meet there are within two bits, and at most 65 can meet, so that a star at each is exact and
grows with the number of members only.

`near` and `stars` join at a larger distance by grids that leave out more groups, for callers that verify pairs otherwise.

Rows of equal fingerprints are one class from the start. Components come from large-star/small-star rounds over class
representatives, each round cut in the shared checkpoint folder.

Null and empty texts have fingerprint zero, linked like any other. Rows without an id get the component of their
fingerprint; they represent no class. Repeated rows stay. Very long texts are read block by block. Ties go to the smaller id. Empty
tables give empty ones. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

SEED = 42
WORDS = 3
#: Members of a cell that are paired; more take the exact way over shared neighbours.
CELL = 32
GROUPS, DISTANCE = 6, 2
#: Rows of cells that `near` and `stars` read at a time.
CHUNK = 1 << 17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EVEN = 0x5555555555555555


def ones(digests: np.ndarray) -> np.ndarray:
    """How many of the digests have each bit."""
    return np.unpackbits(digests.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned: bit j is set if more than half of the shingles' XXH64 have it."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    width = min(words, len(found))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - width + 1]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):  # a very long text block by block
        block = [digest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)].tolist(), ends[at + width - 1 : at + width - 1 + (1 << 16)].tolist())]
        total += ones(np.array(block, "<u8"))
    return majority(total, len(starts))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the fingerprint's bits as a signed long)."""

    def start():
        common.release()

        def each(batch):
            fp = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            return {"key": batch.column(0), "fp": pa.array(fp.view(np.int64))}

        return each

    kind = df.schema[key].dataType.simpleString()
    return common.arrow_map(df.select(df[key].alias("key"), df[text].alias("text")), f"key {kind}, fp long", start)


def embedded(fp: str = "fp") -> F.Column:
    """The bit counts of the two-bit segments, as 00, 01 or 11: the Manhattan distance is the bits in which two differ."""
    x, half = F.col(fp), F.shiftrightunsigned(fp, 1)
    low = x.bitwiseOR(half).bitwiseAND(F.lit(_EVEN))
    high = F.shiftleft(x.bitwiseAND(half).bitwiseAND(F.lit(_EVEN)), 1)
    return low.bitwiseOR(high)


def _masks(groups: int = GROUPS, left: int = DISTANCE) -> list[int]:
    """A mask over the embedding for each grid that leaves out `left` of the groups of axes."""
    axes = np.array_split(np.arange(32), groups)
    masks = []
    for kept in combinations(range(groups), groups - left):
        bits = sum(3 << (2 * int(a)) for g in kept for a in axes[g])
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return masks


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of representatives of classes (fp, rep) that connect all fingerprints within DISTANCE bits."""
    member = F.struct("rep", "fp", embedded().alias("counts"))
    cells = classes.select(
        member.alias("m"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), embedded().bitwiseAND(F.lit(mask)).alias("cell")) for i, mask in enumerate(_masks())])).alias("at"),
    ).select("at.grid", "at.cell", "m")
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n"), F.min("m").alias("low"), F.max("m").alias("high")).where("n > 1")
    sizes = common.cut(sizes)
    two = sizes.where("n = 2").select(F.col("low").alias("x"), F.col("high").alias("y"))
    kept = sizes.where("n > 2").select("grid", "cell", "n", F.col("n").alias("size"))
    more = common.join_hot(cells, kept, ["grid", "cell"], "size")
    some = (
        more.where(F.col("n") <= CELL).groupBy("grid", "cell").agg(F.collect_list("m").alias("ms"))
        .select(F.explode("ms").alias("x"), "ms").select("x", F.explode("ms").alias("y")).where("x.rep < y.rep")
    )
    near = (
        two.unionByName(some)
        .where(F.bit_count(F.col("x.counts").bitwiseXOR(F.col("y.counts"))) <= DISTANCE)
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE)
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    )
    crowd = more.where(F.col("n") > CELL).select("m.rep", "m.fp").distinct()
    meets = crowd.select("rep", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))).alias("at"))
    stars = meets.groupBy("at").agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1")
    stars = stars.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a < b")
    return near.unionByName(stars).distinct()


def _meeting(cell: np.ndarray, fp: np.ndarray, reach: int, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints within reach bits in rows sorted by cell and fp; all of a cell, but of a crowded one with its first.

    first: that of the first row's cell, if it is crowded and began before these rows.
    """
    begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[begins, len(cell)])
    lead, n = np.repeat(begins, size), np.repeat(size, size)
    star = np.flatnonzero((n > CELL) & (lead < np.arange(len(cell))))
    one, two = [fp[lead[star]]], [fp[star]]
    if first is not None:  # the whole cell goes to what came before
        star = star[star >= size[0]]
        one, two = [np.full(size[0], first, np.int64), fp[lead[star]]], [fp[: size[0]], fp[star]]
    few = np.flatnonzero((n <= CELL) & ((lead > 0) | (first is None)))
    for step in range(1, min(CELL, int(size.max()))):
        at = few[few + step < len(cell)]
        at = at[lead[at] == lead[at + step]]
        if not len(at):
            break
        one.append(fp[at])
        two.append(fp[at + step])
    a, b = np.concatenate(one), np.concatenate(two)
    close = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= reach
    return a[close], b[close]


def _starred(cell: np.ndarray, fp: np.ndarray, reach: int, first: int | None) -> dict[str, np.ndarray]:
    """Of rows sorted by cell and fp, all but the first of each cell, as `stars` returns them.

    first: that of the first row's cell, if it is crowded and began before these rows; the first row is one of before then.
    """
    begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[begins, len(cell)])
    lead, crowded = np.repeat(begins, size), np.repeat(size > CELL, size)
    a, other = fp[lead], lead < np.arange(len(cell))
    if first is not None:
        a[: size[0]], crowded[: size[0]] = first, True
    open_, few = crowded.copy(), np.flatnonzero(other & ~crowded)
    for step in range(1, min(CELL, int(size.max()))):
        at = few[few + step < len(cell)]
        at = at[lead[at] == lead[at + step]]
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at].view(np.uint64) ^ fp[at + step].view(np.uint64)) <= reach]
        open_[at] = open_[at + step] = True
    close = np.bitwise_count(a.view(np.uint64) ^ fp.view(np.uint64)) <= reach
    kept = other & (close | open_)
    return {"cell": cell[kept], "a": a[kept], "b": fp[kept], "close": close[kept], "open": open_[kept]}


def near(known: DataFrame, groups: int, left: int, reach: int) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints (fp) that share a cell of a grid and differ in `reach` bits at most.

    All within `left` bits share one, but in a crowded cell (more than CELL members) only its smallest is paired with the others.
    """

    def found(cell, fp, first):
        a, b = _meeting(cell, fp, reach, first) if len(cell) else (fp, fp)
        return {"a": a, "b": b}

    return _by_cells(known, groups, left, found, "a long, b long").where("a < b").distinct()


def stars(known: DataFrame, groups: int, left: int, reach: int) -> DataFrame:
    """Members (cell, a, b, close, open) of the grids' cells: b with the smallest fingerprint a of its cell, never more rows than members.

    close: a and b differ in `reach` bits at most. open: others than a may be as near to b, so that the open members of a cell are yet to
    be compared; all of a crowded cell are. A member that is neither has no row. Pairs within `left` bits share a cell.
    """

    def found(cell, fp, first):
        return _starred(cell, fp, reach, first) if len(cell) else {"cell": cell, "a": fp, "b": fp, "close": fp > 0, "open": fp > 0}

    return _by_cells(known, groups, left, found, "cell long, a long, b long, close boolean, open boolean")


def _by_cells(known: DataFrame, groups: int, left: int, found: Callable[[np.ndarray, np.ndarray, int | None], dict], schema: str) -> DataFrame:
    """What found(cell, fp, first) gives for the cells of the grids, sorted; a cell of CELL members at most comes in one call."""
    masks = np.array(_masks(groups, left), np.int64).view(np.uint64)

    def start():
        # a digest of grid and cell: what collides is told apart by its bits
        factor = np.random.default_rng(SEED).integers(0, 1 << 63, len(masks), np.uint64) * np.uint64(2) + np.uint64(1)

        def each(batch):
            x = batch.column(0).to_numpy().view(np.uint64)
            half = x >> np.uint64(1)
            counts = ((x | half) & np.uint64(_EVEN)) | ((x & half & np.uint64(_EVEN)) << np.uint64(1))
            cell = ((counts & masks[:, None]) + np.uint64(1)) * factor[:, None]
            cell = (cell ^ (cell >> np.uint64(32))) * factor[::-1, None]
            return {"cell": cell.ravel().view(np.int64), "fp": np.tile(batch.column(0).to_numpy(), len(masks))}

        return each

    cells = common.arrow_map(known, "cell long, fp long", start).repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp, first = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # rows of a cell that may go on; its first, if crowded

        def some(end: int):
            return pa.RecordBatch.from_pydict(found(cell[:end], fp[:end], first))

        parts, rows = [], 0
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            cell = np.concatenate([cell, *(p.column(0).to_numpy() for p in parts)])
            fp = np.concatenate([fp, *(p.column(1).to_numpy() for p in parts)])
            parts, rows = [], 0
            last = int(np.searchsorted(cell, cell[-1]))  # where the last cell begins
            crowded = len(cell) - last > CELL
            yield some(len(cell) if crowded else last)
            if crowded:
                # one row stays, to tell the cell by
                first = first if first is not None and last == 0 else int(fp[last])
                cell, fp = cell[-1:], fp[-1:]
            else:
                cell, fp, first = cell[last:], fp[last:], first if last == 0 else None
        cell = np.concatenate([cell, *(p.column(0).to_numpy() for p in parts)])
        fp = np.concatenate([fp, *(p.column(1).to_numpy() for p in parts)])
        yield some(len(cell))

    return cells.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for the nodes of edges (a, b), a < b, that aren't roots themselves."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.where("a < b").distinct()

    edges = common.cut(distinct(edges))
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: larger neighbours go to the smallest neighbour
        large = distinct(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b"))
        # small star: a node and its smaller neighbours go to the smallest of these
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        edges = common.cut(distinct(large.join(small, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))))
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id (the smallest key reachable over links)."""
    rows = common.cut(fingerprints(df, key, text))
    classes = common.cut(rows.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    roots = components(links(classes.where("rep IS NOT NULL")))
    labels = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id"))
    return common.join_hot(rows, common.cut(labels), "fp", "n").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component, that of the smallest key; of rows with one key, one. Rows without a key go."""
    found = near_duplicates(df, key, text)
    kept = found.where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("n"))
    rows = df.where(df[key].isNotNull()).withColumn("__key", df[key])
    wanted = common.cut(kept.select(*common.digests(F.col(key)), "n"))
    return common.chosen_rows(rows, wanted, "n", F.col("__key")).select(df.columns)

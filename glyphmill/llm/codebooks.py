"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Components are turned into whole numbers first, floor(SCALE * x), so that sums don't depend on the order in which tasks add them.
Rows are written once, as columnar blocks of at most ROWS vectors (component by component), to the shared checkpoint folder. Each
round is one treeAggregate over the RDD of these blocks: within a block distances accumulate component by component for all
its vectors, np.add.at adds each part to its entry's sum and count, and these tensors of fixed size (parts x entries x length)
merge through a reduction tree. The driver holds them and the codebooks only. A lost executor's blocks are read again.

Codebooks begin with the parts of the ENTRIES smallest ids (null ids last, equal ids by their components), fewer where there are
fewer vectors. Ties of distance go to the lower index, quotients are rounded down, an entry that no part is nearest to stays.

Vectors that are null or hold null or non-finite components take no part and have no row. The length is that of the vector with
the smallest id; vectors of another length, or all if it can't be cut into PARTS equal parts, have a row with null code and
error. Where numbers may exceed 64 bits (components over 2^28 / SCALE, or very many rows of large ones) whole Python integers are
added instead, slowly; an error beyond a long is null, and so is that of its label. Repeated rows count as often as they come. Empty tables give empty
results. Other columns stay; those with the names of the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block.
ROWS = 4096
#: Components below it have squared distances of a part of 128 within 64 bits.
LARGE = 1 << 27
LONG = (1 << 63) - 1


def usable(vector: str) -> "F.Column":
    """Neither null nor with a null or non-finite component."""
    c = F.col(vector)
    return c.isNotNull() & F.coalesce(~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(flat: np.ndarray, length: int) -> np.ndarray:
    """Columns of floor(SCALE * x), one row for each component; as doubles, in which they are exact."""
    return np.floor(flat.astype(np.float64).reshape(-1, length) * SCALE).T


@dataclass
class Codebooks:
    """entries[part][index] is a list of whole numbers."""

    entries: list[list[list[int]]]
    large: bool = False

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()

    def nearest(self, block: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector of a columnar block: the nearest entry and the squared distance."""
        book = self.entries[part]
        width = len(book[0])
        distances = np.zeros((len(book), block.shape[1]), block.dtype)
        for i in range(width):  # dimension by dimension
            here = np.array([e[i] for e in book], block.dtype)
            gap = block[part * width + i][None] - here[:, None]
            distances += gap * gap
        at = distances.argmin(axis=0)  # the first of equal ones
        return at, distances[at, np.arange(block.shape[1])]

    def typed(self, block: np.ndarray) -> np.ndarray:
        """Numbers of 64 bits, or Python's where these may not do."""
        if not self.large:
            return block.astype(np.int64)
        return np.array([int(x) for x in block.ravel()], object).reshape(block.shape)


def _blocks(df: DataFrame, vector: str, length: int) -> DataFrame:
    """One row for each block: vectors, largest magnitude, columnar doubles; only vectors of the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block():
            columns = whole(np.concatenate(held), length)
            small = columns.astype(np.int32) if np.abs(columns).max() < LARGE else columns
            return pa.RecordBatch.from_pydict({"n": pa.array([columns.shape[1]], pa.int64()), "largest": pa.array([float(np.abs(columns).max())], pa.float64()), "block": pa.array([small.tobytes()], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
                n += batch.num_rows
                if n >= ROWS:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return df.select(vector).where(F.size(vector) == length).mapInArrow(run, "n long, largest double, block binary")


def _read(row: T.Row, length: int) -> np.ndarray:
    small = len(row["block"]) == 4 * row["n"] * length
    return np.frombuffer(row["block"], np.int32 if small else np.float64).reshape(length, row["n"])


def fit(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the usable vectors of df; None if none can be cut into parts."""
    vectors = df.where(usable(vector)).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    first = vectors.orderBy(F.asc_nulls_last("key"), "vector").limit(1).collect()
    length = len(first[0]["vector"]) if first else 0
    if not length or length % parts:
        return None
    width = length // parts
    start = vectors.where(F.size("vector") == length).orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    columns = whole(np.array([r["vector"] for r in start], np.float64), length)
    books = [[[int(columns[p * width + i][e]) for i in range(width)] for e in range(len(start))] for p in range(parts)]
    blocks = common.cut(_blocks(vectors, "vector", length))
    size = blocks.agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).first()
    found = Codebooks(books, size["largest"] >= LARGE or width * size["largest"] ** 2 > LONG >> 3 or size["n"] * size["largest"] > LONG >> 1)
    rdd = blocks.rdd
    kind, shape = (object if found.large else np.int64), (parts, len(start), width)
    for _ in range(rounds):
        now = found

        def add(total, row, now=now):
            sums, counts = total
            block = now.typed(_read(row, length))
            for p in range(parts):
                at, _ = now.nearest(block, p)
                np.add.at(counts[p], at, 1)
                np.add.at(sums[p], at, block[p * width : (p + 1) * width].T)
            return sums, counts

        def merge(a, b):
            a[0][...] += b[0]
            a[1][...] += b[1]
            return a

        sums, counts = rdd.treeAggregate((np.zeros(shape, kind), np.zeros(shape[:2], np.int64)), add, merge)
        found = Codebooks([[[int(s) // int(counts[p, e]) for s in sums[p, e]] if counts[p, e] else now.entries[p][e] for e in range(shape[1])] for p in range(parts)], now.large)
    return found


def encode(df: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The usable rows of df with code (two hex digits a part) and error (squared distance to what the code stands for)."""
    df = df.drop("code", "error").where(usable(vector))
    schema = T.StructType([*df.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    at = df.columns.index(vector)
    length = sum(len(p[0]) for p in books.entries) if books else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            column = batch.column(at)
            rows = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == length) if length and batch.num_rows else []
            if len(rows):
                block = books.typed(whole(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), length))
                found = [books.nearest(block, p) for p in range(len(books.entries))]
                said = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                total = sum(f[1] for f in found)
                for i, code, error in zip(rows, said, total.tolist()):
                    codes[i], errors[i] = code.tobytes().hex(), error if error <= LONG else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], [*batch.schema.names, "code", "error"])

    return df.mapInArrow(run, schema)


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """encode()'s rows with label_error, the error over all rows of the same label (nulls together), and codebooks_sha256."""
    books = fit(df, vector, key)
    coded = common.cut(encode(df.drop("label_error", "codebooks_sha256"), books, vector))
    rows = coded.withColumns({"__none": F.col(label).isNull(), "__label": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    known = F.when(~F.bool_or(F.col("code").isNotNull() & F.col("error").isNull()), F.try_sum(F.col("error").cast("decimal(38,0)")))
    sums = rows.groupBy("__none", "__label").agg(known.alias("e"), F.count("*").alias("__n"))
    totals = common.cut(sums.select("__none", "__label", F.expr("try_cast(e AS long)").alias("label_error"), "__n"))
    told = common.join_hot(rows, totals, ["__none", "__label"], "__n").drop("__none", "__label", "__n")
    return told.withColumn("codebooks_sha256", F.lit(books.sha256() if books else None).cast("string"))


def _oracle(parts: int = PARTS, width: int = 8, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL: parts as rows of component lists, each round an assignment and a mean."""
    gap = " + ".join(f"(p.v[{i}] - b.v[{i}]) * (p.v[{i}] - b.v[{i}])" for i in range(1, width + 1))
    nearest = lambda k: f"SELECT p.vec_id, p.part, p.v, min(({gap}) * {entries} + b.e) AS best FROM p JOIN b{k} b ON p.part = b.part GROUP BY ALL"
    steps = []
    for k in range(rounds):
        sums = ", ".join(f"sum(v[{i}])" for i in range(1, width + 1))
        steps += [
            f"a{k} AS MATERIALIZED ({nearest(k)})",
            f"m{k} AS (SELECT part, best % {entries} AS e, [{sums}] AS s, count(*) AS n FROM a{k} GROUP BY part, best % {entries})",
            # // rounds towards zero, so the remainder goes first
            f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, CASE WHEN m.n IS NULL THEN b.v ELSE list_transform(m.s, lambda x: ((x - (x % m.n + m.n) % m.n) // m.n)::BIGINT) END AS v FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.e = m.e)",
        ]
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * {width} + 1 : part * {width} + {width}] AS v FROM (SELECT vec_id, v, unnest(range({parts})) AS part FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT p.part, f.e, p.v FROM f JOIN p ON f.vec_id = p.vec_id),
{', '.join(steps)},
z AS ({nearest(rounds)}),
r AS (SELECT vec_id, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM z GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT r.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM r JOIN k ON r.vec_id = k.vec_id, h"""


ORACLE_SQL = _oracle()

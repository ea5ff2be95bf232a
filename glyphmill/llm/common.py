"""What the operators of this subpackage share: reading tables, cutting lineage, bounded caches, sampling of labelled rows."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Rows of one Arrow batch. Texts may have 100 kB each, so a batch stays well under an executor's memory.
BATCH_ROWS = 1000
#: Rows of one key from which the key is hot, at least; and the share of all rows, so that there are few hot keys.
HOT_ROWS, HOT_SHARE = 1000, 1e-4

#: Distinct words that a worker's memo holds before it starts anew.
MEMO_WORDS = 1_000_000

#: Parts of a stratum that are ranked apart, and of the rest of these.
SPREAD = (512, 8, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Sets the session's rows for each Arrow batch, which are read when a query is run, not when it is written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it only a local session has one, its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


#: With it, the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor takes no part of it along.

    What was shuffled for it isn't read again, so its files go at once.
    """
    session = df.sparkSession
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(shared_folder(session))
    before = session.conf.get(CLEANUP)
    session.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # select: a query takes the setting when it is made
    finally:
        session.conf.set(CLEANUP, before)


def join_hot(rows: DataFrame, known: DataFrame, on: str | list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined with known, which has one row for each key and, in column n, how many of rows have the key.

    Hot keys, each with HOT_SHARE of all rows at least and so no more than 1 / HOT_SHARE of them, are broadcast, so that
    their rows stay where they are; the others' rows are dealt out by key. Both are read twice and should be cut before.
    """
    total = known.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HOT_ROWS, int(total * HOT_SHARE))
    many, few = known.where(hot).drop(n), known.where(~hot).drop(n)
    if many.isEmpty():
        return rows.join(few, on, how)
    keys = F.broadcast(many.select(*([on] if isinstance(on, str) else on)))
    return rows.join(F.broadcast(many), on).unionByName(rows.join(keys, on, "left_anti").join(few, on, how))


#: Names of a row's digests: 96 bits of all that tells rows apart.
DIGEST = ["__row", "__more"]


def digests(*columns: Column) -> list[Column]:
    """A row's digests over the columns; nulls count."""
    parts = [c for column in columns for c in (F.isnull(column), column)]
    return [F.xxhash64(*parts).alias(DIGEST[0]), F.hash(F.lit(1), *parts).alias(DIGEST[1])]


def chosen_rows(df: DataFrame, wanted: DataFrame, n: str, *columns: Column) -> DataFrame:
    """Of the rows of df whose digests are in wanted, one for each digest; with the columns of df and the others of wanted.

    wanted has one row for each digest and, in column n, how often df has it. Rows travel once, by digest. Those that repeat so
    often that their digest is hot stay where they are until only a few of each are left.
    """
    marked = df.select("*", *digests(*columns))
    total = wanted.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HOT_ROWS, int(total * HOT_SHARE))
    many, few = wanted.where(hot).drop(n), wanted.where(~hot).drop(n)
    if many.isEmpty():
        return marked.join(few, DIGEST).dropDuplicates(DIGEST)
    apart = marked.join(F.broadcast(many), DIGEST).dropDuplicates(DIGEST)
    rest = marked.join(F.broadcast(many.select(*DIGEST)), DIGEST, "left_anti").join(few, DIGEST).dropDuplicates(DIGEST)
    return apart.unionByName(rest)


def fold(key: Column | str, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo; null keys fall in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % modulus, F.lit(0))


def stratified(rows: DataFrame, key: str, stratum: str, bound: int) -> DataFrame:
    """At most bound rows of each stratum, those with the smallest hash of the key.

    Ranked within ever fewer parts of each stratum, so that beyond the first step no task gets more than 64 * bound rows
    of a hot one, however many tasks read it.
    """
    digest = F.xxhash64(key)
    for parts in SPREAD:
        order = Window.partitionBy(stratum, F.pmod(digest, F.lit(parts))).orderBy(digest, key)
        rows = rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= bound).drop("__rank")
    return rows


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows that share the keys the text with the smallest digest: a bound on ids is one on texts, however often an id comes."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


class Memo(dict):
    """word -> value, computed once; fresh() drops everything when too many words have come."""

    def __init__(self, make: Callable, limit: int = MEMO_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def fresh(self) -> bool:
        if len(self) > self.limit:
            self.clear()
            return True
        return False


#: What a Python worker keeps from task to task: the latest use with its token and the object made for it.
_KEPT: dict[str, tuple[str, object]] = {}


def per_worker(use: str, token: str, make: Callable[[], object]) -> object:
    """The object made for a query's token; a worker that runs the query's next task has it still, with what it remembers."""
    known = _KEPT.get(use)
    if known is None or known[0] != token:
        release()  # one at a time: another query's memory goes
        _KEPT[use] = known = (token, make())
    return known[1]


def release() -> None:
    """For tasks that keep nothing: what an earlier query left in the worker goes, back to the system too."""
    if not _KEPT:
        return
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def token() -> str:
    return uuid.uuid4().hex


def arrow_map(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow with state per task: start() gives the function that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(each(batch))

    return df.mapInArrow(run, schema)

"""Specs as tables: a data source that reads a spec's vocabulary, merges and added tokens, and writes a vocabulary into a spec.

spark.dataSource.register(TokenizerSource), then spark.read.format("tokenizer").option("table", "merges").load(path), and
df.write.format("tokenizer").mode("overwrite").option("base", other).save(path). Tables: "vocabulary" (token, id; the default), "merges" (rank, left, right),
"added" (id, token, special). A spec is one JSON file, so a read is one partition; what is written may come from any number of
tasks: each returns its rows with its commit message, and the commit, which sees them all, writes the file once and as a whole.
A task that failed has no message, an aborted write leaves the file as it was.

Vocabularies have the size of a model, not of a corpus. Ids must be unique and not null; tokens that come twice are an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.stages import SpecError
from ..operators.tokenizer import Spec, Tokenizer
from .spec import read_text, write_text

SCHEMAS = {"vocabulary": "token string, id int", "merges": "rank int, left string, right string", "added": "id int, token string, special boolean"}


def rows_of(spec: Spec, table: str) -> Iterator[tuple]:
    if table == "vocabulary":
        yield from sorted(Tokenizer(spec).model.ids.items(), key=lambda x: (x[1], x[0]))
    elif table == "merges":
        for rank, merge in enumerate(spec.model.get("merges") or []):
            yield (rank, *(merge.split(" ", 1) if isinstance(merge, str) else merge))
    else:
        t = Tokenizer(spec)
        yield from ((t.added[a.content], a.content, bool(a.special)) for a in spec.added if a.content)


def with_vocabulary(base: str, vocab: dict[str, int]) -> str:
    """The text of a spec with another vocabulary."""
    spec = json.loads(base)
    if isinstance(spec["model"].get("vocab"), list):
        raise SpecError("a Unigram vocabulary has scores, which token and id don't tell")
    spec["model"]["vocab"] = dict(sorted(vocab.items(), key=lambda x: x[1]))
    Spec.parse(json.dumps(spec))  # what can't be read isn't written
    return json.dumps(spec, ensure_ascii=False, sort_keys=False, indent=2)


@dataclass
class Written(WriterCommitMessage):
    rows: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def read(self, partition) -> Iterator[tuple]:
        yield from rows_of(Spec.parse(read_text(self.path)), self.table)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, base: str):
        self.path, self.base = path, base

    def write(self, iterator: Iterator[Row]) -> Written:
        rows = [(r["token"], r["id"]) for r in iterator]
        if any(t is None or i is None for t, i in rows):
            raise SpecError("a token or an id is null")
        return Written(rows)

    def commit(self, messages: list[Written | None]) -> None:
        rows = [r for m in messages if m is not None for r in m.rows]
        vocab = dict(rows)
        if len(vocab) < len(rows) or len(set(vocab.values())) < len(rows):
            raise SpecError("a token or an id comes twice")
        write_text(self.path, with_vocabulary(read_text(self.base), vocab))

    def abort(self, messages: list[Written | None]) -> None:
        pass  # nothing has been written


class TokenizerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenizer"

    def _table(self) -> str:
        table = self.options.get("table", "vocabulary")
        if table not in SCHEMAS:
            raise SpecError(f"no table {table}; there are {', '.join(SCHEMAS)}")
        return table

    def _path(self) -> str:
        path = self.options["path"]
        return path if path.endswith(".json") else f"{path.rstrip('/')}/tokenizer.json"

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._path(), self._table())

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if self._table() != "vocabulary":
            raise SpecError("only vocabularies are written")
        return _Writer(self._path(), self.options.get("base", self._path()))

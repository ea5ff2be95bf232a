"""URL filters: glob rules as one bit-parallel automaton over canonical URLs.

All patterns lie one after another in the bits of one multiword vector. For each symbol there is a mask of the states that it
leads into and one of those that it leaves as they are (a `*`), so a character moves all patterns of all URLs of a batch on by a
shift and three bit operations a word: Shift-And with loops. URLs are moved on together, position by position, longest first; one
whose fate is sealed, as no state is alive but those that a final `*` keeps, leaves early.

A canonical URL is its host, in lower case, and its path: between the first `://` and the first `?` or `#`. The host ends before
the first `/`, `?` or `#`. A URL that is null or has no `://` has an empty host and path. Two kinds of patterns:

* a rule, `host/path`: fits the host and its subdomains, if the path begins with the rule's, case-sensitively;
* a glob over the canonical URL: `*` any run of characters, `?` any one.

Of the rules that fit the longest decides (of equal ones the first given), only where none does the first glob that fits, else
the URL is allowed. Patterns stand in the automaton in this order, so the lowest final bit is the answer.

Repeated rows are judged each for itself. Very long URLs are read whole, in time in proportion to their length and the number of
patterns over 64. An empty table gives an empty one. Columns of df with the names of the new ones are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

ALLOW, BLOCK = "allow", "block"
# fixed values: the rules of the contract
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
#: Where no rule fits: pages that hold no prose, whatever their host.
GLOBS = ((BLOCK, "ads.*"), (BLOCK, "*/login*"), (BLOCK, "*/cart/*"), (BLOCK, "*.exe"), (BLOCK, "*.zip"), (BLOCK, "*/feed/?"))
OWN = ("host", "path", "rule", "verdict")
#: URLs that are moved on together, and how few are moved on one by one (a few very long ones).
TOGETHER, FEW = 4096, 4
WORD = 64


@dataclass(frozen=True)
class _Pattern:
    """States of one pattern: symbols that lead into each state (the first has none) and those on which it stays."""

    into: list[set[str] | None]
    stays: list[set[str] | None]
    begins: list[int]


#: Sets of symbols that mean all, and all but the slash.
ANY, NO_SLASH = {"*"}, {"^"}


def _of_rule(rule: str) -> _Pattern:
    """Two first states: within a subdomain, which a dot leaves, and at the host."""
    if "/" not in rule:
        raise ValueError(f"rule {rule!r} has no path")
    return _Pattern([None, {"."}, *({c} for c in rule)], [NO_SLASH, set(), *(set() for _ in rule[:-1]), ANY], [0, 1])


def _of_glob(glob: str) -> _Pattern:
    into, stays = [None], [set()]
    for c in glob:
        if c == "*":
            stays[-1] = ANY
        else:
            into.append(ANY if c == "?" else {c})
            stays.append(set())
    return _Pattern(into, stays, [0])


class Automaton:
    """rules and globs, each (verdict, pattern)."""

    def __init__(self, rules=RULES, globs=GLOBS):
        order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
        self.names: list[str | None] = [rules[i][1] for i in order] + [None] * len(globs)
        self.verdicts = [rules[i][0] for i in order] + [v for v, _ in globs]
        patterns = [_of_rule(rules[i][1]) for i in order] + [_of_glob(g) for _, g in globs]
        self.symbols = np.array(sorted({ord(c) for p in patterns for s in [*p.into, *p.stays] if s and s not in (ANY, NO_SLASH) for c in s} | {ord("/")}), np.uint32)
        size = sum(len(p.into) for p in patterns)
        kinds = len(self.symbols) + 1  # the last is for all characters that no pattern names
        into, stays, first, final = (np.zeros((kinds, size), bool), np.zeros((kinds, size), bool), np.zeros(size, bool), np.full(size, -1, np.int64))
        kept, at = np.zeros(size, bool), 0
        for k, p in enumerate(patterns):
            for i, (moves, loops) in enumerate(zip(p.into, p.stays)):
                for table, symbols in ((into, moves), (stays, loops)):
                    table[:, at + i] = self._column(symbols)
            first[[at + i for i in p.begins]] = True
            at += len(p.into)
            final[at - 1], kept[at - 1] = k, p.stays[-1] is ANY
        self.words = max(1, -(-size // WORD))
        self.into, self.stays = self._packed(into), self._packed(stays)
        self.first, self.final, self.kept = (self._packed(v[None])[0] for v in (first, final >= 0, kept))
        self.pattern_at = np.concatenate([final, np.full(self.words * WORD - size, -1)])

    def _column(self, symbols: set[str] | None) -> np.ndarray:
        codes = np.append(self.symbols, np.uint32(0))
        if symbols == ANY or symbols == NO_SLASH:
            return np.full(len(codes), True) if symbols == ANY else codes != ord("/")
        return np.isin(codes, [ord(c) for c in symbols or ()]) & (np.arange(len(codes)) < len(codes) - 1)

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * WORD), bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def _coded(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == codes, at, len(self.symbols)).astype(np.int32)

    def _moved(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        carried = states << np.uint64(1)
        carried[:, 1:] |= states[:, :-1] >> np.uint64(WORD - 1)
        return (carried & self.into[symbols]) | (states & self.stays[symbols])

    def match(self, urls: list[str]) -> np.ndarray:
        """For each URL the number of the pattern that decides, -1 for none."""
        out = np.full(len(urls), -1, np.int64)
        for at in range(0, len(urls), TOGETHER):
            out[at : at + TOGETHER] = self._match(urls[at : at + TOGETHER])
        return out

    def _match(self, urls: list[str]) -> np.ndarray:
        coded = [self._coded(u) for u in urls]
        lengths = np.array([len(c) for c in coded], np.int64)
        flat = np.concatenate([*coded, np.zeros(1, np.int32)])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        states = np.repeat(self.first[None], len(urls), axis=0)
        open_, at = np.flatnonzero(lengths > 0), 0
        while len(open_) > FEW:
            moved = self._moved(states[open_], flat[starts[open_] + at])
            states[open_] = moved
            at += 1
            alive = (moved & ~(self.final & self.kept)).any(axis=1)
            open_ = open_[alive & (lengths[open_] > at)]
        for i in open_:  # whole numbers as vectors: few URLs cost less so
            states[i] = self._one(states[i], coded[i][at:])
        found = states & self.final
        word = (found != 0).argmax(axis=1)
        lowest = found[np.arange(len(urls)), word]
        bit = np.zeros(len(urls), np.int64)
        some = lowest != 0
        bit[some] = np.log2((lowest[some] & (~lowest[some] + np.uint64(1))).astype(np.float64)).astype(np.int64)
        return np.where(some, self.pattern_at[word * WORD + bit], -1)

    def _one(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        number = lambda v: int.from_bytes(v.tobytes(), "little")
        into, stays, now = [number(v) for v in self.into], [number(v) for v in self.stays], number(state)
        sealed = ~number(self.final & self.kept)
        for s in symbols.tolist():
            now = (now << 1 & into[s]) | (now & stays[s])
            if not now & sealed:
                break
        return np.frombuffer(now.to_bytes(self.words * 8, "little"), "<u8")


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path."""
    df = df.select(*[c for c in df.columns if c not in OWN])
    rest = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/]*", 0)
    return df.select("*", rest.alias("__rest")).select("*", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.regexp_extract("__rest", r"(?s)/.*", 0).alias("path")).drop("__rest")


def judge(df: DataFrame, url: str = "url", rules=RULES, globs=GLOBS) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict."""
    parts = split_url(df, url)
    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    host, path = parts.columns.index("host"), parts.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules, globs)
        names, verdicts = [*automaton.names, None], [*automaton.verdicts, ALLOW]  # -1, none, is the last
        for batch in batches:
            found = automaton.match([h + p for h, p in zip(batch.column(host).to_pylist(), batch.column(path).to_pylist())]) if batch.num_rows else []
            said = [pa.array([names[k] for k in found], pa.string()), pa.array([verdicts[k] for k in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *said], [*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(run, schema)


#: DuckDB SQL for the same rows, pattern by pattern.
ORACLE_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^?#]*)', 1) AS rest FROM pages),
p AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '(?s)/.*') AS path FROM u),
r AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host || path LIKE 'ads.%' OR host || path LIKE '%/login%' OR host || path LIKE '%/cart/%' OR host || path LIKE '%.exe'
    OR host || path LIKE '%.zip' OR host || path LIKE '%/feed/_' THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

"""Language identification of whole texts and of spans in them.

A word's script (by ranges of code points) leaves only the languages that write in it as candidates. Each word then gets
a score for every candidate, from hashed counts of its character n-grams. A Viterbi search over the words, with a penalty
for switching, labels spans; the label with the most letters is the document's. Words in scripts that no language writes in
are `und` and count as letters like any other. The score is the label's share of all letters times how well its words fit
the language: their log likelihood by n-gram, on a scale from that of n-grams at random to that of the texts learned from.

Words are runs of characters between white space. Null texts and texts mostly of `und` letters are `und` with score 0. Ties go to
the language that sorts first. Repeated rows are labelled each for itself.

Very long texts are labelled whole. Empty tables give empty ones; without labelled texts all labels are `und`. Other columns of the
tables aren't read, whatever their names, and keep() leaves all as they are.

The model learns from at most PER_LANGUAGE whole documents of each language, one for each id. It holds the n-gram counts in a table of
fixed size, so that what is broadcast doesn't grow with the corpus.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Documents of each language to learn from, at most.
PER_LANGUAGE = 600
#: Characters of a text to learn from, at most, and languages learned, those with the most documents: what the driver gets is bounded.
LONGEST, LANGUAGES = 200_000, 200
#: Cells of the table of n-gram counts, for each language.
CELLS = 1 << 18
#: Words that a worker remembers.
WORDS = 700_000
#: Words whose scores are plain floats at a time.
BLOCK = 4096
#: Forms whose n-grams are looked up together.
FORMS = 1024
#: What a change of language costs, in units of log likelihood; a word of up to LETTERS letters counts LEAST at most against
#: a language, a longer one more in proportion.
SWITCH, LEAST, LETTERS = 14.0, 6.0, 12
#: Where on the scale from random n-grams (0) to the texts learned from (1) a fit is 0, and where it is 1.
POOR, GOOD = 0.5, 0.9
#: A language writes in the scripts that hold at least this share of its letters.
SCRIPT_SHARE = 0.005
UNDETERMINED = "und"

# fixed values: first code points of blocks and the script of each block, as published by Unicode (coarse)
_BLOCKS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"),
    (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB07, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
_FIRST = [b for b, _ in _BLOCKS]


def script(char: str) -> str:
    return _BLOCKS[bisect_right(_FIRST, ord(char)) - 1][1]


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _grams(word: str) -> list[int]:
    """Cells of the n-grams of one to four characters of a word and of the word itself."""
    w = f" {word} ".encode("utf-8", "surrogatepass")
    # bytes rather than characters: the same n-grams, dearer for rare scripts only
    return [zlib.crc32(w[i : i + n]) % CELLS for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [zlib.crc32(w) % CELLS]


@dataclass
class Model:
    languages: list[str]
    #: log probability of each n-gram cell, by language
    table: np.ndarray
    scripts: dict[str, np.ndarray]
    #: mean log probability of the n-grams learned from, and of cells at random, by language
    typical: np.ndarray
    random: np.ndarray


def learn(texts: list[tuple[str, str]]) -> Model:
    """From (language, whole text) rows."""
    languages = sorted({lang for lang, _ in texts})
    counts = np.zeros((len(languages), CELLS), np.float64)
    used: dict[str, np.ndarray] = {}
    seen = []
    for k, lang in enumerate(languages):
        words = Counter()
        for own, text in texts:
            if own == lang:
                words.update(text.lower().split())
        kinds: Counter = Counter()
        cells, weight, times = [], [], []
        for word, n in words.items():
            if letters := _letters(word):
                found = _grams(letters)
                cells += found
                weight += [min(n, 50)] * len(found)  # a passage found in many documents isn't the language
                times += [n] * len(found)
                kinds[script(letters[0])] += n * len(letters)
        seen.append((np.array(cells, np.int64), np.array(times, np.float64)))
        np.add.at(counts[k], np.array(cells, np.int64), np.array(weight, np.float64))
        total = sum(kinds.values())
        for name, n in kinds.items():
            if n >= SCRIPT_SHARE * total:
                used.setdefault(name, np.zeros(len(languages), bool))[k] = True
    rate = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * CELLS)
    table = np.log(rate).astype(np.float32).T.copy()
    typical = np.array([table[cells, k] @ times / max(1.0, times.sum()) for k, (cells, times) in enumerate(seen)])
    return Model(languages, table, used, typical, table.mean(axis=0, dtype=np.float64))


class Labeller:
    def __init__(self, model: Model, words: int = WORDS):
        self.m = model
        n = len(model.languages)
        self.rows, self.lengths = np.zeros((1024, n)), np.zeros(1024, np.int64)
        # sums of log probabilities and numbers of n-grams; no n-grams: no language writes in the script
        self.sums, self.grams = np.zeros((1024, n), np.float32), np.zeros(1024, np.int32)
        # forms with other marks share the row of their letters
        self.forms = common.Memo(self._row, words)
        self.memo = common.Memo(lambda word: self.forms[_letters(word)], words)  # by `numbers`, as a rule

    def _row(self, letters: str) -> int:
        return self._fill([letters])

    def _fill(self, forms: list[str]) -> int:
        """Rows for forms that have none, in their order; the number of the first."""
        first, n = len(self.forms), len(forms)
        while first + n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.grams = np.concatenate([self.grams, np.zeros_like(self.grams)])
        for own in (self.rows, self.sums, self.grams):
            own[first : first + n] = 0
        self.lengths[first : first + n] = list(map(len, forms))
        kinds: dict[str, list[int]] = {}
        for j, letters in enumerate(forms):
            if letters:
                kinds.setdefault(script(letters[0]), []).append(j)
        for name, own in kinds.items():
            candidates = self.m.scripts.get(name)
            if candidates is None:
                continue
            found = [_grams(forms[j]) for j in own]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            cells = np.add.reduceat(self.m.table[flat], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            at = np.array(own) + first
            best = cells[:, candidates].max(axis=1, keepdims=True)
            least = -LEAST * np.maximum(1.0, self.lengths[at, None] / LETTERS)
            self.rows[at] = np.where(candidates, np.maximum((cells - best) / 2, least), least)
            self.sums[at], self.grams[at] = cells, sizes
        return first

    def numbers(self, words: list[str]) -> np.ndarray:
        """The row of each word. Forms that are new get theirs together, some at a time."""
        found = list(map(self.memo.get, words))
        if None in found:
            new = {w: _letters(w) for w, row in zip(words, found) if row is None}
            forms = [w for w in dict.fromkeys(new.values()) if w not in self.forms]
            for start in range(0, len(forms), FORMS):
                some = forms[start : start + FORMS]
                self.forms.update(zip(some, count(self._fill(some))))
            self.memo.update((w, self.forms[letters]) for w, letters in new.items())
            found = list(map(self.memo.get, words))
        return np.array(found, np.int64)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word on the best path."""
        if not len(scores):
            return np.zeros(0, np.int64)
        one = int(np.argmax(scores.sum(axis=0)))
        gain = np.delete(scores, one, axis=1)
        if gain.shape[1] == 0:
            return np.zeros(len(scores), np.int64)
        # what leaving the one language could win over any run of words: below the penalty, no path leaves it
        run = np.cumsum(gain.max(axis=1) - scores[:, one])
        if (run - np.minimum.accumulate(np.concatenate(([0.0], run[:-1])))).max() <= SWITCH:
            return np.full(len(scores), one)
        # plain floats, block by block: arrays of a few languages cost more than what is done with them
        best, gains = scores[0].tolist(), np.empty(scores.shape)
        gains[0] = best
        for start in range(1, len(scores), BLOCK):
            rows = []
            for row in scores[start : start + BLOCK].tolist():
                low = max(best) - SWITCH
                best = [(x if x >= low else low) + y for x, y in zip(best, row)]
                rows.append(best)
            gains[start : start + BLOCK] = rows
        top = gains.argmax(axis=1)
        # the last word up to each after which a language's path comes from the best one
        left = np.where(gains >= gains.max(axis=1, keepdims=True) - SWITCH, -1, np.arange(len(gains))[:, None])
        left = np.maximum.accumulate(left, axis=0)
        out = np.empty(len(scores), np.int64)
        t = len(scores) - 1
        at = int(top[t])
        while t >= 0:
            before = int(left[t - 1, at]) if t else -1
            out[before + 1 : t + 1] = at
            t, at = before, int(top[before])
        return out

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]], str | None]:
        """Label, score, spans (first word, word after the last, label) and the learned language with the most letters, whatever the
        `und` ones; spans hold words with letters only, and without a letter there is no such language."""
        if self.memo.fresh():
            self.forms.clear()
        words = self.numbers(text.lower().split()) if text else np.zeros(0, np.int64)
        lengths = self.lengths[words]
        at = np.flatnonzero(lengths)
        if not len(at) or not self.m.languages:
            return UNDETERMINED, 0.0, [], None
        own = words[at]
        known = self.grams[own] > 0
        path = np.full(len(own), -1)
        path[known] = self.path(self.rows[own[known]])
        share = np.bincount(path + 1, self.lengths[own], len(self.m.languages) + 1)
        names = [*self.m.languages, UNDETERMINED]
        cut = np.flatnonzero(np.diff(path)) + 1
        bounds = [0, *cut.tolist(), len(path)]
        spans = [(int(at[a]), int(at[b - 1]) + 1, names[path[a]]) for a, b in zip(bounds, bounds[1:])]
        top = int(share[1:].argmax())
        if share[0] >= share[top + 1]:
            return UNDETERMINED, 0.0, spans, names[top]
        mine = own[path == top]
        return names[top], float(share[top + 1] / share.sum()) * self.fit(mine, top), spans, names[top]

    def fit(self, words: np.ndarray, k: int) -> float:
        """How well words fit language k, from 0 to 1."""
        low, high = self.m.random[k], self.m.typical[k]
        at = (float(self.sums[words, k].sum(dtype=np.float64)) / int(self.grams[words].sum()) - low) / max(high - low, 1e-9)
        return min(1.0, max(0.0, (at - POOR) / (GOOD - POOR)))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learns=None, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from at most per_language documents of each language for which the condition `learns` holds."""
    rows = df.select(df[key].alias("key"), df[text].alias("text"), df[lang].alias("lang"), (F.lit(True) if learns is None else learns).alias("ok"))
    rows = rows.where("ok AND lang IS NOT NULL AND text IS NOT NULL AND key IS NOT NULL").where(F.char_length("text") <= LONGEST)
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    rows = rows.join(F.broadcast(most), "lang", "left_semi")
    # without the texts; ids that repeat count once, and so do their texts
    chosen = common.stratified(rows.select("key", "lang").distinct(), "key", "lang", per_language)
    found = common.one_text(rows.join(F.broadcast(chosen), ["key", "lang"]), "key", "lang").orderBy("key", "lang").select("lang", "text").collect()
    return learn([(r[0], r[1]) for r in found])


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """key, lang_pred, score, n_spans, lang_best (the learned language that comes nearest, null without a letter) and, if asked for,
    spans (of words: first, after the last, lang)."""
    known = df.sparkSession.sparkContext.broadcast(model)  # CELLS rows, whatever the corpus

    token = common.token()

    def start():
        labeller = common.per_worker("language", token, lambda: Labeller(known.value))

        def each(batch):
            found = [labeller.label(t) for t in batch.column(1).to_pylist()]
            out = {"key": batch.column(0), "lang_pred": pa.array([f[0] for f in found]), "score": pa.array([f[1] for f in found], pa.float64()), "n_spans": pa.array([len(f[2]) for f in found], pa.int32()), "lang_best": pa.array([f[3] for f in found], pa.string())}
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                out["spans"] = pa.array([[dict(zip(("start", "end", "lang"), s)) for s in f[2]] for f in found], kind)
            return out

        return each

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double, n_spans int, lang_best string" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return common.arrow_map(df.select(df[key].alias("key"), df[text].alias("text")), schema, start).withColumnRenamed("key", key)


def keep(df: DataFrame, model: Model, least_share: float, text: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of df whose text has a language with at least this score, in the same pass, so that no text travels."""
    known, token, at = df.sparkSession.sparkContext.broadcast(model), common.token(), df.columns.index(text)

    def run(batches):
        labeller = common.per_worker("language", token, lambda: Labeller(known.value, words))
        for batch in batches:
            found = (labeller.label(t) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least_share for lang, score, *_ in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def learnable(key: str = "doc_id"):
    """The documents of the query's contract to learn from."""
    return common.fold(key, 4) != 2

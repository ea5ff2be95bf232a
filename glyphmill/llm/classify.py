"""Quality and toxicity classifiers, both trained with numpy on bounded samples of labelled rows.

Quality: supervised subword embeddings. A word's vector is the mean of learned vectors of the word and of its character
n-grams, hashed to a table of fixed size. A document's vector is the average over its words of these and of the learned,
hashed vectors of its word n-grams; an n-gram that a document has had already isn't counted again, though its words are. So
a text that says the same thing over and over has little of what word n-grams have learned to stand for. A softmax over two
classes follows. Training is stochastic gradient descent on as many rows of either class; the prior of the classes is
added after. As all of it up to the softmax is linear, a word's share in the logit is computed once for each distinct word.

Toxicity: non-negative positive-unlabelled learning. Confirmed toxic documents and unlabelled ones train a linear model
over the words that a text has; the risk of the unlabelled, corrected by the class prior for the toxic ones among them,
is kept from turning negative.

Null and empty texts have a defined score (that of a document without words), very long ones are scored whole. Empty tables give
empty ones; without labelled rows every score is the same. Other columns of the tables aren't read. Repeated rows are scored each for itself.
Ties in score don't matter: a row's score depends on its text only.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Characters of a text to learn from, at most, so that what the driver gets is bounded.
LONGEST = 200_000
#: Rows of each class to learn quality from, at most; and rows of each kind for toxicity.
PER_CLASS, PER_KIND = 1500, 2000
#: Rows of the tables of hashed vectors.
CELLS = 1 << 17
WIDTH, EPOCHS, RATE = 8, 6, 0.5
#: Rows of the table of word n-grams, as a power of two: few, so that each has been learned from many.
GRAM_BITS = 12
#: Words of the n-grams.
ORDERS = (1, 2, 3)
#: A short text's words count as if there were so many more, of no class.
SMOOTH = 4
#: A word needs a difference of so many standard deviations between toxic and unlabelled texts to be of use. Measured without
#: (sf0.1, 352 toxic rows, held out): AUC 0.942 to 0.978 and 3 to 6 % false positives by the strength of the soft threshold; with
#: it 0.968 and 1.2 %. See evaluate.py.
SIGNIFICANT = 6.0
#: Share of the toxic texts that a threshold must catch for the class prior to be read off there.
CAUGHT = 0.25
_EDGE = string.punctuation + "“”„‘’«»…–—¡¿"


def _cells(word: str) -> list[int]:
    """Cells of a word and of its n-grams of three and four characters, with its case and its marks."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    if len(w) == len(word) + 2:
        at = range(len(w) + 1)
    else:  # where its characters begin
        at = [i for i, byte in enumerate(w) if byte & 0xC0 != 0x80] + [len(w)]
    return [zlib.crc32(w) % CELLS] + [zlib.crc32(w[at[i] : at[i + n]], 1) % CELLS for n in (3, 4) for i in range(len(at) - n)]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Cells of the distinct n-grams of a text's words, given the words' hashes."""
    parts, now = [], hashes
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            now = (now[:-1] ^ (now[:-1] >> np.uint64(29))) * _MIX + hashes[n - 1 :]
        if n in ORDERS and len(now):
            parts.append(((np.unique(now) * _MIX) >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + CELLS)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def sampled(df: DataFrame, labels: DataFrame, label: str, learns: Column, bound: int, key: str = "doc_id", text: str = "text") -> list[tuple[int, str]]:
    """(label, whole text) of at most bound rows of each label, of texts up to LONGEST. Ids are chosen first; texts of chosen rows only travel."""
    marks = labels.select(F.col(key).alias("key"), F.col(label).alias("label"), learns.alias("ok")).where("ok AND label IN (0, 1) AND key IS NOT NULL")
    chosen = common.stratified(marks.select("key", "label").distinct(), "key", "label", bound)
    rows = df.select(df[key].alias("key"), df[text].alias("text")).where("text IS NOT NULL").where(F.char_length("text") <= LONGEST)
    found = common.one_text(rows.join(F.broadcast(chosen), "key"), "key", "label").orderBy("key", "label").select("label", "text").collect()
    return [(r[0], r[1]) for r in found]


@dataclass
class Subwords:
    """What a cell adds to the logit of class 1, and what a document without words has."""

    cells: np.ndarray
    bias: float


def train_subwords(rows: list[tuple[int, str]], prior: float = 0.5, epochs: int = EPOCHS, seed: int = 3) -> Subwords:
    if len({label for label, _ in rows}) < 2:
        return Subwords(np.zeros(CELLS + (1 << GRAM_BITS), np.float32), 0.0 if not rows else (2.0 if rows[0][0] else -2.0))
    rng = np.random.default_rng(seed)
    docs = []
    for _, text in rows:
        words, numbers = text.split(), {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        once = _grams(np.array([_hash(w) for w in numbers], np.uint64)[ids])
        cells, weight = once.tolist(), [1 / (len(words) + SMOOTH)] * len(once)
        for word, n in zip(numbers, np.bincount(ids, minlength=len(numbers)) / (len(words) + SMOOTH)):
            c = _cells(word)
            cells += c
            weight += [n / len(c)] * len(c)
        at, back = np.unique(np.array(cells, np.int64), return_inverse=True)
        docs.append((at, np.bincount(back, np.array(weight, np.float64), len(at)).astype(np.float32)))
    y = np.array([label for label, _ in rows], np.int64)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (CELLS + (1 << GRAM_BITS), WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2) / len(y)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, weight = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(at):
                continue
            hidden = weight @ vectors[at]
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= 0.5 / share[y[i]]
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # a document's mean spreads a step over many cells; a cell's own step makes up for it
            vectors[at] -= rate * np.minimum(20 * weight, 1)[:, None] * back
    return Subwords(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]) + math.log(prior / (1 - prior)))


@dataclass
class Marks:
    """Weights of cells in a text or not, for the words that matter."""

    weights: dict[int, float]
    bias: float
    prior: float = 0.0


def _plain(word: str) -> str:
    return word.strip(_EDGE).lower()


def _cell_list(word: str) -> list[int]:
    """Hashes of a word without its marks and case, and of its beginnings of three to eight characters."""
    word = _plain(word)
    w = word.encode("utf-8", "surrogatepass")
    return [zlib.crc32(w)] + [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) for n in range(3, 9) if n <= len(word)] if word else []


def _unlike(texts: list[np.ndarray], sketch: int = 16, shared: int = 8) -> list[np.ndarray]:
    """Texts, as their sorted cells, of which no earlier one is a near copy, by the smallest cells of each."""
    seen: dict[int, list[int]] = {}
    kept = []
    for i, cells in enumerate(texts):
        low = cells[:sketch].tolist()
        met = Counter(j for c in low for j in seen.get(c, ()))
        if not met or met.most_common(1)[0][1] < min(shared, len(low)):
            kept.append(cells)
            for c in low:
                seen.setdefault(c, []).append(i)
    return kept


def _common(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: int, significant: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells more frequent in the toxic texts than chance explains, with the log odds of a toxic text's having one."""
    n_p, n_u = len(positive), len(unlabelled)
    (own, ours), (other, theirs) = (np.unique(np.concatenate([*sets, np.zeros(0, np.uint32)]), return_counts=True) for sets in (positive, unlabelled))
    there = np.isin(own, other)
    both = ours.astype(np.float64)
    both[there] += theirs[np.searchsorted(other, own[there])]
    share = both / (n_p + n_u)
    apart = ours / n_p - (both - ours) / max(1, n_u)
    kept = (both >= least) & (apart > significant * np.sqrt(share * (1 - share) * (1 / n_p + 1 / max(1, n_u))))
    odds = np.log((ours + 0.5) / (n_p + 1)) - np.log((both - ours + 0.5) / (n_u + 1))
    return own[kept], odds[kept]


def class_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: int = 5, significant: float = 4.0) -> float:
    """The share of positive texts among the unlabelled, estimated from the two samples alone.

    Where a score is above t, the unlabelled texts hold at least prior times as many as the positive ones: the prior is no more
    than the least ratio of the two shares, over thresholds that catch CAUGHT of the positive texts or more. Scores are sums of log
    odds learned from the other half of each sample.
    """
    ratios = []
    for half in (0, 1):
        cells, odds = _common(positive[half::2] or positive, unlabelled[half::2] or unlabelled, max(2, least // 2), significant)
        if not len(cells):
            continue
        score = lambda s: float(odds[np.searchsorted(cells, s[np.isin(s, cells)])].sum())  # noqa: E731, B023
        p, u = (np.sort([score(s) for s in sets[1 - half :: 2] or sets]) for sets in (positive, unlabelled))
        if not len(p) or not len(u):
            continue
        at = np.unique(p)
        caught, found = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / max(1, len(u))
        ok = caught >= CAUGHT
        # one standard error on the safe side, as the least of many ratios is too small
        ratios.append(float(((found[ok] + np.sqrt(found[ok] / max(1, len(u)))) / (caught[ok] - np.sqrt(caught[ok] * (1 - caught[ok]) / len(p)))).min()))
    return float(np.mean(ratios)) if ratios else 0.0


def train_marks(toxic: list[str], unlabelled: list[str], prior: float | None = None, epochs: int = 40, rate: float = 0.2, seed: int = 5, least: int = 5, significant: float = SIGNIFICANT) -> Marks:
    """Non-negative PU risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), logistic loss, by mini-batches with a soft threshold on the weights.

    Without a prior it is estimated by class_prior().
    """
    if not toxic:
        return Marks({}, -4.0)
    memo = common.Memo(_cell_list)
    kinds = []
    for texts in (toxic, unlabelled):
        sets = []
        for text in texts:
            flat: list[int] = []
            for word in set(text.split()):
                flat += memo[word]
            sets.append(np.unique(np.array(flat, np.uint32)))
        kinds.append(_unlike(sets))
    memo.clear()
    n_p, n_u = len(kinds[0]), len(kinds[1])
    prior = min(0.5, max(0.01, class_prior(*kinds) if prior is None else prior))
    kept, _ = _common(*kinds, least, significant)
    rows = [np.searchsorted(kept, s[np.isin(s, kept)]) for s in [*kinds[0], *kinds[1]]]
    weight, bias = np.zeros(len(kept)), -1.0
    moment, square = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    rng = np.random.default_rng(seed)
    size, step = 512, 0

    def gradient(chosen: list[np.ndarray], sign: int) -> tuple[float, np.ndarray, float]:
        """Mean logistic loss for the sign, with its gradient."""
        flat = np.concatenate(chosen)
        owner = np.repeat(np.arange(len(chosen)), [len(r) for r in chosen])
        z = sign * (np.bincount(owner, weight[flat], len(chosen)) + bias)
        pull = -sign / (1 + np.exp(np.clip(z, -40, 40))) / len(chosen)
        return float(np.logaddexp(0, -z).mean()), np.bincount(flat, pull[owner], len(weight)), float(pull.sum())

    batches = max(25, (n_p + n_u) // (2 * size))  # few rows need as many steps
    for epoch in range(epochs if n_u else 0):
        for _ in range(batches):
            p = [rows[i] for i in rng.integers(0, n_p, size)]
            u = [rows[n_p + i] for i in rng.integers(0, n_u, size)]
            _, g_plus, b_plus = gradient(p, 1)
            l_minus, g_minus, b_minus = gradient(p, -1)
            l_u, g_u, b_u = gradient(u, -1)
            if l_u - prior * l_minus >= 0:
                g, b = prior * g_plus + g_u - prior * g_minus, prior * b_plus + b_u - prior * b_minus
            else:  # the corrected risk counts as zero
                g, b = prior * g_plus, prior * b_plus
            step += 1
            full = np.append(g, b)
            moment = 0.9 * moment + 0.1 * full
            square = 0.999 * square + 0.001 * full * full
            move = rate * (1 - epoch / epochs) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-4)
            weight -= move[:-1]
            bias -= move[-1]
            weight = np.sign(weight) * np.maximum(np.abs(weight) - 1e-3 * rate, 0)
    return Marks({int(c): float(w) for c, w in zip(kept, weight) if abs(w) > 1e-9}, float(bias), prior)


def _scores(df: DataFrame, key: str, text: str, start) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    rows = common.arrow_map(df.select(df[key].alias("key"), df[text].alias("text")), f"key {kind}, score double", start)
    return rows.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


class Scorer:
    """Scores texts; remembers what each word adds."""

    def __init__(self, model: Subwords):
        self.cells, self.bias = model.cells, model.bias
        self.values, self.hashes = np.zeros(1024), np.zeros(1024, np.uint64)
        self.memo = common.Memo(self._number)

    def _number(self, word: str) -> int:
        i = len(self.memo)
        if i >= len(self.values):
            self.values, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.values, self.hashes))
        self.values[i], self.hashes[i] = self.cells[_cells(word)].mean(), _hash(word)
        return i

    def __call__(self, text: str | None) -> float:
        self.memo.fresh()
        ids = np.fromiter(map(self.memo.__getitem__, (text or "").split()), np.int64)
        z = self.bias + float(self.values[ids].sum() + self.cells[_grams(self.hashes[ids])].sum(dtype=np.float64)) / (len(ids) + SMOOTH)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def score_quality(df: DataFrame, model: Subwords, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (of label 1), predicted."""
    known, token = df.sparkSession.sparkContext.broadcast(model), common.token()

    def start():
        scorer = common.per_worker("quality", token, lambda: Scorer(known.value))
        return lambda batch: {"key": batch.column(0), "score": pa.array(map(scorer, batch.column(1).to_pylist()), pa.float64())}

    return _scores(df, key, text, start)


def marks_scorer(model: Marks):
    """The function that scores a text; it remembers which cells that count each word has."""
    weights, bias, none = model.weights, model.bias, frozenset()
    # most words have no cell that counts
    memo = common.Memo(lambda w: frozenset(c for c in _cell_list(w) if c in weights))

    def one(t):
        memo.fresh()
        z = bias + math.fsum(map(weights.__getitem__, none.union(*map(memo.__getitem__, (t or "").split()))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    return one


def score_marks(df: DataFrame, model: Marks, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (of label 1), predicted."""
    known, token = df.sparkSession.sparkContext.broadcast(model), common.token()

    def start():
        one = common.per_worker("toxicity", token, lambda: marks_scorer(known.value))
        return lambda batch: {"key": batch.column(0), "score": pa.array(map(one, batch.column(1).to_pylist()), pa.float64())}

    return _scores(df, key, text, start)


def fit_quality(df: DataFrame, labels: DataFrame, learns: Column, bound: int = PER_CLASS) -> Subwords:
    share = labels.where(learns).where("quality IN (0, 1)").agg(F.avg("quality")).first()[0]
    return train_subwords(sampled(df, labels, "quality", learns, bound), min(0.99, max(0.01, 0.5 if share is None else share)))


def fit_toxicity(df: DataFrame, labels: DataFrame, learns: Column, unlabelled: Column, bound: int = PER_KIND) -> Marks:
    """learns: labels that may be read, of which only the toxic ones are; unlabelled: documents whose text may serve as unlabelled."""
    toxic = [t for mark, t in sampled(df, labels.where("toxic = 1"), "toxic", learns, bound) if mark]
    rows = df.where(unlabelled).select(F.col("doc_id").alias("key"), F.lit(0).alias("all")).where("key IS NOT NULL")
    chosen = rows.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(bound * 2).select("key").distinct()
    read = df.select(df["doc_id"].alias("key"), "text").where("text IS NOT NULL").where(F.char_length("text") <= LONGEST)
    texts = common.one_text(read.join(F.broadcast(chosen), "key", "left_semi"), "key").orderBy("key").select("text").collect()
    return train_marks(toxic, [r[0] for r in texts])

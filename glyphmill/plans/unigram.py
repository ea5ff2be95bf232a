"""The Unigram model's best path as a fold, over the words of a corpus as a table.

Every piece of the vocabulary that a word holds is an edge from where it begins to where it ends: the substrings of at most the longest
piece's characters, looked up in a constant table (its size is the model's, not the corpus'). A character that is no
piece is an edge of its own, at ten below the lowest score. A word's edges, by their ends, are folded from left to right; the
accumulator holds the best scores of the last places only, as many as the longest piece has characters, and where each best path
comes from. A second fold goes back along it and puts neighbouring unknown characters together. Nothing but distinct words is shuffled.

Of equal scores the longer last piece wins. Words come once, however often they are in the corpus; null isn't a word, the empty word
has no pieces and the score 0. A word's edges are one value, so words of many thousand characters take time with the square of their
length: a pre-tokenizer comes before. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr
from ..functions.pipeline import Unsupported
from ..operators.tokenizer import Spec

#: How far below the lowest score an unknown character lies.
BELOW = 10.0
PATH = "array<struct<start:int,unknown:boolean,id:int>>"


def _ends(word: Column, spec: Spec, longest: int, unknown: float) -> Column:
    """For each end in a word, in order, the edges that end there, from the longest to the shortest."""
    if spec.model.get("byte_fallback"):
        raise Unsupported("no expression for bytes of unknown characters")
    # of a piece that comes twice the last
    known = expr.lookup({piece: {"score": float(score), "id": i} for i, (piece, score) in enumerate(spec.model["vocab"])}, "struct<score:double,id:int>")

    def edges(end: Column) -> Column:
        starts = F.sequence(F.greatest(F.lit(0), end - longest), end - 1)
        found = F.transform(starts, lambda at: F.struct(at.alias("start"), known(F.substring(word, at + 1, end - at))["value"].alias("has")))
        kept = F.filter(found, lambda x: x["has"].isNotNull() | (x["start"] == end - 1))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.coalesce(x["has"]["score"], F.lit(unknown)).alias("score"), x["has"].isNull().alias("unknown"), x["has"]["id"].alias("id")))

    return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda end: F.struct(end.alias("end"), edges(end).alias("edges")))


def _forward(ends: Column, longest: int) -> Column:
    """struct(window, path): the best scores of the last places, and for each place where the best path to it comes from."""

    def step(acc: Column, here: Column) -> Column:
        # the window's last score is that of the place before this end
        total = F.transform(here["edges"], lambda e: F.struct((F.element_at(acc["window"], e["start"] - here["end"]) + e["score"]).alias("score"), (-e["start"]).alias("nearer"), e["unknown"].alias("unknown"), e["id"].alias("id")))
        window = F.when(F.size(acc["window"]) < longest, acc["window"]).otherwise(F.slice(acc["window"], 2, longest - 1))

        def after(best: Column) -> Column:
            came = F.struct((-best["nearer"]).alias("start"), best["unknown"].alias("unknown"), best["id"].alias("id"))
            return F.struct(F.concat(window, F.array(best["score"])).alias("window"), F.concat(acc["path"], F.array(came)).alias("path"))

        # an array of one, so that the best is looked for once
        return F.get(F.transform(F.array(F.array_max(total)), after), F.lit(0))

    return F.aggregate(ends, F.struct(F.array(F.lit(0.0)).alias("window"), F.array().cast(PATH).alias("path")), step)


def _back(path: Column) -> Column:
    """struct(start, end, unknown, id) of each piece, in order."""

    def step(acc: Column, at: Column) -> Column:
        came = F.element_at(path, at)
        last = F.try_element_at(acc["pieces"], F.lit(-1))
        grows = F.coalesce(came["unknown"] & last["unknown"], F.lit(False))
        piece = F.struct(came["start"].alias("start"), F.when(grows, last["end"]).otherwise(at).alias("end"), came["unknown"].alias("unknown"), came["id"].alias("id"))
        before = F.when(grows, F.slice(acc["pieces"], 1, F.size(acc["pieces"]) - 1)).otherwise(acc["pieces"])
        return F.when(acc["at"] == at, F.struct(came["start"].alias("at"), F.concat(before, F.array(piece)).alias("pieces"))).otherwise(acc)

    nothing = F.array().cast("array<struct<start:int,end:int,unknown:boolean,id:int>>")
    return F.reverse(F.aggregate(F.reverse(F.sequence(F.lit(1), F.size(path))), F.struct(F.size(path).alias("at"), nothing.alias("pieces")), step)["pieces"])


def best_paths(words: DataFrame, spec: Spec) -> DataFrame:
    """word, score, pieces (text, id) of each distinct word of a column `word`."""
    scores = [float(s) for _, s in spec.model["vocab"]]
    longest = max((len(p) for p, _ in spec.model["vocab"]), default=1)
    unk = spec.model.get("unk_id")
    distinct = words.select("word").where("word IS NOT NULL").distinct()
    # in as many parts as are set, as the folds are work, not bytes
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.where("word <> ''").repartition(parts, "word")
    folded = dealt.select("word", _forward(_ends(F.col("word"), spec, max(1, longest), min(scores, default=0.0) - BELOW), max(1, longest)).alias("f"))
    paths = folded.select("word", F.element_at("f.window", -1).alias("score"), _back(F.col("f.path")).alias("p"))

    def of(p: Column) -> Column:
        text = F.substring(F.col("word"), p["start"] + 1, p["end"] - p["start"])
        missing = F.raise_error(F.lit("a piece is unknown and the model has no unk_id")).cast("int") if unk is None else F.lit(unk)
        return F.struct(text.alias("text"), F.when(p["unknown"], missing).otherwise(p["id"]).alias("id"))

    found = paths.select("word", "score", F.transform("p", of).alias("pieces"))
    empty = distinct.where("word = ''").select("word", F.lit(0.0).alias("score"), F.array().cast("array<struct<text:string,id:int>>").alias("pieces"))
    return found.unionByName(empty)

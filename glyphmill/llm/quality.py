"""Quality rules as a short-circuit cascade, in built-in expressions only.

Base counts are part of every row. The further rules are conditions of which one is enough to reject; a document that
fails one, or the base rule, needs none of the others. Rules are nested CASEs: what lies behind a condition is evaluated for the rows that
get there, which an OR doesn't promise, as Spark evaluates what two operands share before it looks at either. What rules share (a text's
letters, its lines) is a value bound where the cascade first needs it, for all that follows there.

Each rule's cost and selectivity are measured on a sample of about SAMPLE rows from all partitions, what is shared apart. Next comes
the rule that rejects most per second, where a rule that is the first to need a shared value pays for it. Costs are what two
readings of the JVM's clock differ by, row by row and PASSES times, so that neither jobs nor reading count; they are
rounded to a power of two, so that noise seldom changes the order. The order changes the time, never the verdict.

Words are runs of characters other than U+0020 and U+0009 to U+000D. Null and empty texts have no words and fail the base
rule. Three-word windows are compared by their 64-bit hash (two different windows of a text of 20,000 words share one with
a probability of about 1e-11). Repeated rows are judged each for itself, ties don't arise. Very long texts are read whole. Empty
tables give empty ones. judge() replaces columns with the names of its own, keep() leaves all columns as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Documents on which costs and selectivities are estimated, about; and how often each is judged by each rule.
SAMPLE, PASSES = 3000, 3


@dataclass(frozen=True)
class Rule:
    """A document is rejected if the SQL condition over its text, base counts and shared values holds."""

    name: str
    reject: str
    uses: tuple[str, ...] = ()


#: Values that several rules need, in SQL over the text.
SHARED = {"__letters": r"char_length(regexp_replace(text, '[^\\p{L}]+', ''))", "__rows": r"split(text, '\n')"}
#: None of these can reject an ordinary text: each asks for a share that prose stays far from.
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", r"2 * char_length(regexp_replace(text, '[^\\p{Lu}]+', '')) > __letters", ("__letters",)),
    Rule("few_letters", "2 * __letters < word_chars", ("__letters",)),
    Rule("exclamations", "10 * (char_length(text) - char_length(translate(text, '!?', ''))) > 3 * n_words"),
    Rule("cut_lines", "n_lines >= 10 AND 10 * size(filter(__rows, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) > 3 * n_lines", ("__rows",)),
    Rule("bullets", "n_lines >= 10 AND 10 * size(filter(__rows, x -> ltrim(x) RLIKE '^[-*•]')) > 9 * n_lines", ("__rows",)),
)


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_lines, n_symbols, n_dup_lines, n_repeat_words (long) to df, which keeps its columns."""
    t, own = F.coalesce(F.col(text), F.lit("")), df.columns
    df = df.withColumn("__words", F.filter(F.split(t, BLANK + "+"), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn(
        # the hash of each three-word window, by its first word
        "__windows",
        F.expr("CASE WHEN size(__words) < 3 THEN array() ELSE transform(sequence(0, size(__words) - 3), i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2))) END"),
    )
    df = df.withColumn(
        "__sorted",
        F.expr("CASE WHEN size(array_distinct(__windows)) = size(__windows) THEN NULL ELSE sort_array(transform(__windows, (h, i) -> struct(h, i))) END"),
    )
    # first words of the windows that have an equal neighbour in sorted order
    df = df.withColumn(
        "__found",
        F.expr("CASE WHEN __sorted IS NOT NULL THEN sort_array(transform(filter(__sorted, (x, k) -> x.h = get(__sorted, k - 1).h OR x.h = get(__sorted, k + 1).h), x -> x.i)) END"),
    )
    found = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        # a window covers three words, less those that the window before it covers
        F.expr("coalesce(aggregate(transform(__found, (p, k) -> least(3, p - coalesce(get(__found, k - 1), -3))), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"),
    )
    # a generator of one row: filters on the counts stay above it, where the optimizer can't write each count's whole
    # expression into them again
    return df.select(*own, F.inline(F.array(found)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sampled(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """About `sample` texts, of all partitions alike; all of a table that has no more."""
    rows = df.select(F.col(text).alias("text"))
    count = rows.count()  # of Parquet, from its footers
    return rows if count <= sample else rows.sample(fraction=sample / count, seed=7)


def ordered(counted: DataFrame, rules: tuple[Rule, ...] = RULES, passes: int = PASSES) -> list[tuple[Rule, float, float]]:
    """Rules with their rejected share and seconds a row on a sample of counted rows, in the order of the cascade."""
    needed = sorted({u for r in rules for u in r.uses})
    rows = counted.persist()
    bound = rows.select("*", *(F.expr(SHARED[u]).alias(u) for u in needed)).persist()
    clock = "cast(reflect('java.lang.System', 'nanoTime') AS long)"

    def measured(over: DataFrame, condition: str) -> tuple[float, float]:
        # a generator between keeps the readings on either side of the condition
        timed = over.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes)))).select(F.expr(f"struct({clock} AS a, coalesce({condition}, false) AS hit, {clock} AS b)").alias("t"))
        r = timed.agg(F.count("*").alias("n"), F.count_if("t.hit").alias("hits"), F.sum(F.col("t.b") - F.col("t.a")).alias("ns")).first()
        n = max(1, r["n"])
        return r["hits"] / n, 2.0 ** round(math.log2(max(1.0, (r["ns"] or 0) / n))) / 1e9

    try:
        shared = {u: measured(rows, f"({SHARED[u]}) IS NOT NULL")[1] for u in needed}
        left = [(r, *measured(bound, r.reject)) for r in rules]
    finally:
        bound.unpersist()
        rows.unpersist()
    found: list[tuple[Rule, float, float]] = []
    while left:
        paid = {u for r, _, _ in found for u in r.uses}
        whole = [(r, share, cost + sum(shared[u] for u in r.uses if u not in paid)) for r, share, cost in left]
        best = max(range(len(left)), key=lambda k: (whole[k][1] / whole[k][2], -k))
        found.append(whole[best])
        left.pop(best)
    return found


def cascade(order: list[Rule], base: str = "base_failed") -> str:
    """SQL of the verdict, true for rejected: each rule behind those before it, each shared value bound where it is first needed."""
    out = "false"
    for k in range(len(order) - 1, -1, -1):
        out = f"CASE WHEN coalesce({order[k].reject}, false) THEN true ELSE {out} END"
        before = {u for r in order[:k] for u in r.uses}
        for use in order[k].uses:
            if use not in before:
                out = f"get(transform(array({SHARED[use]}), {use} -> {out}), 0)"
    return f"CASE WHEN {base} THEN true ELSE {out} END"


OWN = ("n_words", "word_chars", "n_lines", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the base counts, base_failed and kept. Columns of df with the names of these are replaced."""
    df = df.select(*[c for c in df.columns if c not in OWN])
    renamed = df if text == "text" else df.withColumnsRenamed({"text": "__own_text"}).withColumnRenamed(text, "text")
    out = counts(renamed).withColumn("base_failed", base_failed())
    verdict = cascade([r for r, _, _ in ordered(counts(sampled(df, text)), rules)])
    judged = out.withColumn("kept", ~F.expr(verdict))
    return judged if text == "text" else judged.withColumnRenamed("text", text).withColumnsRenamed({"__own_text": "text"})


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that are kept, with all columns of df, whatever their names."""
    aside = {c: f"__own_{c}" for c in df.columns if c in OWN}
    return judge(df.withColumnsRenamed(aside), text, rules).where("kept").select(*[F.col(aside.get(c, c)).alias(c) for c in df.columns])


#: DuckDB SQL for the same rows, by plain counting.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT win.doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN rep ON win.doc_id = rep.doc_id AND win.g = rep.g) GROUP BY doc_id),
c AS (SELECT w.doc_id, text, ls, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(ls)::BIGINT AS n_lines,
        (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        len(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, len(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals,
        len(text) - len(regexp_replace(text, '[!?]', '', 'g')) AS marks FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * capitals > letters OR 2 * letters < word_chars
    OR 10 * marks > 3 * n_words
    OR (n_lines >= 10 AND 10 * len(list_filter(ls, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) > 3 * n_lines)
    OR (n_lines >= 10 AND 10 * len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) > 9 * n_lines)) AS kept
FROM j
"""

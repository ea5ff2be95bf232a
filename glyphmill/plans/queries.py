"""Registered queries over the tables and, for each that SQL can state, the same rows in DuckDB's SQL."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import alignment, encodings, expr, tables, templates
from ..operators import stages
from ..operators.frames import TextPipeline
from ..operators.tokenizer import Spec, Tokenizer
from ..sources import spec as spec_files, tables as sources
from . import batches, dictionary, lineage, unigram

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Tokens of the vocabulary that queries take from the corpus.
TOP = 2000
_DUCK_WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"


#: A table of fewer partitions a core is dealt out before its texts are worked on.
SPREAD = 4


def _spread(df: DataFrame) -> DataFrame:
    """Small tables over all cores: a file of one row group is one task, however many cores wait. Larger ones are left where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < SPREAD * cores else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


def _arrays(name: str, make: Callable[[Column], Column], sql: str) -> None:
    """A query of an array of pieces for each document: their number and a digest."""
    QUERIES[name] = lambda spark, d: _docs(spark, d).select("doc_id", make(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\x1f")).alias("digest"))
    SQL[name] = f"SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, chr(31))) AS digest FROM (SELECT doc_id, {sql} AS p FROM documents)"


def _texts(name: str, make: Callable[[Column], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, d: _docs(spark, d).select("doc_id", make(F.col("text")).alias("t")).select("doc_id", F.octet_length("t").alias("n_bytes"), F.md5("t").alias("digest"))
    SQL[name] = f"SELECT doc_id, strlen(t)::INT AS n_bytes, md5(t) AS digest FROM (SELECT doc_id, {sql} AS t FROM documents)"


def _all(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all(text, '{quoted}')"


_arrays("pretok_whitespace", expr.whitespace, _all(rf"[{_DUCK_WORD}]+|[^\s{_DUCK_WORD}]+"))
_arrays("pretok_whitespace_split", expr.whitespace_split, r"list_filter(regexp_split_to_array(text, '[ \t\n\r]'), lambda x: x <> '')")
_arrays("pretok_digits", expr.digits, _all("[0-9]+|[^0-9]+"))
_arrays("pretok_digits_individual", lambda t: expr.digits(t, True), _all("[0-9]|[^0-9]+"))
_arrays("pretok_punct", expr.punctuation, _all(r"\p{P}|\P{P}+"))
_arrays("pretok_bert", expr.bert, _all(r"[!-/:-@\[-\x60{-~\p{P}]|[^\s!-/:-@\[-\x60{-~\p{P}]+"))
_arrays("pretok_char_delim", lambda t: expr.char_delimiter(t, "e"), "list_filter(string_split(text, 'e'), lambda x: x <> '')")
_arrays("pretok_metaspace", expr.metaspace, "regexp_extract_all(CASE WHEN replace(text, ' ', '▁') LIKE '▁%' OR text = '' THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END, '▁?[^▁]+|▁')")
for _name, _pattern in (("removed", "[^,]+"), ("isolated", ",|[^,]+"), ("contiguous", ",+|[^,]+"), ("merged_previous", "[^,]+,?|,"), ("merged_next", ",?[^,]+|,")):
    _behavior = {"removed": "Removed", "isolated": "Isolated", "contiguous": "Contiguous", "merged_previous": "MergedWithPrevious", "merged_next": "MergedWithNext"}[_name]
    _arrays(f"split_{_name}", lambda t, b=_behavior: expr.split_on(t, ",", b), _all(_pattern))
_texts("norm_lower", expr.lowercase, "lower(text)")
_texts("norm_strip", expr.strip, r"regexp_replace(text, '^\s+|\s+$', '', 'g')")
_texts("norm_replace", lambda t: expr.replace(t, "th", "$0\\"), r"replace(text, 'th', '$0\')")
_texts("norm_replace_regex", lambda t: expr.replace_regex(t, r"\d+", "0"), r"regexp_replace(text, '\p{Nd}+', '0', 'g')")
_texts("norm_prepend", lambda t: expr.prepend(t, "▁"), "CASE WHEN text <> '' THEN '▁' || text ELSE text END")
_texts("norm_strip_accents", expr.strip_accents, r"regexp_replace(text, '\p{Mn}', '', 'g')")
_texts("norm_nmt", expr.nmt, r"regexp_replace(regexp_replace(text, '[\x01-\x08\x0B\x0E-\x1F\x7F]', '', 'g'), '[\t\n\f\r]', ' ', 'g')")
_texts("byte_level_roundtrip", lambda t: expr.byte_level_back(expr.byte_level(t)), "text")
_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\s\p{L}\p{M}\p{Nd}\p{Pc}]+')"
_w = expr.whitespace
_texts("decode_wordpiece", lambda t: expr.decode_wordpiece(_w(t), "th"), f"array_to_string(list_transform({_TOKENS}, lambda x, i: CASE WHEN i = 1 THEN x WHEN x LIKE 'th%' THEN x[3:] ELSE ' ' || x END), '')")
_texts("decode_bpe", lambda t: expr.decode_bpe(_w(t), "on"), f"array_to_string(list_transform({_TOKENS}, lambda x, i: replace(x, 'on', CASE WHEN i = len({_TOKENS}) THEN '' ELSE ' ' END)), '')")
_texts("decode_metaspace", lambda t: expr.decode_metaspace(expr.metaspace(t)), "regexp_replace(replace(CASE WHEN text LIKE ' %' OR text = '' THEN text ELSE ' ' || text END, '▁', ' '), '^ ', '')")
_texts("decode_strip", lambda t: expr.decode_strip(_w(t), "e", 1, 2), f"array_to_string(list_transform({_TOKENS}, lambda x: regexp_replace(regexp_replace(x, '^e{{0,1}}', ''), 'e{{0,2}}$', '')), '')")
_texts("decode_replace", lambda t: expr.decode_replace(_w(t), "the", "_"), f"array_to_string(list_transform({_TOKENS}, lambda x: replace(x, 'the', '_')), '')")
_texts("decode_fuse", lambda t: F.array_join(_w(t), ""), f"array_to_string({_TOKENS}, '')")
_texts(
    "decode_ctc", lambda t: expr.decode_ctc(F.split(t, " "), "the", "|"),
    "array_to_string(list_filter(list_transform(list_filter(string_split(text, ' '), lambda x, i: i = 1 OR x <> string_split(text, ' ')[i - 1]), lambda x: replace(replace(x, 'the', ''), '|', ' ')), lambda x: x <> ''), '')",
)

SQL["decode_bpe"] = f"SELECT doc_id, strlen(t)::INT AS n_bytes, md5(t) AS digest FROM (SELECT doc_id, replace(array_to_string(p[:-2], chr(31)), 'on', ' ') || chr(31) || replace(coalesce(p[-1], ''), 'on', '') AS u, replace(u, chr(31), '') AS t FROM (SELECT doc_id, {_TOKENS} AS p FROM documents))"
SQL["decode_ctc"] = "SELECT doc_id, strlen(t)::INT AS n_bytes, md5(t) AS digest FROM (SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(list_zip(p, list_concat([NULL], p[:-2])), lambda x: x[2] IS NULL OR x[1] <> x[2]), lambda x: replace(replace(x[1], 'the', ''), '|', ' ')), lambda x: x <> ''), '') AS t FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents))"


def _lengths(t: Column) -> Column:
    return F.transform(_w(t), lambda x: F.char_length(x))


_DUCK_LENGTHS = f"list_transform({_TOKENS}, lambda x: len(x)::INT)"


def _ids(name: str, make: Callable[[Column], Column], sql: str) -> None:
    """A query of an array of ids (here, the tokens' lengths) for each document."""
    QUERIES[name] = lambda spark, d: _docs(spark, d).select("doc_id", make(_lengths(F.col("text"))).alias("p")).select("doc_id", F.size("p").alias("n"), F.md5(F.array_join(F.col("p").cast("array<string>"), ",")).alias("digest"))
    SQL[name] = f"SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, ',')) AS digest FROM (SELECT doc_id, {sql} AS p FROM (SELECT doc_id, {_DUCK_LENGTHS} AS a FROM documents))"


_repeat = lambda n: f"list_transform(range(greatest(0, {n})), lambda x: 0)"
_ids("post_bert", lambda a: expr.bert_ids(a, None, 101, 102), "list_concat(list_concat([101], a), [102])")
_ids("post_bert_pair", lambda a: expr.bert_ids(a, a, 101, 102), "list_concat(list_concat(list_concat(list_concat([101], a), [102]), a), [102])")
_ids("post_roberta", lambda a: expr.roberta_ids(a, None, 0, 2), "list_concat(list_concat([0], a), [2])")
_ids("post_roberta_pair", lambda a: expr.roberta_ids(a, a, 0, 2), "list_concat(list_concat(list_concat(list_concat([0], a), [2, 2]), a), [2])")
_ids("truncate_right", lambda a: expr.truncate(a, 64), "a[1:64]")
_ids("truncate_left", lambda a: expr.truncate(a, 64, True), "a[greatest(1, len(a) - 63):]")
_ids("pad_right", lambda a: expr.pad(a, 128), f"list_concat(a, {_repeat('128 - len(a)')})")
_ids("pad_left", lambda a: expr.pad(a, 128, left=True), f"list_concat({_repeat('128 - len(a)')}, a)")
_ids("pad_multiple", lambda a: expr.pad(a, expr.rounded(F.size(a), 8)), f"list_concat(a, {_repeat('CAST(ceil(len(a) / 8.0) * 8 AS INT) - len(a)')})")


def _vocabulary(docs: DataFrame) -> DataFrame:
    """token, id of the TOP most frequent tokens; 0 is for the unknown. Bounded, so that it may be broadcast."""
    counts = docs.select(F.explode(_w(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(TOP)
    return top.select("token", "n", F.row_number().over(Window.orderBy(F.desc("n"), "token")).alias("id"))


_VOCAB_SQL = f"""words AS (SELECT doc_id, lang, unnest({_TOKENS.replace("(text", "(lower(text)")}) AS token FROM documents),
vocab AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token))::INT AS id FROM (SELECT token, count(*) AS n FROM words GROUP BY token ORDER BY n DESC, token LIMIT {TOP}))"""


def vocab_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(_docs(spark, sf_dir)).select("token", "id", "n")


def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(_w(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def wordlevel_unk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, unknown ones and the sum of ids by language, over a word-level vocabulary of the corpus."""
    docs = _docs(spark, sf_dir)
    words = docs.select("lang", F.explode(_w(F.lower("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("m"))
    known = words.join(F.broadcast(_vocabulary(docs).select("token", "id")), "token", "left").withColumn("id", F.coalesce("id", F.lit(0)))
    return known.groupBy("lang").agg(F.sum("m").alias("n_tokens"), F.sum(F.when(F.col("id") == 0, F.col("m")).otherwise(0)).alias("n_unknown"), F.sum(F.col("id") * F.col("m")).alias("id_sum"))


def wordlevel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    # the words of a document are together: partial sums leave a row or two of it, and no word is shuffled
    words = docs.select("doc_id", F.explode(_w(F.lower("text"))).alias("token"))
    known = words.join(F.broadcast(_vocabulary(docs).select("token", "id")), "token", "left").withColumn("id", F.coalesce("id", F.lit(0)))
    return known.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.col("id").cast("long")).alias("id_sum"))


QUERIES |= {f.__name__: f for f in (vocab_top_k, token_freq, wordlevel_unk_rate, wordlevel_ids)}


def vocabulary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' vocabulary, written into a spec by the tokenizer data source, and read back from there."""
    spark.dataSource.register(sources.TokenizerSource)
    base, path = (f"{lineage.shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}/{n}.json" for n in ("base", "tokenizer"))
    spec_files.save(Spec.of({"model": {"type": "WordLevel", "vocab": {"[UNK]": 0}}}), base)
    unknown = spark.createDataFrame([("[UNK]", 0)], "token string, id int")
    _vocabulary(_docs(spark, sf_dir)).select("token", "id").unionByName(unknown).write.format("tokenizer").mode("overwrite").option("base", base).save(path)
    return spark.read.format("tokenizer").load(path)


QUERIES["vocabulary_source"] = vocabulary_source
SQL["vocabulary_source"] = f"WITH {_VOCAB_SQL} SELECT token, id FROM vocab UNION ALL SELECT '[UNK]', 0"
SQL["vocab_top_k"] = f"WITH {_VOCAB_SQL} SELECT token, id, n FROM vocab"
SQL["token_freq"] = f"WITH {_VOCAB_SQL} SELECT token, count(*) AS n FROM words GROUP BY token"
SQL["wordlevel_unk_rate"] = f"WITH {_VOCAB_SQL} SELECT lang, count(*) AS n_tokens, sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_unknown, sum(coalesce(id, 0))::BIGINT AS id_sum FROM words LEFT JOIN vocab ON words.token = vocab.token GROUP BY lang"
SQL["wordlevel_ids"] = f"WITH {_VOCAB_SQL} SELECT doc_id, count(*) AS n_tokens, sum(coalesce(id, 0))::BIGINT AS id_sum FROM words LEFT JOIN vocab ON words.token = vocab.token GROUP BY doc_id"

# pipelines over whole documents by kernels: built from fixed specs
_BYTES = {c: i for i, c in enumerate(sorted(expr.BYTE_CHARS.values()))}
_PAIRS = "t h|i n|th e|Ġ th|a n|e r|o n|in g|Ġ a|an d|r e|e n|Ġ the|e d|t i|ti on|Ġ o|Ġo f|e s|o u".split("|")
BPE_SPEC = Spec.of({
    "model": {"type": "BPE", "vocab": _BYTES | {p.replace(" ", ""): 256 + i for i, p in enumerate(_PAIRS)}, "merges": _PAIRS},
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "decoder": {"type": "ByteLevel"},
})


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE there and back: by the corpus' dictionary, and by the tokens' table."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    ids = dictionary.encode(docs, BPE_SPEC, ["doc_id"])
    return ids.select("doc_id", F.md5(dictionary.decode(BPE_SPEC, F.col("ids"))).alias("digest"), (F.size("ids") > 0).alias("encoded"))


def bpe_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, and a digest of all of them, each by its bytes."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    ids = dictionary.encode(docs, BPE_SPEC, ["doc_id"], dictionary=dictionary.words(docs, BPE_SPEC, most=4096))
    of = Tokenizer(BPE_SPEC).model.tokens
    bytes_of = F.array(*(F.lit(bytes(stages.CHAR_BYTES[c] for c in of[i]).hex().upper()) for i in range(len(of))))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda i: F.get(bytes_of, i)), ",")).alias("digest"))


# the pieces of byte-level tokenizers: of a run of white space the last stays with what follows, so a mark is put before it, which no piece takes
_GPT2 = r"""regexp_extract_all(regexp_replace(text, '(\s+)(\s)(\S)', '\1' || chr(1) || '\2\3', 'g'), '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\x01\p{L}\p{N}]+|\s+')"""
_arrays("pretok_gpt2", expr.byte_level_pieces, _GPT2)


def _merged(symbols: str) -> str:
    """Merges one after another, in their order, over symbols between two marks: no merge makes a pair of an earlier one."""
    for pair in _PAIRS:
        a, b = (part.replace("Ġ", " ") for part in pair.split(" "))
        symbols = f"replace({symbols}, chr(2) || '{a}' || chr(3) || chr(2) || '{b}' || chr(3), chr(2) || '{a}{b}' || chr(3))"
    return symbols


_BYTES_SQL = r"list_transform(string_split(rtrim(replace(s, chr(2), ''), chr(3)), chr(3)), lambda x: CASE WHEN strlen(x) = len(x) THEN hex(encode(x)) ELSE rtrim(regexp_replace(hex(encode(x)), '(..)', '\1,', 'g'), ',') END)"
_SYMBOLS_SQL = _merged(r"regexp_replace(piece, '(.)', chr(2) || '\1' || chr(3), 'gs')")
SQL["bpe_doc_counts"] = f"""WITH p AS (SELECT doc_id, unnest(g) AS piece, unnest(range(len(g))) AS i FROM (SELECT doc_id, {_GPT2} AS g FROM documents)),
w AS (SELECT piece, {_SYMBOLS_SQL} AS s FROM (SELECT DISTINCT piece FROM p)),
t AS (SELECT piece, array_to_string({_BYTES_SQL}, ',') AS tokens FROM w),
d AS (SELECT doc_id, string_agg(tokens, ',' ORDER BY i) AS tokens FROM p JOIN t ON p.piece = t.piece GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN coalesce(tokens, '') = '' THEN 0 ELSE len(tokens) - len(replace(tokens, ',', '')) + 1 END::INT AS n_tokens, md5(coalesce(tokens, '')) AS digest
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id"""


def _kernel(name: str, normalizer: dict, sql: str | None) -> None:
    spec = Spec.of({"model": {"type": "WordLevel", "vocab": {"[UNK]": 0}}, "normalizer": normalizer})
    QUERIES[name] = lambda spark, d: TextPipeline(spec).normalize(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.octet_length("normalized").alias("n_bytes"), F.md5("normalized").alias("digest"))
    if sql:
        SQL[name] = f"SELECT doc_id, strlen(t)::INT AS n_bytes, md5(t) AS digest FROM (SELECT doc_id, {sql} AS t FROM documents)"


_kernel("norm_nfc", {"type": "NFC"}, "nfc_normalize(text)")


def _decomposed_sql(form: str) -> str:
    """The text with each character of the Latin blocks and of general punctuation decomposed; others have none in these tables."""
    sql = "text"
    for c in map(chr, [*range(0xA0, 0x250), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07)]):
        if (new := unicodedata.normalize(form, c)) != c:
            sql = f"replace({sql}, '{c}', '{new}')"
    return sql


_kernel("norm_nfd", {"type": "NFD"}, _decomposed_sql("NFD"))
_kernel("norm_nfkd", {"type": "NFKD"}, _decomposed_sql("NFKD"))
_kernel("norm_nfkc", {"type": "NFKC"}, f"nfc_normalize({_decomposed_sql('NFKD')})")
_kernel("norm_bert", {"type": "BertNormalizer"}, f"lower(regexp_replace(regexp_replace(regexp_replace({_decomposed_sql('NFD')}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s', ' ', 'g'), '\\p{{Mn}}', '', 'g'))")


def _offsets(found: DataFrame) -> DataFrame:
    """Number and digest of the pieces with the bytes of the original that each comes from."""
    shown = F.transform("pieces", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"), p["text"]))
    return found.select("doc_id", F.size("pieces").alias("n"), F.md5(F.array_join(shown, "\x1f")).alias("digest"))


def offsets_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pieces between white space."""
    return _offsets(alignment.pre_tokenize(_docs(spark, sf_dir).select("doc_id", "text"), None, {"type": "WhitespaceSplit"}))


def norm_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts that five normalizers have made longer and shorter."""
    steps = [{"type": "Strip"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Replace", "pattern": {"String": "th"}, "content": "þ"}, {"type": "Prepend", "prepend": "▁▁"}]
    spec = Spec.of({"model": {"type": "WordLevel", "vocab": {"[UNK]": 0}}, "normalizer": {"type": "Sequence", "normalizers": steps}, "pre_tokenizer": {"type": "WhitespaceSplit"}})
    return _offsets(TextPipeline(spec).pre_tokenize(_docs(spark, sf_dir).select("doc_id", "text")))


QUERIES |= {f.__name__: f for f in (bpe_roundtrip, bpe_doc_counts, offsets_running, norm_offsets)}
SQL["bpe_roundtrip"] = "SELECT doc_id, md5(text) AS digest, strlen(text) > 0 AS encoded FROM documents"


def _offsets_sql(piece: str, start: str) -> str:
    """Words between white space with their places among the bytes of all that covers the text."""
    return f"""WITH c AS (SELECT doc_id, unnest(g) AS w, unnest(range(len(g))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[ \\t\\n\\r]+|[^ \\t\\n\\r]+') AS g FROM documents)),
s AS (SELECT doc_id, w, i, (sum(strlen(w)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(w))::BIGINT AS a FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s WHERE NOT regexp_matches(w, '^[ \\t\\n\\r]')),
d AS (SELECT doc_id, count(*)::INT AS n, string_agg({start} || ':' || (a + strlen(w)) || ':' || {piece}, chr(31) ORDER BY i) AS t FROM k GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id"""


SQL["offsets_running"] = _offsets_sql("w", "a")
# what replaces "th" stands for its last letter
SQL["norm_offsets"] = _offsets_sql("CASE WHEN r = 1 THEN '▁▁' ELSE '' END || replace(lower(w), 'th', 'þ')", "(a + CASE WHEN starts_with(lower(w), 'th') THEN 1 ELSE 0 END)")

# models on the distinct words of the corpus, whose pieces an alternation of regular expressions finds too
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_STEMS = ["tion", "ing", "the", "er", "in", "th"]
WORDPIECE_SPEC = Spec.of({"model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": {t: i for i, t in enumerate(["[UNK]", *_STEMS, *_LETTERS, *("##" + x for x in [*_STEMS, *_LETTERS])])}}})
# merges that share no letter, so that their order is of no effect
LETTERS_SPEC = Spec.of({"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate([*_LETTERS, "th", "an", "er"])}, "merges": ["t h", "a n", "e r"]}})


def _words(name: str, spec: Spec, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = _docs(spark, sf_dir).select(F.explode(expr.whitespace(F.lower("text"))).alias("word")).distinct()
        found = TextPipeline(spec).encode(words, "word", "e", add_special=False)
        return found.select("word", F.size("e.tokens").alias("n"), F.array_join("e.tokens", " ").alias("pieces"))

    QUERIES[name] = query
    SQL[name] = f"SELECT word, len(p)::INT AS n, array_to_string(p, ' ') AS pieces FROM (SELECT word, {sql} AS p FROM (SELECT DISTINCT unnest({_TOKENS.replace('(text', '(lower(text)')}) AS word FROM documents))"


_words("wordpiece_tokens", WORDPIECE_SPEC, f"CASE WHEN len(word) > 100 OR regexp_matches(word, '[^a-z]') THEN ['[UNK]'] ELSE list_transform(regexp_extract_all(word, '{'|'.join(_STEMS)}|[a-z]'), lambda x, i: CASE WHEN i = 1 THEN x ELSE '##' || x END) END")
_words("bpe_tokens", LETTERS_SPEC, "regexp_extract_all(regexp_replace(word, '[^a-z]', '', 'g'), 'th|an|er|[a-z]')")  # what the model doesn't know is left out

# best paths over the words of the corpus; scores of eighths add up exactly, and some paths are equal
_UNIGRAM_PIECES = {**{c: -2.0 - 0.125 * (i % 5) for i, c in enumerate(_LETTERS)}, "th": -3.0, "he": -3.125, "the": -4.0, "in": -3.25, "ing": -4.25, "er": -3.0, "re": -3.0, "tion": -5.5, "on": -3.5, "an": -3.125, "and": -4.5, "en": -3.25, "sch": -4.75, "ch": -3.5, "la": -3.375, "el": -3.125}
UNIGRAM_SPEC = Spec.of({"model": {"type": "Unigram", "vocab": [["<unk>", -20.0], *([p, s] for p, s in _UNIGRAM_PIECES.items())], "unk_id": 0}})


def unigram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and score of each distinct word."""
    words = _docs(spark, sf_dir).select(F.explode(expr.whitespace_split(F.lower("text"))).alias("word"))
    found = unigram.best_paths(words, UNIGRAM_SPEC)
    return found.select("word", "score", F.array_join(F.transform("pieces", lambda p: p["text"]), " ").alias("pieces"), F.array_join(F.transform("pieces", lambda p: p["id"].cast("string")), " ").alias("ids"))


QUERIES["unigram_score"] = unigram_score
_UNIGRAM_VALUES = ", ".join(f"('{p}', {s}::DOUBLE, {i})" for i, (p, s) in enumerate([("<unk>", -20.0), *_UNIGRAM_PIECES.items()]))
SQL["unigram_score"] = f"""WITH RECURSIVE v(piece, score, id) AS (VALUES {_UNIGRAM_VALUES}),
w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]'), lambda x: x <> '')) AS word FROM documents),
spans AS (SELECT word, a, unnest(range(a + 1, least(len(word), a + 5) + 1)) AS e FROM (SELECT word, unnest(range(len(word))) AS a FROM w)),
edges AS (SELECT word, e, list({{'a': a, 's': coalesce(score, -30.0), 'id': coalesce(id, 0), 'u': score IS NULL}} ORDER BY a) AS c
  FROM spans LEFT JOIN v ON word[a + 1 : e] = piece WHERE score IS NOT NULL OR e = a + 1 GROUP BY word, e),
f(word, e, s, b) AS (SELECT word, 0, [0.0::DOUBLE], []::STRUCT(a BIGINT, s DOUBLE, id INTEGER, u BOOLEAN)[] FROM w UNION ALL
  SELECT word, e, list_append(s, list_max(t)), list_append(b, c[list_position(t, list_max(t))]) FROM (
    SELECT f.word, edges.e::INT AS e, f.s, f.b, edges.c, list_transform(edges.c, lambda x: f.s[x.a + 1] + x.s) AS t FROM f JOIN edges ON f.word = edges.word AND edges.e = f.e + 1)),
g(word, pos, b, p) AS (SELECT word, e, b, []::STRUCT(t VARCHAR, id INTEGER, u BOOLEAN)[] FROM f WHERE e = len(word) UNION ALL
  SELECT word, b[pos].a::INT, b, list_prepend({{'t': word[b[pos].a + 1 : pos], 'id': b[pos].id, 'u': b[pos].u}}, p) FROM g WHERE pos > 0),
h AS (SELECT f.word, f.s[-1] AS score, list_transform(list_zip(p, list_concat([NULL], p[:-2])), lambda x: {{'t': CASE WHEN x[2] IS NULL OR (x[1].u AND x[2].u) THEN '' ELSE ' ' END || x[1].t, 'id': CASE WHEN x[1].u AND coalesce(x[2].u, false) THEN '' WHEN x[2] IS NULL THEN x[1].id::VARCHAR ELSE ' ' || x[1].id END}}) AS q
  FROM f JOIN g ON f.word = g.word AND f.e = len(f.word) AND g.pos = 0)
SELECT word, score, array_to_string(list_transform(q, lambda x: x.t), '') AS pieces, array_to_string(list_transform(q, lambda x: x.id), '') AS ids FROM h"""


# runs of one script; the space joins what is before it
_SQL_SCRIPTS = (r"\p{Latin}", r"\p{Greek}", r"\p{Cyrillic}", r"\p{Han}\p{Hiragana}\p{Katakana}ー")
_SQL_RUNS = "|".join(f"[{c}][ {c}]*" for c in _SQL_SCRIPTS)
_arrays("pretok_scripts", lambda t: expr.unicode_scripts(t, expr.script_names()), _all(f" *(?:{_SQL_RUNS}|[^ {''.join(_SQL_SCRIPTS)}][^{''.join(_SQL_SCRIPTS)}]*)"))

# many added tokens that begin alike: beginnings of words, numbers
ADDED = {t: 1000 + i for i, t in enumerate(dict.fromkeys([*(a + b for a in "tshiwde" for b in _LETTERS), *(w[:n] for w in ("there", "therefore", "their", "and", "another", "information", "international", "ein", "einer", "der", "die", "que", "les") for n in range(2, len(w) + 1)), *map(str, range(100))]))}


def added_token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each document by several hundred added tokens, with their ids."""
    found = _docs(spark, sf_dir).select("doc_id", expr.added_tokens(F.col("text"), ADDED).alias("s"))
    shown = F.transform("s", lambda x: F.concat(F.coalesce(x["id"].cast("string"), F.lit("-")), F.lit(":"), x["text"]))
    return found.select("doc_id", F.size("s").alias("n"), F.size(F.filter("s", lambda x: x["id"].isNotNull())).alias("n_added"), F.md5(F.array_join(shown, "\x1f")).alias("digest"))


def pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 documents of nearly equal length, padded to their longest, a multiple of 8."""
    ids = _docs(spark, sf_dir).select("doc_id", _lengths(F.col("text")).alias("ids")).withColumn("n", F.size("ids"))
    return batches.padded(ids, 64, ["doc_id"], multiple=8).select("doc_id", "batch", "place", "n", "target", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


QUERIES |= {f.__name__: f for f in (added_token_split, pad_batches)}
_ADDED_SQL = "|".join(sorted(ADDED, key=lambda t: (-len(t), t)))
_ADDED_IDS = ", ".join(f"('{t}', {i})" for t, i in ADDED.items())
SQL["added_token_split"] = f"""WITH v(w, id) AS (VALUES {_ADDED_IDS}),
s AS (SELECT doc_id, unnest(g) AS w, unnest(range(len(g))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({_ADDED_SQL})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS g FROM documents)),
k AS (SELECT doc_id, s.w, i, CASE WHEN i % 2 = 1 THEN id END AS id FROM s LEFT JOIN v ON s.w = v.w WHERE s.w <> ''),
d AS (SELECT doc_id, count(*)::INT AS n, count(id)::INT AS n_added, string_agg(coalesce(id::VARCHAR, '-') || ':' || w, chr(31) ORDER BY i) AS t FROM k GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n, coalesce(n_added, 0) AS n_added, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id"""
SQL["pad_batches"] = f"""WITH t AS (SELECT doc_id, a, len(a)::INT AS n, row_number() OVER (ORDER BY len(a), doc_id) - 1 AS r FROM (SELECT doc_id, {_DUCK_LENGTHS} AS a FROM documents)),
b AS (SELECT *, r // 64 AS batch, (ceil(max(n) OVER (PARTITION BY r // 64) / 8.0) * 8)::INT AS target FROM t)
SELECT doc_id, batch, (r % 64)::INT AS place, n, target, md5(array_to_string(list_concat(a, list_transform(range(target - n), lambda x: 0)), ',')) AS digest FROM b"""

def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by a table function in SQL, over the corpus' TOP most frequent words: their number, the unknown ones, and a sum that tells their order."""
    docs = _docs(spark, sf_dir)
    vocab = {r["token"]: r["id"] for r in _vocabulary(docs).select("token", "id").collect()}  # TOP at most
    tables.register(spark, Spec.of({"model": {"type": "WordLevel", "vocab": {"[UNK]": 0} | vocab}, "pre_tokenizer": {"type": "Whitespace"}, "normalizer": {"type": "Lowercase"}}), "corpus_")
    sql = "SELECT doc_id, count(*) AS n_tokens, count_if(id = 0) AS n_unknown, sum((word % 1000 + 1) * id) AS checksum FROM {docs} d, LATERAL corpus_tokens(d.text) t GROUP BY doc_id"
    return spark.sql(sql, docs=docs.select("doc_id", "text"))


QUERIES["sql_tokens"] = sql_tokens
SQL["sql_tokens"] = f"""WITH {_VOCAB_SQL},
p AS (SELECT doc_id, unnest(g) AS token, unnest(range(len(g))) AS i FROM (SELECT doc_id, {_TOKENS.replace("(text", "(lower(text)")} AS g FROM documents))
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (id IS NULL) AS n_unknown, sum((i % 1000 + 1) * coalesce(id, 0))::BIGINT AS checksum FROM p LEFT JOIN vocab ON p.token = vocab.token GROUP BY doc_id"""

# pairs and templates by kernels
_PLAIN = {"model": {"type": "WordLevel", "vocab": {"[UNK]": 0}}, "pre_tokenizer": {"type": "WhitespaceSplit"}}
_COUNT = r"len(list_filter(regexp_split_to_array({}, '[ \t\n\r]'), lambda x: x <> ''))"


def _digest_of(e: str) -> Column:
    return F.md5(F.array_join(F.transform(F.concat(*(F.col(f"{e}.{f}") for f in encodings.FIELDS)), lambda x: x.cast("string")), ","))


def pair_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's words and its marks and words (as ids, their lengths) as a pair, cut to 512 and filled up to a multiple of 8."""
    bert = {"type": "BertProcessing", "cls": ["[CLS]", 101], "sep": ["[SEP]", 102]}
    # each step a column of its own, which the next one reads more than once
    ids = _docs(spark, sf_dir).select("doc_id", F.transform(expr.whitespace_split(F.col("text")), F.char_length).alias("a"), _lengths(F.col("text")).alias("b"))
    pairs = ids.select("doc_id", encodings.processed(bert, F.col("a"), F.col("b")).alias("e"))
    cut = pairs.select("doc_id", encodings.truncated(F.col("e"), 512).alias("e"))
    return cut.select("doc_id", encodings.padded(F.col("e"), expr.rounded(F.size("e.ids"), 8)).alias("e")).select("doc_id", F.size("e.ids").alias("n"), _digest_of("e").alias("digest"))


def post_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"type": "TemplateProcessing", "single": "[CLS] $A:3 [SEP]:5", "special_tokens": {t: {"id": t, "ids": i, "tokens": [t] * len(i)} for i, t in (([7, 9], "[CLS]"), ([8], "[SEP]"))}}
    return _docs(spark, sf_dir).select("doc_id", encodings.processed(template, _lengths(F.col("text"))).alias("e")).select("doc_id", F.size("e.ids").alias("n"), _digest_of("e").alias("digest"))


def decode_bytefallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other word as byte tokens, of which every third loses its last byte, so that some are no UTF-8."""

    def byte_tokens(w: Column) -> Column:
        n = F.octet_length(w)
        kept = F.left(F.hex(w), 2 * (n - F.when(n % 3 == 0, 1).otherwise(0)))
        return expr.pieces(F.regexp_replace(kept, "(..)", "<0x$1>"), ".{6}")

    tokens = F.flatten(F.transform(expr.whitespace_split(F.col("text")), lambda w, i: F.when(i % 2 == 0, byte_tokens(w)).otherwise(F.array(w))))
    back = _docs(spark, sf_dir).select("doc_id", expr.byte_fallback(tokens).alias("p"))
    return back.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "")).alias("digest"))


QUERIES |= {f.__name__: f for f in (pair_encode, post_template, decode_bytefallback)}
_WORDS_SQL = r"list_filter(regexp_split_to_array(text, '[ \t\n\r]'), lambda x: x <> '')"
_SAME = "list_transform(range({}), lambda x: {})"  # so many of one number
SQL["pair_encode"] = f"""WITH w AS (SELECT doc_id, list_transform({_WORDS_SQL}, lambda x: len(x)::INT) AS a, {_DUCK_LENGTHS} AS b FROM documents),
e AS (SELECT doc_id, list_concat(list_concat(list_concat(list_concat([101], a), [102]), b), [102])[1:512] AS ids, list_concat({_SAME.format("len(a) + 2", 0)}, {_SAME.format("len(b) + 1", 1)})[1:512] AS t,
  list_concat(list_concat(list_concat(list_concat([1], {_SAME.format("len(a)", 0)}), [1]), {_SAME.format("len(b)", 0)}), [1])[1:512] AS s FROM w),
p AS (SELECT *, ((len(ids) + 7) // 8 * 8 - len(ids))::INT AS m FROM e)
SELECT doc_id, (len(ids) + m)::INT AS n, md5(array_to_string(list_concat(list_concat(list_concat(list_concat(ids, {_SAME.format("m", 0)}), list_concat(t, {_SAME.format("m", 0)})), list_concat(s, {_SAME.format("m", 1)})), list_concat({_SAME.format("len(ids)", 1)}, {_SAME.format("m", 0)})), ',')) AS digest FROM p"""
SQL["post_template"] = f"""SELECT doc_id, (len(a) + 3)::INT AS n, md5(array_to_string(list_concat(list_concat(list_concat(list_concat([7, 9], list_concat(a, [8])), list_concat([0, 0], list_concat({_SAME.format("len(a)", 3)}, [5]))),
  list_concat([1, 1], list_concat({_SAME.format("len(a)", 0)}, [1]))), {_SAME.format("len(a) + 3", 1)}), ',')) AS digest FROM (SELECT doc_id, {_DUCK_LENGTHS} AS a FROM documents)"""
# without its last byte, a word ends in a part of a character unless that one is of ASCII
SQL["decode_bytefallback"] = f"""SELECT doc_id, (len(p) + coalesce(list_sum(list_transform(p, lambda x: CASE WHEN x.run AND x.bad THEN x.n - 1 WHEN x.run AND x.n = 0 THEN -1 ELSE 0 END)), 0))::INT AS n, md5(array_to_string(list_transform(p, lambda x: x.t), '')) AS digest
FROM (SELECT doc_id, list_transform({_WORDS_SQL}, lambda w, i: CASE WHEN i % 2 = 0 THEN {{'run': false, 'bad': false, 'n': 0, 't': w}} WHEN strlen(w) % 3 <> 0 THEN {{'run': true, 'bad': false, 'n': strlen(w), 't': w}}
  WHEN strlen(w[-1:]) = 1 THEN {{'run': true, 'bad': false, 'n': strlen(w) - 1, 't': w[:-2]}} ELSE {{'run': true, 'bad': true, 'n': strlen(w) - 1, 't': repeat('\ufffd', strlen(w) - 1)}} END) AS p FROM documents)"""

# chat templates, compiled to expressions over arrays of messages
_TURN = "turn, role, text"  # ties of turns in a fixed order
TEMPLATES = {
    "chat_chatml": "{% for m in messages %}{{ '<|im_start|>' + m.role + '\n' + m.content + '<|im_end|>\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}",
    "chat_phi3": "{% for m in messages %}{{ '<|' + m['role'] + '|>\n' + m['content'] + '<|end|>\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|assistant|>\n' }}{% endif %}",
    "chat_turns": "{% for m in messages %}{{ loop.index }}/{{ loop.length }} {{ m.role|upper }}: {{ m.content|trim }}{% if not loop.last %}{{ ' ~ ' }}{% endif %}{% endfor %}",
    # questions are numbered by a namespace, which outlives the loop; the last role is carried from turn to turn
    "chat_numbered": "{% set ns = namespace(questions=0, last='') %}{% for m in messages %}{% if m.role == 'user' %}{% set ns.questions = ns.questions + 1 %}{% endif %}{% if m.role != ns.last %}[{{ m.role }} {{ ns.questions }}]{% endif %}{{ m.content }};{% set ns.last = m.role %}{% endfor %}({{ ns.questions }} {{ ns.last }})",
    # a first system message goes into the first turn after it
    "chat_folded": "{% if messages[0].role == 'system' %}{% set prefix = messages[0].content|trim + '\n\n' %}{% set turns = messages[1:] %}{% else %}{% set prefix = '' %}{% set turns = messages %}{% endif %}{% for m in turns %}{% if m.role == 'assistant' %}{% set role = 'model' %}{% else %}{% set role = m.role %}{% endif %}<start_of_turn>{{ role }}{{ '\n' + (prefix if loop.first else '') + m.content|trim }}<end_of_turn>{{ '\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<start_of_turn>model\n' }}{% endif %}",
    # one macro for all roles, neighbours, JSON
    "chat_macro": "{% macro tag(name, text, more='') %}<{{ name }}{{ more }}>{{ text }}</{{ name }}>{% endmacro %}{% for m in messages %}{% if loop.previtem is defined and loop.previtem.role == m.role %}{{ tag(m.role, m.content, ' again') }}{% else %}{{ tag(m.role, m.content|length) }}{% endif %}{% endfor %}{{ (messages|selectattr('role', 'eq', 'user')|list)|length }}{{ messages|map(attribute='role')|join(',') }}",
}


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages; a conversation is one value, as its prompt is one text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def _chat(name: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: templates.apply_chat(_conversations(spark, d), TEMPLATES[name]).select("conv_id", F.octet_length("prompt").alias("n_bytes"), F.md5("prompt").alias("digest"))
    SQL[name] = f"SELECT conv_id, strlen(p)::INT AS n_bytes, md5(p) AS digest FROM ({sql})"


_CHATML = f"SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY {_TURN}) || '<|im_start|>assistant' || chr(10) AS p FROM conversations GROUP BY conv_id"
_OVER = f"(PARTITION BY conv_id ORDER BY {_TURN})"
_TRIMMED = "trim(text, chr(10) || chr(13) || chr(9) || ' ')"
_chat("chat_chatml", _CHATML)
_chat("chat_phi3", f"SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY {_TURN}) || '<|assistant|>' || chr(10) AS p FROM conversations GROUP BY conv_id")
_chat("chat_turns", f"SELECT conv_id, string_agg(r || '/' || n || ' ' || upper(role) || ': ' || {_TRIMMED}, ' ~ ' ORDER BY {_TURN}) AS p FROM (SELECT *, row_number() OVER {_OVER} AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id")
_chat("chat_numbered", f"""SELECT conv_id, string_agg(CASE WHEN before IS DISTINCT FROM role THEN '[' || role || ' ' || q || ']' ELSE '' END || text || ';', '' ORDER BY r) || '(' || max(q) || ' ' || arg_max(role, r) || ')' AS p
FROM (SELECT *, row_number() OVER {_OVER} AS r, lag(role) OVER {_OVER} AS before, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER ({_OVER[1:-1]} ROWS UNBOUNDED PRECEDING) AS q FROM conversations) GROUP BY conv_id""")
_chat("chat_folded", f"""SELECT conv_id, coalesce(string_agg('<start_of_turn>' || replace(role, 'assistant', 'model') || chr(10) || CASE WHEN r = 1 AND NOT folded OR r = 2 AND folded THEN prefix ELSE '' END || {_TRIMMED} || '<end_of_turn>' || chr(10), '' ORDER BY r)
  FILTER (r > 1 OR NOT folded), '') || '<start_of_turn>model' || chr(10) AS p FROM (
  SELECT *, first(role) OVER {_OVER} = 'system' AS folded, CASE WHEN first(role) OVER {_OVER} = 'system' THEN first({_TRIMMED}) OVER {_OVER} || chr(10) || chr(10) ELSE '' END AS prefix, row_number() OVER {_OVER} AS r FROM conversations) GROUP BY conv_id""")
_chat("chat_macro", f"""SELECT conv_id, string_agg(CASE WHEN before = role THEN '<' || role || ' again>' || text ELSE '<' || role || '>' || strlen(text) END || '</' || role || '>', '' ORDER BY r)
  || count(*) FILTER (role = 'user') || string_agg(role, ',' ORDER BY r) AS p
FROM (SELECT *, row_number() OVER {_OVER} AS r, lag(role) OVER {_OVER} AS before FROM conversations) GROUP BY conv_id""")


def encode_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each conversation's prompt, and those of them that are added tokens."""
    spec = Spec.of(_PLAIN | {"added_tokens": [{"content": t, "special": True} for t in ("<|im_start|>", "<|im_end|>")]})
    prompts = templates.apply_chat(_conversations(spark, sf_dir), TEMPLATES["chat_chatml"])
    ids = TextPipeline(spec).ids(prompts, "prompt")
    return ids.select("conv_id", F.size("ids").alias("n_tokens"), F.size(F.filter("ids", lambda i: i > 0)).alias("n_added"))


QUERIES["encode_chat"] = encode_chat
SQL["encode_chat"] = f"""SELECT conv_id, ({_COUNT.format("replace(replace(p, '<|im_start|>', ' '), '<|im_end|>', ' ')")} + k)::INT AS n_tokens, k::INT AS n_added FROM (
SELECT conv_id, p, len(string_split(p, '<|im_start|>')) + len(string_split(p, '<|im_end|>')) - 2 AS k FROM ({_CHATML}))"""

"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are maximal runs of characters other than the six ASCII white-space characters. All
measures are exact and cover the whole text, of any length; of equal lines and windows all but the first count as
repeated lines, and all as repeated words. A null or empty text has no words, so it fails
the base rule; repeated rows are judged each for itself; a null id stays null; an empty table
gives an empty result; further columns of the input are ignored by ``measure`` and ``judge``
and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import table

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Common function words of the four languages.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are", "from", "at", "an", "a", "der", "die", "das", "und", "in", "zu", "den", "mit", "von", "für", "ist", "auf", "sich", "des", "dem", "ein", "eine", "nicht", "le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "en", "dans", "pour", "est", "par", "sur", "el", "los", "las", "y", "del", "por", "con", "para", "su", "no", "al", "lo", "se"]

#: measure, lowest and highest value that pass (None: open). A measure that is null passes.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_word_ratio", None, 0.1),
    ("dup_line_ratio", None, 0.5),
    ("stop_word_ratio", 0.01, None),
]
BASE = ("n_words", "repeat_word_ratio")


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds ``value`` to ``name`` in ``body``, so that it is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(hashes: str) -> str:
    """SQL for the words in three-word windows that occur twice or more, from the array of word hashes.

    A window's key mixes its three 64-bit word hashes. Sorting the keys shows those that repeat; their
    places are then found by membership (few repeated keys) or by sorting keys with places (many).
    """
    keys = "transform(slice(_w, 1, size(_w) - 2), (x, i) -> x ^ shiftleft(_w[i + 1], 1) ^ shiftleft(_w[i + 2], 2))"
    twice = _let("sort_array(_k)", "_s", "array_distinct(filter(_s, (v, i) -> v = get(_s, i + 1)))")
    few = "filter(transform(_k, (v, i) -> IF(array_contains(_d, v), i, NULL)), i -> i IS NOT NULL)"
    many = _let(
        "sort_array(transform(_k, (v, i) -> named_struct('v', v, 'i', i)))",
        "_t",
        "sort_array(transform(filter(_t, (x, i) -> coalesce(x.v = get(_t, i + 1).v, false) OR coalesce(x.v = get(_t, i - 1).v, false)), x -> x.i))",
    )
    covered = "aggregate(transform(_p, (p, i) -> least(3, coalesce(get(_p, i + 1) - p, 3))), 0L, (a, x) -> a + x)"
    counted = _let(f"IF(size(_d) <= 64, {few}, {many})", "_p", covered)
    return _let(hashes, "_w", f"IF(size(_w) < 3, 0L, {_let(keys, '_k', _let(twice, '_d', f'IF(size(_d) = 0, 0L, {counted})'))})")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words and the ratios of the rules."""
    text = F.col("_text")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    split = plain.select(
        "doc_id",
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0).alias("_lines"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )
    stop = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    hashed = split.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.expr(f"size(filter(_words, w -> w IN ({stop})))").cast("long").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    counted = hashed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(_repeat_words("_hashes")).alias("n_repeat_words"), "n_lines", "n_stop_words")
    n = F.nullif(F.col("n_words"), F.lit(0))
    return counted.select(
        "*",
        (F.col("n_repeat_words") / n).alias("repeat_word_ratio"),
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbol_word_ratio"),
        (F.col("n_stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))).alias("dup_line_ratio"),
    )


def compiled(rules: list[tuple[str, float | None, float | None]]) -> Column:
    """One boolean column: true where every measure lies within its thresholds."""
    passed = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            passed &= F.coalesce(F.col(name) >= F.lit(low), F.lit(True))
        if high is not None:
            passed &= F.coalesce(F.col(name) <= F.lit(high), F.lit(True))
    return passed


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """``measure`` with base_failed and kept."""
    return measure(docs, id_col, text_col).select("*", (~compiled([r for r in rules if r[0] in BASE])).alias("base_failed"), compiled(rules).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes. No join: rows are carried through the projection as one struct."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{text_col}`").alias("text"))
    judged = judge(rows, "_row", "text", rules).withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0))  # else the filter is pushed below the measures and computes them twice
    return judged.where("kept").select("doc_id.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         row_number() OVER () AS rid
  FROM documents),
win AS (
  SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         len(list_filter(words, lambda x: list_contains([@STOP@], x))) AS n_stop
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AND 10 * n_symbols <= n_words
         AND 2 * n_dup_lines <= n_lines AND 100 * n_stop >= n_words AS kept
FROM m
""".replace("@STOP@", ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS)))

"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule is a row of ``RULES``: a measure and the range that a kept document stays in.
Measures are columns of counts and ratios; nothing is evaluated in Python and nothing
is shuffled.

A null text has no words, so it fails the least length. A ratio without a denominator
is zero. Repeated rows and ties have no influence on each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.llm.common import table, text_of

#: Words in windows of so many that a text repeats.
WINDOW = 8
_SPACE, _WORD, _SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+", "[#*$%&|<>]"

#: Frequent function words of four languages, in lower case.
STOP_WORDS = (
    "the of and to in that is was for on are with as be at by this from it not or an have "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le les et des en un une du est que qui dans pour pas sur au par avec "
    "el y los se del las por con una su para es al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document is kept if ``measure`` lies within the bounds; None leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Measures are those of :func:`measured`.
RULES = (
    Rule("mean_word_length", "chars_per_word", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.2),
    Rule("stop_words", "stop_word_share", 0.03, None),
    Rule("repeated_lines", "repeated_line_share", None, 0.4),
    Rule("line_length", "words_per_line", 2.0, None),
)


def _ratio(above: str, below: str) -> Column:
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios to ``df``; clashing columns are replaced."""
    stop = r"(?<![\p{L}\p{N}])(?:" + "|".join(dict.fromkeys(STOP_WORDS)) + r")(?![\p{L}\p{N}])"
    df = df.withColumn("_text", text_of(df[text])).withColumn("_words", F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)))
    has_word = F.filter(F.split("_text", "\n"), lambda line: line.rlike(_WORD))
    df = df.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_lines": has_word, "n_words": F.size("_words").cast("long")})
    df = df.withColumns(
        {
            "word_chars": F.char_length(F.regexp_replace("_text", _SPACE, "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(_SYMBOL)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_stop_words": F.regexp_count("_text", F.lit(stop)).cast("long"),
        }
    ).drop("_words", "_lines")
    # Hashes of 1, 2, 4 and 8 words: each is made of two of the kind before.
    for width in (1, 2, 4):
        later = F.slice("_hashes", F.lit(1 + width), F.greatest(F.size("_hashes") - width, F.lit(0)))
        df = df.withColumn("_hashes", F.zip_with("_hashes", later, lambda a, b: F.xxhash64(a, b)))
    windows = F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0)))
    df = df.withColumn("_windows", windows).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(repeats, placed)).drop("_windows")
    same = lambda x, i, step: x["h"].eqNullSafe(F.get("_placed", i + step)["h"])
    starts = F.filter("_placed", lambda x, i: same(x, i, -1) | same(x, i, 1))
    df = df.withColumn("_starts", F.sort_array(F.transform(starts, lambda x: x["i"]))).drop("_placed")
    covered = F.transform("_starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_starts", "_text")
    return df.withColumns(
        {
            "chars_per_word": _ratio("word_chars", "n_words"),
            "symbols_per_word": _ratio("n_symbols", "n_words"),
            "stop_word_share": _ratio("n_stop_words", "n_words"),
            "repeated_line_share": _ratio("n_dup_lines", "n_lines"),
            "words_per_line": _ratio("n_words", "n_lines"),
        }
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a measured document passes all rules."""
    passed = F.lit(True)
    for rule in rules:
        value = F.col(rule.measure)
        if rule.least is not None:
            passed = passed & (value >= rule.least)
        if rule.most is not None:
            passed = passed & (value <= rule.most)
    return passed


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed`` (too short or repetitive) and ``kept``."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = measured(df, text).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _bounds() -> str:
    parts = [f"{r.measure} >= {r.least}" for r in RULES if r.least is not None]
    return " AND ".join(parts + [f"{r.measure} <= {r.most}" for r in RULES if r.most is not None])


OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), ln AS (
  SELECT r, unnest(string_split(t, chr(10))) AS l FROM d
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), starts AS (
  SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i,
    unnest([array_to_string(w[i:i + {WINDOW - 1}], ' ') for i in range(1, len(w) - {WINDOW - 2})]) AS x FROM d
), marked AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM starts
), gaps AS (
  SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS g FROM marked WHERE n > 1
), repeats AS (
  SELECT r, sum(g) AS n FROM gaps GROUP BY r
), words AS (
  SELECT r, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS x FROM d
), stops AS (
  SELECT r, count(*) AS n FROM words WHERE x IN ({", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(stops.n, 0) AS n_stop_words
  FROM d LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r) LEFT JOIN stops USING (r)
), q AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS chars_per_word,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS repeated_line_share,
    CASE WHEN n_lines > 0 THEN n_words / n_lines ELSE 0 END AS words_per_line FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_bounds()} AS kept
FROM q
"""

"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged first: a line fails when symbols make up too
much of it, when punctuation does, when it is written in capitals only (capitals,
no small letter, and not mostly letters of a caseless script), when it is
navigation (many separators, or as many as parts of a word or two stand between,
or nothing but a link name) or when it holds a phrase of site boilerplate.
Failing lines are removed; a document that loses too much of its text with them
is rejected, and so is one that is too short or repeats itself (base rules).

Null text has no words and fails the base rules.  Lines without a word are not
judged; the cleaned text leaves them out.  Rows are independent, so repeated rows,
ties, empty tables and extra columns need no care: the columns that this
operator adds replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.common import WORD_SPACE, read

# Fixed values of the contract.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are percentages."""

    min_words: int = 20
    max_repeat_share: int = 30
    max_symbol_share: int = 5
    max_punctuation_share: int = 30
    min_line_chars: int = 12
    max_separators: int = 2
    max_part_words: int = 2
    min_kept_share: int = 50
    separators: str = r"[|»›•·]"
    link_names: str = r"(?i)^[\x20\x09-\x0D]*(home|menu|search|login|log in|sign in|sign up|register|contact|contact us|about|about us|next|previous|back to top|share|tweet|read more|skip to content)[\x20\x09-\x0D]*$"
    boilerplate: str = r"(?i)all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|subscribe to our newsletter|powered by wordpress"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_passes(line: Column, rules: Rules) -> Column:
    """The verdict on one line that has a word."""
    long_enough = F.length(line) >= rules.min_line_chars
    symbols = long_enough & (100 * _count(line, SYMBOLS) > rules.max_symbol_share * F.length(line))
    capitals = long_enough & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}") & (2 * _count(line, r"\p{Lu}") > _count(line, r"\p{L}"))
    punctuation = long_enough & (100 * _count(line, r"\p{P}") > rules.max_punctuation_share * F.length(line))
    separators = _count(line, rules.separators)
    words = F.size(F.filter(F.split(F.regexp_replace(line, rules.separators, " "), SPACE), lambda w: w != ""))
    parts = (separators >= rules.max_separators) & (words <= rules.max_part_words * (separators + 1))
    menu = line.rlike(rules.link_names) | (separators > rules.max_separators) | parts
    return ~(symbols | punctuation | capitals | menu | line.rlike(rules.boilerplate))


def judge(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``df`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, cleaned_text (null for null text), kept_chars, line_chars, kept."""
    # Each step is used more than once by the next, so the plan keeps it as a column and computes it once a row.
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(WORD_SPACE))
    lines = F.split(t, "\n")
    with_word = F.filter(lines, lambda x: x.rlike(WORD))
    out = df.withColumns({
        "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)),
        "__lines": with_word,
        "n_symbols": _count(t, SYMBOLS).cast("long"),
    })
    out = out.withColumns({
        "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__kept": F.filter("__lines", lambda x: line_passes(x, rules)),
    }).drop("__words")
    # Windows of WINDOW words as hashes of word hashes; only texts in which one comes twice are looked at further.
    window = F.when(
        F.size("__hash") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("__hash") - WINDOW), lambda i: F.xxhash64(*(F.get("__hash", i + j) for j in range(WINDOW)))),
    ).otherwise(F.array().cast("array<long>"))
    out = out.withColumn("__window", window).drop("__hash")
    at = F.sort_array(F.transform("__window", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__sorted", F.when(F.size("__window") > F.size(F.array_distinct("__window")), at)).drop("__window")
    same = lambda k, j: F.get("__sorted", k)["h"].eqNullSafe(F.get("__sorted", j)["h"])
    found = F.filter(F.sequence(F.lit(0), F.size("__sorted") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    out = out.withColumn("__at", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.transform(found, lambda k: F.get("__sorted", k)["i"])))).drop("__sorted")
    covered = F.aggregate(F.transform("__at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumns({
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "cleaned_text": F.when(F.col(text).isNotNull(), F.array_join("__kept", "\n")),
        "kept_chars": F.length(F.array_join("__kept", "")).cast("long"),
        "line_chars": F.length(F.array_join("__lines", "")).cast("long"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= rules.min_kept_share * F.col("line_chars")))
    return out.drop("__lines", "__kept", "__at")


def accepted(judged: DataFrame) -> DataFrame:
    """The rows of judge() that are kept.

    A row number stands between the verdict and the filter: without it the
    filter would be pushed below the steps of judge(), each of which it would
    then hold several times over.
    """
    return judged.withColumn("__row", F.monotonically_increasing_id()).where("kept AND __row >= 0").drop("__row")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", "line_chars"
    )


def verdict_sql(rules: Rules = Rules()) -> str:
    """SQL of op3_quality_rules, over the table documents."""
    count = lambda x, p: f"(length({x}) - length(regexp_replace({x}, '{p}', '', 'g')))"
    line_fails = (
        f"(length(x) >= {rules.min_line_chars} AND 100 * {count('x', SYMBOLS)} > {rules.max_symbol_share} * length(x))"
        f" OR (length(x) >= {rules.min_line_chars} AND regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}') AND 2 * {count('x', '\\p{Lu}')} > {count('x', '\\p{L}')})"
        f" OR (length(x) >= {rules.min_line_chars} AND 100 * {count('x', '\\p{P}')} > {rules.max_punctuation_share} * length(x))"
        f" OR regexp_matches(x, '{rules.link_names}') OR {count('x', rules.separators)} > {rules.max_separators}"
        f" OR ({count('x', rules.separators)} >= {rules.max_separators} AND len(regexp_extract_all(regexp_replace(x, '{rules.separators}', ' ', 'g'), '{WORD}+')) <= {rules.max_part_words} * ({count('x', rules.separators)} + 1))"
        f" OR regexp_matches(x, '{rules.boilerplate}')"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '{WORD}+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
v AS (SELECT row, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS words8
      FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS r(i)),
twice AS (SELECT row, words8 FROM v GROUP BY row, words8 HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT i + j) AS n FROM v JOIN twice USING (row, words8), range(0, {WINDOW}) AS k(j) GROUP BY row),
b AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             {count('text', SYMBOLS)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words,
             length(array_to_string(list_filter(lines, lambda x: NOT ({line_fails})), '')) AS kept_chars,
             length(array_to_string(lines, '')) AS line_chars
      FROM w LEFT JOIN covered USING (row))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_share} * n_words AS base_failed,
       NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_share} * n_words)
           AND 100 * kept_chars >= {rules.min_kept_share} * line_chars AS kept,
       kept_chars::BIGINT AS kept_chars, line_chars::BIGINT AS line_chars
FROM b"""

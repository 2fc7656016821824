"""Quality rules: line-first cleaning, in Spark SQL expressions only.

Every line is judged by itself (navigation, symbols, shouting, missing punctuation, boilerplate); failing lines
are removed and a document that loses more than `max_lost` of its word characters is rejected, as is one that
fails the base rule (under 10 words, or over 20 % of its words in 5-word windows found twice or more).

Defined cases: a null or empty text has no words and is rejected; blank lines are neutral and stay; a text
whose every line fails is rejected; repeated rows are judged one by one; other columns pass unchanged.
Everything is a function of one row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

#: Short lines with one of these phrases are boilerplate.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|licensed under|released under|general public license|terms of (use|service)"
    r"|privacy policy|cookie policy|accept (all )?cookies|subscribe to our|sign in|log in|click here"
    r"|enable javascript|skip to content|lorem ipsum|copyright \(c\))\b"
)
MAX_BOILERPLATE_WORDS = 30
MAX_LOST = 0.5


def _q(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _line_fails(x: str) -> str:
    """SQL of the rules over one line `x`; the rule's name, or null for a line that stays."""
    squeezed = f"regexp_replace({x}, {_q(SPACE)}, '')"
    symbols = f"(length({x}) - length(regexp_replace({x}, {_q(SYMBOLS)}, '')))"
    bars = f"(length({x}) - length(replace(replace(replace({x}, '|', ''), '»', ''), '›', '')))"
    letters = f"length(regexp_replace({x}, {_q(r'[^\p{L}]+')}, ''))"
    upper = f"length(regexp_replace({x}, {_q(r'[^\p{Lu}]+')}, ''))"
    n = f"size(filter(split({x}, {_q(SPACE)}), w -> w <> ''))"
    return (
        f"CASE WHEN {squeezed} = '' THEN NULL"
        f" WHEN {bars} >= 2 AND {bars} * 4 >= {n} THEN 'navigation'"
        f" WHEN {symbols} * 10 > length({squeezed}) THEN 'symbols'"
        f" WHEN {letters} >= 20 AND {upper} * 10 > {letters} * 6 THEN 'shouting'"
        f" WHEN NOT {x} RLIKE r'[.!?…。:;]' AND {n} >= 10 THEN 'punctuation'"
        f" WHEN {x} RLIKE {_q(BOILERPLATE)} AND {n} <= {MAX_BOILERPLATE_WORDS} THEN 'boilerplate'"
        " ELSE NULL END"
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `_words`, `_lines` and the base counts. Each step is a projection of its own, so that arrays are
    computed once and only read inside the lambdas."""
    step = docs.withColumns(
        {
            "_words": F.expr(f"filter(split(coalesce(`{text}`, ''), {_q(SPACE)}), w -> w <> '')"),
            "_lines": F.expr(f"split(coalesce(`{text}`, ''), '\\n')"),
        }
    )
    step = step.withColumns(
        {
            "_h": F.expr("transform(_words, w -> xxhash64(w))"),
            "n_words": F.expr("cast(size(_words) as bigint)"),
            "word_chars": F.expr("cast(length(array_join(_words, '')) as bigint)"),
            "n_symbols": F.expr(
                f"cast(length(coalesce(`{text}`, '')) - length(regexp_replace(coalesce(`{text}`, ''), {_q(SYMBOLS)}, '')) as bigint)"
            ),
            "_full": F.expr(f"filter(_lines, l -> l RLIKE {_q(WORD)})"),
        }
    )
    step = step.withColumns(
        {
            "_win": F.expr(
                "CASE WHEN size(_h) >= 5 THEN transform(sequence(0, size(_h) - 5), i -> xxhash64(get(_h, i), get(_h, i + 1),"
                " get(_h, i + 2), get(_h, i + 3), get(_h, i + 4))) ELSE cast(array() as array<bigint>) END"
            ),
            "n_dup_lines": F.expr("cast(size(_full) - size(array_distinct(_full)) as bigint)"),
        }
    )
    # Only texts with a repeated window sort their windows; equal neighbours are the repeated ones.
    step = step.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_win)) < size(_win) THEN array_sort(transform(_win, (x, i) -> struct(x as x, i as i)))"
            " ELSE cast(array() as array<struct<x: bigint, i: int>>) END"
        ),
    )
    step = step.withColumn(
        "_at",
        F.expr(
            "CASE WHEN size(_sorted) = 0 THEN cast(array() as array<int>) ELSE"
            " array_sort(transform(filter(sequence(0, size(_sorted) - 1), k -> get(_sorted, k).x <=> get(_sorted, k - 1).x"
            " OR get(_sorted, k).x <=> get(_sorted, k + 1).x), k -> get(_sorted, k).i)) END"
        ),
    )
    step = step.withColumn(
        "n_repeat_words",
        F.expr(
            "aggregate(_at, struct(cast(0 as bigint) as n, -9 as till), (a, i) ->"
            " struct(a.n + least(5, i + 5 - a.till) as n, i + 5 as till), a -> a.n)"
        ),
    )
    return step.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def clean_lines(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """`docs` with base counts, `cleaned` (text without failing lines), `n_failed_lines`, `lost` and `kept`."""
    step = base_counts(docs, text)
    step = step.withColumn("_ok", F.expr(f"filter(_lines, l -> ({_line_fails('l')}) IS NULL)"))
    step = step.withColumns(
        {
            "cleaned": F.expr("array_join(_ok, '\\n')"),
            "n_failed_lines": F.expr("cast(size(_lines) - size(_ok) as bigint)"),
        }
    )
    step = step.withColumn(
        "lost",
        F.expr(
            f"CASE WHEN word_chars = 0 THEN 1D WHEN n_failed_lines = 0 THEN 0D ELSE"
            f" 1D - length(regexp_replace(cleaned, {_q(SPACE)}, '')) / word_chars END"
        ),
    )
    return step.withColumn("kept", F.expr(f"NOT base_failed AND lost <= {max_lost:g}D")).drop(
        "_words", "_lines", "_h", "_full", "_win", "_sorted", "_at", "_ok"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines"
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines gone; `n_chars` follows the text.

    Rows leave by a generator: a filter would be pushed below the projections, and its copy of their expressions
    would be computed anew for every element of the arrays.
    """
    value = {"text": "cleaned", "n_chars": "cast(length(cleaned) as bigint)"}
    row = ", ".join(f"{value.get(c, f'_row.`{c}`')} as `{c}`" for c in docs.columns)
    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))  # no name can clash
    return clean_lines(apart).select(F.expr(f"inline(CASE WHEN kept THEN array(struct({row})) ELSE array() END)"))

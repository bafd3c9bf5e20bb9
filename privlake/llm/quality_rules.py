"""Quality rules: a threshold table compiled into one projection.

A ``Rule`` is a row of the table: a ratio, a bound on either side, the least
number of words from which it applies, and the points it gives when broken.
``compile_rules`` folds the table into one boolean expression (points < 1), so
the verdict is evaluated inside Spark's own expressions: no user function, no
shuffle, one scan.

Edge cases: null and empty text have no words and so fail the base rule; a null
bound is not checked; repeated rows are judged one by one; an empty table gives
an empty result; other columns of the input are kept by ``filter_quality`` and
may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from privlake.llm.common import WS_CLASS, split_words, table

WINDOW = 5

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is was for on with that as at by it be are this from or an "
    "le la les de des du et en un une est que qui dans pour "
    "der die das und ist nicht ein eine zu den dem mit von im für auf "
    "el los las del y es un una por con no para se"
).split()

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop")


@dataclass(frozen=True)
class Rule:
    ratio: str  # a key of RATIOS
    low: float | None = None
    high: float | None = None
    min_words: int = 10
    points: float = 1.0


#: Ratios the table may name, from the counted columns; the divisor is never 0.
RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "stop_word_ratio": ("n_stop", "n_words"),
}

#: A document goes when its points reach 1.  Missing stop words alone don't
#: condemn a text (lists, names, other languages), only with a second sign.
DEFAULT_RULES = (
    Rule("mean_word_length", low=2.0, high=20.0),
    Rule("symbol_ratio", high=0.5),
    Rule("dup_line_ratio", high=0.5),
    Rule("stop_word_ratio", low=0.01, min_words=50, points=0.5),
    Rule("symbol_ratio", high=0.1, points=0.5),
    Rule("mean_word_length", low=2.5, high=14.0, points=0.5),
)


def compile_rules(rules: tuple[Rule, ...], counts: dict[str, Column]) -> Column:
    """True where the points of the broken rules stay below 1."""

    def points(r: Rule) -> Column:
        top, bottom = RATIOS[r.ratio]
        ratio = counts[top] / F.greatest(counts[bottom], F.lit(1))
        broken = reduce(lambda a, b: a | b, [ratio < r.low] * (r.low is not None) + [ratio > r.high] * (r.high is not None), F.lit(False))
        return F.when(broken & (counts["n_words"] >= r.min_words), F.lit(r.points)).otherwise(F.lit(0.0))

    return reduce(lambda a, b: a + b, map(points, rules), F.lit(0.0)) < 1.0


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """One struct column ``row`` with the input's columns, and the counts.

    A 5-word window is compared by a 64-bit hash of its words.  Texts without a
    repeated window, most of them, skip the sorting path.
    """
    text = F.coalesce(text, F.lit(""))
    d = df.select(F.struct("*").alias("row"), text.alias("t"), split_words(text, WS_CLASS).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.when(
        F.size("w") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])),
    )
    d = d.select(
        "row", "w", lines.alias("lines"), hashes.alias("h"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
    )
    again = F.size(F.array_distinct("h")) < F.size("h")
    ordered = F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    d = d.select("*", ordered.alias("o"))
    same = F.filter(
        F.transform("o", lambda s, j: F.when((s["h"] == F.get(F.col("o"), j - 1)["h"]) | (s["h"] == F.get(F.col("o"), j + 1)["h"]), s["p"])),
        lambda p: p.isNotNull(),
    )
    d = d.select("*", F.when(F.col("o").isNotNull(), F.sort_array(same)).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), j + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    return d.select(
        "row",
        F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_stop",
    )


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """``row``, the counts, ``base_failed`` and ``kept`` of every row."""
    d = with_counts(df, F.col(text_col))
    counts = {c: F.col(c) for c in _COUNTS}
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumns({"base_failed": base, "kept": ~base & compile_rules(rules, counts)})


def filter_quality(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The rows of ``df`` that are kept, with the columns of ``df``."""
    # not where("kept"): Catalyst would push that filter down and repeat all the counts inside it
    d = judge(df, text_col, rules).select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return d.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    """DuckDB SQL for the query; windows are compared as text."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

    def points(r: Rule) -> str:
        top, bottom = RATIOS[r.ratio]
        ratio = f"{top}::double / greatest({bottom}, 1)"
        sides = [f"{ratio} < {r.low}"] * (r.low is not None) + [f"{ratio} > {r.high}"] * (r.high is not None)
        return f"(CASE WHEN ({' OR '.join(sides)}) AND n_words >= {r.min_words} THEN {r.points} ELSE 0.0 END)"

    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram FROM g),
r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
         (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(c.n, 0)::bigint AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' + '.join(map(points, DEFAULT_RULES))} < 1.0 AS kept
FROM b"""

"""Rule cascade over texts, in SQL expressions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rejection test as SQL over the text's measures and words."""
    name: str
    rejects: str


#: Thresholds leave a wide margin around prose; a text must be far off to be rejected.
RULES = (
    Rule("symbols", "n_symbols > 0.3D * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 3 AND n_dup_lines > 0.5D * n_lines"),
    Rule("word_length", "word_chars > 25L * n_words OR word_chars < 2L * n_words"),
    Rule("shouting", "4 * length(regexp_replace(text, '[^!?]', '')) > n_words AND n_words > 20"),
    Rule("capitals", "length(regexp_replace(text, '\\\\P{Lu}', '')) > 0.6D * word_chars"),
    Rule("letters", "length(regexp_replace(text, '\\\\P{L}', '')) < 0.5D * word_chars"),
    Rule("bullets", "n_lines > 5 AND size(filter(split(text, '\\n', -1), l -> ltrim(l) rlike '^[-*\\u2022]')) > 0.9D * n_lines"),
)


def with_measures(df: DataFrame, text: str, window: int = 8) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text.

    Nothing leaves the row: repeated word windows are found by sorting the hashes of a text's windows, and only
    in texts that have any. A null text counts as empty.
    """
    words = f"filter(split(`__text`, '{BLANKS}', -1), w -> w <> '')"
    hashed = df.selectExpr("*", f"coalesce({text}, '') AS `__text`").selectExpr(
        "*", f"transform({words}, w -> xxhash64(w)) AS `__words`",
        f"filter(split(`__text`, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS `__lines`")
    counted = hashed.selectExpr(
        "*", "size(`__words`) AS `__n`",
        f"if(size(`__words`) < {window}, array(), transform(sequence(1, size(`__words`) - {window - 1}), "
        f"i -> xxhash64(slice(`__words`, i, {window})))) AS `__windows`")
    ordered = counted.selectExpr(
        "*", "CASE WHEN size(array_distinct(`__windows`)) < size(`__windows`) THEN "
        "sort_array(transform(`__windows`, (h, i) -> named_struct('h', h, 'i', i))) END AS `__order`")
    paired = ordered.selectExpr("*", """CASE WHEN `__order` IS NOT NULL THEN zip_with(`__order`,
        slice(`__order`, 2, greatest(size(`__order`) - 1, 0)), (a, b) -> named_struct('i', a.i, 'j', b.i, 'same', a.h <=> b.h))
        END AS `__pairs`""")
    placed = paired.selectExpr("*", """CASE WHEN `__pairs` IS NOT NULL THEN sort_array(array_distinct(flatten(transform(
        filter(`__pairs`, p -> p.same), p -> array(p.i, p.j))))) END AS `__at`""")
    covered = placed.selectExpr("*", f"""CASE WHEN `__at` IS NULL THEN 0L ELSE aggregate(zip_with(`__at`,
        slice(`__at`, 2, greatest(size(`__at`) - 1, 0)), (a, b) -> least({window}, coalesce(b - a, {window}))),
        0L, (total, x) -> total + x) END AS `__repeated`""")
    return covered.selectExpr(
        *[f"`{c}`" for c in df.columns], "`__text`", "bigint(`__n`) AS n_words",
        f"bigint(length(regexp_replace(`__text`, '{BLANKS}', ''))) AS word_chars",
        f"bigint(length(`__text`) - length(translate(`__text`, '{SYMBOLS}', ''))) AS n_symbols",
        "bigint(size(`__lines`)) AS n_lines", "bigint(size(`__lines`) - size(array_distinct(`__lines`))) AS n_dup_lines",
        "`__repeated` AS n_repeat_words")


def _seconds(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def cascade_order(measured: DataFrame, rules=RULES, sample_rows: int = 1000) -> list[Rule]:
    """Order rules by rejection per cost, both estimated on a sample of at most `sample_rows` measured texts.

    The cost of a rule is the time of a pass with it less that of a pass without, and a small constant, so that
    no rule is free. Only the order depends on these estimates; the verdict of the cascade does not.
    """
    sample = measured.limit(sample_rows).persist()
    try:
        n = sample.count()
        if not n:
            return list(rules)
        named = sample.withColumnRenamed("__text", "text") if "text" not in sample.columns else \
            sample.drop("text").withColumnRenamed("__text", "text")
        counts = named.selectExpr(*[f"count_if({r.rejects}) AS `{r.name}`" for r in rules]).first()
        idle = _seconds(named.selectExpr("n_words"))
        cost = {r.name: max(0.0, _seconds(named.selectExpr(f"{r.rejects} AS r")) - idle) + 1e-3 for r in rules}
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: (-(counts[r.name] + 0.5) / (n + 1) / cost[r.name], r.name))


def judge_quality(df: DataFrame, id_column: str = "doc_id", text: str = "text", rules=RULES,
                  min_words: int = 20, repeat_percent: int = 30, sample_rows: int = 1000) -> DataFrame:
    """Measures, base verdict and cascade verdict of each whole text, one row per input row.

    Base: fewer than `min_words` words, or over `repeat_percent` percent of the words in repeated windows. The
    rest run as one CASE in the order of `cascade_order`: a text that one rule rejects is not tested by the next.
    A null or empty text has no words and fails the base. Repeated rows and ties get a row each with the same
    verdict; an empty table gives no rows; other columns of the input are not returned, whatever their names.
    """
    own = df.select(F.col(id_column).alias("__id"), F.col(text).alias("__in"))
    order = cascade_order(with_measures(own.limit(sample_rows), "__in"), rules, sample_rows)
    measured = with_measures(own, "__in").withColumnRenamed("__text", "text")
    tests = " ".join(f"WHEN {r.rejects} THEN false" for r in order)
    base = f"n_words < {min_words} OR 100 * n_repeat_words > {repeat_percent} * n_words"
    return measured.selectExpr(
        f"`__id` AS `{id_column}`", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"{base} AS base_failed", f"CASE WHEN {base} THEN false {tests} ELSE true END AS kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
h AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY 1),
m AS (SELECT w.doc_id, text, len(words)::bigint AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, len(lines)::bigint AS n_lines,
        len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^ *[-*\x{2022}]'))) AS bullets,
        length(regexp_replace(text, '[^!?]', '', 'g')) AS marks, length(regexp_replace(text, '\P{Lu}', '', 'g')) AS capitals,
        length(regexp_replace(text, '\P{L}', '', 'g')) AS letters, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words
    FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols > 0.3::double * n_words OR (n_dup_lines > 3 AND n_dup_lines > 0.5::double * n_lines)
        OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR (4 * marks > n_words AND n_words > 20)
        OR capitals > 0.6::double * word_chars OR letters < 0.5::double * word_chars
        OR (n_lines > 5 AND bullets > 0.9::double * n_lines)) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
"""

"""How filters overlap: what every order of them removes, and each one's Shapley share, from coalition counts.

Documents are counted once per part and pattern of failed filters. From these few counts comes the number that each of
the 32 coalitions removes. Steps of an order are differences of two coalitions; Shapley shares solve the least squares
problem over all coalitions with the Shapley kernel as weights and the efficiency condition as a constraint. Its normal
equations are solved once in rationals, for all right-hand sides, so parts only take exact integer combinations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import BLANKS


@dataclass(frozen=True)
class Filter:
    """A letter and its failure condition: SQL over text, words (array) and n_words; None: a copy of a smaller id's text."""
    letter: str
    fails: str | None


FILTERS = (
    Filter("A", "n_words < 200"),
    Filter("B", "100L * size(array_distinct(words)) < 50L * n_words"),
    Filter("C", "100L * length(regexp_replace(text, '[^A-Z]+', '')) > 3L * length(text)"),
    Filter("D", "text rlike '[#$%&*|]'"),
    Filter("E", None),
)


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Solve matrix * x = right for all columns of right by elimination in rationals."""
    n = len(matrix)
    rows = [list(m) + list(r) for m, r in zip(matrix, right)]
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [r[n:] for r in rows]


def shapley_weights(m: int) -> list[list[int]]:
    """weights[i][S]: m! times the share of player i per unit of coalition S (a bit mask), all integers.

    Least squares over the coalitions between none and all, weighted by (m - 1) / (C(m, s) s (m - s)), under the
    condition that the shares add up to the value of all. The unknowns are the shares and the multiplier.
    """
    full = (1 << m) - 1
    inner = range(1, full)
    kernel = {s: Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in inner}
    normal = [[sum((kernel[s] for s in inner if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(m)] + [Fraction(1)]
              for i in range(m)] + [[Fraction(1)] * m + [Fraction(0)]]
    right = [[kernel[s] if s in kernel and s >> i & 1 else Fraction(0) for s in range(full + 1)] for i in range(m)]
    right.append([Fraction(int(s == full) - int(s == 0)) for s in range(full + 1)])
    shares = [[x * factorial(m) for x in row] for row in solved(normal, right)[:m]]
    assert all(x.denominator == 1 for row in shares for x in row)
    return [[int(x) for x in row] for row in shares]


def failure_patterns(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS,
                     id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, pattern, n, good, toxic): documents per part and set of failed filters, bit i for filter i.

    Copies are found by SHA-256 digests. Rows are first counted per id, then per digest and part, so a text that holds
    a third of the table reaches each task as a handful of partial counts. Only a strictly smaller id makes a copy: rows
    that repeat an id with the same text are no copies of each other, and a null id neither is nor makes one.
    """
    m, own = len(filters), [f for f in filters if f.fails is not None]
    copies = next((1 << i for i, f in enumerate(filters) if f.fails is None), 0)
    bits = {f.letter: 1 << i for i, f in enumerate(filters)}
    if m != len(bits) or len(own) < m - 1 or not 2 <= m <= 8:
        raise ValueError("2 to 8 filters with letters of their own, at most one for copies")
    texts = docs.selectExpr(f"bigint(`{id_column}`) AS id", f"coalesce(string(`{part}`), '') AS part",
                            f"coalesce(string(`{text}`), '') AS text")
    worded = texts.selectExpr("id", "part", "text", f"array_remove(split(text, '{BLANKS}', -1), '') AS words") \
                  .selectExpr("*", "size(words) AS n_words")
    pattern = " | ".join([f"if({f.fails}, {bits[f.letter]}, 0)" for f in own] or ["0"])
    # rows without an id match no label; their digests keep them from meeting in one task, copies are counted before
    slim = worded.selectExpr("id", "part", "unhex(sha2(text, 256)) AS digest", f"{pattern} AS pattern") \
                 .selectExpr("*", "if(id IS NULL, xxhash64(digest), 0L) AS salt")
    counted = slim.groupBy("id", "salt", "part", "digest", "pattern").agg(F.expr("count(1) AS n"))
    judged = labels.filter(f"`{id_column}` IS NOT NULL").groupBy(F.col(id_column).cast("bigint").alias("id")).agg(
        F.expr("bool_or(quality <=> 1) AS good"), F.expr("bool_or(toxic <=> 1) AS toxic")).withColumn("salt", F.expr("0L"))
    rows = counted.join(judged, ["id", "salt"], "left").selectExpr(
        "id", "part", "digest", "pattern", "coalesce(good, false) AS good", "coalesce(toxic, false) AS toxic", "n")
    keys = ["digest", "pattern", "part", "good", "toxic"]
    held = rows.groupBy(*keys).agg(
        F.expr("min(id) AS least"), F.expr("min_by(n, id) FILTER (WHERE id IS NOT NULL) AS n_least"),
        F.expr("sum(n) AS n"), F.expr("coalesce(sum(n) FILTER (WHERE id IS NULL), 0L) AS n_unnamed"))
    first = "min(least) OVER (PARTITION BY digest)"
    split = held.selectExpr("*", f"n_unnamed + if(least <=> {first}, coalesce(n_least, 0L), 0L) AS n_first") if copies \
        else held.selectExpr("*", "n AS n_first")
    spread = split.selectExpr("part", "good", "toxic", f"stack(2, pattern, n_first, pattern | {copies}, n - n_first) AS (pattern, n)")
    return spread.filter("n > 0").groupBy("part", "pattern").agg(
        F.expr("sum(n) AS n"), F.expr("sum(if(good, n, 0L)) AS good"), F.expr("sum(if(toxic, n, 0L)) AS toxic"))


def coalition_removals(patterns: DataFrame, m: int) -> DataFrame:
    """(part, coalition, removed, good, toxic): documents that fail a filter of the coalition; all 2^m of each part."""
    hit = "pattern & coalition <> 0"
    return patterns.selectExpr("*", f"explode(sequence(0, {(1 << m) - 1})) AS coalition").groupBy("part", "coalition").agg(
        F.expr("sum(n) AS n"), *[F.expr(f"sum(if({hit}, {c}, 0L)) AS {name}")
                                 for c, name in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))])


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS,
                  id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of all filters and step, with counts of documents of that part.

    kept, removed, redundant (fail the step's filter, gone before), unique_fails (fail no other filter), good_lost and
    toxic_lost (removed here, labelled quality = 1 or toxic = 1 by any row of labels), shapley (removed by the filter
    summed over all orders). A null text is empty; a null part is the part ''; an empty text has no words, so it fails
    A alone. Ties and repeated rows count as documents of their own. An empty table has no parts and gives no rows;
    other columns are ignored, whatever their names.
    """
    m, letters = len(filters), [f.letter for f in filters]
    full, at = (1 << m) - 1, {f.letter: i for i, f in enumerate(filters)}
    table = coalition_removals(failure_patterns(docs, labels, filters, id_column, text, part), m)
    # 2^m entries a part, in the order of the coalition's number
    held = table.groupBy("part").agg(F.expr("max(n) AS n"), F.expr(
        "array_sort(collect_list(struct(coalition, removed, good, toxic))) AS v"))
    weights = shapley_weights(m)
    shares = [" + ".join(f"{w}L * v[{s}].removed" for s, w in enumerate(row) if w) for row in weights]
    parts = held.selectExpr("*", f"array({', '.join(shares)}) AS shares")
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(letters))
    place = f"locate(substr(filter_order, step, 1), '{''.join(letters)}') - 1"
    earlier = f"aggregate(sequence(1, {m}), 0, (s, i) -> if(i < step, s | shiftleft(1, locate(substr(filter_order, i, 1), '{''.join(letters)}') - 1), s))"
    assert all(len(x) == 1 for x in at)
    steps = parts.selectExpr("*", f"explode(array({orders})) AS filter_order") \
                 .selectExpr("*", f"explode(sequence(1, {m})) AS step") \
                 .selectExpr("*", f"{place} AS f", f"{earlier} AS before") \
                 .selectExpr("*", "shiftleft(1, f) AS own", "before | shiftleft(1, f) AS after")
    return steps.selectExpr(
        "part", "filter_order", "step", "n - v[after].removed AS kept", "v[after].removed - v[before].removed AS removed",
        "v[own].removed + v[before].removed - v[after].removed AS redundant",
        f"v[{full}].removed - v[{full} - own].removed AS unique_fails", "v[after].good - v[before].good AS good_lost",
        "v[after].toxic - v[before].toxic AS toxic_lost", "shares[f] AS shapley")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
         'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < doc_id, false)} AS t
    FROM w LEFT JOIN l USING (doc_id)),
p AS (SELECT part, concat(if(t.A, 'A', ''), if(t.B, 'B', ''), if(t.C, 'C', ''), if(t.D, 'D', ''), if(t.E, 'E', '')) AS fails,
        count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
o AS (SELECT concat(a, b, c, d, e) AS filter_order FROM unnest(['A','B','C','D','E']) x(a), unnest(['A','B','C','D','E']) y(b),
        unnest(['A','B','C','D','E']) z(c), unnest(['A','B','C','D','E']) u(d), unnest(['A','B','C','D','E']) v(e)
    WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step::int AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before
    FROM o, unnest(range(1, 6)) r(step)),
x AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS hit,
        before <> '' AND regexp_matches(fails, '[' || before || '-]') AS gone FROM p, s),
c AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed,
        sum(n) FILTER (gone AND hit) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
        sum(good) FILTER (NOT gone AND hit) AS good_lost, sum(toxic) FILTER (NOT gone AND hit) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed,
    coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
    coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::bigint AS shapley
FROM c
"""

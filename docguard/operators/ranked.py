"""Running totals, ranks and exact quantiles without one task that sees all rows.

The input is first aggregated to one row per distinct value, so a value held by a third
of all rows costs one row.  The distinct values are then cut into ranges; a window runs
inside each range only, and the few range totals are summed up in front of it.  Single
ranks need less: only the ranges that hold them are ranked, all others are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docguard.functions.numbers import nan_to_null, num, quote

RANGES = 1023  # cut points between ranges at least; four for each shuffle partition where that is more
STEP = 32  # one coarse cut point for so many fine ones


def running_totals(counts: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add <s>_before (sum over smaller values) and <s>_total for every s in sums.

    counts holds one row per (by, value); by is not NULL, a NULL value comes first.
    """
    keys = [*by, "_range"]
    columns = counts.columns
    # coarse cuts first, then the fine ones between two of them
    coarse = f"size(filter(_cuts.coarse, cut -> cut < {value}))"
    fine = f"size(filter(slice(_cuts.fine, {STEP} * _coarse + 1, {STEP}), cut -> cut < {value}))"
    placed = counts.withColumn("_cuts", _cut_points(counts, value)).selectExpr("*", f"{coarse} AS _coarse")
    # never NULL: else a filter on it would be inferred from the join and evaluated per input row
    ranged = placed.selectExpr(*columns, f"coalesce({STEP} * _coarse + {fine}, 0) AS _range")
    totals = ranged.groupBy(*keys).agg(*[F.expr(f"sum({s}) AS {s}") for s in sums])
    group = f"PARTITION BY {', '.join(by) or '1'}"
    earlier = "ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = totals.selectExpr(
        *keys, *[f"coalesce(sum({s}) OVER ({group} {earlier}), 0) AS _{s}_offset" for s in sums],
        *[f"sum({s}) OVER ({group}) AS {s}_total" for s in sums])
    inside = f"PARTITION BY {', '.join(keys)} ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return ranged.join(offsets, keys).selectExpr(
        *columns, *[f"_{s}_offset + coalesce(sum({s}) OVER ({inside}), 0) AS {s}_before" for s in sums],
        *[f"{s}_total" for s in sums])


#: Rank error of the sketch that places the ranges, as one over it; a range reaches four times as far to either side.
ACCURACY = 4000
#: Columns with so many values at most are one range.
FEW = 20_000


def selected_counts(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(feature, value, n, ranked): the values of the ranges that hold the wanted ranks, one row each, ranked = true;
    of the values between two ranges one row with their number.

    A quantile sketch, whose error is bounded, places the ranges; the counts around them are exact.  What is shuffled
    and sorted afterwards is a share of the values that does not depend on the data, however many distinct ones there are.
    """
    wanted = sorted(set(probabilities))
    margin = 4.0 / ACCURACY
    shares = [x for p in wanted for x in (max(0.0, p - margin), min(1.0, p + margin))]
    wide = df.selectExpr(*[f"{nan_to_null(f'double({c})')} AS c{i}" for i, c in enumerate(columns)])
    everything = f"array({', '.join(["double('-infinity'), double('infinity')"] * len(wanted))})"
    sketch = wide.agg(*[F.expr(
        f"if(count(c{i}) <= {FEW}, {everything}, percentile_approx(c{i}, array({', '.join(num(x) for x in shares)}), {ACCURACY})) AS c{i}")
        for i in range(len(columns))])
    edges = sketch.selectExpr(f"named_struct({', '.join(f'{quote(f"c{i}")}, c{i}' for i in range(len(columns)))})").scalar()
    held = ", ".join(f"{quote(c)}, c{i}, _edges.c{i}" for i, c in enumerate(columns))
    long = wide.withColumn("_edges", edges).selectExpr(f"stack({len(columns)}, {held}) AS (feature, value, edges)").filter("value IS NOT NULL")
    inside = " OR ".join(f"value BETWEEN edges[{2 * k}] AND edges[{2 * k + 1}]" for k in range(len(wanted)))
    before = " + ".join(f"int(value > edges[{2 * k + 1}])" for k in range(len(wanted)))
    placed = long.selectExpr("feature", "value", f"({inside}) AS ranked", f"{before} AS gap")
    return placed.groupBy("feature", "ranked", F.expr("if(ranked, -1, gap) AS gap"), F.expr("if(ranked, value, null) AS own")).agg(
        F.expr("min(value) AS value"), F.expr("count(1) AS n")).select("feature", "value", "n", "ranked")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """One row per column with linearly interpolated exact quantiles, e.g. {"median": .5}.

    Only values near a wanted rank are ranked (selected_counts).  Should the sketch ever miss a rank, the job fails.
    """
    ranked = running_totals(selected_counts(df, columns, list(probabilities.values())), "value", ["n"], ["feature"])

    def value_at(place: str) -> str:
        found = "if(ranked, value, double(raise_error('the sketch missed a rank')))"
        return f"max(if(n_before <= {place} AND {place} < n_before + n, {found}, null))"

    edges, result = [], []
    for name, p in probabilities.items():
        place = f"({num(p)} * (n_total - 1))"
        edges += [f"{value_at(f'floor({place})')} AS _{name}_low", f"{value_at(f'ceil({place})')} AS _{name}_high"]
        between = f"_{name}_low + (_{name}_high - _{name}_low) * ({place} - floor({place}))"
        result.append(f"if(_{name}_low = _{name}_high, _{name}_low, {between}) AS {name}")
    held = ranked.groupBy("feature").agg(*[F.expr(e) for e in ["max(n_total) AS n_total", *edges]])
    return held.selectExpr("feature", *result)


def value_at_rank(values: DataFrame, value: str, ranks: dict[str, str], prefix: int = 4) -> DataFrame:
    """One row: the values at the given 1-based ranks (NULL for rank 0) of distinct texts that spread, such as digests.

    A rank is an expression over the column n_total, the number of values.  Values are counted per prefix; only those
    that share a prefix with a wanted one are sorted.
    """
    distinct = values.select(F.col(value).alias("value")).filter("value IS NOT NULL").distinct().selectExpr(
        "value", f"substring(value, 1, {prefix}) AS part")
    # at most 16 ** prefix rows of hexadecimal digests
    counts = distinct.groupBy("part").agg(F.expr("count(1) AS n")).selectExpr(
        "part", "n", "sum(n) OVER (PARTITION BY 1 ORDER BY part) - n AS n_before", "sum(n) OVER (PARTITION BY 1) AS n_total")
    wanted = ", ".join(f"named_struct('name', {quote(name)}, 'rank', bigint({rank}))" for name, rank in ranks.items())
    held = counts.selectExpr("part", "n", "n_before", f"explode(array({wanted})) AS at") \
        .filter("at.rank > n_before AND at.rank <= n_before + n").selectExpr("part", "at.name AS name", "at.rank - n_before AS place")
    near = distinct.join(F.broadcast(held.select("part").distinct()), "part")  # a part for each rank at most
    ordered = near.selectExpr("part", "value", "row_number() OVER (PARTITION BY part ORDER BY value) AS place")
    found = ordered.join(F.broadcast(held), ["part", "place"])
    return found.agg(*[F.expr(f"max(if(name = {quote(name)}, value, null)) AS {name}") for name in ranks])


def _cut_points(counts: DataFrame, value: str) -> Column:
    """Sorted cut points between the ranges, drawn by hash.

    The draw is the same whenever it runs, so a recomputed task agrees with the others;
    how well the ranges are balanced never changes the result.  All columns take part in the
    order, so this reads the very aggregation that the totals read, and Spark runs it once.
    """
    ranges = max(RANGES, 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1)
    drawn = counts.orderBy(F.xxhash64(value), *counts.columns).limit(ranges)
    cuts = f"array_sort(collect_list({value}))"
    return drawn.agg(F.expr(f"{cuts} AS fine")).selectExpr(
        f"named_struct('fine', fine, 'coarse', filter(fine, (cut, i) -> i % {STEP} = {STEP - 1}))").scalar()

"""Profiles and summaries of datasets and feature matrices."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docguard.fixed_values import SPLITS
from docguard.functions.numbers import listed, nan_to_null, quote, ratio, rounded, share
from docguard.operators.features import replaced
from docguard.operators.ranked import exact_quantiles
from docguard.operators.splits import aggregates


def _column_measures(columns: Sequence[str], fields: dict[str, str]) -> list[str]:
    """Aggregates of all columns, <field>_<i> for the i-th; {x} is the column."""
    return [f"{e.format(x=nan_to_null(f'double({c})'))} AS {f}_{i}" for i, c in enumerate(columns) for f, e in fields.items()]


def _per_column(df: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One global aggregate over all columns, laid out as one row per column."""
    wide = df.agg(*aggregates(*_column_measures(columns, fields)))
    rows = ", ".join(f"{quote(c)}, " + ", ".join(f"{f}_{i}" for f in fields) for i, c in enumerate(columns))
    return wide.selectExpr(f"stack({len(columns)}, {rows}) AS (feature, {', '.join(fields)})")


_STATS = {"mean": "avg({x})", "std": "stddev_samp({x})", "min": "min({x})", "max": "max({x})",
          "zeros": "count_if({x} = 0)", "nonzero_pct": ratio("count_if({x} <> 0)", "count(1)") + " * 100"}
_STATS_DIGITS = {"mean": 6, "std": 6, "min": 6, "max": 6, "nonzero_pct": 2}


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, std, min, max, zeros and share of non-zeros per feature: one global aggregate that skips NaN."""
    return replaced(_per_column(df, columns, _STATS), {c: rounded(c, n) for c, n in _STATS_DIGITS.items()})


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per column, 4 decimals."""
    plain = _per_column(df, columns, {"count": "count({x})", "mean": "avg({x})", "std": "stddev_samp({x})",
                                      "min": "min({x})", "max": "max({x})"})
    quartiles = exact_quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    shown = ("mean", "std", "min", "q25", "q50", "q75", "max")
    return plain.join(quartiles, "feature", "left").selectExpr(
        "feature", "count", *[f"{rounded(c, 4)} AS {c}" for c in shown])


def signal_summary(df: DataFrame) -> DataFrame:
    """Vision score and keyword density of all documents, with and without image."""
    plain = df.agg(*aggregates(
        "count(1) AS n", "count_if(has_image = 1) AS with_image", "count_if(has_image = 0) AS text_only",
        "avg(vision_score) AS mean", "stddev_samp(vision_score) AS std", "min(vision_score) AS min",
        "max(vision_score) AS max", "count_if(vision_score > 0) AS n_positive",
        "count_if(keyword_density > 0) AS n_keywords",
        "avg(if(keyword_density > 0, keyword_density, null)) AS mean_keywords", "'vision_score' AS feature"))
    return plain.join(exact_quantiles(df, ["vision_score"], {"median": 0.5}), "feature").drop("feature")


#: Pairs of so many columns at most are single aggregates of one plan; more columns are worked off as matrices.
NARROW = 16


def correlation_matrix(df: DataFrame, columns: Sequence[str], narrow: int = NARROW) -> DataFrame:
    """Pearson correlation (a, b, r) of all pairs a <= b over the rows where both are known; NaN counts as NULL.

    NULL where a column is constant over these rows.  Both ways to compute give the same numbers: few columns are
    aggregates in generated code, many are blocked products of matrices per Arrow batch.
    """
    known = df.selectExpr(*[f"{nan_to_null(f'double(`{c}`)')} AS c{i}" for i, c in enumerate(columns)])
    if len(columns) > narrow:
        return _gram_correlations(known, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    # deviations are those of the rows where the other column is known, too
    wide = known.agg(*aggregates(*[
        f"named_struct('xy', covar_pop(c{i}, c{j}), 'xx', var_pop(if(c{j} IS NULL, null, c{i})), "
        f"'yy', var_pop(if(c{i} IS NULL, null, c{j}))) AS p{i}_{j}" for i, j in pairs]))
    rows = ", ".join(f"{quote(columns[i])}, {quote(columns[j])}, p{i}_{j}" for i, j in pairs)
    r = "if(a = b, if(p.xx > 0, 1.0D, null), try_divide(p.xy, sqrt(p.xx) * sqrt(p.yy)))"
    return wide.selectExpr(f"stack({len(pairs)}, {rows}) AS (a, b, p)").selectExpr("a", "b", f"{r} AS r")


def _gram_correlations(known: DataFrame, columns: Sequence[str], block: int = 64) -> DataFrame:
    """Correlations from sums of products over pairs of column blocks.

    A task adds up, for each pair of blocks, five matrices of at most block x block numbers: rows known in both, sums and
    squares of either side over these rows, and products.  Values are shifted by their columns' means first, so large
    offsets cancel nothing.  A task's state is k x k numbers whatever its rows; the shuffle merges one row per
    column pair and task.
    """
    k = len(columns)
    means = known.agg(*aggregates(*[f"coalesce(avg(c{i}), 0.0D) AS c{i}" for i in range(k)])).first()
    shift = [float(means[i]) for i in range(k)]

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        cuts = [(at, min(k, at + block)) for at in range(0, k, block)]
        held = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns], 1)
                there = ~np.isnan(x)
                x = np.where(there, x - np.array(shift), 0.0)
                w, xx = there.astype(float), x * x
                for a, (i, i2) in enumerate(cuts):
                    for b, (j, j2) in enumerate(cuts[a:], a):
                        part = np.stack([w[:, i:i2].T @ w[:, j:j2], x[:, i:i2].T @ w[:, j:j2], w[:, i:i2].T @ x[:, j:j2],
                                         xx[:, i:i2].T @ w[:, j:j2], w[:, i:i2].T @ xx[:, j:j2], x[:, i:i2].T @ x[:, j:j2]])
                        held[a, b] = held[a, b] + part if (a, b) in held else part
        for (a, b), part in held.items():
            at = np.indices(part.shape[1:])
            left, right = cuts[a][0] + at[0].ravel(), cuts[b][0] + at[1].ravel()
            keep = left <= right
            yield pa.record_batch([pa.array(left[keep].astype(np.int32)), pa.array(right[keep].astype(np.int32)),
                                   *[pa.array(p.ravel()[keep]) for p in part]], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    parts = known.mapInArrow(sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    total = parts.groupBy("i", "j").agg(*aggregates(*[f"sum({c}) AS {c}" for c in ("n", "x", "y", "xx", "yy", "xy")]))
    spread = total.selectExpr("i", "j", "n", "n * xy - x * y AS cxy", "n * xx - x * x AS cxx", "n * yy - y * y AS cyy", "xx", "yy")
    # what is left of a constant column is rounding
    flat = "n < 2 OR cxx <= 1e-13D * n * xx OR cyy <= 1e-13D * n * yy"
    names = f"array({listed(columns)})"
    return spread.selectExpr(f"{names}[i] AS a", f"{names}[j] AS b",
                             f"if({flat}, null, if(i = j, 1.0D, try_divide(cxy, sqrt(cxx) * sqrt(cyy)))) AS r")


def top_families(df: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent attack families among malicious rows."""
    counted = df.filter("label = 'malicious'").groupBy("attack_family").agg(F.expr("count(1) AS n"))
    return counted.orderBy(F.desc("n"), "attack_family").limit(k)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (2 * n_class) per class."""
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.expr("count(1) AS n"))
    # the window runs over the few class rows
    return sizes.selectExpr("label", "n", f"{ratio('sum(n) OVER (PARTITION BY 1)', 'n * 2')} AS weight")


def over_limit_share(df: DataFrame, limit: int = 512, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.expr(f"{share(f'approx_tokens > {limit}')} AS over_limit"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins are left out."""
    known = df.selectExpr(f"double({column}) AS x").filter("x IS NOT NULL")
    limits = known.agg(F.expr("named_struct('low', min(x), 'high', max(x))")).scalar()
    place = f"floor(try_divide((x - _l.low) * {bins}, _l.high - _l.low))"
    placed = known.withColumn("_l", limits).selectExpr("x", f"int(least(coalesce({place}, 0), {bins - 1})) AS bin")
    return placed.groupBy("bin").agg(*aggregates("count(1) AS n", "min(x) AS low", "max(x) AS high"))


def label_balance_ratio(df: DataFrame, label: str = "label", warn_below: float = 0.3) -> DataFrame:
    sizes = df.groupBy(label).agg(F.expr("count(1) AS n"))
    return sizes.agg(F.expr(f"{ratio('min(n)', 'max(n)')} AS balance_ratio")) \
        .selectExpr("balance_ratio", f"balance_ratio < {warn_below}D AS imbalanced")


def flag_share(df: DataFrame, column: str) -> DataFrame:
    """Counts per raw value, with the overall share of true values and whether it is above one half."""
    counted = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.expr("count(1) AS n"))
    # both windows run over the few value rows
    true = "sum(if(lower(value) IN ('true', '1'), n, 0)) OVER (PARTITION BY 1)"
    return counted.selectExpr("value", "n", f"{ratio(true, 'sum(n) OVER (PARTITION BY 1)')} AS true_share") \
        .selectExpr("*", "true_share > 0.5D AS mostly_true")


def ocr_run_summary(cache: DataFrame) -> DataFrame:
    """Coverage of an OCR run: non-empty texts, errors, mean length and confidence, and the gate."""
    totals = cache.agg(*aggregates(
        "count(1) AS n", "count_if(ocr_text_cached <> '') AS non_empty", "count_if(error IS NOT NULL) AS errors",
        "avg(if(ocr_text_cached <> '', char_count, null)) AS mean_chars",
        "avg(if(ocr_confidence > 0, ocr_confidence, null)) AS mean_confidence"))
    return totals.selectExpr("*", f"{ratio('non_empty', 'n')} * 100 AS non_empty_pct",
                             "non_empty >= floor(n * 0.99D) AS passed")


def _value_counts_map(df: DataFrame, column: str) -> Column:
    """Counts per value as one map; for columns with a short closed list of values."""
    counted = df.groupBy(column).agg(F.expr("count(1) AS n"))
    entries = f"array_sort(collect_list(named_struct('k', coalesce({column}, 'NULL'), 'n', n)))"
    return counted.agg(F.expr(f"map_from_entries({entries})")).scalar()


def dataset_card(df: DataFrame, seed: int = 42, version: str = "v1.0") -> DataFrame:
    """One record: totals, sizes per split, labels, image-backed rows, columns, families."""
    columns = df.columns
    totals = df.agg(*aggregates(
        "count(1) AS total_samples", *[f"count_if(split = '{s}') AS {s}_samples" for s in SPLITS],
        f"{'count(image_path)' if 'image_path' in columns else 'bigint(0)'} AS image_backed_samples"))
    card = totals.withColumn("label_distribution", _value_counts_map(df, "label"))
    families = "map()"
    if "attack_family" in columns:
        card, families = card.withColumn("_families", _value_counts_map(df, "attack_family")), "_families"
    return card.selectExpr(
        *totals.columns, f"{quote(version)} AS dataset_version", "label_distribution",
        f"array({listed(columns)}) AS columns", f"{seed} AS random_seed", f"map_keys({families}) AS attack_families")


def run_log(df: DataFrame, options: dict[str, Any]) -> DataFrame:
    """One record of a run: totals, image-backed rows, and the options as given."""
    totals = df.agg(*aggregates("count(1) AS total_samples", "count_if(has_image = 1) AS image_samples"))
    return totals.withColumns({name: F.lit(value) for name, value in options.items()})


def summary_measures(columns: Sequence[str]) -> list[str]:
    """The aggregates that feature_matrix_summary is made of, for one pass or for an observation of a write."""
    return ["count(1) AS total_samples", *[f"count_if(split = '{s}') AS split_{s}" for s in SPLITS],
            "count_if(label = 0) AS benign", "count_if(label = 1) AS malicious",
            "count_if(total_boxes > 0) AS samples_with_images", *_column_measures(columns, _STATS)]


def summary_record(measured: DataFrame, columns: Sequence[str], total_columns: int) -> DataFrame:
    """The record of a matrix from one row of its summary_measures."""
    def stats(i: int, name: str) -> str:
        values = ", ".join(f"'{f}', {rounded(f'{f}_{i}', _STATS_DIGITS[f]) if f in _STATS_DIGITS else f'{f}_{i}'}" for f in _STATS)
        return f"named_struct('feature', {quote(name)}, {values})"

    splits = ", ".join(f"'{s}', split_{s}" for s in SPLITS)
    return measured.selectExpr(
        "total_samples", f"named_struct({splits}) AS split_counts",
        "named_struct('benign', benign, 'malicious', malicious) AS label_counts", "samples_with_images",
        f"array_sort(array({', '.join(stats(i, c) for i, c in enumerate(columns))})) AS feature_stats",
        f"array({listed(columns)}) AS feature_columns", f"{total_columns} AS total_columns")


def feature_matrix_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One record: totals, sizes per split and label, rows with boxes, statistics per feature: one pass."""
    return summary_record(df.agg(*aggregates(*summary_measures(columns))), columns, len(df.columns))

"""Data-quality gates: (check, passed, detail) rows; enforce() turns a failed row into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docguard.fixed_values import FOURTEEN_FEATURES, SPLITS, VISION_DOUBLES, VISION_REQUIRED
from docguard.functions.numbers import listed, quote, ratio
from docguard.operators.splits import PAIRS, aggregates, leaking_groups, split_overlap, unique_count


class QualityError(AssertionError):
    """A quality gate did not pass."""


def enforce(gate: DataFrame) -> None:
    """Run a gate and raise with the details of every check that failed."""
    failed = [f"{row['check']}: {row['detail']}" for row in gate.filter("NOT passed").collect()]
    if failed:
        raise QualityError("; ".join(failed))


def _report(one: DataFrame, checks: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = ", ".join(f"{quote(name)}, {passed}, string({detail})" for name, passed, detail in checks)
    return one.selectExpr(f"stack({len(checks)}, {rows}) AS (check, passed, detail)")


def _duplicates(df: DataFrame, key: str) -> Column:
    return df.groupBy(key).agg(F.expr("count(1) AS n")).agg(F.expr("count_if(n > 1)")).scalar()


def _nulls(columns: Sequence[str]) -> str:
    return f"count_if({' OR '.join(f'{c} IS NULL' for c in columns) or 'false'}) AS nulls"


def _outside(test: str, name: str) -> str:
    """Count of rows that do not pass a test, NULL included."""
    return f"count_if(NOT coalesce({test}, false)) AS {name}"


def validate_splits(df: DataFrame) -> DataFrame:
    """No id in two splits; the detail lists the overlap of every pair."""
    names = [f"{a}_{b}" for a, b in PAIRS]
    one = split_overlap(df).agg(*aggregates(*[
        f"max(if(pair = '{a}-{b}', n_overlap, null)) AS {a}_{b}" for a, b in PAIRS]))
    text = ", ', ', ".join(f"'{a}-{b}=', {a}_{b}" for a, b in PAIRS)
    return _report(one, [("disjoint_splits", f"{' + '.join(names)} = 0", f"concat({text})")])


def matrix_measures(columns: Sequence[str] = tuple(FOURTEEN_FEATURES)) -> list[str]:
    """The aggregates that the gate of a feature matrix looks at, but for repeated ids."""
    up, down = "count_if(label = 1)", "count_if(label = 0)"
    return [_nulls(columns), _outside("vision_score BETWEEN 0 AND 1", "vision"),
            _outside("malicious_probability BETWEEN 0 AND 1", "prompt"), _outside("label IN (0, 1)", "labels"),
            _outside(f"split IN ({listed(SPLITS)})", "splits"),
            f"{ratio(f'least({up}, {down})', f'greatest({up}, {down})')} AS balance"]


def missing_columns(df: DataFrame, columns: Sequence[str] = tuple(FOURTEEN_FEATURES)) -> list[str]:
    present = df.columns
    return [c for c in [*columns, "sample_id", "label", "split"] if c not in present]


def matrix_report(measured: DataFrame) -> DataFrame:
    """The gate's rows from one row of matrix_measures and duplicates."""
    return _report(measured, [
        ("columns", "true", "''"),
        ("no_null_features", "nulls = 0", "nulls"),
        ("unique_ids", "duplicates = 0", "duplicates"),
        ("vision_score_range", "vision = 0", "vision"),
        ("malicious_probability_range", "prompt = 0", "prompt"),
        ("label_values", "labels = 0", "labels"),
        ("split_values", "splits = 0", "splits"),
        ("label_balance", "true", "if(balance < 0.3D, 'imbalanced', 'ok')"),  # a warning, never a failure
    ])


def validate_feature_matrix(df: DataFrame, columns: Sequence[str] = tuple(FOURTEEN_FEATURES)) -> DataFrame:
    """Columns, NULLs, unique ids, ranges, labels, splits, and a warning on balance: one pass."""
    missing = missing_columns(df, columns)
    if missing:
        return _report(df.agg(F.expr("count(1) AS n")), [("columns", "false", quote(", ".join(missing)))])
    one = df.agg(*aggregates(*matrix_measures(columns))).withColumn("duplicates", _duplicates(df, "sample_id"))
    return matrix_report(one)


def validate_vision(df: DataFrame) -> DataFrame:
    """Required columns and types, no NULL, score range, and how many rows were really read."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in VISION_REQUIRED if c not in types]
    wrong = [c for c in VISION_DOUBLES if c in types and not isinstance(types[c], (T.DoubleType, T.FloatType))]
    score = "vision_score" if "vision_score" in types else "double(null)"
    confidence = "ocr_confidence" if "ocr_confidence" in types else "double(null)"
    one = df.agg(*aggregates(
        _nulls([c for c in VISION_REQUIRED if c in types]), _outside(f"{score} BETWEEN 0 AND 1", "outside"),
        f"count_if({confidence} > 0) AS read", "count(1) AS n"))
    return _report(one, [
        ("columns", str(not missing).lower(), quote(", ".join(missing))),
        ("float_types", str(not wrong).lower(), quote(", ".join(wrong))),
        ("no_null", "nulls = 0", "nulls"),
        ("vision_score_range", "outside = 0", "outside"),
        ("read_rows", "true", "concat(read, '/', n)"),
    ])


def verify_splits(df: DataFrame, expected: int, split_column: str = "corrected_split",
                  key: str = "group_key", id_column: str = "sample_id") -> DataFrame:
    """No leaking group, the expected number of rows, and as many unique ids."""
    one = df.agg(F.expr("count(1) AS n")).withColumns({
        "leaked": leaking_groups(df, split_column, key), "uniques": unique_count(df, id_column)})
    return _report(one, [
        ("group_leakage", "leaked = 0", "leaked"),
        ("total_rows", f"n = {expected}", "n"),
        ("unique_ids", f"uniques = {expected}", "uniques"),
    ])


def verify_roundtrip(written: DataFrame, reloaded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The reloaded table has all rows and columns, and no NULL feature."""
    found = reloaded.columns
    missing = [c for c in columns if c not in found]
    before = written.agg(F.expr("count(1)")).scalar()
    one = reloaded.agg(*aggregates("count(1) AS n", _nulls([c for c in columns if c in found]))) \
        .withColumn("before", before)
    return _report(one, [
        ("row_count", "n = before", "n"),
        ("columns", str(not missing).lower(), quote(", ".join(missing))),
        ("no_null", "nulls = 0", "nulls"),
    ])

"""Repair and verification of train/val/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docguard.fixed_values import SPLITS
from docguard.functions.numbers import quote, ratio, rounded
from docguard.functions.signals import group_key, split_name
from docguard.operators.ranked import value_at_rank

PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]


def aggregates(*expressions: str) -> list[Column]:
    return [F.expr(e) for e in expressions]


def normalise_split(df: DataFrame) -> DataFrame:
    """corrected_split becomes split; names trimmed, lower case, 'validation' as 'val'."""
    if "corrected_split" in df.columns and "split" not in df.columns:
        df = df.withColumnRenamed("corrected_split", "split")
    return df.withColumn("split", F.expr(split_name("split")))


def with_group_key(df: DataFrame, id_column: str = "sample_id") -> DataFrame:
    return df.withColumn("group_key", F.expr(group_key(id_column)))


def group_split(df: DataFrame, key: str = "group_key", seed: str = "42", test_share: float = 0.10,
                val_share: float = 0.1111, out: str = "corrected_split") -> DataFrame:
    """Leak-free split by group: every row's split depends on the hash of its group alone.

    The two hashes that bound test and val are found over the distinct groups; the rows
    are only compared with them, so no row moves and a huge group is no special case.
    """
    hashed = f"md5(concat({quote(seed + ':')}, string({key})))"
    n_test = f"ceil(n_total * {test_share}D)"
    n_val = f"ceil((n_total - {n_test}) * {val_share}D)"
    groups = df.select(key).distinct().selectExpr(f"{hashed} AS _hash")
    bounds = value_at_rank(groups, "_hash", {"test": n_test, "val": f"{n_test} + {n_val}"})
    bound = bounds.selectExpr("named_struct('test', test, 'val', val)").scalar()
    chosen = f"CASE WHEN {hashed} <= _bound.test THEN 'test' WHEN {hashed} <= _bound.val THEN 'val' ELSE 'train' END"
    return df.withColumn("_bound", bound).withColumn(out, F.expr(chosen)).drop("_bound")


def group_sizes(df: DataFrame, key: str = "group_key") -> DataFrame:
    sizes = df.groupBy(key).agg(F.expr("count(1) AS n"))
    return sizes.agg(*aggregates("count(1) AS n_groups", "min(n) AS min_size", "max(n) AS max_size",
                                 "avg(n) AS mean_size"))


def _spread(df: DataFrame, split_column: str, key: str) -> DataFrame:
    """First and last split per group: more than one distinct value is first < last."""
    return df.groupBy(key).agg(*aggregates(f"min({split_column}) AS first", f"max({split_column}) AS last"))


def group_leakage(df: DataFrame, split_column: str, key: str = "group_key") -> DataFrame:
    """Groups with members in more than one split: count and percentage."""
    counted = _spread(df, split_column, key).agg(*aggregates(
        "count(1) AS n_groups", "count_if(first < last) AS leaked_groups"))
    return counted.selectExpr("*", f"{ratio('leaked_groups', 'n_groups')} * 100 AS leaked_pct")


def leaking_groups(df: DataFrame, split_column: str, key: str) -> Column:
    return _spread(df, split_column, key).agg(F.expr("count_if(first < last)")).scalar()


def unique_count(df: DataFrame, id_column: str) -> Column:
    return df.select(id_column).distinct().agg(F.expr("count(1)")).scalar()


def duplicate_ids(df: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return df.groupBy(id_column).agg(F.expr("count(1) AS n")).filter("n > 1")


def split_overlap(df: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """Per pair of splits the number of ids in both: one shuffle, no self-join."""
    held = df.groupBy(id_column).agg(*aggregates(*[f"max(split = '{s}') AS {s}" for s in SPLITS]))
    counts = held.agg(*aggregates(*[f"count_if({a} AND {b}) AS {a}_{b}" for a, b in PAIRS]))
    rows = ", ".join(f"'{a}-{b}', {a}_{b}" for a, b in PAIRS)
    return counts.selectExpr(f"stack({len(PAIRS)}, {rows}) AS (pair, n_overlap)")


def class_balance(df: DataFrame, split_column: str = "split", label: str = "label") -> DataFrame:
    """Per split: size, benign, malicious, benign ratio, and whether it is near one half."""
    sizes = df.groupBy(F.col(split_column).alias("split")).agg(*aggregates(
        "count(1) AS n", f"count_if({label} = 'benign') AS benign", f"count_if({label} = 'malicious') AS malicious"))
    return sizes.selectExpr("*", f"{ratio('benign', 'n')} AS benign_ratio",
                            f"abs({ratio('benign', 'n')} - 0.50D) < 0.01D AS balanced")


def split_proportions(df: DataFrame, split_column: str = "split") -> DataFrame:
    """Percentage of the rows per split."""
    sizes = df.groupBy(F.col(split_column).alias("split")).agg(F.expr("count(1) AS n"))
    total = df.agg(F.expr("count(1)")).scalar()
    part = f"({ratio('n', '_total')} * 100)"
    return sizes.withColumn("_total", total).selectExpr("split", "n", f"{rounded(part, 2)} AS pct")


def id_intersect(left: DataFrame, right: DataFrame, id_column: str = "sample_id") -> DataFrame:
    return left.select(id_column).intersect(right.select(id_column))


def id_except(left: DataFrame, right: DataFrame, id_column: str = "sample_id") -> DataFrame:
    return left.select(id_column).subtract(right.select(id_column))


def flag_membership(df: DataFrame, ids: DataFrame, flag: str, id_column: str = "sample_id") -> DataFrame:
    """1 where the id occurs in ids, else 0."""
    known = ids.select(id_column).distinct().selectExpr(id_column, "1 AS _known")
    joined = df.join(known, id_column, "left")
    return joined.withColumn(flag, F.expr("coalesce(_known, 0)")).drop("_known")


def original_split(df: DataFrame, sources: dict[str, DataFrame], id_column: str = "sample_id") -> DataFrame:
    """Which source holds the id; a later source wins, 'unknown' if none does."""
    tagged = None
    for place, (name, source) in enumerate(sources.items()):
        part = source.selectExpr(id_column, f"named_struct('place', {place}, 'name', {quote(name)}) AS s")
        tagged = part if tagged is None else tagged.unionByName(part)
    last = tagged.groupBy(id_column).agg(F.expr("max(s) AS _s"))
    joined = df.join(last, id_column, "left")
    return joined.withColumn("original_split", F.expr("coalesce(_s.name, 'unknown')")).drop("_s")


def verification_report(df: DataFrame, split_column: str = "corrected_split", key: str = "group_key",
                        id_column: str = "sample_id", label: str = "label") -> DataFrame:
    """The checks as ordered (ordinal, check_name, value) rows."""
    sizes = ["count(1) AS total"]
    for s in SPLITS:
        here = f"{split_column} = '{s}'"
        sizes += [f"count_if({here}) AS {s}_total", f"count_if({here} AND {label} = 'benign') AS {s}_benign",
                  f"count_if({here} AND {label} = 'malicious') AS {s}_malicious"]
    one = df.agg(*aggregates(*sizes)).withColumns({
        "leaked": leaking_groups(df, split_column, key), "uniques": unique_count(df, id_column)})
    checks = [("group_leakage_count", "leaked"), ("total_rows", "total"), ("unique_sample_ids", "uniques")]
    for s in SPLITS:
        checks += [(f"{s}_benign_ratio", rounded(ratio(f"{s}_benign", f"{s}_total"), 4)), (f"{s}_total", f"{s}_total"),
                   (f"{s}_benign", f"{s}_benign"), (f"{s}_malicious", f"{s}_malicious")]
    checks += [(f"{s}_pct", rounded(f"({ratio(f'{s}_total', 'total')} * 100)", 2)) for s in SPLITS]
    rows = ", ".join(f"{i + 1}, {quote(name)}, double({value})" for i, (name, value) in enumerate(checks))
    return one.selectExpr(f"stack({len(checks)}, {rows}) AS (ordinal, check_name, value)")

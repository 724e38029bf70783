"""Labels, predictions and vision features to a checked feature matrix."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation

from docguard.fixed_values import FOURTEEN_FEATURES
from docguard.operators.features import engineer_features, fuse_sources, join_labels_splits, legacy_columns
from docguard.operators.profile import summary_measures, summary_record
from docguard.operators.quality import enforce, matrix_measures, matrix_report, missing_columns, validate_feature_matrix
from docguard.operators.splits import aggregates, normalise_split
from docguard.session import new_path, removed
from docguard.sources.tables import write_parquet, write_record


def feature_matrix(labels: DataFrame, splits: DataFrame, predictions: DataFrame, vision: DataFrame) -> DataFrame:
    """The lazy plan: one row per labelled sample with all features."""
    master = join_labels_splits(labels, normalise_split(splits))
    return engineer_features(fuse_sources(master, predictions, legacy_columns(vision)))


def observed_write(df: DataFrame, measures: Sequence[str], names: Sequence[str], path: str, drop: str) -> tuple:
    """Write a frame without one column and return the named measures of what was written, from the same job.

    The job runs in a session of its own: MLlib's functions cannot be sent to executors from a session that has observed.
    """
    spark, view = df.sparkSession, f"observed_{uuid.uuid4().hex}"
    own, seen = spark.newSession(), Observation(view)
    for name in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    df.createGlobalTempView(view)
    try:
        own.table(f"global_temp.{view}").observe(seen, *aggregates(*measures)).drop(drop).write.parquet(path)
    finally:
        spark.catalog.dropGlobalTempView(view)
    return tuple(seen.get[name] for name in names)


def build_feature_matrix(labels: DataFrame, splits: DataFrame, predictions: DataFrame, vision: DataFrame,
                         matrix_path: str, summary_path: str) -> DataFrame:
    """Check the new matrix, then replace the stored one by it, by split; write its summary, return it.

    One pass over the sources: the numbers of the gate and of the summary are observed while the matrix is staged, and
    what is read again is only the staged matrix, to be published.
    """
    spark = labels.sparkSession
    matrix = feature_matrix(labels, splits, predictions, vision)
    if missing_columns(matrix):
        enforce(validate_feature_matrix(matrix))
    measures = [*matrix_measures(), *summary_measures(FOURTEEN_FEATURES), "count_if(_copy = 2) AS duplicates"]
    # the joins have brought equal ids together, so numbering them moves no row
    numbered = matrix.selectExpr("*", "row_number() OVER (PARTITION BY sample_id ORDER BY sample_id) AS _copy")
    kinds = numbered.agg(*aggregates(*measures)).schema
    path = new_path(spark, "feature-matrix")
    measured = spark.createDataFrame([observed_write(numbered, measures, kinds.names, path, drop="_copy")], kinds)
    try:
        enforce(matrix_report(measured))
        write_parquet(spark.read.parquet(path), matrix_path, ["split"])
    finally:
        removed(spark, path)
    write_record(summary_record(measured, FOURTEEN_FEATURES, len(matrix.columns)), summary_path)
    return spark.read.parquet(matrix_path)

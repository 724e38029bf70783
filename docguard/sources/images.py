"""Which image files exist, and which rows they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docguard.functions.signals import file_name, has_path
from docguard.operators.splits import aggregates
from docguard.session import written


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length")


def plain_path(path: str) -> str:
    """A path as other tables write it: without the scheme of a local file, and without percent-encoding."""
    bare = f"regexp_replace({path}, '^file:(//)?/', '/')"
    encoded = f"{path} LIKE 'file:%' AND {bare} RLIKE '%[0-9A-Fa-f]{{2}}'"
    return f"if({encoded}, url_decode(replace({bare}, '+', '%2B')), {bare})"


def resolve_images(df: DataFrame, files: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """Add resolved_path: the file of the full path, else the one of the same name, else NULL.

    Where several files share a name, the first in path order stands in.  Rows without a
    path would all meet in one task; they join on keys of their own that match no file.
    The listing is taken once and kept in written tables: both joins are then plain ones,
    in which Spark splits the partition of a path that very many rows share.
    """
    spread = f"concat('//', xxhash64({id_column}))"
    path_key = f"if({has_path('image_path')}, {plain_path('image_path')}, {spread})"
    name_key = f"if({has_path('image_path')}, {file_name('image_path')}, {spread})"
    full = written(files.selectExpr(f"{plain_path('path')} AS _full").distinct(), "image_files")
    names = full.groupBy(F.expr(f"{file_name('_full')} AS _name")).agg(F.expr("min(_full) AS _by_name"))
    named = written(names, "image_names")
    joined = df.join(full, F.expr(f"{path_key} = _full"), "left").join(named, F.expr(f"{name_key} = _name"), "left")
    return joined.withColumn("resolved_path", F.expr("coalesce(_full, _by_name)")).drop("_full", "_name", "_by_name")


def image_inventory(resolved: DataFrame) -> DataFrame:
    """How many rows have a path, a file, or no file for their path."""
    path = has_path("image_path")
    return resolved.agg(*aggregates(
        f"count_if({path}) AS image_backed", f"count_if({path} AND resolved_path IS NOT NULL) AS found",
        f"count_if({path} AND resolved_path IS NULL) AS missing"))


def missing_examples(resolved: DataFrame, n: int = 5) -> DataFrame:
    """The first few paths without a file."""
    lost = resolved.filter(f"{has_path('image_path')} AND resolved_path IS NULL")
    return lost.select("image_path").orderBy("image_path").limit(n)

"""Where a session keeps durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch between the JVM and its workers, for rows as long as texts.
BATCH_ROWS = 1_000
#: Bytes of an Arrow batch of long rows.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session move texts in batches of some megabytes, unless it names a size of its own.

    Ten thousand texts or 64 MB a batch, the defaults, are held several times over by the JVM and by each worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def durable_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, shared by all executors.

    Only on a local master (tests, a laptop) may the session name none; a local one is set then.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="docguard-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table below the durable folder."""
    return f"{durable_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the durable folder and go on from the written table.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Path test through the Hadoop file system of that path."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds data files, at any depth; markers and files in progress are none."""
    if not exists(spark, path):
        return False
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(hadoop_path, True)
    while files.hasNext():
        parts = files.next().getPath().toString().removeprefix(hadoop_path.toString()).strip("/").split("/")
        if not any(p.startswith(("_", ".")) for p in parts):
            return True
    return False


def is_directory(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory()


def listed_names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what a folder holds; none if it does not exist."""
    if not exists(spark, path):
        return []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    return sorted(f.getPath().getName() for f in found)


def moved(spark: SparkSession, source: str, target: str, prefix: str) -> None:
    """Move the data files of a folder into another, names prefixed; markers stay, and a repeated call goes on."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    system = path_of(source).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in listed_names(spark, source):
        if not name.startswith(("_", ".")) and not system.rename(path_of(f"{source}/{name}"), path_of(f"{target}/{prefix}{name}")):
            raise OSError(f"cannot move {source}/{name} to {target}")

"""Scans and sinks: parquet, CSV and JSON lines with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docguard.operators.splits import normalise_split
from docguard.session import exists, has_data, listed_names, moved, removed
from docguard.sources import schemas

# split name -> name of its original table
SPLIT_FILES = {"train": "train", "val": "validation", "test": "test"}


def read_splits(spark: SparkSession, folder: str,
                optional: Sequence[str] = tuple(schemas.OPTIONAL_SPLIT_COLUMNS)) -> DataFrame:
    """The three split tables as one, tagged with their split; optional columns become NULL."""
    parts = [spark.read.parquet(f"{folder}/{name}.parquet").withColumn("split", F.lit(split))
             for split, name in SPLIT_FILES.items()]
    union = union_splits(parts)
    absent = [name for name in optional if name not in union.columns]
    return union.withColumns({name: F.lit(None).cast("string") for name in absent}) if absent else union


def union_splits(parts: Sequence[DataFrame]) -> DataFrame:
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


# What stands for NULL in a CSV file, so that it differs from the empty text.
CSV_NULL = "\\N"


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True, null: str = CSV_NULL,
             empty_is_null: bool = False) -> DataFrame:
    """CSV with header, as write_csv writes it: blanks, line breaks, quotes, '' and NULL come back.

    Values with line breaks need multi_line, by which a file is one task; write_csv writes many files.  Where it is
    known that no value has one, multi_line=False lets Spark split files.  Files of other tools leave NULL empty:
    empty_is_null=True reads them so.
    """
    return spark.read.schema(schema).csv(
        path, header=True, multiLine=multi_line, escape='"', nullValue="" if empty_is_null else null, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_cols(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only these columns; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def load_splits(spark: SparkSession, corrected_path: str, folder: str) -> DataFrame:
    """All rows with their corrected split where that table exists, else the original one."""
    original = read_splits(spark, folder)
    if not exists(spark, corrected_path):
        return original
    corrected = normalise_split(read_csv(spark, corrected_path, schemas.CORRECTED_SPLITS, empty_is_null=True))
    return original.drop("split").join(corrected, "sample_id")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", null: str = CSV_NULL) -> None:
    """CSV with header in which every value is kept; see read_csv."""
    df.write.mode(mode).csv(path, header=True, escape='"', quoteAll=False, nullValue=null, emptyValue='""',
                            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_audit(df: DataFrame, path: str, fresh: bool = False) -> None:
    """One JSON object per decision, NULL fields written out; fresh drops the earlier log."""
    df.write.mode("overwrite" if fresh else "append").option("ignoreNullFields", False).json(path)


def write_record(one: DataFrame, path: str) -> None:
    """A one-row record as JSON."""
    one.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stored result if there is one, else compute and store it."""
    if force or not has_data(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Files of a ledger per run, and how many keys at most are looked up by value.
LEDGER_PARTS = 64
LOOKED_UP = 100


def resume(todo: DataFrame, done_path: str, key: str, process: Callable[[DataFrame], DataFrame],
           force: bool = False, parts: int = LEDGER_PARTS) -> DataFrame:
    """Process the rows whose key is in no finished run yet, append them, return all.

    Each run first writes the keys it takes on to a ledger, dealt to `parts` by hash, and then its result beside the
    stored one; the result's success marker makes both count, and its files are moved in.  A run that broke off before
    is done again as a whole, one that broke off while moving is moved by the next.  A run reads only those parts of the
    ledger that its own keys fall into, and few keys are looked up through the files' bloom filters.  Rows without a key
    go by their content.  Files that no run wrote count by their keys.  force starts afresh.
    """
    spark, known = todo.sparkSession, [F.col(f"`{c}`") for c in todo.columns]
    if force:
        removed(spark, done_path)
    done = _finished(spark, done_path)
    for r in done:
        moved(spark, f"{done_path}/{_ROWS}/{r}", done_path, f"{r}-")
    named = F.when(F.col(key).isNotNull(), F.concat(F.lit("key:"), F.col(key).cast("string"))).otherwise(
        F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*known)), 256)))
    marked = todo.withColumn("_key", named)
    keys = fresh = marked.select("_key", F.expr(f"int(pmod(xxhash64(_key), {parts}))").alias("part"))
    if done:
        fresh = fresh.join(ledger_of(spark, done_path, done, keys), "_key", "left_anti")
    foreign = [f"{done_path}/{name}" for name in listed_names(spark, done_path) if not name.startswith(("run-", "_", "."))]
    if foreign:
        earlier = spark.read.parquet(*foreign).select(F.concat(F.lit("key:"), F.col(key).cast("string")).alias("_key"))
        fresh = fresh.join(earlier, "_key", "left_anti")
    run = f"run-{max([int(r[4:]) for r in done], default=0) + 1:06d}"
    write = fresh.distinct().repartition("part").sortWithinPartitions("part", "_key").write.mode("overwrite").partitionBy("part")
    write.option("parquet.bloom.filter.enabled#_key", "true").parquet(f"{done_path}/{_KEYS}/{run}")
    taken = spark.read.schema("_key string, part int").parquet(f"{done_path}/{_KEYS}/{run}").select("_key")
    process(marked.join(taken, "_key", "left_semi").select(*known)).write.mode("overwrite").parquet(f"{done_path}/{_ROWS}/{run}")
    moved(spark, f"{done_path}/{_ROWS}/{run}", done_path, f"{run}-")
    return spark.read.parquet(done_path)


# readers of the folder skip what begins with an underscore
_ROWS, _KEYS = "_runs/rows", "_runs/keys"


def _finished(spark: SparkSession, done_path: str) -> list[str]:
    """Names of the runs whose results were written whole."""
    return [r for r in listed_names(spark, f"{done_path}/{_ROWS}") if exists(spark, f"{done_path}/{_ROWS}/{r}/_SUCCESS")]


def ledger_of(spark: SparkSession, done_path: str, runs: Sequence[str], keys: DataFrame) -> DataFrame:
    """(_key) of the finished runs, as far as it may hold the given (_key, part): only their parts are read."""
    hit = sorted(r["part"] for r in keys.select("part").distinct().collect())  # at most `parts` numbers
    ledger = union_splits([spark.read.schema("_key string, part int").parquet(f"{done_path}/{_KEYS}/{r}") for r in runs])
    ledger = ledger.filter(F.col("part").isin(hit))
    few = keys.select("_key").distinct().limit(LOOKED_UP + 1).collect()
    if len(few) <= LOOKED_UP:
        ledger = ledger.filter(F.col("_key").isin([r["_key"] for r in few]))
    return ledger.select("_key")


def append_audit_table(df: DataFrame, path: str, fresh: bool = False, rows_per_group: int | None = None) -> None:
    """Audit records as a parquet log that can be searched: clustered by time, a bloom filter on the id per row group."""
    # neighbouring times share files and row groups, whatever the order of arrival
    clustered = df.repartitionByRange("timestamp").sortWithinPartitions("timestamp")
    writer = clustered.write.mode("overwrite" if fresh else "append").option("parquet.bloom.filter.enabled#audit_log_id", "true")
    if rows_per_group is not None:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    writer.parquet(path)


def read_audit_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT).parquet(path)


def newest_audit(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The newest n records (ties by id) of a searchable log: times alone give the bound, then only row groups beyond it are read."""
    log = read_audit_table(spark, path)
    oldest = log.select("timestamp").orderBy(F.desc("timestamp")).limit(n).agg(F.min("timestamp")).first()[0]
    return log.filter(F.col("timestamp") >= F.lit(oldest)).orderBy(F.desc("timestamp"), "audit_log_id").limit(n)

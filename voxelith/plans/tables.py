"""Intermediate tables in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Narrow rows up to which a counted side may be broadcast.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder in the one that driver and executors share.

    The cluster names that in spark.checkpoint.dir. Only where that is unset on a
    single machine (tests) a temporary folder is made and set; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="voxelith-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/voxelith-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has written to the shared folder; results that still read them are lost."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Lets Spark remove a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the queries run inside; names with __ for dots. Former values come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write_parquet(df: DataFrame, path: str, **options) -> None:
    """Write df; once the files are there, the shuffle files that led to them go."""
    with settings(df.sparkSession, **{CLEANUP: "true"}):
        df.write.options(**options).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df, which Spark won't broadcast of its own accord in the next join.

    It judges a table by the bytes of its files or of its source. Cells of a grid
    take few there, a small part of what their rows take in the driver. A side that maybe_broadcast() has counted is still broadcast.
    """
    return df.hint("merge")


def cut(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it: the lineage ends here. Its rows are counted; many are large()."""
    path, seen = shared_path(df.sparkSession, tag), Observation()
    write_parquet(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, **options)
    out, rows = df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]
    if rows > BROADCAST_ROWS:
        out = large(out)
    out._written, out._rows = path, rows
    return out


def rows_of(df: DataFrame) -> int:
    """The rows of a table that cut() has written."""
    return df._rows


def drop(*tables: DataFrame) -> None:
    """Removes tables that cut() has written, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows, else df unchanged.

    Give narrow tables only. The count stops at the bound, so it is cheap for
    large inputs; beyond the bound Spark plans a shuffled join.
    """
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Rows of a range that is numbered by one task, where the rows have been counted.
ROWS_A_RANGE = 1 << 20


def numbered(df: DataFrame, group: list[str], order: list, name: str, first: int = 1, rows: int | None = None) -> DataFrame:
    """df with whole numbers first, first + 1, .. within each group, in order.

    Ranges of (group, order) are sorted and numbered apart where they are written, and shifted by the counts of the
    ranges before, so a group of any size is spread over tasks. order names
    columns that tell the rows of a group apart. rows, if known: there are as many more ranges.
    """
    ranges = df.repartitionByRange(*([] if rows is None else [1 + rows // ROWS_A_RANGE]), *group, *order).sortWithinPartitions(*group, *order)
    part = cut(ranges.withColumn("own_", F.monotonically_increasing_id()), "ranges")  # number of the range, and 33 bits of the row in it
    part = part.withColumn("range_", F.shiftright("own_", 33))
    counts = part.groupBy(*group, "range_").agg(F.count("*").alias("n_"), F.min("own_").alias("least_"))  # at most a row for each group and range
    before = F.sum("n_").over(Window.partitionBy(*group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select(*group, "range_", (F.coalesce(before, F.lit(0)) - F.col("least_")).alias("before_"))
    keys = [*group, "range_"]
    return part.join(maybe_broadcast(shift), keys).withColumn(name, (F.col("own_") + F.col("before_") + first).cast("int")).drop("own_", "before_", "range_")

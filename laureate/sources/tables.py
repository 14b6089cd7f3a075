"""Warehouse tables in and out."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.schemas import ERA_TABLE, FLAG_SEED, SEED, STAGING, conform


def read(spark: SparkSession, where: str) -> DataFrame:
    """A Parquet folder when ``where`` has a slash, else a catalog table."""
    return spark.read.parquet(where) if "/" in where else spark.table(where)


def load_staging(spark: SparkSession, where: str) -> DataFrame:
    return conform(read(spark, where), STAGING)


def load_seed(spark: SparkSession, where: str) -> DataFrame:
    return conform(read(spark, where), SEED)


def load_eras(spark: SparkSession, where: str) -> DataFrame:
    return conform(read(spark, where), ERA_TABLE)


def load_flag_seed(spark: SparkSession, where: str) -> DataFrame:
    return distinct_flags(read(spark, where))


def distinct_flags(flags: DataFrame) -> DataFrame:
    """Flag keys as text, each once, so that joining them never adds rows."""
    return conform(flags, FLAG_SEED).filter(F.col("app_id").isNotNull()).distinct()


def swap_table(df: DataFrame, table: str, folder: str) -> None:
    """Create a Parquet table or replace what it holds, in one step of the catalog.

    ``df`` is written to a new folder below ``folder``, which all machines share; the
    table then points there. Readers by name see the old rows or the new ones, never
    part of them, a failed write leaves the table as it was, and ``df`` may read the
    table that it replaces. The rows before are removed afterwards.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{table}-{uuid4().hex}"
    df.write.parquet(path)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{path}'")
        return
    before = spark.table(table)
    if before.schema.simpleString() != df.schema.simpleString():
        raise ValueError(f"{table} has other columns: {before.schema.simpleString()}")
    old = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Location'").first()[1]
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
    spark.catalog.refreshTable(table)
    place = spark._jvm.org.apache.hadoop.fs.Path(old)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(place, True)


def replace_table(
    df: DataFrame,
    table: str,
    partition_by: tuple[str, ...] = (),
    v2_catalog: bool = False,
) -> None:
    """Create the table or replace what it holds.

    With ``v2_catalog`` the swap is one catalog operation; the built-in catalog
    overwrites in place, so there ``df`` must not read the table it replaces.
    """
    if v2_catalog:
        writer = df.writeTo(table)
        if partition_by:
            writer = writer.partitionedBy(*[F.col(c) for c in partition_by])
        writer.createOrReplace()
        return
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)

"""Raw CSV files in, with the column order checked."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def ingest_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    on_bad_row: str = "keep",
    multi_line: bool = False,
) -> DataFrame:
    """Read headed CSV files with a declared schema.

    The header must name the schema's columns in order: a shifted column fails
    the load instead of filling a column with NULLs. A row with too few or too
    many fields, or with a field that does not fit its type, is kept with its
    text in ``_corrupt``; ``on_bad_row="fail"`` fails the load instead.
    ``multi_line`` allows line breaks inside quotes, at the price of one task per
    file.
    """
    if on_bad_row not in ("keep", "fail"):
        raise ValueError(f"on_bad_row must be 'keep' or 'fail', not {on_bad_row!r}")
    keep = on_bad_row == "keep"
    # Fields are read as text and cast here: the reader itself only converts the
    # columns a query uses, so which rows it calls bad would vary by query.
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    if keep:
        text.add(CORRUPT, T.StringType())
    lines = (
        spark.read.schema(text)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE" if keep else "FAILFAST")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    if not keep:
        return lines.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    misfit = reduce(
        or_, [F.col(name).isNotNull() & value.isNull() for name, value in typed.items()]
    )
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    fields = F.to_csv(F.struct(*schema.names), {"escape": '"', **blanks})
    return lines.select(
        *[value.alias(name) for name, value in typed.items()],
        F.coalesce(F.col(CORRUPT), F.when(misfit, fields)).alias(CORRUPT),
    )

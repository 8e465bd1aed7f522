"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.storage import written

__all__ = ["ascii_lower", "by_place", "schema_of", "small_batches", "written"]

#: Rows in one Arrow batch; a batch of whole documents must fit a Python worker.
ARROW_ROWS = "512"
ARROW_BYTES = "16m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that a batch of long documents stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII strings take the quick built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def schema_of(fields: list[T.StructField], more: str) -> T.StructType:
    """These fields and more in DDL. Fields are never put in DDL themselves, where names within
    structs with blanks, dots or hyphens could not be read."""
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])


def by_place(df: DataFrame) -> DataFrame:
    """The columns under plain names: Spark cannot hand columns with dots in theirs to Python."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])

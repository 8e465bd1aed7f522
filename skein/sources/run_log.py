"""Run logs: line-delimited JSON events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECK = "struct<kind:string,blocks:array<string>,formulas:array<string>,verdict:string,note:string>"
EVENT = f"type string, ts string, checkLog array<{CHECK}>, output string"


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """IO-1. Check entries (kind, blocks, formulas, verdict, note), from ``logic_check_log`` events
    and from JSON inside a tool's output. Blank and malformed lines, and entries without kind,
    blocks or verdict, are left out."""
    events = spark.read.schema(EVENT).option("mode", "PERMISSIVE").json(path)
    nested = F.from_json("output", f"checkLog array<{CHECK}>")["checkLog"]
    entries = F.when(F.col("type") == "logic_check_log", F.col("checkLog")).otherwise(nested)
    return events.select(F.explode(entries).alias("e")).select("e.*").where("kind is not null and blocks is not null and verdict is not null")


def write_run_log(events: DataFrame, path: str) -> None:
    """IO-2. Append events (type and any other columns), with the time of writing, a folder a type."""
    events.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).write.mode("append").partitionBy("type").json(path)


def run_log_counts(events: DataFrame, kind: str, text: str) -> DataFrame:
    """IO-3. Events and estimated tokens (a quarter of the characters, rounded up) of each type."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("events"), F.sum(F.ceil(F.char_length(text) / 4)).alias("tokens"))

"""Helpers shared by the corpus operators: written tables in the shared folder, table reading and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources.shared import scratch as written
from meridia.sources.shared import shared as fresh_path

__all__ = ["fresh_path", "free_name", "lower_ascii", "partitions", "table", "written"]

#: The white space and the case folding that the text contracts name.
ASCII_SPACE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores before it, so that it clashes with no column of df (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

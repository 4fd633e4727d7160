"""Reading the input tables, and tables written on the way to the folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codehist.session import shared_dir, staged

__all__ = ["fold", "new_folder", "staged", "table", "under"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """Name of a folder of its own below the shared folder; files in it are kept for the caller."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def fold(key: str, n: int) -> Column:
    """Remainder of the crc32 of a key's text: the same rows fall in the same fold in every run."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def under(df: DataFrame, most: int) -> bool:
    """Whether a table has at most so many rows; reads no more than that."""
    return df.limit(most + 1).count() <= most

"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.batches import bounded
from seqloom.sources.shared import shared_dir

#: Rows of text that a kernel sees at once; fewer where they would exceed the bytes of a piece.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that text operators read, under names of their own: extra columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow in pieces of bounded rows and bytes."""
    return df.mapInArrow(bounded(fn, rows), schema)


class Renamed:
    """A frame under column names of its own, with which an operator's cannot clash."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.frame = df.toDF(*[f"column{k}" for k in range(len(self.names))])

    def at(self, name: str) -> Column:
        return F.col(f"column{self.names.index(name)}")

    def back(self, df: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
        """The columns of the frame, those in ``new`` replaced, under their old names."""
        return df.select(*[(new or {}).get(n, F.col(f"column{k}")).alias(n) for k, n in enumerate(self.names)])


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder that the cluster names."""
    shared_dir(spark)

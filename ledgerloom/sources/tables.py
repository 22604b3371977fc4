"""Where queries find instruction and account tables."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables(Protocol):
    spark: SparkSession

    def instruction(self, name: str, low: int | None = None, high: int | None = None) -> DataFrame:
        """Rows of one instruction; slot bounds allow pruning and need not be exact."""

    def nearest(self, name, low, high, conditions: list[Column], limit: int, ascending: bool) -> tuple[int | None, int | None]:
        """Slot bounds inside low and high that hold the first `limit` rows which pass."""

    def signers(self, program) -> DataFrame:
        """(instruction, signer, slot) over all instructions of the program."""

    def signer_counts(self, program) -> DataFrame | None:
        """(instruction, signer, rows, latest), if such counts are kept."""


def union_signers(tables: Tables, program) -> DataFrame:
    """One branch per instruction table; each branch reads two columns."""
    branches = [
        tables.instruction(name).select(F.lit(name).alias("instruction"), "signer", "slot")
        for name in program.instructions
    ]
    if not branches:
        return tables.spark.createDataFrame([], "instruction string, signer string, slot bigint")
    return reduce(DataFrame.unionAll, branches)


class FrameTables:
    """Instruction tables as views of frames.

    `frames` maps instruction names to frames. When all of them are slices of one
    frame with an `instruction` column, `combined` lets statistics read it once.
    """

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], combined: DataFrame | None = None):
        self.spark = spark
        self.frames = frames
        self.combined = combined

    def instruction(self, name, low=None, high=None) -> DataFrame:
        return self.frames[name]

    def nearest(self, name, low, high, conditions, limit, ascending) -> tuple[int | None, int | None]:
        return low, high

    def signer_counts(self, program) -> DataFrame | None:
        return None

    def signers(self, program) -> DataFrame:
        if self.combined is None:
            return union_signers(self, program)
        names = list(program.instructions)
        return self.combined.where(F.col("instruction").isin(names)).select(
            "instruction", "signer", "slot"
        )

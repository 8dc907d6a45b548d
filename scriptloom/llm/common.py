"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.session import spread

#: Characters that separate words in every contract of this subpackage: [\x20\x09-\x0D].
WORD_BREAKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null text gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WORD_BREAKS}]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def double_array(values: list[float]) -> Column:
    """A constant array; one literal for the optimizer to fold, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the cluster names it in ``spark.checkpoint.dir``.

    Only in local mode (tests, one machine) a temporary folder may take its place.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="scriptloom-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: it survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Hint a broadcast only if the table provably has at most ``max_rows`` rows.

    The count stops after ``max_rows + 1`` rows. Beyond the bound the table is returned as
    it is and the planner shuffles both sides.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "scriptloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: Rows of an Arrow batch. Texts are long: Spark's default of 10,000 rows makes batches of tens of
#: megabytes, of which the JVM and the worker each hold some.
ARROW_ROWS = 1_000
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per Spark context.

    Also sets the session's Arrow batches to ``ARROW_ROWS``, unless they have been set.
    """
    if spark.conf.get(_ARROW_KEY) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, str(ARROW_ROWS))
    context = spark.sparkContext
    if getattr(context, "_scriptloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="scriptloom-"), "scriptloom_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"scriptloom/{path.relative_to(root)}")
    context.addPyFile(target)
    context._scriptloom_shipped = True


#: Bytes of code beyond which the JVM only interprets a method.
HUGE_METHOD = 8_000
_HUGE_KEY, _HUGE_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "65535"


def compile_long_rules(spark: SparkSession) -> None:
    """Have Spark split expressions whose code would be one method too long to be compiled.

    A table of rules fuses into a method of tens of kilobytes, which the JVM interprets for every
    row. Above the session's limit, set here to the JVM's own unless it has been set, Spark gives
    up the fusion and makes many small methods of the same expressions.
    """
    if spark.conf.get(_HUGE_KEY) == _HUGE_DEFAULT:
        spark.conf.set(_HUGE_KEY, str(HUGE_METHOD))


def once(df: DataFrame, *names: str) -> DataFrame:
    """``df``, whose columns ``names`` are computed once: a filter on them is not pushed below, where it
    would compute them a second time."""
    held = df.withColumn("_once", F.explode(F.array(F.struct(*names))))
    return held.select(*[F.col(f"_once.{c}") if c in names else F.col(c) for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than cores out over all cores.

    A file of one row group is one task otherwise. Tables with a split for every core, so all
    large ones, come back as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that the cluster names in ``spark.checkpoint.dir``.

    Off local mode the setting is required; a lost executor loses nothing.
    """
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scriptloom-"))
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)

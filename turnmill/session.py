"""Session defaults and small helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "turnmill", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TURNMILL_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    session of one machine (tests) gets a temporary folder; on a cluster no
    machine-local folder would do, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="turnmill-"))
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it from there.

    Unlike ``checkpoint()`` this computes ``df`` a single time. A null-typed
    column isn't allowed, as Parquet has none.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/turnmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table that is a single file, dealt out; any other table as it is read.

    One small file is one task, which leaves work bound by the CPU to a single core. The results are the same
    either way, and no text of a table in several files is shuffled.
    """
    files = df.inputFiles()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(files) == 1 else df

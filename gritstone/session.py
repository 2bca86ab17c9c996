"""Session helpers shared by every operator: table access, checkpoint folder, collision-free column names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; Catalyst prunes columns and pushes filters into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is local (tests, a laptop) a folder of
    this machine is made. On a cluster without the setting this is an error, since executors could not read such a folder.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at:
        return at
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        at = tempfile.mkdtemp(prefix="gritstone-checkpoint-")
    sc.setCheckpointDir(at)
    return sc.getCheckpointDir() or at


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder; it survives the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df``, for helper columns of an operator."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        at = name
        while at.lower() in used:
            at += "_"
        used.add(at.lower())
        out.append(at)
    return out

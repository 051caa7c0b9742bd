"""Cutting of lineage through the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only for a local session that names none."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="textloom-")


def materialise(rows: DataFrame) -> DataFrame:
    """Write ``rows`` to the checkpoint folder and go on from what is written."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)

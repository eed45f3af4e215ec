"""Lineage cuts and written tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset (one machine, tests) a
    temporary folder takes its place."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, tag: str) -> str:
    """The path of a fresh folder in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"

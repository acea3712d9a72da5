"""What iterations need: results that are written, so that plans stay short and survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from enclosa.types import Matrix, StateError

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a session in one process has a temporary one and a cluster is refused."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise StateError("spark.checkpoint.dir names no folder that driver and executors share")
    if "folder" not in _local:
        _local["folder"] = tempfile.mkdtemp(prefix="enclosa-")
    return _local["folder"]


def settled_frame(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the checkpoint folder."""
    context, folder = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def settled(a: Matrix) -> Matrix:
    """As settled_frame(), for a matrix."""
    return a.like(settled_frame(a.df))

"""Cutting lineage: results of rounds go to the folder that all machines share."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that
    is unset, as in tests, one of this machine serves if this machine is all
    there is; on a cluster it's an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = _own_folder()
    return folder.rstrip("/")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="pagewright-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: lineage ends,
    and a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

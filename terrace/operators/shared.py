"""The folder that driver and executors share."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder.

    Where neither is set, a session whose executors are threads of the driver gets a temporary folder; on a cluster there
    is no place then that all executors are sure to see, which is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="terrace-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")

"""A checkpoint folder for local sessions that name none: the library itself has no fallback."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from cutpoint.session import shared_folder


def name_folder(spark: SparkSession) -> None:
    """Name a temporary folder where none is named and every task runs on this machine."""
    sc = spark.sparkContext
    if shared_folder(spark) is None and sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cutpoint-"))

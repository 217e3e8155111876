"""Cuts of lineage for loops whose plans would grow from turn to turn."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint, in the folder of spark.checkpoint.dir that the driver and all executors see.

    Only where that is unset, as in tests on a local master, a temporary folder takes its place.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="quire-"))
    return df.checkpoint(eager=True)

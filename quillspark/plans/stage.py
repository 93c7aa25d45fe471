"""Stages of a long flow: their rows are written once, so that plans stay small and a lost executor costs one stage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; only a local session without one gets one made."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)

"""Intermediate results that several branches of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df written once to the session's checkpoint folder, so that branches read it instead of its lineage.

    Unlike a cache it needs no release and outlives lost executors. Without a named folder a temporary
    one serves, but only where everything runs on this machine.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)

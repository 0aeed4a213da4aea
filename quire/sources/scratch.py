"""Tables between the steps of a long plan, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``); in local mode, where none is set, a folder of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-steps-"))
    return context.getCheckpointDir()


def step(df: DataFrame) -> DataFrame:
    """The rows, written down and read again: several steps read them without computing them anew, and a lost executor costs no
    more than its part of one step. The table stays in the shared folder, as a checkpoint would."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.quire_step = path
    return out


def forget(*steps: DataFrame) -> None:
    """Delete tables of :func:`step` that nothing reads any more."""
    for s in steps:
        context = s.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(s.quire_step)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

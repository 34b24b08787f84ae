"""Cutting a plan from its lineage by files in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from threading import Lock

from pyspark.sql import DataFrame

#: Spark's setting, since 4.1, for executions that delete their shuffle files when they end. A frame takes the setting that holds when it is made.
_PASSING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTING = Lock()


def passing(df: DataFrame) -> DataFrame:
    """df, for one execution: its shuffle files go when that ends. Else they stay until the driver happens to collect its garbage, and loops pile them up."""
    conf = df.sparkSession.conf
    with _SETTING:
        before = conf.get(_PASSING, None)
        conf.set(_PASSING, "true")
        try:
            return df.select("*")
        finally:
            if before is None:
                conf.unset(_PASSING)
            else:
                conf.set(_PASSING, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the files, so that lost executors cost no recomputation. What was shuffled for it goes at once.

    The folder is the one the cluster names in spark.checkpoint.dir. Where none is named, one is made in the temporary folder if all of Spark is
    on this machine, as in tests; on a cluster that is an error, as executors would not see each other's files.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-"))
    return passing(df).checkpoint()


def cut_off(df: DataFrame) -> None:
    """Delete the files of a cut whose rows are not read any more; loops call it for the round before. What was not cut is left alone."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

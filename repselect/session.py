"""Session helpers shared by every job."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    Cuts the lineage with a reliable checkpoint, so that rows used by several branches are the same
    rows after an executor is lost. The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, a
    temporary one is made if driver and executors are one process, as in tests; on a cluster it is an error.
    The shuffle files behind it go as soon as it is written; its own files stay until ``released`` or, with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, until nothing refers to it.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)


def released(*settled_ones: DataFrame) -> None:
    """Removes the files of frames that ``settled`` gave. Nothing lazy may still be read from them."""
    for df in settled_ones:
        session = df.sparkSession
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = session._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

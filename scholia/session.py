"""Session helpers: a shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests, a laptop) is a
    temporary folder taken; on a cluster an unset folder is an error, since a
    machine-local one would not survive the loss of an executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "scholia-checkpoints")
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared folder, removed at the end by whatever file system holds it."""
    folder = f"{shared_dir(spark)}/scholia-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (reliable checkpoint)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan ahead of costly work per row, over all cores at least.

    A table of a few small files would keep most cores idle; its rows are dealt
    out evenly. Larger tables, which have as many splits as there are cores, pass
    as they are, without a shuffle. For plain scans only: other plans would be
    run in part to find out their partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan

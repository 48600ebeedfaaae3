"""Tables staged in the shared folder, so that lineage ends and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor and the driver can see: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a folder of its own, once for each application;
    a cluster gets an error, as its executors couldn't read a folder of the driver's machine.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = context.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        context.setCheckpointDir(_own_roots[app])
    return _own_roots[app]


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    The rows are written once as compressed Parquet; readers of the returned frame scan only
    the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/maskwright/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path is None:
            continue
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are done. It learns of them when the
    driver collects its garbage, which an idle driver puts off while executors' disks fill. The last
    plan is still held when its job ends, so a job of one row takes its place first."""
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()

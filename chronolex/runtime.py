"""Session helpers: reading tables, spreading Python work, written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over the cluster's cores when its scan yields fewer tasks.

    Only small or unsplittable inputs are moved; a scan that already has a task per
    core is returned as it is, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    The setting is read from the session.  Where it is unset, a local session (tests, a
    laptop) gets a temporary folder of this process; on a cluster that is an error, as no
    folder of the driver's machine can be read elsewhere.  ``release`` removes the folders.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="chronolex-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
    if not _made:
        atexit.register(release, spark)
    _made.append(f"{base.rstrip('/')}/written-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Removes the folders that ``shared_dir`` gave out, once no result that reads them is needed; runs at exit too."""
    done = 0
    try:
        jvm = spark._jvm
        while _made:
            path = jvm.org.apache.hadoop.fs.Path(_made.pop())
            done += path.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the engine may be gone at exit; the folders then stay
        pass
    return done


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing Python
    stages, and several consumers share one computation.
    """
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

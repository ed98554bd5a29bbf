"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without that setting; it then gets a temporary
    folder. A cluster without it is an error, as a machine-local folder would
    lose data with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _local_dir.append(tempfile.mkdtemp(prefix="engram-", dir="/tmp/checkpoints"))
    return "file://" + _local_dir[0]


def stage_table(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later reads survive lost executors, and work that must
    not run twice (chunk ids, ranks) is fixed. The table goes at interpreter exit.
    ``options`` are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/engram-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may already be closed
        return


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

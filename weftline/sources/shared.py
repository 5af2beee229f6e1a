"""Tables that end a lineage: written to the folder that the cluster shares, and read again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests on one machine, below a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    elif base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base[5:]}"
    return f"{base.rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished, stored steps: it does so once the driver has collected
    the plans that made them, which may otherwise be long after the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def collected(df: DataFrame, rows: int, what: str):
    """``df`` as a pandas table on the driver, if it has at most ``rows`` rows."""
    out = df.limit(rows + 1).toPandas()
    if len(out) > rows:
        raise ValueError(f"{what} has more than {rows} rows, too many to hold on the driver")
    return out

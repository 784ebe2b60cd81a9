"""Tables written between the steps of a plan.

They lie in the folder that all executors share (``spark.checkpoint.dir``), so a
lost executor costs a re-read, not the work behind them. A folder of the machine
is used only where the setting is absent, as in tests on a local master.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="memquarry-"))
    return "file://" + _local[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Kept as objects of the JVM, which outlives the session: a session that was stopped leaves nothing behind.
    _written.append((spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Removes everything written so far. A program that runs many queries may call it
    between two of them, once their results have been taken."""
    while _written:
        path, conf = _written.pop()
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM has ended: nothing can be done
            pass

"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE merges small shuffle partitions and splits skewed ones, so the partition
#: count only needs to be large enough for the largest input.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("memquarry")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.driver.host": "127.0.0.1"} | extra
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that functions run
    there wherever the driver found it."""
    import atexit
    import shutil
    import tempfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parents[1]
    # Executors that start later fetch the archive too: it stays as long as the driver.
    folder = tempfile.mkdtemp(prefix="memquarry-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, f"{folder}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/tree"))

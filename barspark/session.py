"""Session settings, and the package on the executors' Python path."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def builder(app: str = "barspark", cores: str = "*", partitions: int = 8):
    """A local session's builder with the settings that the engine's results rest on."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )


#: Rows in an Arrow batch where the session has Spark's default of 10,000: whole texts and sets are rows here.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (once for each application), so that Arrow kernels import it there, and keeps their batches small."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="barspark-"), "barspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


#: Rows that one task of a spread table sorts, about.
TASK_ROWS = 1 << 18


def tasks_for(rows: int, each: int = TASK_ROWS) -> int:
    """Tasks that so many rows need, for spread()."""
    return -(-rows // each)


def spread(df: DataFrame, by: list[str], tasks: int | None) -> DataFrame:
    """df dealt by the columns over `tasks` tasks, if these are more than the session's shuffle partitions, so that a task's share does not grow with the table."""
    if not tasks or tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *by)


_own_dir: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, for what streams write; one of this machine's where it is unset (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="barspark-"))
        found = _own_dir[0]
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the work folder and read again: planned and computed once whatever reads it, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/barspark/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner sweeps it
            return

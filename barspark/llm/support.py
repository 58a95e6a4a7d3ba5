"""Reading tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows of a narrow side (keys of at most some 32 bytes) that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or one of this machine's where it is unset (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="barspark-"))
        found = _own_dir[0]
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: its rows survive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barspark/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def done_with(*tables: DataFrame) -> None:
    """Deletes tables that saved() returned and that no plan reads any more."""
    for df in tables:
        known = (df.sparkSession, df.saved_at)
        _delete(*known)
        _written.remove(known)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner sweeps it
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use that clash with none of df's."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def carried(df: DataFrame, *own: str) -> list[str]:
    """df's columns but those whose names an operator's own output columns take."""
    mine = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in mine]

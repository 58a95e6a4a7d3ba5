"""Replay of a panel as a stream: the times that all symbols have, in order, some at a time.

prepare() writes the rows of the common calendar with each time's number, in folders of some
times each. The stream source's offset is the number of times given so far; a batch reads
just the folders of its times, a task a folder, so no row passes the driver. How far batches
were planned is noted beside the data under the stream's name, so that a query that starts
again from its checkpoint goes on from there.
"""

from __future__ import annotations

import json

import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.panel import on_common_calendar, ordinals
from ..session import saved, ship

FORMAT = "replayed_bars"


def prepare(panel: DataFrame, path: str, times_per_folder: int = 64, most_folders: int | None = None) -> int:
    """Writes the panel's rows at times that every symbol has, and their numbers from 0; gives how many times there are.

    most_folders: a long calendar has more times in a folder, so that there are no more folders than that.
    """
    rows = saved(on_common_calendar(panel), "replay-rows")
    calendar = saved(ordinals(rows), "replay-calendar")
    numbered = rows.join(calendar, "ts").select(*rows.columns, F.col("ordinal").cast("long").alias("ordinal"))
    n = calendar.count()
    if most_folders:
        times_per_folder = max(times_per_folder, -(-n // most_folders))
    step = F.floor(F.col("ordinal") / times_per_folder).cast("long")
    numbered.withColumn("step", step).repartition("step").sortWithinPartitions("step", "ordinal", "symbol").write.partitionBy("step").parquet(path)
    where, inside = fs.FileSystem.from_uri(path)
    with where.open_output_stream(f"{inside}/_replay.json") as f:
        f.write(json.dumps({"times": n, "per": times_per_folder, "schema": numbered.schema.json()}).encode())
    return n


def _read(path: str, name: str) -> dict | None:
    where, inside = fs.FileSystem.from_uri(path)
    if where.get_file_info(f"{inside}/{name}").type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(f"{inside}/{name}") as f:
        return json.loads(f.read())


class Step(InputPartition):
    def __init__(self, step: int, start: int, end: int):
        self.step, self.start, self.end = step, start, end


class Replayed(DataSource):
    """Options: path, name (of the stream), times (in a batch at most)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return T.StructType.fromJson(json.loads(_read(self.options["path"], "_replay.json")["schema"]))

    def streamReader(self, schema):
        return Reader(dict(self.options), schema)


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.times = options["path"], int(options.get("times", "64"))
        self.mark = f"_planned-{options.get('name', 'stream')}.json"
        self.about, self.names = _read(self.path, "_replay.json"), schema.names
        self.at = (_read(self.path, self.mark) or {"at": 0})["at"]

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        self.at = min(self.at + self.times, self.about["times"])
        return {"at": self.at}

    def partitions(self, start, end):
        a, b, per = start["at"], end["at"], self.about["per"]
        self.at = max(self.at, b)
        where, inside = fs.FileSystem.from_uri(self.path)
        with where.open_output_stream(f"{inside}/{self.mark}") as f:
            f.write(json.dumps({"at": b}).encode())
        return [Step(s, a, b) for s in range(a // per, -(-b // per))] if a < b else []

    def read(self, partition):
        where, inside = fs.FileSystem.from_uri(self.path)
        found = ds.dataset(f"{inside}/step={partition.step}", filesystem=where, format="parquet")
        own = (ds.field("ordinal") >= partition.start) & (ds.field("ordinal") < partition.end)
        yield from found.to_batches(columns=self.names, filter=own)


def replay(spark: SparkSession, path: str, times: int = 64, name: str = "stream") -> DataFrame:
    """The prepared panel as a stream, `times` times of the calendar in a batch, oldest first; name tells streams over one folder apart."""
    ship(spark)
    spark.dataSource.register(Replayed)
    return spark.readStream.format(FORMAT).option("path", path).option("times", str(times)).option("name", name).load()

"""A streaming source for a log file that is appended to in place: spark.readStream.format("sawmill_tail").

The offset is a byte position after the last whole line, so a line that is being written is left for the next
batch. A file that became shorter was rotated and is read from its start. The file must be readable by the driver."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.at_end, self.most = options["path"], options.get("from", "start") == "end", int(options.get("maxbytes", 16_000_000))

    def initialOffset(self) -> dict:
        return {"at": os.path.getsize(self.path) if self.at_end and os.path.exists(self.path) else 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["at"]
        if not os.path.exists(self.path):
            return iter(()), start
        if os.path.getsize(self.path) < at:
            at = 0
        rows, end = self._lines(at, at + self.most)
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["at"] if end["at"] >= start["at"] else 0
        return iter(self._lines(at, end["at"])[0])

    def _lines(self, at: int, stop: int) -> tuple[list[tuple], int]:
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(stop - at)
        whole = data[: data.rfind(b"\n") + 1]
        return [(self.path, 0, x.decode("utf-8", "replace").rstrip("\r")) for x in whole.split(b"\n")[:-1]], at + len(whole)


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sawmill_tail"

    def schema(self) -> str:
        return "source_file string, line_number long, text string"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, path: str, from_end: bool = True) -> DataFrame:
    spark.dataSource.register(Tail)
    return spark.readStream.format("sawmill_tail").option("from", "end" if from_end else "start").load(path)

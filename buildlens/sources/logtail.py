"""SRC-7: logs that grow, one file per build, as a stream whose offset is a byte of each file.

A file source takes a file once and never sees it grow. This source asks for the sizes of
``<folder>/<build_id>/build.log`` and reads what lies beyond the offset that the query's checkpoint holds:
a batch that fails leaves it, a restarted query goes on there. Only whole bytes are read, no
lines, as a chunk may end anywhere; chunks of a build in the order of ``at`` give its log.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LOG = "build.log"
#: Bytes of a row, of a file that one task reads, and of all files that one task reads (and the most files).
CHUNK, PIECE, TASK, FILES = 1 << 16, 64 << 20, 128 << 20, 1000
TAIL = "build_id string, at bigint, data binary"


@dataclass
class Pieces(InputPartition):
    """(build, first byte, end) of what one task reads."""

    pieces: list


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of each build's log; a build without a log is not there."""
    files, root = file_system(path)
    builds = [f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory]
    logs = files.get_file_info([f"{root}/{b}/{LOG}" for b in builds])
    return {b: f.size for b, f in zip(builds, logs, strict=True) if f.type == fs.FileType.File and f.size}


def packed(start: dict, end: dict) -> list[Pieces]:
    """The bytes from one offset to another in tasks of bounded size; a long log is cut in pieces."""
    tasks: list[Pieces] = []
    room = files = 0
    for build in sorted(end):
        at = start.get(build, 0)
        while at < end[build]:
            upto = min(end[build], at + PIECE)
            if upto - at > room or not files:
                tasks.append(Pieces([]))
                room, files = TASK, FILES
            tasks[-1].pieces.append((build, at, upto))
            room, files, at = room - (upto - at), files - 1, upto
    return tasks


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.path)

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return packed(start, end)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        files, root = file_system(self.path)
        for build, at, upto in partition.pieces:
            with files.open_input_file(f"{root}/{build}/{LOG}") as f:
                f.seek(at)
                while at < upto:
                    data = f.read(min(CHUNK, upto - at))
                    if not data:
                        raise OSError(f"the log of build {build} ends before byte {upto}, which it had")
                    yield pa.RecordBatch.from_arrays([pa.array([build]), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["build_id", "at", "data"])
                    at += len(data)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return TAIL

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_growing_logs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (build_id, at, data) from the logs below ``path``, a folder that driver and
    executors share. A build without a log yields nothing, an empty log neither. A log that has
    become shorter than the offset yields nothing until it is longer again. The offset has an entry per
    log, so that logs of builds long ended should leave the folder."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").load(path)


def write_logs(lines: DataFrame, path: str) -> None:
    """``lines(build_id, seq, data)`` as the whole log of each build, in order of ``seq``. A task that
    runs again writes the same file again, so that a log that had part of these lines only grows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = file_system(path)
        build = out = None
        for pdf in batches:
            for name, some in pdf.groupby("build_id", sort=False):
                if name != build:
                    if out is not None:
                        out.close()
                    files.create_dir(f"{root}/{name}", recursive=True)
                    build, out = name, files.open_output_stream(f"{root}/{name}/{LOG}")
                out.write(b"".join(some["data"]))
        if out is not None:
            out.close()
        yield pd.DataFrame({"done": [True]})

    rows = lines.select(F.col("build_id").cast("string").alias("build_id"), "seq", F.col("data").cast("binary").alias("data"))
    rows.repartition("build_id").sortWithinPartitions("build_id", "seq").mapInPandas(write, "done boolean").write.format("noop").mode("overwrite").save()

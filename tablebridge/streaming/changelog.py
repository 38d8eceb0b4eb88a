"""Change log files as a streaming source of positions: format ``changelog``.

A log is a folder of files whose names end in a number (``binlog.000001``), each with one JSON entry a line. An offset is a file and a byte in it, so a
stream resumes in the middle of a file, and a job may begin at a position or behind a set of global transaction ids. What is read of a file while
another writer appends to it ends with its last whole line.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.positions import Position, available, parse_gtid
from ..session import qualified

SCHEMA = "file string, pos long, line string"
#: Bytes of a planned partition, and of a trigger (0: all there is).
PARTITION_BYTES, TRIGGER_BYTES = 64_000_000, 0
#: Most partitions of a trigger, or a few more: beyond, each is larger than asked for, since a task costs the driver and Python the same for any size.
MOST_PARTITIONS = 2_000
#: Most bytes that a task reads at once; entries and bytes after which it hands on what it has.
READ_BYTES, BATCH_ROWS, BATCH_BYTES = 1 << 20, 10_000, 8_000_000


@dataclass
class Stretch(InputPartition):
    """Entries that begin in bytes [start, end) of a file."""

    file: str
    start: int
    end: int


class Folder:
    """The files of a log, opened with pyarrow wherever a task runs."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def sizes(self) -> dict[str, int]:
        """Bytes of each file, in the order of their numbers."""
        from pyarrow import fs

        infos = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        found = {i.base_name: i.size for i in infos if i.type == fs.FileType.File and re.search(r"\.\d+$", i.base_name)}
        return dict(sorted(found.items(), key=lambda x: number(x[0])))

    def whole(self, name: str, size: int, step: int = 1 << 16) -> int:
        """End of the last whole line before ``size``."""
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            while size > 0:
                start = max(0, size - step)
                f.seek(start)
                at = f.read(size - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                size = start
        return 0

    def lines(self, part: Stretch) -> Iterator[tuple[int, str]]:
        """(position, entry) of the lines that begin in the stretch; the one it begins within belongs to the stretch before.

        The file is opened for random access: a stream can only go forward, so all that is before the stretch would be read.
        """
        at = max(0, part.start - 1)
        with self.fs.open_input_file(f"{self.root}/{part.file}") as f, io.BufferedReader(f, min(READ_BYTES, part.end - at + 4096)) as r:
            r.seek(at)
            if part.start > 0:
                at += len(r.readline())
            while at < part.end and (line := r.readline()).endswith(b"\n"):
                if line.strip():
                    yield at, line[:-1].decode()
                at += len(line)


def number(name: str) -> tuple[int, str]:
    return int(name.rpartition(".")[2]), name


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.start = Position(options.get("startfile", ""), int(options.get("startpos", "0")))
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.trigger_bytes = int(options.get("triggerbytes", TRIGGER_BYTES))
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        sizes = Folder(self.uri).sizes()
        if not self.start.file:
            first = next(iter(sizes), "")
            return {"file": first, "pos": 0}
        if problem := available(self.start, logs=sizes):
            raise ValueError(f"can't start at {self.start.file}:{self.start.pos}: {problem}")
        return {"file": self.start.file, "pos": self.start.pos}

    def latestOffset(self) -> dict:
        """The end of the last whole entry, or ``triggerbytes`` beyond the last offset that was planned."""
        folder = Folder(self.uri)
        sizes = folder.sizes()
        if not sizes:
            return self.last or {"file": "", "pos": 0}
        name = list(sizes)[-1]
        end = {"file": name, "pos": folder.whole(name, sizes[name])}
        if self.trigger_bytes:
            at = self.last or self.initialOffset()
            left = self.trigger_bytes
            for f in [n for n in sizes if number(n) >= number(at["file"])] if at["file"] else list(sizes):
                begin = at["pos"] if f == at["file"] else 0
                if sizes[f] - begin > left:
                    cut = folder.whole(f, begin + left)
                    end = {"file": f, "pos": cut} if cut > begin else {"file": f, "pos": folder.whole(f, sizes[f])}
                    break
                left -= sizes[f] - begin
        self.last = end
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = end
        sizes = Folder(self.uri).sizes()
        if start["file"] and start["file"] not in sizes:
            raise ValueError(f"log file {start['file']} is gone: the stream can't go on at {start['pos']}")
        spans = []
        for name in sizes:
            if (start["file"] and number(name) < number(start["file"])) or not end["file"] or number(name) > number(end["file"]):
                continue
            low = start["pos"] if name == start["file"] else 0
            high = end["pos"] if name == end["file"] else sizes[name]
            spans.append((name, low, high))
        step = max(self.partition_bytes, math.ceil(sum(high - low for _, low, high in spans) / MOST_PARTITIONS))
        return [Stretch(name, a, min(high, a + step)) for name, low, high in spans for a in range(low, high, step)]

    def read(self, partition: Stretch) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("line", pa.string())])
        places, lines, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], schema=schema)

        for at, line in Folder(self.uri).lines(partition):
            places.append(at)
            lines.append(line)
            held += len(line)
            if len(lines) == BATCH_ROWS or held >= BATCH_BYTES:
                yield batch()
                places, lines, held = [], [], 0
        if lines:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class ChangeLogSource(DataSource):
    """Options: ``path``, ``startFile`` and ``startPos``, ``partitionBytes`` (more for a trigger of over MOST_PARTITIONS of them), ``triggerBytes``."""

    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> ChangeLogReader:
        return ChangeLogReader(dict(self.options))


def follow(spark: SparkSession, path: str, schema: StructType, start: Position | None = None, **options: object) -> DataFrame:
    """A log as a stream of its entries' columns, with ``log_file`` and ``log_pos``.

    ``start`` is a file and position, or the GTID set of what is applied: then entries carry a ``gtid`` (uuid:number), and those in the set are
    left out.
    """
    spark.dataSource.register(ChangeLogSource)
    reader = spark.readStream.format("changelog").option("path", qualified(spark, path))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    if start and start.file:
        reader = reader.option("startFile", start.file).option("startPos", str(start.pos))
    applied = parse_gtid(start.gtid) if start and start.gtid else {}
    entry = StructType([*schema.fields]).add("gtid", "string") if applied else schema
    rows = reader.load().select("file", "pos", F.from_json("line", entry).alias("e")).select("e.*", F.col("file").alias("log_file"), F.col("pos").alias("log_pos"))
    if applied:
        uuid, n = F.lower(F.split_part("gtid", F.lit(":"), F.lit(1))), F.split_part("gtid", F.lit(":"), F.lit(2)).cast("long")
        done = F.lit(False)
        for u, spans in applied.items():
            for lo, hi in spans:
                done |= (uuid == u) & n.between(lo, hi)
        rows = rows.where(~F.coalesce(done, F.lit(False))).drop("gtid")
    return rows


def write_log(rows: DataFrame, path: str, order: list[str], files: int) -> None:
    """Write a log of numbered files in ascending order, as a source's server would: for tests and for replays of a kept log."""
    spark = rows.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.json(f"{path}/_new")
    parts = sorted(s.getPath().getName() for s in fs.listStatus(jvm_path(f"{path}/_new")) if s.getPath().getName().startswith("part-"))
    for i, name in enumerate(parts, 1):
        fs.rename(jvm_path(f"{path}/_new/{name}"), jvm_path(f"{path}/binlog.{i:06d}"))
    fs.delete(jvm_path(f"{path}/_new"), True)


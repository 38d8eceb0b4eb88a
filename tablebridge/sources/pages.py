"""Pages written exactly once: format ``pages``, a sink whose tasks may die and whose job may be started again.

A task writes its rows in pages. A page is a Parquet file under a name of its own, and counts only once its entry in the ledger exists: a file named by
the task's partition and the page's number, which is created last. Another attempt of the task, or the job started again under its name, finds
the entry and writes nothing for that page. When all tasks have ended the driver writes the job's commit, with the pages of all messages; reading
asks for it. abort() leaves the ledger, so that the next start goes on from there; discard() takes a job away.

The rows of a partition must come in the same order each time, as dealt() deals them. A page that a ledger entry names is checked against
the rows' count and hash of the new attempt, so that another input is an error and not a mixture.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import qualified
from .readers import PAGE


@dataclass
class Written(WriterCommitMessage):
    """The ledger entries of one partition's pages."""

    partition: int
    pages: list[dict]


class PageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.uri, self.job = options["path"], options["job"]
        self.rows = int(options.get("rows", PAGE))
        self.fail_after = int(options.get("failafter", -1))  # tests: die once so many pages are written

    def _open(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        return store, f"{root}/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = self._open()
        partition = TaskContext.get().partitionId()
        store.create_dir(f"{root}/ledger", recursive=True)
        store.create_dir(f"{root}/pages", recursive=True)
        held, count, done = [], 0, []

        def put(table: pa.Table) -> None:
            done.append(self._page(store, root, partition, len(done), table))
            if 0 <= self.fail_after <= len(done):
                raise RuntimeError(f"stopped after {len(done)} pages")

        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, self.rows - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == self.rows:
                    put(pa.Table.from_batches(held))
                    held, count = [], 0
        if held:
            put(pa.Table.from_batches(held))
        return Written(partition, done)

    def _page(self, store, root: str, partition: int, number: int, table) -> dict:
        """Write one page and its entry, or find that they are there."""
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        name = f"{partition:06d}-{number:06d}"
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table.combine_chunks())
        digest = hashlib.sha256(sink.getvalue()).hexdigest()
        entry = f"{root}/ledger/{name}.json"
        if store.get_file_info(entry).type == fs.FileType.File:
            with store.open_input_file(entry) as f:
                old = json.loads(f.read())
            if (old["rows"], old["digest"]) != (table.num_rows, digest):
                raise ValueError(f"page {name} of job {self.job} was written from other rows")
            return old
        # The file of an attempt that died before its entry is another name, which no entry ever holds.
        page = {"partition": partition, "page": number, "file": f"{name}-{uuid.uuid4().hex}.parquet", "rows": table.num_rows, "digest": digest}
        with store.open_output_stream(f"{root}/pages/{page['file']}") as f:
            pq.write_table(table, f)
        temp = f"{root}/ledger/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as f:
            f.write(json.dumps(page).encode())
        if store.get_file_info(entry).type == fs.FileType.File:  # a second attempt was faster: its page counts
            store.delete_file(temp)
            return self._page(store, root, partition, number, table)
        store.move(temp, entry)
        return page

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._open()
        pages = [p for m in messages if m for p in m.pages]
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/commit.json") as f:
            f.write(json.dumps({"pages": sorted(pages, key=lambda p: (p["partition"], p["page"]))}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing counts without the job's commit; pages with an entry are there for its next start."""


class PageSink(DataSource):
    """Options: ``path``, ``job`` (its name; the same one goes on), ``rows`` a page."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(dict(self.options), overwrite)


def dealt(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Rows dealt by a hash of keys and in the order of all columns: the same in each run, where ranges between sampled splitters would not be."""
    return df.repartition(parts, *keys).sortWithinPartitions(*df.columns)


def write_pages(df: DataFrame, path: str, job: str, rows: int = PAGE, **options: object) -> None:
    """Write a table as pages of a job; started again after a failure, only what lacks is written. ``df`` as dealt() gives it, or in an order of its own."""
    spark = df.sparkSession
    spark.dataSource.register(PageSink)
    writer = df.write.format("pages").option("path", qualified(spark, path)).option("job", job).option("rows", str(rows))
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.mode("append").save()


def _pages(spark: SparkSession, path: str, job: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at = hadoop(f"{path}/{job}/commit.json")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise ValueError(f"job {job} has not ended")
    stream = fs.open(at)
    try:
        return [f"{path}/{job}/pages/{p['file']}" for p in json.loads(bytes(stream.readAllBytes()).decode())["pages"]]
    finally:
        stream.close()


def read_pages(spark: SparkSession, path: str, job: str, schema: StructType) -> DataFrame:
    """The rows of a job that has ended: the pages of its commit, whatever else its failed attempts have left."""
    files = _pages(spark, path, job)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def discard(spark: SparkSession, path: str, job: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{job}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

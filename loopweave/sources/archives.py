"""Lines inside tar.gz archives, read by many tasks from an offset index.

``write_archives`` makes ordinary archives whose entries are gzip members of their
own, and a Parquet index of (file, offset, size, entry, lines). From the index,
``read_archives`` plans runs of entries of about the size of a file split; a task
opens the store, seeks to its run and streams its entries, so one large archive is
read by several tasks, and no entry is held whole. It is a Spark data source: the
schema asked for (any of ``member`` and ``line``) decides what rows are built.

Defined cases: empty entries and empty archives give no lines; lines end with a line
feed, a carriage return before it goes as well; a null line is written as an empty
one; the index names only archives of tasks that were committed.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loopweave.session import scratch_path
from loopweave.sources.stores import store

RUN_BYTES = 64 << 20  # compressed, of one task
ENTRY_BYTES = 4 << 20  # of lines in one entry
INDEX = "file string, offset long, size long, entry string, lines long"
ROWS = 4_000  # lines of a batch


def write_archives(lines: DataFrame, folder: str, line: str = "value",
                   entry_bytes: int = ENTRY_BYTES) -> str:
    """One archive for each partition of ``lines``; returns the path of the index."""
    folder = folder.rstrip("/")

    def entry(name: str, body: bytes) -> bytes:
        packed = io.BytesIO()
        with tarfile.open(fileobj=packed, mode="w") as archive:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
        # Header and padded body only; the end of the archive comes once, at its end.
        return gzip.compress(packed.getvalue()[:512 + -(-len(body) // 512) * 512], 6, mtime=0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        name, found = f"{uuid.uuid4().hex}.tar.gz", []
        with files.open_output_stream(f"{root}/{name}", compression=None) as sink:
            def put(held: list[bytes]) -> None:
                title = f"lines-{len(found):06d}.txt"
                data = entry(title, b"".join(held))
                found.append((f"{folder}/{name}", sink.tell(), len(data), title, len(held)))
                sink.write(data)

            held, size = [], 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    held.append(f"{'' if text is None else text}\n".encode())
                    size += len(held[-1])
                    if size >= entry_bytes:
                        put(held)
                        held, size = [], 0
            if held:
                put(held)
            sink.write(gzip.compress(bytes(1024), mtime=0))
        columns = list(zip(*found)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (
                pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))],
            ["file", "offset", "size", "entry", "lines"])

    index = f"{folder}/_index"
    lines.select(F.col(line).cast("string")).mapInArrow(pack, INDEX).write.parquet(index)
    return index


def _runs(index: DataFrame, run_bytes: int) -> DataFrame:
    """(file, offset, size): neighbouring entries together, up to about ``run_bytes``."""
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = F.floor((F.sum("size").over(before) - F.col("size")) / run_bytes)
    return (index.withColumn("_run", run).groupBy("file", "_run")
            .agg(F.min("offset").alias("offset"), F.sum("size").alias("size"))
            .select("file", "offset", "size"))


class _Run(InputPartition):
    def __init__(self, file: str, offset: int, size: int | None):
        self.file, self.offset, self.size = file, offset, size


class _Part(io.RawIOBase):
    """A stretch of an open file as a file of its own."""

    def __init__(self, file, size: int | None):
        self.file, self.left = file, size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        n = len(buffer) if self.left is None else min(len(buffer), self.left)
        data = self.file.read(n) if n else b""
        buffer[:len(data)] = data
        if self.left is not None:
            self.left -= len(data)
        return len(data)


def _lines(run: _Run) -> Iterator[tuple[str, str]]:
    """(member, line) of the files of a run, one after another."""
    files, path = store(run.file)
    with files.open_input_file(path) as whole:
        whole.seek(run.offset)
        stretch = io.BufferedReader(_Part(whole, run.size), 1 << 20)
        with gzip.GzipFile(fileobj=stretch) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
            for member in tar:
                if member.isfile():
                    for line in tar.extractfile(member):
                        yield member.name, line.decode("utf-8").rstrip("\r\n")


class _LineReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self) -> list[_Run]:
        files, path = store(self.options["plan"])
        with files.open_input_stream(path) as plan:
            return [_Run(*run) for run in json.loads(plan.read())]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        at = [("member", "line").index(n) for n in self.names]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in held], pa.string()) for i in at], self.names)

        for row in _lines(partition):
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class ArchiveLines(DataSource):
    """The data source ``archive_lines``; ``plan`` is a JSON file of (file, offset, size) runs."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "member string, line string"

    def reader(self, schema) -> DataSourceReader:
        unknown = set(schema.fieldNames()) - {"member", "line"}
        if unknown:
            raise ValueError(f"archives have member and line, not {', '.join(sorted(unknown))}")
        return _LineReader(schema, self.options)


def _planned(spark: SparkSession, runs: list[tuple]) -> str:
    """Write the runs where the reader finds them; their number is that of input splits."""
    path = f"{scratch_path(spark, 'runs')}.json"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(json.dumps(runs).encode()))
    out.close()
    return path


def read_archives(spark: SparkSession, index: str | None = None, files: list[str] | None = None,
                  schema: str = "member string, line string", run_bytes: int = RUN_BYTES
                  ) -> DataFrame:
    """(member, line) of indexed archives, or of plain ones, each read by one task."""
    if index is not None:
        rows = _runs(spark.read.schema(INDEX).parquet(index), run_bytes).orderBy("file", "offset")
        runs = [tuple(r) for r in rows.collect()]
    else:
        runs = [(f, 0, None) for f in files or []]
    spark.dataSource.register(ArchiveLines)
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.format("archive_lines").schema(schema).option(
        "plan", _planned(spark, runs)).load()

"""Arrow IPC files as a Spark data source: a partition for each record batch, and only the columns asked for are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Record batches of a stream format file, which has no index, are one partition.
ALL = -1


def _opened(path: str):
    """A reader of a file, and whether it has an index of its record batches."""
    fs, where = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    try:
        return pa.ipc.open_file(fs.open_input_file(where)), True
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(fs.open_input_stream(where)), False


class Batch(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str]):
        self.paths, self.columns = paths, columns

    def partitions(self) -> list[Batch]:
        """Only footers are read here."""
        out = []
        for path in self.paths:
            reader, indexed = _opened(path)
            out += [Batch(path, k) for k in (range(reader.num_record_batches) if indexed else [ALL])]
        return out

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        reader, indexed = _opened(partition.path)
        for batch in [reader.get_batch(partition.number)] if indexed else reader:
            yield batch.select(self.columns)


class ArrowFiles(DataSource):
    """Options: ``paths``, one a line, and ``columns``, comma-separated, all where it is left out."""

    @classmethod
    def name(cls) -> str:
        return "arrowfiles"

    def _paths(self) -> list[str]:
        return [p for p in self.options["paths"].split("\n") if p]

    def schema(self) -> StructType:
        """That of the first file; all files have the same."""
        whole = from_arrow_schema(_opened(self._paths()[0])[0].schema)
        columns = [c for c in self.options.get("columns", "").split(",") if c]
        return StructType([whole[c] for c in columns]) if columns else whole

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self._paths(), schema.names)


def files_at(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files that a pattern names, on any file system that Spark reads, in order of their names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in fs.globStatus(where) or [] if s.isFile() and s.getLen() > 0]
    return sorted(s.getPath().toString() for s in found)


def read_arrow(spark: SparkSession, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of Arrow IPC files (file or stream format) of one schema; no file is an error."""
    paths = files_at(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrowfiles").option("paths", "\n".join(paths)).option("columns", ",".join(columns or [])).load()


def write_arrow(df: DataFrame, folder: str, rows: int = 10_000) -> None:
    """A file for each partition, of record batches of so many rows at most; a file appears under its name when it is whole."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, where = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        task = TaskContext.get()
        name, temporary = f"{where}/part-{task.partitionId():05d}.arrow", f"{where}/.{task.taskAttemptId()}"
        fs.create_dir(where, recursive=True)
        writer, n = None, 0
        for batch in batches:
            if writer is None:
                sink = fs.open_output_stream(temporary)
                writer = pa.ipc.new_file(sink, batch.schema)
            for at in range(0, batch.num_rows, rows):
                writer.write_batch(batch.slice(at, rows))
            n += batch.num_rows
        if writer is not None:
            writer.close(), sink.close()
            fs.move(temporary, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["rows"])

    written = df.select(*schema.names).mapInArrow(run, "rows long")
    written.groupBy().sum("rows").collect()

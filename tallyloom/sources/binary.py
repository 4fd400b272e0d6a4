"""Binary column-major relation files as a Spark data source.

Layout: u64 rows, u64 columns, then each column's u64 values; little-endian.
A file is read in row ranges; each task seeks to its slice of every needed
column and yields Arrow batches. Values are bit patterns in BIGINT.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "colmajor_u64"
ROWS_PER_PARTITION = 4_000_000
ROWS_PER_BATCH = 65_536
ROWS_PER_FILE = 1_000_000


def header(path: str) -> tuple[int, int]:
    with _opened(path) as f:
        head = f.read(16)
    if len(head) < 16:
        raise ValueError(f"{path} has no header of 16 bytes")
    return struct.unpack("<QQ", head)


def _opened(path: str):
    """A seekable input: the local file, or any store that pyarrow knows."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _files(path: str) -> list[str]:
    """The file itself or, of a folder, its files by name; those that begin with _ or . don't count."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + os.path.abspath(path))
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{n}" for n in names]


class RowRange(InputPartition):
    def __init__(self, path: str, rows: int, start: int, stop: int):
        super().__init__((path, rows, start, stop))
        self.path, self.rows, self.start, self.stop = path, rows, start, stop


class _Reader(DataSourceReader):
    def __init__(self, shapes: list[tuple[str, int, int]], columns: int, step: int):
        self.shapes, self.columns, self.step = shapes, columns, step

    def partitions(self) -> list[RowRange]:
        return [RowRange(path, rows, a, min(rows, a + self.step)) for path, rows, _ in self.shapes for a in range(0, rows, self.step)] or [RowRange("", 0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        names = [f"c{i}" for i in range(self.columns)]
        with _opened(partition.path) as f:
            for at in range(partition.start, partition.stop, ROWS_PER_BATCH):
                n, arrays = min(ROWS_PER_BATCH, partition.stop - at), []
                for c in range(self.columns):
                    f.seek(16 + 8 * (c * partition.rows + at))
                    data = f.read(8 * n)
                    if len(data) != 8 * n:
                        raise ValueError(f"{partition.path} ends within column {c}")
                    arrays.append(pa.array(np.frombuffer(data, "<u8").view("<i8")))
                yield pa.RecordBatch.from_arrays(arrays, names)


class ColumnMajorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _shapes(self) -> list[tuple[str, int, int]]:
        """(path, rows, columns) of each file; files of one relation have as many columns."""
        shapes = [(p, *header(p)) for p in _files(self.options["path"])]
        if not shapes:
            raise ValueError(f"{self.options['path']} holds no file")
        if len({c for _, _, c in shapes}) > 1:
            raise ValueError(f"the files of {self.options['path']} differ in their columns")
        return shapes

    def schema(self) -> str:
        return ", ".join(f"c{i} bigint" for i in range(self._shapes()[0][2]))

    def reader(self, schema) -> DataSourceReader:
        shapes = self._shapes()
        return _Reader(shapes, shapes[0][2], int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION)))


def read(spark: SparkSession, path: str, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The relation of a file, or of a folder of files that hold rows of one relation each."""
    spark.dataSource.register(ColumnMajorSource)
    return spark.read.format(NAME).option("rowsPerPartition", rows_per_partition).load(path)


def write_folder(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """BIGINT columns of any number of rows as a folder of files; gives the number of rows.

    A task holds the rows of one file. Names follow from the partition and a
    file comes to its name by a rename, so a task that runs again replaces what
    it wrote before by the same.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, inner = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + path)
        store.create_dir(inner, recursive=True)
        held, count, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{context.partitionId():06d}-{number:05d}"
            table = pa.Table.from_batches(held)
            aside = f"{inner}/_{name}-{context.taskAttemptId()}"
            with store.open_output_stream(aside, compression=None) as f:
                f.write(struct.pack("<QQ", table.num_rows, len(names)))
                for c in range(len(names)):
                    f.write(table.column(c).to_numpy().astype("<i8").tobytes())
            store.move(aside, f"{inner}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64())], ["n_rows"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows_per_file - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == rows_per_file:
                    yield flush()
                    held, count, number = [], 0, number + 1
        if count:
            yield flush()

    rows = df.mapInArrow(run, "n_rows bigint").agg({"n_rows": "sum"}).first()[0] or 0
    if not rows:  # a relation without rows has a file, too
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + path)
        store.create_dir(inner, recursive=True)
        with store.open_output_stream(f"{inner}/part-000000-00000", compression=None) as f:
            f.write(struct.pack("<QQ", 0, len(names)))
    return rows


def write(path: str, columns: list[list[int]]) -> None:
    """Columns of unsigned integers to one file; for fixtures and small relations."""
    with open(path, "wb") as f:
        f.write(struct.pack("<QQ", len(columns[0]) if columns else 0, len(columns)))
        for c in columns:
            f.write(np.array(c, dtype="<u8").tobytes())

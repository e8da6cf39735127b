"""An archive of pages as a stream: offsets are numbers of pages, and each page is one batch, whole or not at all.

A page is a folder ``page=<number>`` of Parquet files below the archive's path; numbers begin at 0 and have no holes. A page
counts as there once its successor or the archive's end mark (``_LAST``, with the number of pages) is, so that a page that is
being written is never read. The reader gives one page a trigger: a sink that writes by batch so keeps each page whole, and a query that
stopped behind page k goes on at k + 1 from its checkpoint.

The executors read a page's files, each file by a task; only names of folders and files are seen by the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _at(path: str):
    """(file system, path) for pyarrow, of a path as Hadoop writes it (file:/x has one slash)."""
    import pyarrow.fs

    path = re.sub(r"\Afile:/+", "file:///", path)
    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"\A\w+://", path) else f"file://{path}")


def _pages(path: str) -> int:
    """How many pages can be read."""
    import pyarrow.fs

    fs, root = _at(path)
    mark = fs.get_file_info(f"{root}/_LAST")
    if mark.type == pyarrow.fs.FileType.File:
        return int(fs.open_input_stream(f"{root}/_LAST").read())
    found = [int(m[1]) for x in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if (m := re.fullmatch(r"page=(\d+)", x.base_name))]
    return max(found, default=0)


@dataclass
class _File(InputPartition):
    path: str
    file: str
    page: int


def _files(path: str, first: int, stop: int) -> list[_File]:
    import pyarrow.fs

    fs, root = _at(path)
    return [_File(path, x.path, page) for page in range(first, stop) for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/page={page}")) if x.base_name.endswith(".parquet")]


def _rows(part: _File, names: list[str]) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq

    fs, _ = _at(part.path)
    with fs.open_input_file(part.file) as f:
        for b in pq.ParquetFile(f).iter_batches(columns=[n for n in names if n != "page"]):
            columns = [pa.array([part.page] * b.num_rows, pa.int64()) if n == "page" else b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)


def _planned(checkpoint: str) -> int:
    """The page up to which the query's last planned batch goes, by its checkpoint; 0 for a new query."""
    import pyarrow.fs

    fs, root = _at(checkpoint)
    batches = [int(x.base_name) for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/offsets", allow_not_found=True)) if x.base_name.isdigit()]
    if not batches:
        return 0
    with fs.open_input_stream(f"{root}/offsets/{max(batches)}") as f:
        return int(re.findall(r'"page":\s*(\d+)', f.read().decode())[-1])


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, names: list[str], checkpoint: str) -> None:
        self.path, self.names, self.planned = path, names, _planned(checkpoint)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": min(self.planned + 1, max(self.planned, _pages(self.path)))}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        self.planned = end["page"]
        return _files(self.path, start["page"], end["page"])

    def read(self, partition: _File) -> Iterator:
        return _rows(partition, self.names)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def partitions(self) -> list[_File]:
        return _files(self.path, 0, _pages(self.path))

    def read(self, partition: _File) -> Iterator:
        return _rows(partition, self.names)


class Pages(DataSource):
    """``spark.read.format("pages")`` and ``spark.readStream.format("pages")``, each with a schema that has page, and a path;
    a stream also with the query's own ``checkpoint``, by which the reader knows at which page it goes on."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], schema.fieldNames(), self.options["checkpoint"])

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], schema.fieldNames())


def write_pages(rows: DataFrame, path: str, ended: bool = True) -> None:
    """Adds rows (page, ...) to an archive by their pages, and, if it has ``ended``, the mark of how many there are."""
    rows.repartition("page").write.mode("append").partitionBy("page").parquet(path)
    if ended:
        n = rows.agg(F.coalesce(F.max("page") + 1, F.lit(0))).first()[0]
        sc = rows.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_LAST")
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.writeBytes(str(n))
        out.close()


def read_pages(spark: SparkSession, schema: str, path: str, checkpoint: str | None = None) -> DataFrame:
    """The archive's rows; a stream of them, a page a batch, if it is told the query's ``checkpoint``."""
    spark.dataSource.register(Pages)
    if checkpoint is None:
        return spark.read.format("pages").schema(schema).option("path", path).load()
    return spark.readStream.format("pages").schema(schema).option("path", path).option("checkpoint", checkpoint).load()

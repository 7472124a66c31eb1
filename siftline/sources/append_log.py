"""An append-only log as a data source: an append costs its own rows, and nothing counts before it is committed.

A task writes its rows to one Parquet file of a new name and reports it in its commit message. When all tasks are done, one
commit file names the files of the append, with their rows and the greatest id; readers open only files that a commit
names. An append that fails deletes its folder; what a lost task writes later is named by no commit and is never read. Appends of
several writers do not meet: every folder and name is new.

Paths are those of pyarrow's file systems, so tasks write to any shared store that it reaches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType, FileSelector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "append_log"


def _at(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("a log is only appended to")
        self.path, self.id, self.append = options["path"], options.get("id"), uuid.uuid4().hex  # made on the driver, once an append

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _at(self.path)
        name, out, rows, greatest = f"data/{self.append}/{uuid.uuid4().hex}.parquet", None, 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    fs.create_dir(f"{root}/data/{self.append}")
                    out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
                if self.id:
                    top = pa.compute.max(batch.column(self.id)).as_py()
                    greatest = top if greatest is None else greatest if top is None else max(greatest, top)
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{root}/{name}")
            raise
        if out is None:
            return Written()
        out.close()
        return Written([{"file": name, "rows": rows, "greatest": greatest}])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        said = "".join(json.dumps(f) + "\n" for m in messages if m for f in m.files)
        fs.create_dir(f"{root}/commits")
        with fs.open_output_stream(f"{root}/.{self.append}") as out:
            out.write(said.encode())
        fs.move(f"{root}/.{self.append}", f"{root}/commits/{self.append}.json")  # whole or not at all

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        if fs.get_file_info(f"{root}/data/{self.append}").type == FileType.Directory:  # also what lost tasks did not report
            fs.delete_dir(f"{root}/data/{self.append}")


class AppendLog(DataSource):
    """df.write.format("append_log").mode("append").option("path", ...).save(); option id: a column whose greatest value commits remember."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise NotImplementedError("read a log with read_log")

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def append(df: DataFrame, path: str, id: str | None = None) -> None:
    df.sparkSession.dataSource.register(AppendLog)
    options = {"path": path} | ({"id": id} if id else {})
    df.write.format(FORMAT).mode("append").options(**options).save()


def commits(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, greatest of every committed file."""
    fs, root = _at(path)
    schema = "file string, rows long, greatest long"
    if fs.get_file_info(f"{root}/commits").type != FileType.Directory:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/commits")


def next_id(spark: SparkSession, path: str) -> int:
    """One more than the greatest id: from the commits alone, whatever the size of the log."""
    return commits(spark, path).agg(F.coalesce(F.max("greatest"), F.lit(0)) + 1).first()[0]


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All committed rows. The driver holds the files' names, a row a task and append."""
    files = [f"{path}/{r['file']}" for r in commits(spark, path).select("file").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def left_over(spark: SparkSession, path: str) -> list[str]:
    """Files that no commit names: of tasks that ended after their append had failed, or of appends that are still going on."""
    fs, root = _at(path)
    known = {f"{root}/{r['file']}" for r in commits(spark, path).select("file").collect()}
    return [f.path for f in fs.get_file_info(FileSelector(f"{root}/data", allow_not_found=True, recursive=True)) if f.type == FileType.File and f.path not in known]


def clean(spark: SparkSession, path: str) -> int:
    """Delete what is left over, when no append is going on; how many files."""
    fs, gone = _at(path)[0], left_over(spark, path)
    for f in gone:
        fs.delete_file(f)
    return len(gone)

"""Graph statements as text files: a Spark data source whose tasks write and whose commit names what counts."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyarrow import RecordBatch, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomgraph.sources.sinks import BATCH_ROWS

MANIFEST = "manifest.json"
# statements repeat most of their text: at this level they take an eighteenth of it, as fast as at the lowest
GZIP_LEVEL = 3


def opened(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt wrote: `files` files `<prefix>-<number>.txt.gz` with `rows` statements in all."""

    prefix: str
    files: int
    rows: int


class StatementWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        """Compressed files of at most `batch` statements, a line each; their names hold the attempt, so none meets another's."""
        store, folder = opened(self.path)
        task = TaskContext.get()
        prefix = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        files = rows = room = 0
        out = raw = None

        def close() -> None:
            if out:
                out.close()
                raw.close()

        for b in iterator:
            lines = b.column(0).to_pylist()
            while lines:
                if room == 0:
                    close()
                    raw = store.open_output_stream(f"{folder}/{prefix}-{files}.txt.gz", compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=GZIP_LEVEL, mtime=0)
                    files, room = files + 1, self.batch
                now, lines = lines[:room], lines[room:]
                out.write("".join(f"{line}\n" for line in now).encode())
                room -= len(now)
                rows += len(now)
        close()
        return Written(prefix, files, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """One manifest line per task that wrote; files of failed attempts are in none and go."""
        store, folder = opened(self.path)
        done = [m for m in messages if m and m.files]
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            for m in done:
                out.write((json.dumps({"prefix": m.prefix, "files": m.files, "rows": m.rows}) + "\n").encode())
        kept = {m.prefix for m in done}
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith("part-") and info.base_name.rpartition("-")[0] not in kept:
                store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        gone = {m.prefix for m in messages if m and m.files}
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.base_name.rpartition("-")[0] in gone:
                store.delete_file(info.path)


class StatementSource(DataSource):
    """`df.write.format("statements").option("path", ...)`; one string column."""

    @classmethod
    def name(cls) -> str:
        return "statements"

    def writer(self, schema: StructType, overwrite: bool) -> StatementWriter:
        if len(schema.fields) != 1:
            raise ValueError("statements are one string column")
        store, folder = opened(self.options["path"])
        store.create_dir(folder)
        if store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{folder} already holds statements")
        return StatementWriter(self.options["path"], int(self.options.get("batch", BATCH_ROWS)))


def quoted(text: Column) -> Column:
    """A string literal of the statement language on one line."""
    for raw, safe in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.concat(F.lit("'"), text, F.lit("'"))


def edge_statements(edges: DataFrame) -> DataFrame:
    """`(statement)`: each edge merged between its item and its neighbour; edges without a name are none."""
    text = F.concat(
        F.lit("MATCH (i:Item {id: "),
        quoted(F.col("src_id").cast("string")),
        F.lit("}) MATCH (e:"),
        F.col("dst_label"),
        F.lit(" {name: "),
        quoted(F.col("dst_name").cast("string")),
        F.lit("}) MERGE (i)-[:"),
        F.col("rel_type"),
        F.lit("]->(e);"),
    )
    return edges.select(text.alias("statement")).filter("statement IS NOT NULL")


def write_statements(statements: DataFrame, path: str, batch: int = BATCH_ROWS) -> None:
    """A new folder of statement files of at most `batch` lines and its manifest; a folder that has one is refused.

    A task that fails and runs again, or twice at once, counts once: only files
    that the manifest names belong to the result.
    """
    spark = statements.sparkSession
    spark.createDataFrame([], "statement string")  # makes the session this thread's active one, where the name is looked up
    spark.dataSource.register(StatementSource)
    statements.write.format("statements").option("path", path).option("batch", batch).mode("append").save()


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """`(statement, file)` of the files that the manifest names."""
    named = spark.read.schema("prefix string, files long, rows long").json(f"{path}/{MANIFEST}").select("prefix")
    lines = spark.read.option("pathGlobFilter", "part-*.txt.gz").option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").alias("statement"), F.col("_metadata.file_name").alias("file"))
    return lines.withColumn("prefix", F.substring_index("file", "-", 3)).join(named, "prefix", "left_semi").select("statement", "file")

"""Sinks of published transitions: a readable log that counts what it writes, and a table by day."""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from candlewick.operators.transitions import CONTRACT
from candlewick.sources.transition_text import BANNER, BLOCK_START, TITLE, blocks

DAY = "effective_day"


@dataclass
class Part(WriterCommitMessage):
    """What one task reports: its file and what became of its rows."""

    file: str
    written: int
    dropped: int
    errors: int


class LogWriter(DataSourceWriter):
    """Every task attempt writes a file of its own; only files of committed tasks get into ``blocks``.

    A row without block is dropped.  A block that holds the start of another one would be read as two, so it
    counts as a write error.  A failing file system fails the task, which Spark repeats.
    """

    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator) -> Part:
        store, root = self._store()
        open_dir = posixpath.join(root, f"_open-{self.run}")
        store.create_dir(open_dir, recursive=True)
        name, written, dropped, errors = f"part-{uuid.uuid4().hex}.txt", 0, 0, 0
        with store.open_output_stream(posixpath.join(open_dir, name)) as out:
            for row in iterator:
                block = row[0]
                if block is None:
                    dropped += 1
                elif BLOCK_START in block[1:]:
                    errors += 1
                else:
                    out.write(f"{block}\n".encode())
                    written += 1
        return Part(name, written, dropped, errors)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = self._store()
        parts = [m for m in messages if m is not None]
        open_dir, target = posixpath.join(root, f"_open-{self.run}"), posixpath.join(root, "blocks")
        store.create_dir(target, recursive=True)
        for part in parts:
            store.move(posixpath.join(open_dir, part.file), posixpath.join(target, part.file))
        total = [sum(getattr(p, n) for p in parts) for n in ("written", "dropped", "errors")]
        footer = (
            f"{BANNER}\n{TITLE} DIAGNOSTIC COMPLETE\n{BANNER}\n\nTransitions Written:  {total[0]}\n"
            f"Transitions Dropped:  {total[1]}\nWrite Errors:         {total[2]}\n\n{BANNER}\n"
        )
        header = f"{BANNER}\n{TITLE} DIAGNOSTIC\n{BANNER}\n\nContract Version:   {CONTRACT}\n\n{BANNER}\n"
        for folder, text in (("footer", footer), ("header", header)):
            store.create_dir(posixpath.join(root, folder), recursive=True)
            with store.open_output_stream(posixpath.join(root, folder, "part.txt")) as out:
                out.write(text.encode())
        if parts:
            store.delete_dir(open_dir)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = self._store()
        open_dir = posixpath.join(root, f"_open-{self.run}")
        if store.get_file_info(open_dir).type != fs.FileType.NotFound:
            store.delete_dir(open_dir)


class TransitionLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transition_log"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"])


def write_log(changes: DataFrame, path: str) -> None:
    """Blocks in parallel part files below ``path``; the footer's counts come from the tasks' commit messages.

    A transition without id has no block and is counted as dropped.  ``path`` is a new folder that the driver
    and all executors see.
    """
    changes.sparkSession.dataSource.register(TransitionLog)
    shown = blocks(changes.select("*", F.col("transition_id").isNotNull().alias("_known")), keep=F.col("_known"))
    shown.write.format("transition_log").mode("append").option("path", path).save()


def write_by_day(changes: DataFrame, path: str) -> None:
    """Parquet in one folder per day of ``effective_time``.

    Rows are dealt by ranges of the time first: a day's rows lie in few files, and a busy day in several.
    Transitions without a time share one folder.
    """
    dealt = changes.withColumn(DAY, F.to_date("effective_time")).repartitionByRange("effective_time")
    dealt.write.partitionBy(DAY).parquet(path)


def read_slice(spark: SparkSession, path: str, start: Column, end: Column | None = None) -> DataFrame:
    """Transitions from ``start`` on, before ``end``; folders of other days are not opened."""
    found = spark.read.parquet(path)
    at = F.col("effective_time")
    found = found.filter((F.col(DAY) >= F.to_date(start)) & (at >= start))
    if end is not None:
        found = found.filter((F.col(DAY) <= F.to_date(end)) & (at < end))
    return found.drop(DAY)

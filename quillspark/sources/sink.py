"""A file of one list, written by tasks in parts and joined at commit.

Rows are texts in the order they should stand in. Each task writes those of its partition to a part
beside the target and tells its number and name; at commit the parts are joined between head and
tail, in the order of partitions, and take the target's name at once. A write that fails leaves no
part and the target as it was. Parts of attempts that were given up are removed too.

The folder is one that all machines see under the same path.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "one_list"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class ListWriter(DataSourceWriter):
    def __init__(self, path: str, head: str, between: str, tail: str, empty: str):
        self.path, self.head, self.between, self.tail, self.empty = path, head, between, tail, empty
        # Parts are hidden files of this write alone.
        self.stem = str(Path(path).parent / f".{Path(path).name}.{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, n = f"{self.stem}.{task.partitionId():06}-{task.taskAttemptId()}", 0
        with open(name, "w", encoding="utf-8", newline="") as out:
            for n, (text,) in enumerate(rows, 1):
                out.write((self.between if n > 1 else "") + text)
        return Part(task.partitionId(), name, n)

    def commit(self, messages: list[Part]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        whole = f"{self.stem}.whole"
        with open(whole, "wb") as out:
            out.write(self.head.encode())
            for k, m in enumerate(parts):
                out.write(self.between.encode() if k else b"")
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 20)
            out.write((self.tail if parts else self.empty).encode())
        os.replace(whole, self.path)
        self.abort(messages)

    def abort(self, messages: list[Part]) -> None:
        for name in glob.glob(f"{glob.escape(self.stem)}.*"):
            os.unlink(name)


class OneList(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        o = self.options
        return ListWriter(o["path"], o.get("head", ""), o.get("between", "\n"), o.get("tail", ""), o.get("empty", o.get("tail", "")))


def write_list(texts: DataFrame, path: str | os.PathLike, head: str = "", between: str = "\n", tail: str = "", empty: str | None = None) -> None:
    """Write the only column of ``texts``, in its order, as one file; ``empty`` follows the head where there are no rows."""
    texts.sparkSession.dataSource.register(OneList)
    options = {"path": str(path), "head": head, "between": between, "tail": tail, "empty": tail if empty is None else empty}
    texts.toDF("text").write.format(NAME).options(**options).mode("append").save()

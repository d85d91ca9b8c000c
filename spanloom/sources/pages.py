"""A sink that writes each page as a file of its own, from the tasks that have them.

A page is written under a name of its attempt and renamed when it is whole, so that a task that fails or runs twice leaves no half page, and a rerun replaces pages by the same.
When all tasks are done ``_SUCCESS`` is written; when the job fails, the pages of the tasks that had finished are removed. Paths may be those of any file system that Arrow opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_name(title: str) -> str:
    """A title as a file's name: what a name may not hold is written as in an address."""
    return quote(title, safe=" -_.,()+=#") + ".html"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class PageWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        names, attempt = [], uuid.uuid4().hex
        for row in iterator:
            name = file_name(row["title"])
            half = f"{root}/.{attempt}-{len(names)}"
            with system.open_output_stream(half) as out:
                out.write(row["html"].encode())
            system.move(half, f"{root}/{name}")
            names.append(name)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/{name}")


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "title string, html string"

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


def write_pages(found: DataFrame, path: str, title: str = "title") -> None:
    """A file for each row of ``found`` (title, html), named by its title."""
    found.sparkSession.dataSource.register(Pages)
    found.selectExpr(f"`{title}` AS title", "html").write.format("pages").mode("append").save(path)

"""Converted documents as files: <folder>/<name>/<name>.md with its images beside it.

    spark.dataSource.register(MarkdownFolder)
    converted.write.format("markdown_folder").mode("append").option("path", folder).save()

A task writes everything under a folder of its own first. When it has all its rows it moves the
files into place, each by one rename, images before the Markdown that shows them; so a task that is
lost leaves no half file, and one that runs twice leaves the same files. A document that was there is replaced, with
its images. The driver ends the job with a _SUCCESS file, or clears what was not moved. The folder
is any that pyarrow's file systems reach from all executors."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.functions import text as T

SCHEMA = "output_name string, markdown string, images array<struct<name string, content binary>>"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    local = folder.removeprefix("file:")
    if "://" in local:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(local)


def _checked(name: str | None) -> str:
    if not name or "/" in name or name in (".", ".."):
        raise ValueError(f"no name of a file: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    documents: int


class MarkdownFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_folder"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MarkdownWriter(self.options["path"], overwrite)


class MarkdownWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.job = folder, f"_parts-{uuid.uuid4().hex}"
        if overwrite:
            raise ValueError("documents are replaced one by one: use mode append")

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _place(self.folder)
        mine, found = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        files.create_dir(mine, recursive=True)
        for row in iterator:
            name = _checked(row["output_name"])
            images = {_checked(i["name"]): i["content"] or b"" for i in row["images"] or []}
            parts = [*((f"images/{k}", v) for k, v in images.items()), (f"{name}.md", (row["markdown"] or "").encode("utf-8", "replace"))]
            for i, (_, content) in enumerate(parts):
                with files.open_output_stream(f"{mine}/{len(found)}-{i}") as out:
                    out.write(bytes(content))
            found.append((name, [p for p, _ in parts]))
        for n, (name, parts) in enumerate(found):
            files.create_dir(f"{root}/{name}/images" if len(parts) > 1 else f"{root}/{name}", recursive=True)
            for i, part in enumerate(parts):
                files.move(f"{mine}/{n}-{i}", f"{root}/{name}/{part}")
            kept = {f"{root}/{name}/{p}" for p in parts}
            for old in files.get_file_info(fs.FileSelector(f"{root}/{name}/images", allow_not_found=True)):
                if old.path not in kept:
                    files.delete_file(old.path)
        return Written(len(found))

    def _clear(self) -> None:
        files, root = _place(self.folder)
        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()
        files, root = _place(self.folder)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


def write(results: DataFrame, folder: str, images: str | None = None) -> None:
    """Write the successes of a conversion. images names a column of (name, content) structs; of
    these only those that the Markdown shows are written, once each, under their base names."""
    results.sparkSession.dataSource.register(MarkdownFolder)
    done = results.filter("success")
    none = F.array().cast("array<struct<name string, content binary>>")
    if images is None:
        kept = none
    else:
        base = F.transform(images, lambda i: F.struct(F.substring_index(i["name"], "/", -1).alias("name"), i["content"].alias("content")))
        kept = F.coalesce(F.filter(base, lambda i: F.array_contains(T.image_names(F.col("markdown")), i["name"])), none)
    done.select("output_name", "markdown", kept.alias("images")).write.format("markdown_folder").mode("append").option("path", folder).save()

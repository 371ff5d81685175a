"""``docfile``: a data source that reads a folder of document files, as a batch or a stream, and writes them."""

from __future__ import annotations

import glob
import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from quire.sources import syntax

SCHEMA = "path string, version string, n_revisions int, n_objects int, length long, content binary"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path is: a URI's file system, which drivers and executors of a cluster share, or this machine's."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files of a folder and all below it, or those of a pattern on this machine."""
    if "://" not in path and not os.path.isdir(path):
        return sorted(glob.glob(path))
    where, base = filesystem(path)
    found = where.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    head = path[: len(path.rstrip("/")) - len(base.rstrip("/"))] if "://" in path else ""
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".pdf"))


def row(path: str) -> tuple:
    where, at = filesystem(path)
    with where.open_input_stream(at) as file:
        content = file.read()
    try:
        doc = syntax.read(content)
        return path, doc.version, len(doc.revisions), len(doc.objects), len(content), content
    except (ValueError, PermissionError):
        return path, None, None, None, len(content), content


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("filesPerPartition", 64))

    def partitions(self):
        paths = listed(self.path)
        return [FilePartition(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [FilePartition([])]

    def read(self, partition):
        for path in partition.paths:
            yield row(path)


class StreamReader(SimpleDataSourceStreamReader):
    """New files by name: each trigger takes up to ``maxFilesPerTrigger`` names after the last."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxFilesPerTrigger", 1000))

    def initialOffset(self):
        return {"after": ""}

    def read(self, start):
        paths = [p for p in listed(self.path) if p > start["after"]][: self.most]
        return iter([row(p) for p in paths]), {"after": paths[-1] if paths else start["after"]}

    def readBetweenOffsets(self, start, end):
        return iter([row(p) for p in listed(self.path) if start["after"] < p <= end["after"]])


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceWriter):
    """Writes ``content`` under the last part of ``path`` to the target folder.

    Tasks write to a folder of their own job; what they wrote is moved to the target when all have ended well, and goes if not. Two files of one
    name, or one that is there already (but for ``overwrite``), are an error, and nothing is moved then.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staged = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def write(self, rows):
        where, staged = filesystem(self.staged)
        own, names = uuid.uuid4().hex, []
        where.create_dir(f"{staged}/{own}", recursive=True)
        for r in rows:
            name = r["path"].rstrip("/").rpartition("/")[2]
            if not name:
                raise ValueError(f"no file name in {r['path']!r}")
            names.append(f"{own}/{name}")
            with where.open_output_stream(f"{staged}/{own}/{name}") as file:
                file.write(bytes(r["content"] or b""))
        return Written(names)

    def commit(self, messages):
        where, staged = filesystem(self.staged)
        base = filesystem(self.path)[1]
        names = [n for m in messages if m for n in m.names]
        by: dict[str, int] = {}
        for n in names:
            by[n.partition("/")[2]] = by.get(n.partition("/")[2], 0) + 1
        clash = sorted(n for n, k in by.items() if k > 1)
        there = [] if self.overwrite else sorted(n for n in by if where.get_file_info(f"{base}/{n}").type != fs.FileType.NotFound)
        if clash or there:
            self.abort(messages)
            raise ValueError(f"files of one name: {(clash or there)[:5]}")
        for n in names:
            target = f"{base}/{n.partition('/')[2]}"
            if self.overwrite and where.get_file_info(target).type == fs.FileType.File:
                where.delete_file(target)
            where.move(f"{staged}/{n}", target)
        self.abort(messages)

    def abort(self, messages):
        where, staged = filesystem(self.staged)
        if where.get_file_info(staged).type == fs.FileType.Directory:
            where.delete_dir(staged)


class DocFile(DataSource):
    @classmethod
    def name(cls):
        return "docfile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def simpleStreamReader(self, schema):
        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocFile)

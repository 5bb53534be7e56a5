"""Files as data sources of Spark: split files, whole texts by name, and named files as a sink.

Paths are read by the file systems that Arrow knows (local, hdfs, s3, gs); scans in
``scans`` go through Spark's own readers and reach any other store. Filters on what a
file's name says choose files when the scan is planned.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

_SPLIT_NAME = re.compile(r"([a-z]+)_(\d+)\.txt(?:/part-[^/]*)?$")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, or of a file, in order; hidden ones and markers of writers left out."""
    system, root = opened(path)
    one = system.get_file_info(root)
    found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[_.][^/]*$", f.path))


@dataclass
class Files(InputPartition):
    """What one task reads."""

    paths: tuple


class _Reader(DataSourceReader):
    """Files chosen by equal values of the columns that ``names`` makes of a path."""

    def __init__(self, options: dict):
        self.options, self.wanted = options, []

    def named(self, path: str) -> dict | None:
        raise NotImplementedError

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = self.file_columns
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in known:
                self.wanted.append((f.attribute[0], {f.value}))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in known:
                self.wanted.append((f.attribute[0], set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files of about ``bytes`` together, 16 MB if nothing is said, at most 1,000."""
        most, out, size = int(self.options.get("bytes", 16 << 20)), [], 0
        for path, length in listed(self.options["path"]):
            name = self.named(path)
            if name is None or any(name[c] not in values for c, values in self.wanted):
                continue
            if not out or size + length > most or len(out[-1]) >= 1000:
                out.append([])
                size = 0
            out[-1].append(path)
            size += length
        return [Files(tuple(p)) for p in out] or [Files(())]

    def system(self) -> fs.FileSystem:
        return opened(self.options["path"])[0]


class SplitReader(_Reader):
    file_columns = ("split", "fold")

    def named(self, path):
        match = _SPLIT_NAME.search(path)
        return {"split": match[1], "fold": int(match[2])} if match else None

    def read(self, partition: Files):
        least = 3 if str(self.options.get("with_n", "true")).lower() == "true" else 2
        system = self.system()
        for path in partition.paths:
            name = self.named(path)
            with system.open_input_stream(path) as stream:
                for line in _lines(stream):
                    parts = line.split()
                    if len(parts) >= least:
                        n = int(parts[2]) if least == 3 and re.match(r"[+-]?\d{1,9}\Z", parts[2]) else None
                        yield parts[0], parts[1], n, name["split"], name["fold"], "syn" in parts[0].lower()


def _lines(stream) -> Iterator[str]:
    """Lines of a stream of bytes, read in pieces of bounded size."""
    rest = b""
    while piece := stream.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


class SplitFiles(DataSource):
    """``neumes_splits``: (img, gt, n, split, fold, is_synthetic) of the files <split>_<fold>.txt below ``path``.

    A file may be a folder of parts that a job wrote. Lines with too few fields are left
    out; with ``with_n`` false two fields are enough and n is null. Equal split and fold
    in a filter leave other files unread.
    """

    @classmethod
    def name(cls):
        return "neumes_splits"

    def schema(self):
        return "img string, gt string, n int, split string, fold int, is_synthetic boolean"

    def reader(self, schema):
        return SplitReader(dict(self.options))


class TextReader(_Reader):
    file_columns = ("name",)

    def named(self, path):
        match = re.search(self.options.get("pattern", r"([^/]+)$"), path)
        return {"name": match[1]} if match else None

    def read(self, partition: Files):
        system = self.system()
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                text = stream.read().decode("utf-8", "replace")
            yield pa.record_batch([[self.named(path)["name"]], [text], [path]], schema=pa.schema([("name", pa.string()), ("text", pa.string()), ("path", pa.string())]))


@dataclass
class Written(WriterCommitMessage):
    moved: tuple


class TextWriter(DataSourceWriter):
    """Each row's text as a file: written beside its place, and moved there when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows):
        from pyspark import TaskContext

        system, root = opened(self.path)
        attempt, moved = TaskContext.get().taskAttemptId(), []
        for row in rows:
            target = f"{root}/{row['name']}"
            folder, _, name = target.rpartition("/")
            system.create_dir(folder, recursive=True)
            beside = f"{folder}/.{name}.{attempt}"
            with system.open_output_stream(beside) as out:
                out.write((row["text"] or "").encode())
            moved.append((beside, target))
        return Written(tuple(moved))

    def commit(self, messages):
        system, root = opened(self.path)
        new = {target for m in messages if m for _, target in m.moved}
        if self.overwrite:
            for path, _ in listed(self.path):
                if path not in new:
                    system.delete_file(path)
        for m in messages:
            for beside, target in m.moved if m else ():
                system.move(beside, target)

    def abort(self, messages):
        system, _ = opened(self.path)
        for m in messages:
            for beside, _ in m.moved if m else ():
                system.delete_file(beside)


class TextFiles(DataSource):
    """``neumes_texts``: (name, text, path) of the files below ``path``, whole, and (name, text) as files of these names.

    ``pattern`` has one group that makes the name of a path; files that it doesn't find
    are left out, and equal names in a filter leave other files unread. As a sink,
    ``overwrite`` takes away all other files below ``path``; ``append`` leaves them. Of
    rows with one name any may be the one that stays; a null text is an empty file.
    """

    @classmethod
    def name(cls):
        return "neumes_texts"

    def schema(self):
        return "name string, text string, path string"

    def reader(self, schema):
        return TextReader(dict(self.options))

    def writer(self, schema, overwrite):
        return TextWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Both sources by their names; filters are pushed to sources in Python from here on in this session."""
    spark.dataSource.register(SplitFiles)
    spark.dataSource.register(TextFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

"""Dictionary files as a data source: ``spark.read.format("wordmill_articles")`` and the same for writing.

Reading gives file, file_no, place and line. ``file_no`` counts the files in their given
order, ``place`` is where a line begins in its file, in bytes: both together are the order
of a dictionary that is loaded file by file. Files are read in parts of ``split`` bytes,
each a partition; a line belongs to the part it begins in. Lines end with a line feed, a
carriage return before it goes off.

Options: ``path``, a file, a folder (its files by name, but for hidden ones) or several of
either set apart by line feeds; ``encoding``, any name of ``notation.CODE_PAGES`` or a
codec of Python's (what a page lacks is read as U+FFFD and written as a question mark);
``split``, at most so many bytes for a partition.

Writing takes the column ``line``. A task writes one file under a hidden name; the files
get their names when all tasks are done, and go away if one fails. A folder with files in
it is only written to in the modes append and overwrite.

Paths are those of pyarrow's file systems: local ones, which all executors must share, or
such as s3:// and hdfs://.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from wordmill.sources import lexicon
from wordmill.sources.notation import CODE_PAGES

NAME, SCHEMA = "wordmill_articles", "file string, file_no int, place long, line string"
SPLIT, BATCH = 32 << 20, 8192


def codec(name: str) -> str:
    return CODE_PAGES.get(name.lower(), name)


def _files(path: str):
    """(file system, path, size) of the files of a path, in order."""
    from pyarrow import fs

    for one in filter(None, path.split("\n")):
        system, at = fs.FileSystem.from_uri(one) if "://" in one or one.startswith("file:") else (fs.LocalFileSystem(), one)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        inside = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
        for x in sorted(inside, key=lambda x: x.path):
            if x.type == fs.FileType.File and (info.type == fs.FileType.File or not x.base_name.startswith((".", "_"))):
                yield system, x.path, x.size


@dataclass
class Part(InputPartition):
    uri: str
    path: str
    file_no: int
    first: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Articles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options), schema, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.page = options["path"], codec(options.get("encoding", "utf-8"))
        # two-byte code pages can't be cut at line feeds
        self.split = int(options.get("split", SPLIT)) if self.page != "utf-16" else 1 << 62

    def partitions(self) -> list[Part]:
        out = []
        for n, (_, path, size) in enumerate(_files(self.path)):
            out += [Part(self.path, path, n, at, min(size, at + self.split)) for at in range(0, size, self.split)]
        return out or [Part(self.path, "", -1, 0, 0)]

    def read(self, part: Part) -> Iterator:
        import pyarrow as pa

        rows: list[tuple[int, str]] = []

        def batch():
            columns = [[part.path] * len(rows), [part.file_no] * len(rows), [at for at, _ in rows], [line for _, line in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()))], ["file", "file_no", "place", "line"])

        for at, line in self._lines(part):
            rows.append((at, line))
            if len(rows) == BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()

    def _lines(self, part: Part) -> Iterator[tuple[int, str]]:
        if part.file_no < 0:
            return
        system = next(s for s, p, _ in _files(self.path) if p == part.path)
        with system.open_input_file(part.path) as f:
            if self.page == "utf-16":
                at = 2  # behind the mark of byte order
                for line in f.read().decode("utf-16", "replace").split("\n"):
                    yield at, line.removesuffix("\r")
                    at += len((line + "\n").encode("utf-16-le", "surrogatepass"))
                return
            at = max(0, part.first - 1)
            f.seek(at)
            for n, data in enumerate(_cut_lines(f)):
                if at >= part.end:
                    return
                if n or not part.first:  # the first line from the byte before a part on begins before it
                    yield at, data.removesuffix(b"\n").removesuffix(b"\r").decode(self.page, "replace")
                at += len(data)


def _cut_lines(f, step: int = 1 << 18) -> Iterator[bytes]:
    """The lines from where a file stands, with their line feeds; the last one may have none. Every byte is read once."""
    begun: list[bytes] = []
    while data := f.read(step):
        first, *more = data.split(b"\n")
        begun.append(first)
        if more:
            yield b"".join(begun) + b"\n"
            yield from (x + b"\n" for x in more[:-1])
            begun = [more[-1]]
    if last := b"".join(begun):
        yield last


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.page, self.overwrite = options["path"], codec(options.get("encoding", "utf-8")), overwrite
        if "line" not in schema.names:
            raise ValueError("what is written has no column line")
        self.mark = uuid.uuid4().hex[:8]

    def _folder(self):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, at.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        path = f"{folder}/.{self.mark}-{task.partitionId():05d}-{task.taskAttemptId()}"
        with system.open_output_stream(path) as f:
            if self.page == "utf-16":
                f.write(b"\xff\xfe")
            page = "utf-16-le" if self.page == "utf-16" else self.page
            for row in rows:
                f.write(((row["line"] or "") + "\n").encode(page, "replace"))
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(folder)):
                if x.type == fs.FileType.File and not x.base_name.startswith(f".{self.mark}"):
                    system.delete_file(x.path)
        kept = {m.path for m in messages if m}
        for i, path in enumerate(sorted(kept)):
            system.move(path, f"{folder}/part-{self.mark}-{i:05d}.dic")
        self._swept(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = self._folder()
        self._swept(system, folder)

    def _swept(self, system, folder: str) -> None:
        """Files of tasks that failed or ran twice go."""
        from pyarrow import fs

        for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith(f".{self.mark}"):
                system.delete_file(x.path)


_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or, where that is unset and all is on one machine, in one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="wordmill-files-"))
            atexit.register(shutil.rmtree, _own[0], True)
        named = _own[0]
    return f"{named.rstrip('/')}/articles-{uuid.uuid4().hex}"


def written(table: DataFrame) -> DataFrame:
    """The same rows, written once to a folder of ``scratch``, so that plans that use them several times don't make them again."""
    path = scratch(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Articles)
    return spark


def article_lines(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """file, file_no, place, line of dictionary files."""
    path = paths if isinstance(paths, str) else "\n".join(paths)
    return registered(spark).read.format(NAME).option("encoding", encoding).option("path", path).load()


def load(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8", rejects_to: str | None = None) -> DataFrame:
    """file, file_no, place and the columns of articles of dictionary files; what is no article is written to ``rejects_to`` in their code page."""
    lines = article_lines(spark, paths, encoding)
    parsed = lexicon.parse(lines, "file", "file_no", "place")
    if rejects_to is not None:
        parsed.where("reject is not null and reject <> 'blank'").select("line").write.format(NAME).option("encoding", encoding).mode("overwrite").save(rejects_to)
    return parsed.where("reject is null").drop("line", "reject")


def save(lines: DataFrame, path: str, encoding: str = "utf-8", mode: str = "append") -> None:
    """Writes ``line`` of a table as dictionary files."""
    registered(lines.sparkSession)
    lines.select("line").write.format(NAME).option("encoding", encoding).mode(mode).save(path)

"""Files of raw frames as a table, and tables of bytes as files: two data sources for Spark.

``raw_frames`` reads folders of files that hold frames of one size end to end, 8-bit RGB, as a decoder gives them. A file
is read in ranges of frames, each by a task. ``read_frames`` takes the frames wanted, so that no others are read. Conditions on
``frame`` and ``name`` narrow the ranges of ``raw_frames_pushed``, which needs spark.sql.python.filterPushdown.enabled. Spark 4.1
keeps what was pushed with the table that it has loaded, so such a table has to be loaded anew for each condition.

``byte_files`` writes rows (name, piece, content): the pieces of a name, in order, become one file. Tasks write below a folder
of the job's own; the files are moved to their places when all tasks have ended well, and the folder goes in any case, so a
failed or cancelled job, or a task run twice, leaves nothing.

Paths are local or of a file system that pyarrow opens (file:, hdfs:, s3:, gs:); on a cluster they have to be shared.

Defined results: a last frame that is short is dropped; a file shorter than a frame has no rows; other files than those with
the suffix are not read, nor those whose names begin with a dot or underscore; a null content is no bytes; a null name, or one
that leaves the folder, is an error before anything is moved; an existing file of the name is replaced.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Bytes of frames that a task reads about, and that it hands on at once.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SUFFIX = ".rgb"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the driver and all executors see it: below ``spark.checkpoint.dir``, or in local mode the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass
class Range(InputPartition):
    """Frames of one file from ``first`` up to, but not with, ``end``."""

    path: str
    name: str
    first: int
    end: int


class RawFrames(DataSource):
    """Options: path, width, height; optionally first, end (frames from and up to), only (a name), suffix and rangebytes."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return "name string, frame long, pixels binary"

    def reader(self, schema: StructType) -> RawReader:
        return RawReader(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options["width"]) * int(options["height"]) * 3
        if self.size <= 0:
            raise ValueError("frames need a width and a height")
        self.suffix = options.get("suffix", SUFFIX)
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.first = max(0, int(options.get("first", 0)))
        self.end = int(options["end"]) if "end" in options else None
        self.only = options.get("only")

    def partitions(self) -> list[Range]:
        system, root = opened(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, allow_not_found=False, recursive=True))
        out, step = [], max(1, self.range // self.size)
        for f in sorted(files, key=lambda f: f.path):
            name = f.base_name.removesuffix(self.suffix)
            inner = f.path[len(root) :].strip("/").split("/")
            if f.type != fs.FileType.File or not f.base_name.endswith(self.suffix) or any(p[:1] in ("_", ".") for p in inner) or self.only not in (None, name):
                continue
            end = f.size // self.size if self.end is None else min(self.end, f.size // self.size)
            out += [Range(f.path, name, k, min(k + step, end)) for k in range(self.first, end, step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = opened(self.path)
        step = max(1, BATCH_BYTES // self.size)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.first * self.size)
            for k in range(partition.first, partition.end, step):
                n = min(step, partition.end - k)
                data = f.read(n * self.size)
                pixels = [data[i * self.size : (i + 1) * self.size] for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.name] * n), pa.array(range(k, k + n), pa.int64()), pa.array(pixels, pa.binary())], names=["name", "frame", "pixels"]
                )


class PushingReader(RawReader):
    """Narrows the ranges by the conditions that Spark hands it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("name",) and isinstance(f, EqualTo) and self.only in (None, value):
                self.only = value
            elif column == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self._until(value + 1)
            elif column == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self._until(value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _until(self, end: int) -> None:
        self.end = end if self.end is None else min(self.end, end)


class PushedFrames(RawFrames):
    @classmethod
    def name(cls) -> str:
        return "raw_frames_pushed"

    def reader(self, schema: StructType) -> PushingReader:
        return PushingReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ByteFiles(DataSource):
    """Options: path, the folder."""

    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def writer(self, schema: StructType, overwrite: bool) -> ByteWriter:
        return ByteWriter(self.options["path"])


def _below(name: str | None) -> str:
    path = posixpath.normpath(name or "")
    if path in ("", ".") or path.startswith(("/", "..")):
        raise ValueError(f"not a name of a file below the folder: {name!r}")
    return path


class ByteWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"  # a task that runs again writes to another one
        system.create_dir(folder, recursive=True)
        out, name, files = None, None, []
        try:
            for batch in iterator:
                for now, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                    if out is None or now != name:
                        if out is not None:
                            out.close()
                        name, temporary = now, f"{folder}/{len(files)}"
                        files.append((temporary, _below(now)))
                        out = system.open_output_stream(temporary)
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for temporary, name in (f for m in messages if m for f in m.files):
            system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            system.move(temporary, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


def register(spark: SparkSession) -> SparkSession:
    """Make the sources known to a session."""
    spark.dataSource.register(RawFrames)
    spark.dataSource.register(PushedFrames)
    spark.dataSource.register(ByteFiles)
    return spark


def read_frames(spark: SparkSession, path: str, width: int, height: int, **options) -> DataFrame:
    """(name, frame, pixels) of the raw files below a folder; a name is a file's without its suffix. Options as of ``RawFrames``."""
    options = {k: str(v) for k, v in options.items()}
    return register(spark).read.format("raw_frames").options(width=str(width), height=str(height), **options).load(path)


def write_files(spark: SparkSession, rows: DataFrame, path: str, name: str = "name", content: str = "content", piece: str | None = None) -> None:
    """A file for each name, of its pieces in order. The pieces of a name are dealt to one task and sorted, not held."""
    register(spark)
    order = [F.col(piece)] if piece else []
    rows = rows.select(F.col(name).cast("string").alias("name"), *[o.alias("piece") for o in order], F.col(content).cast("binary").alias("content"))
    rows = rows.repartition("name").sortWithinPartitions("name", *(["piece"] if piece else []))
    rows.select("name", "content").write.format("byte_files").mode("append").save(path)

"""Sinks: envelope rows as files of any format."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import value as V
from ..codecs import encoder
from ..errors import FormatError
from ..shared import bound_batches

EXTENSIONS = {"json": "json", "csv": "csv", "raw": "txt", "avro": "avro", "cbor": "cbor", "messagepack": "msgpack", "toml": "toml", "yaml": "yaml"}


@dataclass
class Written(WriterCommitMessage):
    task: int
    aside: str | None


def as_uri(path: str) -> str:
    return re.sub("^file:/(?!/)", "file:///", path) if re.match("[a-z0-9]+:/", path) else Path(path).resolve().as_uri()


def file_system(uri: str):
    """The file system and plain path of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class RecordWriter(DataSourceArrowWriter):
    """A file for each task, written aside and named when the job commits: an attempt that fails leaves nothing behind."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.fmt, self.path = options["recordformat"], options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def encode(self, values):
        keys = {"schema": "schema", "codec": "codec", "style": "style", "byte_strings": "bytestrings"}
        return encoder(self.fmt, {k: self.options[o] for k, o in keys.items() if o in self.options})(values)

    def write(self, batches) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = file_system(self.path)
        aside = f"{path}/_aside-{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        fs.create_dir(f"{path}/_aside-{self.job}", recursive=True)
        n = 0

        def values():
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                yield from map(V.from_envelope, batch.column("value").to_pylist())

        with fs.open_output_stream(aside) as out:
            for piece in self.encode(values()):
                out.write(piece)
        return Written(context.partitionId(), aside if n else None)

    def commit(self, messages) -> None:
        fs, path = file_system(self.path)
        old = []
        if self.overwrite:
            from pyarrow.fs import FileSelector

            old = [info.path for info in fs.get_file_info(FileSelector(path, allow_not_found=True)) if info.base_name.startswith("part-")]
        done = sorted((m.task, m.aside) for m in messages if m and m.aside)
        for k, (_, aside) in enumerate(done):
            fs.move(aside, f"{path}/part-{k:05d}-{self.job[:8]}.{EXTENSIONS[self.fmt]}")
        fs.create_dir(path, recursive=True)
        for own in old:  # the new files are in place
            fs.delete_file(own)
        self.clear(fs, path)

    def abort(self, messages) -> None:
        self.clear(*file_system(self.path))

    def clear(self, fs, path: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{path}/_aside-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{path}/_aside-{self.job}")


class RecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordloom"

    def schema(self) -> str:
        return "src string, pos long, value string"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def write_records(records: DataFrame, fmt: str, path: str, *, ordered: bool = True, mode: str = "append", **options) -> None:
    """Writes src, pos, value rows. With ordered, files in the order of their names hold the records by src and pos.

    A value that the format can't hold fails the job, and no file of it is left: Spark can't keep what came before an error.
    """
    if fmt not in EXTENSIONS:
        encoder(fmt, options)
        raise FormatError(f"no file name for {fmt}")
    encoder(fmt, options)  # bad options fail here
    if ordered:
        records = records.orderBy("src", "pos")
    bound_batches(records.sparkSession)
    records.sparkSession.dataSource.register(RecordSink)
    names = {"byte_strings": "bytestrings"}
    given = {names.get(k, k): str(v) for k, v in options.items() if v not in (None, False)}
    records.select("src", "pos", "value").write.format("recordloom").mode(mode).options(recordformat=fmt, path=as_uri(path), **given).save()

"""Act documents in bundles: a source, a stream and a sink of files that hold many responses of the register of acts.

    spark.dataSource.register(ActBundles)
    spark.read.format("act_bundles").load(folder)         # act_id, kind, body, file, place
    spark.readStream.format("act_bundles").load(folder)
    frame.write.format("act_bundles").mode("append").save(folder)

A record is a separator byte, a header of one line (JSON: act_id, kind) and the body as it came, which may be malformed.
The separator can stand in no header and is escaped in bodies, so that files can be read from any place on: a task reads a
range of a file, starts at the first separator in it, and owns the records that begin inside its range. Ranges are of
about `range_bytes` (an option), whatever the sizes of files, and longer where there would be more than a thousand: a task costs
about a tenth of a second before it reads. Null bodies stay null; a header that can't be read gives a row
without act_id and kind, and its whole record as the body.

The sink writes each task's file aside and moves the files of a finished job into place; those of a failed job go. Files are
named in the order of jobs, and a stream takes files by name: each batch those after the last one it has seen.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

SEPARATOR, ESCAPE = b"\x1e", b"\x1f"
RANGE_BYTES, CHUNK = 32 << 20, 1 << 20
RANGES = 1000
ROWS, WRITTEN_ROWS = 500, 2000
SCHEMA = "act_id long, kind string, body string, file string, place long"


def _unescaped(body: bytes) -> bytes:
    return body.replace(ESCAPE + b"S", SEPARATOR).replace(ESCAPE + b"E", ESCAPE) if ESCAPE in body else body


def written(batch: pa.RecordBatch) -> pa.Buffer:
    """The records of a batch's rows one after another, put together by column."""
    large = pa.large_string()
    kind, body = batch.column("kind"), batch.column("body").cast(large)
    kinds = {k: json.dumps(k) for k in [*pc.unique(kind).to_pylist(), None]}
    said = pc.take(pa.array(kinds.values(), large), pc.index_in(kind, value_set=pa.array(kinds.keys(), kind.type)))
    act = pc.fill_null(batch.column("act_id").cast(pa.int64()).cast(large), "null")
    for mark, instead in ((ESCAPE, ESCAPE + b"E"), (SEPARATOR, ESCAPE + b"S")):
        body = pc.replace_substring(body, mark.decode(), instead.decode())
    end = pc.if_else(body.is_null(), pa.scalar(', "none": true}\n', large), pa.scalar("}\n", large))
    parts = [SEPARATOR.decode() + '{"act_id": ', act, ', "kind": ', said, end, pc.fill_null(body, ""), "\n"]
    whole = pc.binary_join_element_wise(*[pa.scalar(p, large) if isinstance(p, str) else p for p in parts], pa.scalar("", large))
    begin, end_of = (int.from_bytes(whole.buffers()[1][8 * i : 8 * i + 8].to_pybytes(), "little") for i in (whole.offset, whole.offset + len(whole)))
    return whole.buffers()[2].slice(begin, end_of - begin)


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def bundle_files(folder: str) -> list[tuple[str, int]]:
    """(name, size) of the bundles in place, by name."""
    from pyarrow import fs

    store, root = _opened(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".acts"))


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int


def ranges(files: list[tuple[str, int]], range_bytes: int) -> list[Range]:
    step = max(range_bytes, -(-sum(size for _, size in files) // RANGES))
    return [Range(name, at, min(at + step, size)) for name, size in files for at in range(0, size, step)]


def records(folder: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, record without its separator) of the records that begin in the range."""
    store, root = _opened(folder)
    with store.open_input_file(f"{root}/{part.name}") as source:
        source.seek(part.start)
        at, buffer, begun = part.start, b"", False
        while True:
            chunk = source.read(CHUNK)
            buffer += chunk
            cuts = buffer.split(SEPARATOR)
            if not chunk:
                cuts.append(b"")
            for cut in cuts[:-1]:
                if begun:
                    yield at - 1, cut
                at, begun = at + len(cut) + 1, True
                if at - 1 >= part.end:  # the next record begins beyond the range
                    return
            buffer = cuts[-1]
            if not chunk:
                return


def row_of(record: bytes) -> tuple[int | None, str | None, str | None]:
    head, _, body = record.partition(b"\n")
    try:
        said = json.loads(head)
        text = None if said.get("none") else _unescaped(body.removesuffix(b"\n")).decode("utf-8", "replace")
        return said["act_id"], said["kind"], text
    except (ValueError, KeyError, AttributeError):
        return None, None, record.decode("utf-8", "replace")


def _batches(folder: str, part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def made() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["act_id", "kind", "body", "file", "place"])

    size = 0
    for place, record in records(folder, part):
        rows.append((*row_of(record), part.name, place))
        size += len(record)
        if len(rows) >= ROWS or size >= 4 * CHUNK:
            yield made()
            rows.clear()
            size = 0
    if rows:
        yield made()


class Reader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        return ranges(bundle_files(self.folder), self.range_bytes) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.folder, partition) if partition.name else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((name for name, _ in bundle_files(self.folder)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges([f for f in bundle_files(self.folder) if start["after"] < f[0] <= end["after"]], self.range_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.folder, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.job = f"{time.time_ns():020}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.folder)
        store.create_dir(f"{root}/_aside-{self.job}", recursive=True)
        name, out = f"{uuid.uuid4().hex}.acts", None
        for batch in iterator:
            for at in range(0, batch.num_rows, WRITTEN_ROWS):
                if out is None:
                    out = store.open_output_stream(f"{root}/_aside-{self.job}/{name}")
                out.write(written(batch.slice(at, WRITTEN_ROWS)))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.folder)
        for k, message in enumerate(m for m in messages if m and m.name):
            store.move(f"{root}/_aside-{self.job}/{message.name}", f"{root}/{self.job}-{k:06}.acts")
        self._cleared(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared(*_opened(self.folder))

    def _cleared(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_aside-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_aside-{self.job}")


class ActBundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "act_bundles"

    def schema(self) -> str:
        return SCHEMA

    def _place(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES))

    def reader(self, schema) -> Reader:
        return Reader(*self._place())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._place())

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("bundles are only added")
        return Writer(self._place()[0])

"""Scan files: tagged binary images of the public medical imaging standard, little endian and uncompressed, as a Spark data source.

`read_scans` gives a row a file. If `pixels` isn't among the asked columns, a file is read only as far as its header goes, so the source prunes what is by far the most of it. The driver lists
the entries of the folder itself (series, studies or archives), and tasks list what is below them. `write_scans` writes a file a row, or packs the files into tar archives; files of an archive (*.tar) are
read as if they lay in its folder, and an archive that can't be read is an error.

A file whose header can't be read has readable = false and nulls; one whose samples can't be decoded (compressed, cut, several samples a pixel, no number as its slope) has null pixels. Hidden files
are left out. A missing folder is an empty one.
"""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER = "path string, readable boolean, description string, body_part string, image_side string, side string, instance double, position array<double>, orientation array<double>, rows int, columns int, frames int"
SLICES = HEADER + ", pixels array<float>"
#: Entries of the folder that a task lists and reads, files read before a batch is passed on, and bytes read at once of a header.
ENTRIES, FILES, CHUNK = 64, 32, 1 << 14
#: Files and bytes of an archive, which one task reads.
PACKED, ARCHIVE = 16_384, 64 << 20

#: The standard's tags.
TAGS = {
    "syntax": 0x00020010,
    "description": 0x0008103E,
    "body_part": 0x00180015,
    "instance": 0x00200013,
    "position": 0x00200032,
    "orientation": 0x00200037,
    "side": 0x00200060,
    "image_side": 0x00200062,
    "samples": 0x00280002,
    "photometric": 0x00280004,
    "frames": 0x00280008,
    "rows": 0x00280010,
    "columns": 0x00280011,
    "bits": 0x00280100,
    "stored_bits": 0x00280101,
    "high_bit": 0x00280102,
    "signed": 0x00280103,
    "intercept": 0x00281052,
    "slope": 0x00281053,
    "pixels": 0x7FE00010,
}
NAMES = {tag: name for name, tag in TAGS.items()}
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
UNDEFINED = 0xFFFFFFFF
KINDS = {"samples": "US", "rows": "US", "columns": "US", "bits": "US", "stored_bits": "US", "high_bit": "US", "signed": "US", "frames": "IS", "instance": "IS", "position": "DS", "orientation": "DS", "intercept": "DS", "slope": "DS", "photometric": "CS", "side": "CS", "image_side": "CS", "body_part": "CS", "description": "LO", "pixels": "OW"}


class Damaged(ValueError):
    pass


class _Stream:
    """Bytes of a file, read in chunks as they are asked for."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = self.file.read(max(CHUNK, n - len(self.held) + self.at))
            if not more:
                raise Damaged("the file ends early")
            self.held, self.at = self.held[self.at :] + more, 0
        self.at += n
        return self.held[self.at - n : self.at]

    def peek(self, n: int) -> bytes:
        got = self.take(n)
        self.at -= n
        return got

    def ended(self) -> bool:
        try:
            self.peek(1)
        except Damaged:
            return True
        return False


def _head(s: _Stream, explicit: bool) -> tuple[int, int]:
    """(tag, length) of the next element."""
    group, element = struct.unpack("<HH", s.take(4))
    tag = group << 16 | element
    if not explicit or group == 0xFFFE:
        return tag, struct.unpack("<I", s.take(4))[0]
    if (kind := s.take(2)) in LONG:
        return tag, struct.unpack("<2xI", s.take(6))[0]
    if not kind.isalpha():
        raise Damaged("no value representation")
    return tag, struct.unpack("<H", s.take(2))[0]


def _skip(s: _Stream, explicit: bool) -> None:
    """Over a sequence of undefined length, and those inside it."""
    while True:
        tag, length = _head(s, explicit)
        if tag == SEQUENCE_END:
            return
        if tag != ITEM:
            raise Damaged("no item in a sequence")
        if length != UNDEFINED:
            s.take(length)
            continue
        while True:
            tag, length = _head(s, explicit)
            if tag == ITEM_END:
                break
            _skip(s, explicit) if length == UNDEFINED else s.take(length)


def parse(file, with_pixels: bool) -> dict:
    """The named elements of a file as bytes. Without pixels it stops where they begin."""
    s, out, syntax = _Stream(file), {}, None
    try:
        marked = s.peek(132)[128:] == b"DICM"
    except Damaged:
        marked = False
    if marked:
        s.take(132)
        while struct.unpack("<H", s.peek(2))[0] == 2:
            tag, length = _head(s, True)
            value = s.take(length)
            if tag == TAGS["syntax"]:
                syntax = value.rstrip(b"\0 ").decode("ascii")
        explicit = syntax != IMPLICIT
    else:
        explicit = s.peek(6)[4:].isalpha()
    last = -1
    while not s.ended():
        tag, length = _head(s, explicit)
        if tag <= last:
            raise Damaged("tags out of order")
        last, name = tag, NAMES.get(tag)
        if tag >= TAGS["pixels"] and not with_pixels:
            break
        if length == UNDEFINED:
            if name == "pixels":  # compressed frames
                break
            _skip(s, explicit)
        elif name:
            out[name] = s.take(length)
        else:
            s.take(length)
    if not out:
        raise Damaged("none of the tags")
    out["_plain"] = syntax in (None, IMPLICIT, EXPLICIT)
    return out


def _text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace").strip("\0 ") or None


def _numbers(raw: bytes | None) -> list[float] | None:
    try:
        return [float(x) for x in _text(raw).split("\\")] if _text(raw) else None
    except ValueError:
        return None


def _short(raw: bytes | None) -> int | None:
    return struct.unpack("<H", raw[:2])[0] if raw and len(raw) >= 2 else None


def header_of(found: dict) -> dict:
    number = lambda n: (_numbers(found.get(n)) or [None])[0]
    out = {n: _text(found.get(n)) for n in ("description", "body_part", "image_side", "side")}
    out |= {n: _numbers(found.get(n)) for n in ("position", "orientation")}
    return out | {"instance": number("instance"), "rows": _short(found.get("rows")), "columns": _short(found.get("columns")), "frames": int(number("frames") or 1)}


def pixels_of(found: dict) -> np.ndarray | None:
    """The middle frame: inverted if small values are bright, then times slope (1 if it is 0 or empty) plus intercept; None if it can't be decoded."""
    rows, columns, bits = (_short(found.get(n)) for n in ("rows", "columns", "bits"))
    if not rows or not columns or bits not in (8, 16, 32) or (_short(found.get("samples")) or 1) != 1 or not found["_plain"] or "pixels" not in found:
        return None
    kind = np.dtype(f"<{'i' if _short(found.get('signed')) else 'u'}{bits // 8}")
    frames = max(1, int((_numbers(found.get("frames")) or [1])[0]))
    size = rows * columns
    if len(found["pixels"]) < size * frames * kind.itemsize:
        return None
    if any(_text(found.get(n)) and _numbers(found.get(n)) is None for n in ("slope", "intercept")):
        return None
    frame = np.frombuffer(found["pixels"], kind, size, frames // 2 * size * kind.itemsize).astype(np.float32)
    if _text(found.get("photometric")) == "MONOCHROME1":
        frame = frame.max() - frame
    slope, intercept = ((_numbers(found.get(n)) or [0.0])[0] for n in ("slope", "intercept"))
    return frame * np.float32(slope or 1.0) + np.float32(intercept)


def read_file(open_file, path: str, with_pixels: bool) -> dict:
    """A row of SLICES (or of HEADER)."""
    try:
        with open_file() as f:
            found = parse(f, with_pixels)
        row = {"path": path, "readable": True} | header_of(found)
        if with_pixels:
            row["pixels"] = pixels_of(found)
    except (Damaged, UnicodeDecodeError, struct.error):
        return {"path": path, "readable": False}
    return row


class _Entries(InputPartition):
    def __init__(self, paths: list[tuple[str, bool]]):
        super().__init__(paths)
        self.paths = paths


def _packed(path: str, is_folder: bool = False) -> bool:
    return path.endswith(".tar") and not is_folder


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ScanReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder.rstrip("/"), schema
        self.wanted = [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        entries = sorted((f.path, f.type == fs.FileType.Directory) for f in found if not f.base_name.startswith("."))
        archives = [e for e in entries if _packed(*e)]
        entries = [e for e in entries if not _packed(*e)]
        return [_Entries([e]) for e in archives] + [_Entries(entries[k : k + ENTRIES]) for k in range(0, len(entries), ENTRIES)] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, base = _store(self.folder)
        schema, rows = to_arrow_schema(self.schema), []
        for path, open_file in self._opened(store, partition.paths):
            # the path as its folder was named, so that rows can be joined to what names them
            name = self.folder + path.removeprefix(base.rstrip("/"))
            rows.append(read_file(open_file, name, "pixels" in self.wanted))
            if len(rows) == FILES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _opened(self, store, entries: list[tuple[str, bool]]) -> Iterator[tuple[str, Callable]]:
        """The path of each file, and what opens it, to be used before the next is asked for."""
        for path in self._files(store, entries):
            if not _packed(path):
                yield path, lambda p=path: store.open_input_stream(p)
                continue
            with io.BufferedReader(store.open_input_file(path), 1 << 20) as f, tarfile.open(fileobj=f, mode="r:") as archive:
                while (member := archive.next()) is not None:
                    # the archive keeps all members that it has seen, which nothing asks for again
                    archive.members.clear()
                    if member.isfile() and not member.name.rsplit("/", 1)[-1].startswith("."):
                        yield f"{path.rsplit('/', 1)[0]}/{member.name}", lambda m=member, a=archive: a.extractfile(m)

    def _files(self, store, entries: list[tuple[str, bool]]) -> Iterator[str]:
        from pyarrow import fs

        for path, is_folder in entries:
            if not is_folder:
                yield path
                continue
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
            yield from sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith("."))


def _element(name: str, value: bytes, explicit: bool) -> bytes:
    """An element of even length."""
    tag, kind = TAGS[name], KINDS[name].encode()
    value += (b"\0" if kind in (b"OW", b"US") else b" ") * (len(value) % 2)
    place = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return place + struct.pack("<I", len(value)) + value
    return place + kind + (struct.pack("<2xI", len(value)) if kind in LONG else struct.pack("<H", len(value))) + value


def scan_bytes(row: dict, explicit: bool = True) -> bytes:
    """A file from the columns of HEADER, photometric, slope, intercept, and values: 16-bit samples of all frames, one after the other."""
    texts = {n: row.get(n) for n in ("description", "body_part", "image_side", "side", "photometric")}
    numbers = {n: row.get(n) for n in ("instance", "position", "orientation", "frames", "intercept", "slope")}
    fields = {n: v.encode() for n, v in texts.items() if v is not None}
    fields |= {n: "\\".join(f"{x:.15g}" for x in (v if isinstance(v, (list, tuple, np.ndarray)) else [v])).encode() for n, v in numbers.items() if v is not None}
    fields |= {n: struct.pack("<H", v) for n, v in {"samples": 1, "rows": row["rows"], "columns": row["columns"], "bits": 16, "stored_bits": 16, "high_bit": 15, "signed": 0}.items()}
    if row.get("values") is not None:
        fields["pixels"] = np.asarray(row["values"], "<u2").tobytes()
    body = b"".join(_element(n, fields[n], explicit) for n in sorted(fields, key=TAGS.__getitem__))
    syntax = (EXPLICIT if explicit else IMPLICIT).encode()
    syntax += b"\0" * (len(syntax) % 2)
    meta = struct.pack("<HH2sH", 2, 0x10, b"UI", len(syntax)) + syntax
    return b"\0" * 128 + b"DICM" + struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(meta)) + meta + body


class ScanWriter(DataSourceArrowWriter):
    """Each row goes to <folder>/<path>, under another name until it is whole; a task that runs again writes the same files."""

    def __init__(self, folder: str, explicit: bool):
        self.folder, self.explicit = folder.rstrip("/"), explicit

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _store(self.folder)
        made: set[str] = set()
        for b in iterator:
            for row in b.to_pylist():
                target = f"{base}/{row['path']}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(scan_bytes(row, self.explicit))
                store.move(part, target)
        return WriterCommitMessage()


@dataclass
class _Archives(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Tar archives of rows' files. They are hidden until the driver commits those of the tasks that count, so no row comes twice if a task runs again."""

    def __init__(self, folder: str, explicit: bool):
        self.folder, self.explicit = folder.rstrip("/"), explicit

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        names: list[str] = []
        rows = (row for b in iterator for row in b.to_pylist())
        row = next(rows, None)
        while row is not None:
            names.append(f"{uuid.uuid4().hex}.tar")
            with store.open_output_stream(f"{base}/.{names[-1]}", buffer_size=1 << 20) as f, tarfile.open(fileobj=f, mode="w|") as archive:
                files = size = 0
                while row is not None and files < PACKED and size < ARCHIVE:
                    content = scan_bytes(row, self.explicit)
                    entry = tarfile.TarInfo(row["path"])
                    entry.size = len(content)
                    archive.addfile(entry, io.BytesIO(content))
                    archive.members.clear()
                    files, size, row = files + 1, size + len(content), next(rows, None)
        return _Archives(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.folder)
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{base}/.{name}", f"{base}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.folder)
        for name in (n for m in messages if m is not None for n in m.names):
            store.delete_file(f"{base}/.{name}")


class ScanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema: StructType) -> ScanReader:
        return ScanReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        kind = ArchiveWriter if self.options.get("packed", "false") == "true" else ScanWriter
        return kind(self.options["path"], self.options.get("explicit", "true") == "true")


def read_scans(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of SLICES (all of them without names) of the files in and below a folder."""
    spark.dataSource.register(ScanSource)
    kinds = dict(c.strip().split(" ", 1) for c in SLICES.split(","))
    return spark.read.format("scan").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(folder)


def write_scans(rows: DataFrame, folder: str, explicit: bool = True, packed: bool = False) -> None:
    """Writes a file for each row: path (below the folder), the columns of HEADER that are there, photometric, slope, intercept and values (array of 16-bit samples). Packed files go into archives, which
    many small files should, as a folder of millions takes longer to make and list than to read."""
    rows.sparkSession.dataSource.register(ScanSource)
    rows.write.format("scan").option("explicit", str(explicit).lower()).option("packed", str(packed).lower()).mode("append").save(folder)


def decode(content: bytes, with_pixels: bool = True) -> dict:
    """A row of SLICES without its path, of a file's bytes."""
    row = read_file(lambda: io.BytesIO(content), "", with_pixels)
    row.pop("path")
    return row

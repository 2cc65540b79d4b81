"""Parts of files, read by the tasks that need them: zip directories, TIFF headers, first lines.

Files are opened through Arrow's file systems (local, HDFS and object stores) and read by ranges: a zip gives up its central
directory and a TIFF its first image directory, whatever the size of the file.
"""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag that holds the number of bands, and the sizes of the integer types a TIFF may state it in (fixed values).
_BANDS_TAG, _INTEGERS = 277, {3: "H", 4: "I", 16: "Q"}


def open_ranges(path: str):
    """A seekable stream over the file at ``path``, as Spark lists it: a plain path or a URI whose names are not escaped."""
    from pyarrow import fs

    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path)
    if scheme is None or scheme[1].lower() == "file":
        return fs.LocalFileSystem().open_input_file(re.sub(r"^(?i:file):/*", "/", path))
    system, name = fs.FileSystem.from_uri(quote(path, safe="/:@?=&+,~"))
    return system.open_input_file(name)


def zip_members(stream) -> list[str]:
    """Names in a zip archive; none for a file that is not one."""
    try:
        with zipfile.ZipFile(stream) as archive:
            return archive.namelist()
    except (zipfile.BadZipFile, OSError, ValueError):
        return []


def tiff_bands(stream) -> int | None:
    """Bands (samples per pixel) of the first image of a TIFF or BigTIFF; None for a file that is not one."""
    head = stream.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 16:
        return None
    kind = struct.unpack(order + "H", head[2:4])[0]
    if kind == 42:
        at, count, entry, value = struct.unpack(order + "I", head[4:8])[0], "H", "HHI4s", 4
    elif kind == 43:
        at, count, entry, value = struct.unpack(order + "Q", head[8:16])[0], "Q", "HHQ8s", 8
    else:
        return None
    stream.seek(at)
    raw = stream.read(struct.calcsize(order + count))
    if len(raw) < struct.calcsize(order + count):
        return None
    (entries,), size = struct.unpack(order + count, raw), struct.calcsize(order + entry)
    table = stream.read(entries * size)
    for k in range(len(table) // size):
        tag, form, _, held = struct.unpack(order + entry, table[k * size:(k + 1) * size])
        if tag == _BANDS_TAG and form in _INTEGERS:
            width = struct.calcsize(_INTEGERS[form])
            return struct.unpack(order + _INTEGERS[form], held[:width])[0] if width <= value else None
    return 1


def first_line(stream, block: int = 1 << 16) -> str:
    """The first line of a text file, without its line break."""
    line = b""
    while b"\n" not in line and (more := stream.read(block)):
        line += more
    return line.split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig", "replace")


def per_file(paths: DataFrame, read: Callable, column: str, kind: str, many: bool = False) -> DataFrame:
    """(path, ``column``): what ``read`` finds in the file of each path, one row per file or, with ``many``, per item.

    Files that cannot be opened give no item (``many``) or NULL. They are dealt out by path, so that one task does not open all.
    """
    types = {"string": pa.string(), "int": pa.int32()}

    def found(path: str):
        try:
            with open_ranges(path) as stream:
                return read(stream)
        except (OSError, ValueError):
            return [] if many else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                items = found(path) if many else [found(path)]
                yield pa.record_batch([pa.array([path] * len(items), pa.string()), pa.array(items, types[kind])], ["path", column])

    return paths.select("path").repartition(F.col("path")).mapInArrow(kernel, f"path string, {column} {kind}")

"""Header timestamps of MP4 files: a walk over boxes, for each file in the task that read it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Seconds from 1904 to 1970, fixed by the format.
EPOCH = 2_082_844_800
MOST_MOOV = 64 << 20
CONTAINERS = (b"trak", b"mdia")
TIMED = (b"mvhd", b"tkhd", b"mdhd")


def boxes(raw: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body from, body to): 32-bit and 64-bit sizes, and 0 for "to the end". A box that overruns ends the walk with an error."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} overruns its parent")
        yield kind, start + head, start + size
        start += size


def timestamps(moov: bytes) -> list[tuple[str, int, int]]:
    """(box, created, modified) of the headers in the body of a moov box, in seconds since 1904: ``mvhd``, ``trak[i].tkhd``, ``trak[i].mdia.mdhd``. Fields of versions 0 and 1; a header of
    any other version is left out."""
    out: list[tuple[str, int, int]] = []

    def walk(start: int, end: int, path: str) -> None:
        tracks = 0
        for kind, a, b in boxes(moov, start, end):
            name = kind.decode("latin-1")
            if kind == b"trak":
                name, tracks = f"trak[{tracks}]", tracks + 1
            if kind in CONTAINERS:
                walk(a, b, f"{path}{name}.")
            elif kind in TIMED and b > a and moov[a] in (0, 1):
                wide = moov[a] == 1
                if b - a < (20 if wide else 12):
                    raise ValueError("a header is cut off")
                out.append((path + name, *struct.unpack_from(">QQ" if wide else ">II", moov, a + 4)))

    walk(0, len(moov), "")
    return out


def moov_body(file, size: int) -> bytes:
    """The body of the moov box of an open file, found by stepping from header to header: what lies between, the media, isn't read. Its size is looked at before it is read."""
    at = 0
    while at + 8 <= size:
        file.seek(at)
        head = file.read(16)
        length, kind = struct.unpack_from(">I4s", head)
        skip = 8
        if length == 1:
            if len(head) < 16:
                raise ValueError("a box header is cut off")
            length, skip = struct.unpack_from(">Q", head, 8)[0], 16
        elif length == 0:
            length = size - at
        if length < skip or at + length > size:
            raise ValueError(f"box {kind!r} overruns the file")
        if kind == b"moov":
            if length - skip > MOST_MOOV:
                raise ValueError("moov is too large")
            file.seek(at + skip)
            return file.read(length - skip)
        at += length
    raise ValueError("no moov box")


def header_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(path, box, created, modified, error); DECIMAL(20,0), as the format's 64 bits are unsigned. A file that can't be walked gives one row with its error.

    Spark lists the files; each is opened by the task that gets its row, through the file system that its path names, and of it only box headers and the moov box are read.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        from pyarrow import fs

        for frame in frames:
            rows: list[tuple] = []
            for p, size in zip(frame["path"], frame["length"], strict=True):
                try:
                    files, at = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
                    with files.open_input_file(at) as file:
                        rows += [(p, k, Decimal(c), Decimal(m), None) for k, c, m in timestamps(moov_body(file, size))]
                except (ValueError, struct.error, IndexError, OSError) as e:
                    rows.append((p, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "box", "created", "modified", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInPandas(read, "path string, box string, created decimal(20,0), modified decimal(20,0), error string")

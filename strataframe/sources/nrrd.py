"""NRRD images as a Spark data source: planes as rows, large files split over tasks, filters pushed into planning."""

from __future__ import annotations

import gzip
import math
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, plane long, n_planes long, shape array<long>, spacing array<double>, values array<double>"
#: Fixed values of the format: names of number types.
TYPES = {
    "signed char": "i1", "int8": "i1", "int8_t": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1",
    "short": "i2", "short int": "i2", "int16": "i2", "int16_t": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint16_t": "u2",
    "int": "i4", "signed int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "uint32_t": "u4",
    "longlong": "i8", "long long": "i8", "int64": "i8", "int64_t": "i8", "ulonglong": "u8", "unsigned long long": "u8", "uint64": "u8", "uint64_t": "u8",
    "float": "f4", "double": "f8",
}
#: Bytes of planes that a task reads of a file, about; a header is never longer than the second number.
SPLIT, HEADER = 64 << 20, 1 << 20


class Header(NamedTuple):
    start: int
    kind: np.dtype
    sizes: tuple[int, ...]  # the fastest axis first
    spacing: tuple[float, ...]
    packed: bool

    @property
    def planes(self) -> int:
        return self.sizes[-1]

    @property
    def plane_bytes(self) -> int:
        return math.prod(self.sizes[:-1]) * self.kind.itemsize


def parse_header(data: bytes) -> Header:
    """The header of a file whose values follow it; raw and gzip encodings are known."""
    end = data.find(b"\n\n")
    skip = 2
    if end < 0 or 0 <= data.find(b"\r\n\r\n") < end:
        end, skip = data.find(b"\r\n\r\n"), 4
    if not data.startswith(b"NRRD000") or end < 0:
        raise ValueError("not an NRRD file with its values attached")
    fields = {}
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        if not line.startswith("#") and ": " in line:
            name, value = line.split(": ", 1)
            fields[name.strip().lower()] = value.strip()
    if "data file" in fields or "datafile" in fields:
        raise ValueError("values in a file of their own aren't read")
    sizes = tuple(int(x) for x in fields["sizes"].split())
    if len(sizes) != int(fields["dimension"]) or not sizes or min(sizes) < 1:
        raise ValueError("sizes don't agree with the dimension")
    if fields["type"].lower() not in TYPES:
        raise ValueError(f"unknown type {fields['type']!r}")
    encoding = fields["encoding"].lower()
    if encoding not in ("raw", "gzip", "gz"):
        raise ValueError(f"unknown encoding {encoding!r}")
    kind = np.dtype(TYPES[fields["type"].lower()]).newbyteorder(">" if fields.get("endian", "little").lower() == "big" else "<")
    spacing = [1.0] * len(sizes)
    if "spacings" in fields:
        spacing = [1.0 if x.lower() == "nan" else float(x) for x in fields["spacings"].split()]
    elif "space directions" in fields:
        columns = fields["space directions"].replace(", ", ",").split()
        spacing = [1.0 if c.lower() == "none" else math.hypot(*(float(x) for x in c.strip("()").split(","))) for c in columns]
    return Header(end + skip, kind, sizes, tuple(spacing), encoding != "raw")


def write_nrrd(values: np.ndarray, spacing: Sequence[float] | None = None, packed: bool = False) -> bytes:
    """A file of an array of doubles, floats or whole numbers, the last axis the fastest."""
    name = next(n for n, code in TYPES.items() if np.dtype(code) == values.dtype.newbyteorder("="))
    lines = ["NRRD0004", f"type: {name}", f"dimension: {values.ndim}", f"sizes: {' '.join(map(str, values.shape[::-1]))}", f"encoding: {'gzip' if packed else 'raw'}", "endian: little"]
    lines.append(f"spacings: {' '.join(map(str, list(spacing or [1.0] * values.ndim)[::-1]))}")
    body = values.astype(values.dtype.newbyteorder("<")).tobytes()
    return "\n".join(lines).encode() + b"\n\n" + (gzip.compress(body) if packed else body)


class PlaneRange(InputPartition):
    def __init__(self, path: str, header: Header, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.header, self.first, self.last = path, header, first, last


def _files(path: str) -> list[tuple[pyarrow.fs.FileSystem, str]]:
    system, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pyarrow.fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    if info.type == pyarrow.fs.FileType.Directory:
        found = system.get_file_info(pyarrow.fs.FileSelector(place, recursive=True))
        return [(system, f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".nrrd")]
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(system, place)]


class NrrdReader(DataSourceReader):
    """Plans ranges of planes: of about ``split`` bytes in a raw file, the whole of a packed one."""

    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.low, self.high, self.only = 0, None, None

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for system, place in _files(self.path):
            if self.only is not None and self.only != place:
                continue
            with system.open_input_file(place) as f:
                header = parse_header(f.read(HEADER))
            low, high = self.low, header.planes - 1 if self.high is None else min(self.high, header.planes - 1)
            step = high - low + 1 if header.packed else max(1, self.split // max(header.plane_bytes, 1))
            out += [PlaneRange(place, header, a, min(a + step - 1, high)) for a in range(low, high + 1, max(step, 1))]
        return out or [PlaneRange("", Header(0, np.dtype("f8"), (0,), (1.0,), False), 0, -1)]

    def read(self, partition: PlaneRange) -> Iterator[pa.RecordBatch]:
        """One plane at a time: raw files are read from its place on, packed ones unpacked as a stream up to it."""
        h, kinds = partition.header, [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        if partition.last < partition.first:
            return
        system = _files(self.path)[0][0]
        with system.open_input_file(partition.path) as f:
            f.seek(h.start + (0 if h.packed else partition.first * h.plane_bytes))
            stream = _unpacked(f) if h.packed else None
            for plane in range(0 if h.packed else partition.first, partition.last + 1):
                data = stream.take(h.plane_bytes) if stream else f.read(h.plane_bytes)
                if len(data) < h.plane_bytes:
                    raise ValueError(f"{partition.path} ends within plane {plane}")
                if plane < partition.first:
                    continue
                values = np.frombuffer(data, h.kind).astype(float)
                row = [partition.path, plane, h.planes, list(h.sizes[:-1][::-1]), list(h.spacing[::-1]), values]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class FilteringReader(NrrdReader):
    """The same for sessions that hand filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the plane and an equal path choose what is planned and read at all."""
        for f in filters:
            value = getattr(f, "value", None)
            if f.__class__ is EqualTo and f.attribute == ("path",):
                self.only = value
            elif f.__class__ is EqualTo and f.attribute == ("plane",):
                self.low, self.high = max(self.low, value), value if self.high is None else min(self.high, value)
            elif f.__class__ in (GreaterThan, GreaterThanOrEqual) and f.attribute == ("plane",):
                self.low = max(self.low, value + (f.__class__ is GreaterThan))
            elif f.__class__ in (LessThan, LessThanOrEqual) and f.attribute == ("plane",):
                top = value - (f.__class__ is LessThan)
                self.high = top if self.high is None else min(self.high, top)
            yield f  # Spark tests them again: they only narrow what is read here


class _unpacked:  # noqa: N801
    """A gzip stream of which as many bytes are taken as asked for, so a file is never whole in memory."""

    def __init__(self, source):
        self.source, self.unpack, self.left = source, zlib.decompressobj(31), b""

    def take(self, n: int) -> bytes:
        parts, have = [self.left], len(self.left)
        while have < n:
            data = self.unpack.unconsumed_tail or self.source.read(1 << 20)
            if not data:
                break
            got = self.unpack.decompress(data, max(n - have, 1 << 16))
            parts.append(got)
            have += len(got)
        whole = b"".join(parts)
        self.left = whole[n:]
        return whole[:n]


class NrrdSource(DataSource):
    """``spark.read.format("nrrd").option("split", bytes).load(path)``: a row for each plane of each file.

    A plane is a slice along the slowest axis; ``shape`` is the plane's, in row-major order, ``spacing`` the whole
    image's.  With option ``filters`` bounds of the plane and an equal path choose what is planned, for which the
    session must set ``spark.sql.python.filterPushdown.enabled``.  Paths are those that pyarrow's file systems open: local and shared folders, HDFS, object stores."""

    @classmethod
    def name(cls) -> str:
        return "nrrd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteringReader if self.options.get("filters") == "true" else NrrdReader)(self.options)


def read_nrrd(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """All planes of the NRRD files in a folder, or of one file; filters are pushed down if the session does that."""
    spark.dataSource.register(NrrdSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("nrrd").option("split", str(split)).option("filters", filters).load(path)

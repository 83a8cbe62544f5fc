"""Array files (NPY, NPZ, NIfTI-1) as rows: shape, spacing and flat values."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, name string, shape array<int>, spacing array<double>, values array<double>, error string"
#: Fixed values of the NIfTI-1 format: codes of voxel types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def parse_nifti(data: bytes) -> tuple[np.ndarray, list[float]]:
    """Voxels, scaled as the header says, and spacing."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(f"{order}i", data[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(f"{order}8h", data[40:56])
    kind = struct.unpack(f"{order}h", data[70:72])[0]
    pixdim = struct.unpack(f"{order}8f", data[76:108])
    start, slope, inter = struct.unpack(f"{order}3f", data[108:120])
    shape = dim[1 : dim[0] + 1]
    voxels = np.frombuffer(data, np.dtype(NIFTI_TYPES[kind]).newbyteorder(order), int(np.prod(shape)), int(start)).reshape(shape, order="F")
    if slope not in (0.0, 1.0) or (slope == 1.0 and inter):
        voxels = voxels * slope + inter
    return voxels, [float(x) for x in pixdim[1 : dim[0] + 1]]


def write_nifti(values: np.ndarray, spacing: list[float]) -> bytes:
    """A single-file NIfTI-1 image of doubles."""
    n = values.ndim
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, n, *values.shape, *[1] * (7 - n))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, *[1.0] * (7 - n))
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\x00"
    return bytes(head) + values.astype("<f8").tobytes(order="F")


def _members(path: str, data: bytes) -> Iterator[tuple[str, np.ndarray, list[float] | None]]:
    if path.endswith((".nii", ".nii.gz")):
        yield "image", *parse_nifti(data)
    elif path.endswith(".npz"):
        with np.load(io.BytesIO(data), allow_pickle=False) as members:
            for name in members.files:
                yield name, members[name], None
    else:
        yield "array", np.load(io.BytesIO(data), allow_pickle=False), None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rows = [(path, name, list(v.shape), spacing or [1.0] * v.ndim, v.astype(float).ravel().tolist(), None) for name, v, spacing in _members(path, data)]
            except (ValueError, KeyError, struct.error, OSError) as e:
                rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
            for row in rows:  # one image at a time
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.{npy,npz,nii,nii.gz}") -> DataFrame:
    """One row for each array of each file, values in row-major order; a file that can't be read gives its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(_decoded, SCHEMA)

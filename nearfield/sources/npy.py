"""NumPy array files: read as rows, written by no one here."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The first bytes of a file, and the element types that are read.
MAGIC = b"\x93NUMPY"
TYPES = {"<f4": "float", "<f8": "double", "<i4": "int", "<i8": "long", "|b1": "boolean"}


def parse_header(raw: bytes) -> tuple[str, tuple[int, ...], int]:
    """Element type, shape and the place of the data; an unfit file is an error."""
    if raw[:6] != MAGIC:
        raise ValueError("not an npy file")
    wide = raw[6] >= 2
    length, start = int.from_bytes(raw[8 : 12 if wide else 10], "little"), 12 if wide else 10
    head = ast.literal_eval(raw[start : start + length].decode("latin-1"))
    if head["descr"] not in TYPES:
        raise ValueError(f"element type {head['descr']} is not read; known: {', '.join(TYPES)}")
    if head["fortran_order"]:
        raise ValueError("arrays in Fortran order are not read")
    return head["descr"], head["shape"], start + length


def parse(raw: bytes) -> np.ndarray:
    descr, shape, start = parse_header(raw)
    kind = np.dtype(descr)
    want = int(np.prod(shape)) * kind.itemsize
    if len(raw) - start < want:
        raise ValueError("the file is cut off")
    return np.frombuffer(raw, kind, int(np.prod(shape)), start).reshape(shape)


def read_npy(spark: SparkSession, path: str, kind: str = "float", matrix: bool = True, limit: int | None = None, first_id: int = 0) -> DataFrame:
    """id (row number) and embedding, or value for arrays of one dimension, of one file."""
    if kind not in TYPES.values():
        raise ValueError(f"kind is one of {', '.join(TYPES.values())}")
    name, value = ("embedding", f"array<{kind}>") if matrix else ("value", kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"].to_pylist():
                array = parse(raw)
                if array.ndim != (2 if matrix else 1) or TYPES[array.dtype.str] != kind:
                    raise ValueError(f"the file has {array.ndim} dimensions of {array.dtype.str}")
                array = array[:limit]
                for at in range(0, len(array), 8192):
                    part = array[at : at + 8192]
                    ids = pa.array(np.arange(at, at + len(part)) + first_id)
                    if matrix:
                        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * array.shape[1])
                        values = pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))
                    else:
                        values = pa.array(part)
                    yield pa.RecordBatch.from_arrays([ids, values], names=["id", name])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, f"id long, {name} {value}")

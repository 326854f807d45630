"""What the operators of this subpackage share: tables, shared storage, word classes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.sources.scratch import discard, shared_dir
from nearfield.sources.scratch import written as materialise

__all__ = ["discard", "materialise", "partitions_for", "shared_dir", "slices", "table", "tidy", "words_column", "words_of"]

# The ASCII code points that separate words. All other code points are word characters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The same, one by one: Java looks single characters up in a table, but tries ranges in turn.
SEPARATOR_TABLE = "[" + "".join(f"\\x{i:02x}" for i in range(128) if not chr(i).isalnum()) + "]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Maps UTF-8 bytes to lower case (A-Z only) and each separator to a blank, so that ``split()`` gives the words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words_column(text: Column) -> Column:
    """Lower-cased words of a text, on the JVM; none for null. As in ``words_of``, only A-Z are lower-cased by force.

    ``lower`` changes other letters too, but the Kelvin sign is the only one that it turns into a letter of ASCII
    alone; words that differ in other letters are no words of ASCII before or after.
    """
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATOR_TABLE + "+"), "")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives unused memory back; workers stay for later tasks and stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some ``most`` bytes of text each."""
    n = np.array([x or 0 for x in pc.binary_length(batch[column]).to_pylist()])
    part = np.cumsum(n) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)

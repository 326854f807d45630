"""Document fingerprints by order MinHash.

A text's k-mers are runs of K words, each numbered by its occurrence in the text. For each of ``HASHES`` hash
functions the TUPLE k-mers of least hash are put in text order, and the tuple's hash is one component of the
fingerprint. Two texts agree in a component only if they share those k-mers in the same order, so the share of
equal components falls with edit distance, not only with the change of the set of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialise, partitions_for, slices, tidy
from nearfield.llm.hashing import kmers, mix, odd

K = 5
TUPLE = 2
HASHES = 64
BLANKS = bytes(range(33))
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)


def numbered(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes made distinct within a text by the number of the occurrence."""
    own = hashes + mix(np.repeat(np.arange(len(count), dtype=_U), count) + _U(1))
    order = np.sort(own)
    repeated = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(repeated):
        return hashes
    at = np.flatnonzero(np.isin(own, repeated))
    by = at[np.argsort(own[at], kind="stable")]
    new = np.concatenate(([True], own[by][1:] != own[by][:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    out = hashes.copy()
    out[by] += mix((np.arange(len(by)) - start).astype(_U)) * (np.arange(len(by)) > start).astype(_U)
    return out


def fingerprints(texts: list[str | None], k: int = K, size: int = HASHES) -> np.ndarray:
    """One row of ``size`` 16-bit components for each text; a text without words has zeros."""
    hashes, count = kmers(texts, k, BLANKS)
    out = np.zeros((len(texts), size), ">u2")
    rows = np.flatnonzero(count)
    if not len(rows):
        return out
    own = numbered(hashes, count)
    starts = (np.cumsum(count) - count)[rows]
    single = count[rows] < TUPLE
    place = np.arange(len(own), dtype=_U)
    high, low = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)
    for j, c in enumerate(odd(size, 11)):
        key = own * c
        key ^= key >> _U(29)
        key *= c
        key &= high
        key |= place
        a = (np.minimum.reduceat(key, starts) & low).astype(np.int64)
        key[a] = _MAX
        b = (np.minimum.reduceat(key, starts) & low).astype(np.int64)
        b = np.where(single, a, b)
        pair = mix(hashes[np.minimum(a, b)] * _U(3) + mix(hashes[np.maximum(a, b)]) + c)
        out[rows, j] = (pair >> _U(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, kind int, part int, text string"
)
_DONE, _OPEN, _HEAD = 0, 1, 2  # a finished row; the last row of a partition; the text of the first row of one
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]


def _compare(ids: list, texts: list[str], following: list[str], prints: np.ndarray, after: np.ndarray) -> list[list]:
    """Columns _ROW of some rows, with the texts that follow them."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new = fingerprints(changed)
    say = lambda x: [r.tobytes().hex() for r in x]
    shas = [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in changed]
    return [ids, [len(t) for t in texts], shas, say(prints), say(new), likeness(prints, new).tolist(), likeness(prints, after).tolist()]


def _batch(cols: list[list], kind: int, part: int, texts: list | None = None) -> pa.RecordBatch:
    n = len(cols[0])
    cols = [*cols, [kind] * n, [part] * n, texts or [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=[*_ROW, "kind", "part", "text"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the one after it, holding one row over."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None  # id, text and fingerprint of the row that waits for the next
    for batch in batches:
        for piece in slices(batch):
            ids, texts = piece["doc_id"].to_pylist(), [t or "" for t in piece["text"].to_pylist()]
            prints = fingerprints(texts)
            if held is None:
                yield _batch([[None], *[[None]] * 6], _HEAD, part, texts[:1])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], prints])
            if len(ids) > 1:
                yield _batch(_compare(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]), _DONE, part)
            held = ids[-1], texts[-1], prints[-1]
    if held is not None:
        yield _batch([[held[0]], *[[None]] * 6], _OPEN, part, [held[1]])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, following = (batch[c].to_pylist() for c in ("doc_id", "text", "following"))
        if ids:
            yield _batch(_compare(ids, texts, following, fingerprints(texts), fingerprints(following)), _DONE, 0)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row and of its edited text.

    Rows are taken by descending doc_id (null ids last; rows of equal id by their texts); the row after the
    last is the first. The table is range-partitioned, so each task sees neighbours; only one text for each
    end of a partition is matched afterwards. Null texts count as empty; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    found = materialise(rows.repartitionByRange(partitions_for(spark), order[0]).sortWithinPartitions(*order).mapInArrow(tidy(_walk), _SCHEMA))
    # One number for each partition that has rows.
    parts = sorted(r["part"] for r in found.where(F.col("kind") == _HEAD).select("part").collect())
    after = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, head int")
    heads = found.where(F.col("kind") == _HEAD).select(F.col("part").alias("head"), F.col("text").alias("following"))
    ends = found.where(F.col("kind") == _OPEN).select("doc_id", "part", "text")
    ends = ends.join(after, "part").join(heads, "head").select("doc_id", "text", "following").mapInArrow(tidy(_pairs), _SCHEMA)
    return found.where(F.col("kind") == _DONE).select(*_ROW).unionByName(ends.select(*_ROW))

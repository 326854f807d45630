"""Token ids in ORC files.

Rows lie in ascending doc_id order over the files. ORC encodes the ids of a stripe with integer run-length
encoding; row indexes and Bloom filters on doc_id let a reader skip stripes and row groups by their metadata,
and several tasks read the stripes of one file side by side.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import partitions_for, tidy

END_ID = 1
#: Words that a worker remembers the ids of.
CACHE_WORDS = 1_000_000
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}

# A part that is one word of Latin letters, which the tokenizer lower-cases, between marks, of which it keeps runs
# together. An apostrophe is no such mark: with letters after it, it is a piece of its own.
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(f"({_MARKS})([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)({_MARKS})")


def _is_whole(text: str) -> bool:
    """Whether ids of the parts between white space are not known to be the ids of the whole.

    Python splits at \\x1c-\\x1f, the tokenizer does not; special tokens can be followed by anything.
    """
    return "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


class WordEncoder:
    """Ids of whole texts, by way of their parts between white space.

    The tokenizer's own split never crosses white space, so ids of the parts, joined, are the ids of the text.
    Parts repeat, so each is encoded once and then remembered, as the bytes of its ids (little-endian, 32 bits).
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_each(self, parts: list[str]) -> None:
        for part, got in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.cache[part] = np.array(got.ids, "<u4").tobytes()

    def _learn(self, parts: set[str]) -> None:
        """Encode parts: plain words as one text, cut after the ids that end a word; what they build from them; others singly."""
        cache, plain, marks, rest = self.cache, [], {""}, []
        for part in parts:
            m = _PLAIN.fullmatch(part)
            if m:
                before, word, after = m.groups()
                plain.append((part, before, word.lower(), after))
                if before or after:
                    marks.update((before, after))
            else:
                rest.append(part)
        words = list({w for _, _, w, _ in plain if w not in cache})
        for at in range(0, len(words), 8192):
            chunk = words[at : at + 8192]
            texts = [" ".join(chunk[k : k + 512]) for k in range(0, len(chunk), 512)]
            ids = np.concatenate([np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(chunk):
                self._learn_each(chunk)
                continue
            raw, a = ids.tobytes(), 0
            for word, b in zip(chunk, cuts.tolist(), strict=True):
                self.cache[word] = raw[a:b]
                a = b
        self._learn_each(rest + [m for m in marks if m and m not in cache])
        of = {m: cache[m] if m else b"" for m in marks}
        for part, before, word, after in plain:
            cache[part] = of[before] + cache[word] + of[after]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known, out, waiting, new = self.cache, [], [], set()
        for t in texts:
            if t and _is_whole(t):
                out.append(self.whole(t))
                continue
            parts = (t or "").split()
            ids = list(map(known.get, parts))  # one look-up a part
            if None in ids:
                missing = [i for i, x in enumerate(ids) if x is None]
                new.update([parts[i] for i in missing])
                waiting.append((len(out), parts, ids, missing))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if new:
            if len(known) + len(new) > self.cache_words:
                known.clear()  # what these texts had of it is in ``waiting``
            self._learn(new)
        for at, parts, ids, missing in waiting:
            for i in missing:
                ids[i] = known[parts[i]]
            out[at] = b"".join(ids)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and tokens (array<int>, with the end id) of each row; a null or empty text has the end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x + end for x in coder.encode(part["text"].to_pylist())]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, tokens array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> str:
    """Encode every row and write ORC files under ``path``, in ascending doc_id order (null ids first).

    Rows of equal doc_id lie in the order of their texts. An empty table gives a file without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions_for(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = encode(rows, tokenizer_path, end_id).select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    tokens.write.options(**ORC_OPTIONS).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    schema = "doc_id long, n_tokens int, tokens array<int>, part int, place long"
    return spark.read.schema(schema).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; stripes and row groups without them are skipped by their metadata."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "tokens")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids_crc32, all from the files.

    The start is a sum within each file, by its rows' places, and of the files before it.
    """

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            flat, offsets = np.asarray(lists.values).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            n = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], batch["place"], pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "part", "place", "tokens").mapInArrow(tidy(crcs), "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    # One number for each file.
    sums = {r["part"]: r["n"] for r in read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    return rows.select("doc_id", (F.coalesce(F.sum("n_tokens").over(within), F.lit(0)) + base).cast("long").alias("start"), "n_tokens", "ids_crc32")

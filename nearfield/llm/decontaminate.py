"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of consecutive words of every item. A document's words are streamed through
it; at each word the automaton knows the longest run of item words that ends there. Where that run is at
least ``window`` words long, or holds a whole item that is shorter, the words of that window are hit.

The automaton is sent to the executors, so its size is bounded: items are dealt into groups of at most
``max_words`` words, and each group gets an automaton and a pass of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WORD, discard, materialise, tidy, words_of

WINDOW = 10
#: Words of items in one automaton (some 400 bytes a word); more items mean more passes.
MAX_WORDS = 1_000_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        self.short_items: dict[int, list[int]] = {}
        self.window_items: dict[int, set[int]] = {}
        self.least = window

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q for the runs that are no longer than those of p and w."""
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    @classmethod
    def of(cls, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> SuffixAutomaton:
        self = cls(window)
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for i, words in items if words]
        ends = {}
        for k, (_, seq) in enumerate(coded):
            last = 0
            for w in seq:
                last = self._extend(last, w)
            ends[k] = last
        for k, (item, seq) in enumerate(coded):
            if len(seq) < window:
                self.least = min(self.least, len(seq))
                # A later item may have split the state of this one.
                last = 0
                for w in seq:
                    last = self.next[last][w]
                self.short_items.setdefault(last, []).append(item)
        self._shortcuts()
        for item, seq in coded:
            for _, state, _ in self._stream(seq):
                if state not in self.short_items or self.length[state] >= window:
                    self.window_items.setdefault(state, set()).add(item)
        return self

    def _shortcuts(self) -> None:
        """For each state: the state of its last ``window`` words, and the nearest that is a whole short item."""
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.at_window, self.at_short = [0] * len(order), [0] * len(order)
        for s in order[1:]:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.at_window[s] = self.at_window[up] if self.length[up] >= self.window else s
            self.at_short[s] = s if s in self.short_items else self.at_short[up]

    def _stream(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position of the last word, state, words of the hit) for each window or short item that occurs."""
        state = matched = 0
        following, link, length = self.next, self.link, self.length
        for pos, w in enumerate(seq):
            while state and w not in following[state]:
                state = link[state]
                matched = length[state]
            state = following[state].get(w, 0)
            matched = matched + 1 if state else 0
            if matched >= self.window:
                yield pos, self.at_window[state], self.window
            short = self.at_short[state]
            while short:
                if length[short] <= matched:
                    yield pos, short, length[short]
                short = self.at_short[link[short]]

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], set[int]]:
        """Merged runs [start, end) of hit words, and the items that have an occurring window."""
        if len(words) < self.least or not self.vocab:
            return [], [], set()
        ids = np.fromiter((self.vocab.get(w, -1) for w in words), np.int32, len(words))
        # Only runs of item words that are long enough can hold a window.
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends, items = [], [], set()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a < self.least:
                continue
            for pos, state, n in self._stream(ids[a:b].tolist()):
                lo, hi = int(a) + pos + 1 - n, int(a) + pos + 1
                items.update(self.short_items.get(state, ()) if n < self.window else self.window_items.get(state, ()))
                while ends and starts[-1] >= lo:
                    starts.pop()
                    hi = max(hi, ends.pop())
                if ends and lo <= ends[-1]:
                    ends[-1] = max(ends[-1], hi)
                else:
                    starts.append(lo)
                    ends.append(hi)
        return starts, ends, items


def _groups(items: DataFrame, max_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with words, in groups of at most ``max_words`` words (or one item); only one group is held at a time."""
    group, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if group and size + len(words) > max_words:
            yield group
            group, size = [], 0
        if words:
            group.append((item, words))
            size += len(words)
    yield group


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Hit words of each document.

    Returns a row per row of ``docs``: doc_id, n_words, n_hit, starts and ends (word runs [start, end)), items
    (sorted distinct item_ids; null ids are left out). A null or empty text has no words and no hits; items
    without words hit nothing; of equal items all are reported; with no items no document is hit. Extra
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = _passes(docs, items, window, max_words)
    total = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    return hits.select("doc_id", "n_words", total.alias("n_hit"), "starts", "ends", "items")


def _passes(docs: DataFrame, items: DataFrame, window: int, max_words: int, max_coverage: float | None = None) -> DataFrame:
    """``docs`` with n_words, starts, ends and items; each group of items makes a pass and adds its hits.

    A pass is written before the next one, so no task and not the driver holds more than one automaton. With
    ``max_coverage`` the last pass also adds the column cut: the text without hit words, where there are any and they
    are no more than that part of it.
    """
    none = F.array().cast("array<int>")
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "starts": none, "ends": none, "items": F.array().cast("array<long>")})
    if max_coverage is not None:
        out = out.withColumn("cut", F.lit(None).cast("string"))
    schema = out.schema
    groups = _groups(items, max_words)
    group, old = next(groups), []
    while group is not None:
        following = next(groups, None)
        cutting = following is None and max_coverage is not None
        model = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton.of(group, window))

        def run(batches: Iterator[pa.RecordBatch], model=model, cutting=cutting) -> Iterator[pa.RecordBatch]:
            automaton = model.value
            for batch in batches:
                cols = {c: [] for c in ("n_words", "starts", "ends", "items", *(["cut"] if cutting else []))}
                for text, s, e, i in zip(*(batch[c].to_pylist() for c in ("text", "starts", "ends", "items")), strict=True):
                    words = words_of(text)
                    starts, ends, found = automaton.hits(words)
                    starts, ends = merged(starts, ends, s, e) if s else (starts, ends)
                    for c, v in zip(cols, (len(words), starts, ends, sorted({*found, *i} - {None})), strict=False):
                        cols[c].append(v)
                    if cutting:
                        some = 0 < sum(ends) - sum(starts) <= max_coverage * len(words)
                        cols["cut"].append(cut_words(text, starts, ends) if some else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[f.name], f.type) if f.name in cols else batch[f.name] for f in batch.schema], schema=batch.schema
                )

        out, group = out.mapInArrow(tidy(run), schema), following
        if group is not None:
            new: list[str] = []
            out = materialise(out, new)
            model.destroy()
            discard(docs.sparkSession, old)
            old = new
    return out


def merged(starts: list[int], ends: list[int], more_starts: list[int], more_ends: list[int]) -> tuple[list[int], list[int]]:
    """The union of two lists of runs."""
    out: list[list[int]] = []
    for s, e in sorted([*zip(starts, ends, strict=True), *zip(more_starts, more_ends, strict=True)]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [s for s, _ in out], [e for _, e in out]


_WORD = re.compile(WORD + "+")


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the given word runs; what is left of each side is joined by a blank."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(text[at : spans[s][0]].rstrip(" "))
        at = spans[e - 1][1]
    out.append(text[at:].lstrip(" "))
    return " ".join(out).strip()


def remove_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, max_words: int = MAX_WORDS
) -> DataFrame:
    """Documents without benchmark passages.

    A document of which more than ``max_coverage`` of the words are hit is dropped; from others the hit words
    are cut. Documents without hits, and null or empty texts, are unchanged. All columns of ``docs`` are kept,
    whatever their names; n_chars, where it exists, follows a text that was cut.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    found = _passes(rows, items, window, max_words, max_coverage)
    size = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0), lambda a, n: a + n)
    found = found.where(size <= max_coverage * F.col("n_words"))
    out = found.select("row.*", F.coalesce("cut", found["text"]).alias("_cut"), (F.size("starts") > 0).alias("_hit"))
    new = {"text": F.col("_cut").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_hit"), F.length("_cut")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])

"""SentencePiece segmentations drawn without replacement by Gumbel top-k, and decoding.

All ways to cut a text into pieces of a vocabulary form a lattice over its characters. A segmentation's
probability is the product of its pieces' weights, normalised over the lattice; piece weights fall with the
piece's rank in the vocabulary (``(2 + rank) ** -ALPHA``). The k segmentations of greatest log probability plus
independent Gumbel noise are a sample without replacement. They are found by a best-first (A*) search over
sets of segmentations with a common beginning: the greatest perturbed value in a set has a known law, so the
search draws it for each set it meets, always opens the set with the greatest value, and stops at the k-th
segmentation; sets that are never opened are never listed. The value of the best set left over, the threshold,
gives each sample's probability of inclusion.

The noise is a hash of row key, sample and place in the text, so a row's samples depend on nothing else.

Memory is some 200 bytes a character of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import slices, tidy
from nearfield.llm.hashing import mix, span_hashes

ALPHA = 1.0
SAMPLES = 2
#: Bytes of text that are taken together, so that what repeats in them is worked out once.
SLICE = 1 << 18
MARK = "▁"  # stands for a blank

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a model file, and where in a text they match."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_at = np.full(256, -1, np.int32)
        pieces: dict[str, int] = {}
        self.raw: list[bytes] = [b""] * n  # what a piece decodes to
        rank = np.full(n, float(n))
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.bytes_at[b], self.raw[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i
                self.raw[i] = piece.replace(MARK, " ").encode()
                if -model.get_score(i) < n:
                    rank[i] = max(0.0, -model.get_score(i))
        self.logp = -alpha * np.log(2 + rank)
        self.unknown = model.unk_id()
        self.raw_sizes = np.array([len(x) for x in self.raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.longest = max(map(len, pieces))
        self.single = np.full(0x110000, -1, np.int32)
        prefixes, pairs = set(), set()
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
            prefixes.update(piece[:k] for k in range(2, len(piece) + 1))
            pairs.update(zip(piece, piece[1:], strict=False))
        self.crossed = _Set(np.array([self._hash(a + b) for a, b in pairs], _U))
        keys = sorted(prefixes)
        self.prefixes = _Set(np.array([self._hash(k) for k in keys], _U), np.array([pieces.get(k, -1) for k in keys], np.int32))

    @staticmethod
    def start(c: np.ndarray) -> np.ndarray:
        return (c.astype(_U) + _U(1)) * _STEP

    @staticmethod
    def more(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + (c.astype(_U) + _U(1)) * _STEP
        return h ^ (h >> _U(32))

    def _hash(self, piece: str) -> int:
        c = np.array([ord(x) for x in piece], np.uint32)
        h = self.start(c[:1])
        for k in range(1, len(c)):
            h = self.more(h, c[k : k + 1])
        return int(h[0])


class _Set:
    """Lookup of 64-bit hashes, by a table of their low bits and, where two share a place, by bisection."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = (np.zeros(len(keys), np.int32) if values is None else values)[order]
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.table[(self.keys & _U((1 << self.BITS) - 1)).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place among the keys, or -1."""
        at = self.table[(h & _U((1 << self.BITS) - 1)).astype(np.int64)]
        other = np.flatnonzero((at >= 0) & (self.keys[at] != h))
        if len(other):
            place = np.minimum(np.searchsorted(self.keys, h[other]), len(self.keys) - 1)
            at[other] = np.where(self.keys[place] == h[other], place, -1)
        return at


class Lattice:
    """Pieces that match at each character of some texts, and the chance of each to be next.

    The lattice falls into units between characters that no piece has side by side; ``first`` marks where they
    start. A unit's pieces and chances follow from its characters alone, so units of equal characters share their
    nodes: character i of the joined texts is node ``i + shift[i]``. ``ids[node, k]`` is the piece of k + 1
    characters there, or -1; -2 stands for the bytes of a character that is no piece.
    """

    def __init__(self, vocabulary: Vocabulary, texts: list[str]):
        self.vocabulary = v = vocabulary
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        c = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(t) for t in marked], np.int64)
        self.size = n = len(c)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        self.first = np.ones(n + 1, bool)
        if n > 1:
            self.first[1:n] = v.crossed.find(v.more(v.start(c[:-1]), c[1:])) < 0
        self.first[self.starts[sizes > 0]] = True
        bounds = np.flatnonzero(self.first)
        self.units = bounds[:-1]
        self._share(c, np.diff(bounds))
        self.width = int(min(v.longest, self.reach.max(initial=1)))
        self._match()
        self._sum()

    def _share(self, c: np.ndarray, sizes: np.ndarray) -> None:
        """Set up the nodes: of units with equal characters, those of one."""
        numbers = np.arange(len(sizes))
        like = numbers
        if len(sizes):
            hashes = span_hashes(c, self.units, self.units + sizes)
            slots = (hashes & _U((1 << int(2 * len(sizes)).bit_length()) - 1)).astype(np.int64)
            table = np.empty(slots.max() + 1, np.int64)
            table[slots] = numbers
            like = np.where(hashes[table[slots]] == hashes, table[slots], numbers)
        for like in (like, numbers):
            kept = np.flatnonzero(like == numbers)
            lengths = sizes[kept]
            ends = np.cumsum(lengths)
            begins = np.zeros(len(sizes), np.int64)
            begins[kept] = ends - lengths
            self.shift = np.repeat(begins[like] - self.units, sizes)
            self.chars = c[np.repeat(self.units[kept] - begins[kept], lengths) + np.arange(lengths.sum())]
            if np.array_equal(self.chars[np.arange(len(c)) + self.shift], c):
                break  # else two different units have one hash
        self.reach = np.repeat(ends, lengths) - np.arange(len(self.chars))  # characters to the end of the unit

    def _match(self) -> None:
        v, c = self.vocabulary, self.chars
        single = v.single[c]
        columns = [np.where(single < 0, -2, single)]
        self.n_bytes = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
        at = np.flatnonzero(self.reach > 1)
        h = v.start(c[at])
        for k in range(1, self.width):
            keep = self.reach[at] > k
            at, h = at[keep], h[keep]
            h = v.more(h, c[at + k])
            place = v.prefixes.find(h)
            keep = place >= 0
            at, h, place = at[keep], h[keep], place[keep]
            if not len(at):
                break
            columns.append(np.full(len(c), -1, np.int32))
            columns[-1][at] = v.prefixes.values[place]
        while len(columns) > 1 and columns[-1].max(initial=-1) < 0:
            columns.pop()
        self.ids, self.width = np.stack(columns, 1).astype(np.int32), len(columns)

    def _sum(self) -> None:
        """Log sums of all ways from each node to the end of its unit, from the ends backward, and chances."""
        n, logp = len(self.chars), self.vocabulary.logp
        # Of the ids, -1 and -2 read the last entries: no piece, and one byte.
        self.logp = np.concatenate([logp, [logp.min(), -np.inf]])
        weights = self.logp[self.ids]
        several = np.flatnonzero((self.ids[:, 0] == -2) & (self.n_bytes > 1))
        weights[several, 0] *= self.n_bytes[several]
        self.beta = beta = np.zeros(n + 1)
        self.upto = np.empty((n, self.width), np.float32)  # summed chances of pieces up to each length
        self.upto.fill(2.0)
        by = np.argsort(self.reach.astype(np.uint16) if n and self.reach.max() < 65536 else self.reach, kind="stable")
        cuts = np.searchsorted(self.reach[by], np.arange(1, self.reach.max(initial=0) + 2))
        ahead = np.arange(1, self.width + 1)
        for d in range(1, len(cuts)):
            at = by[cuts[d - 1] : cuts[d]]
            if not len(at):
                continue
            k = min(d, self.width)
            w = weights[at, :k]
            short = k - (k == d)  # the longest piece may end the unit, after which nothing is left to sum
            if short:
                w[:, :short] += beta[at[:, None] + ahead[:short]]
            top = w.max(1, keepdims=True)
            w -= top
            np.exp(w, out=w)
            np.cumsum(w, axis=1, out=w)
            total = w[:, -1:].copy()
            beta[at] = (top + np.log(total))[:, 0]
            w[w >= total] = 2.0 * total.max()  # against rounding
            self.upto[at, :k] = w / total

    def log_chance(self, node: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Log chance of the piece of k + 1 characters to be next at each node."""
        return self.log_chance_of(self.ids[node, k], node, k)

    def log_chance_of(self, piece: np.ndarray, node: np.ndarray, k: np.ndarray) -> np.ndarray:
        chance = self.logp[piece]
        several = np.flatnonzero(piece == -2)
        chance[several] *= self.n_bytes[node[several]]
        after = self.beta[node + k + 1]
        after[self.reach[node] == k + 1] = 0.0
        chance += after
        chance -= self.beta[node]
        return chance


def _uniform(key: np.ndarray, place: np.ndarray, use: int) -> np.ndarray:
    """Numbers in (0, 1) that are a hash of key, place and use."""
    x = mix(key + mix(place.astype(_U) * _STEP + _U(use)))
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Path:
    """One segmentation of each text: the characters where its pieces start, their lengths, and the sets that branch off."""

    def __init__(self, lattice: Lattice, steps: np.ndarray):
        self.at = np.flatnonzero(steps >= 0)
        self.k = steps[self.at].astype(np.int64)  # lengths less 1
        self.node = self.at + lattice.shift[self.at]
        self.doc = lattice.doc[self.at]
        self.of = np.searchsorted(self.at, np.concatenate((lattice.starts, lattice.ends[-1:])))
        self.place = self.at - lattice.starts[self.doc]
        self.value = np.full(len(self.at), -np.inf)  # greatest perturbed value of the set that branches off here
        self.used = np.uint32(1) << self.k.astype(np.uint32)  # lengths (bits) that this set is without
        self.piece = lattice.ids[self.node, self.k]
        chance = lattice.log_chance_of(self.piece, self.node, self.k)
        total = np.empty(len(chance))
        for a, b in zip(self.of[:-1].tolist(), self.of[1:].tolist(), strict=True):
            np.cumsum(chance[a:b], out=total[a:b])  # each text by itself, so that its sums depend on nothing else
        self.chance, self.before = chance, total - chance  # log chance of the piece, and of the path up to it
        filled = self.of[1:] > self.of[:-1]
        self.logp = np.where(filled, total[self.of[1:] - 1] if len(total) else 0.0, 0.0)

    def best(self) -> np.ndarray:
        """The greatest value of each text; -inf where it has no path."""
        out, rows = np.full(len(self.of) - 1, -np.inf), np.flatnonzero(self.of[1:] > self.of[:-1])
        if len(rows):
            out[rows] = np.maximum.reduceat(self.value, self.of[rows])
        return out


def draw(lattice: Lattice, keys: np.ndarray, k: int) -> list[dict]:
    """The k best perturbed segmentations of each text, best first.

    Each element: the ``path``, and for each text ``logp``, ``gumbel`` (perturbed value; -inf where there are
    fewer segmentations) and ``threshold`` (best value left).
    """
    docs = len(lattice.starts)
    unit_docs = lattice.doc[lattice.units]
    paths: list[_Path] = []
    found = []

    def walk(steps: np.ndarray, at: np.ndarray, use: int) -> None:
        """Draw pieces from these characters to the ends of their units."""
        while len(at):
            doc = lattice.doc[at]
            u = _uniform(keys[doc], at - lattice.starts[doc], use).astype(np.float32)
            step = (lattice.upto[at + lattice.shift[at]] > u[:, None]).argmax(1)
            steps[at] = step
            at = at + step + 1
            at = at[~lattice.first[at]]

    def branched(steps: np.ndarray, since: np.ndarray, gumbel: np.ndarray, use: int) -> None:
        """Take up the path; give values to the sets that branch off at characters from ``since`` on."""
        path = _Path(lattice, steps)
        new = np.flatnonzero(path.at >= since[path.doc])
        doc, p = path.doc[new], path.chance[new]
        with np.errstate(divide="ignore", over="ignore"):
            mass = path.before[new] + np.log1p(-np.minimum(np.exp(p), 1.0))
            mass = np.where(p > -1e-12, -np.inf, mass)
            path.value[new] = _truncated(mass, gumbel[doc], -np.log(_uniform(keys[doc], path.place[new], use)))
        paths.append(path)
        found.append({"path": path, "logp": path.logp, "gumbel": gumbel})

    gumbel = -np.log(-np.log(_uniform(keys, np.zeros(docs, np.int64), 1)))
    gumbel[lattice.ends == lattice.starts] = -np.inf
    steps = np.full(lattice.size, -1, np.int8)
    walk(steps, lattice.units, 2)
    branched(steps, lattice.starts, gumbel, 3)
    for sample in range(1, k):
        use = 16 * sample
        best = np.stack([p.best() for p in paths])
        which, gumbel = best.argmax(0), best.max(0)
        steps, since, starts = np.full(lattice.size, -1, np.int8), lattice.ends.copy(), []
        for i, path in enumerate(paths):
            mine = np.isfinite(gumbel) & (which == i)
            if not mine.any():
                continue
            # The place of the best set of each of these texts.
            inside = mine[path.doc]
            hit = np.flatnonzero(inside & (path.value == gumbel[path.doc]))
            hit = hit[np.unique(path.doc[hit], return_index=True)[1]]
            own, at, node, place = path.doc[hit], path.at[hit], path.node[hit], path.place[hit]
            lengths, reach = np.arange(lattice.width), lattice.reach[node]
            p = np.exp(np.stack([np.where(reach > x, lattice.log_chance(node, np.minimum(x, reach - 1)), -np.inf) for x in lengths], 1))
            p[(path.used[hit][:, None] >> lengths.astype(np.uint32)) & 1 == 1] = 0.0
            left = p.sum(1)
            step = np.minimum((np.cumsum(p, 1) <= (_uniform(keys[own], place, use + 1) * left)[:, None]).sum(1), lattice.width - 1)
            # The set at this place loses the piece; its new best value lies under the one just taken.
            rest = left - p[np.arange(len(hit)), step]
            with np.errstate(divide="ignore", over="ignore"):
                mass = np.where(rest > 1e-12, path.before[hit] + np.log(np.maximum(rest, 1e-300)), -np.inf)
                path.value[hit] = _truncated(mass, gumbel[own], -np.log(_uniform(keys[own], place, use + 2)))
            path.used[hit] |= np.uint32(1) << step.astype(np.uint32)
            upto = np.zeros(docs, np.int64)
            upto[own] = at
            same = np.flatnonzero(inside & (path.at < upto[path.doc]))
            steps[path.at[same]] = path.k[same]
            steps[at] = step
            since[own] = at + step + 1
            starts += [lattice.units[mine[unit_docs] & (lattice.units > upto[unit_docs])], since[own][~lattice.first[since[own]]]]
        walk(steps, np.concatenate([np.zeros(0, np.int64), *starts]), use + 3)
        branched(steps, since, gumbel, use + 4)
    threshold = np.stack([p.best() for p in paths]).max(0)
    return [f | {"threshold": threshold} for f in found]


def _truncated(location: np.ndarray, most: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A Gumbel value at this location, given that it is under ``most``; e is exponential noise."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        x = location - np.log(np.exp(np.minimum(location - most, 700.0)) + e)
    return np.where(np.isfinite(location), np.minimum(x, most), -np.inf)


def ids_of(lattice: Lattice, path: _Path) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a path of each text, and how many each text has."""
    ids = path.piece
    several = np.flatnonzero(ids == -2)
    if not len(several):
        return ids, np.diff(path.of)
    n = np.where(ids == -2, lattice.n_bytes[path.node], 1)
    flat = np.repeat(ids, n)
    ends = np.cumsum(n)
    for i in several.tolist():
        flat[ends[i] - n[i] : ends[i]] = lattice.vocabulary.bytes_at[list(chr(lattice.chars[path.node[i]]).encode("utf-8", "replace"))]
    return flat, np.bincount(path.doc, n, len(lattice.starts)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of some ids: pieces joined, marks read as blanks, without the blank put before the text."""
    text = b"".join(map(v.raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decoded_right(v: Vocabulary, ids: list[list[np.ndarray]], texts: list[str | None]) -> list[bool]:
    """For each text whether all its segmentations decode to it (U+2581 as a blank)."""
    flat = np.concatenate([np.zeros(0, np.int32), *[x for each in ids for x in each]])
    sizes = v.raw_sizes[flat]
    got = v.raw_bytes[np.repeat(v.raw_starts[flat] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    want = [(" " + t.replace(MARK, " ") if t else "").encode("utf-8", "replace") for t in texts]
    # All at once: the same bytes, and the same ends of texts in them.
    said = [w for w, each in zip(want, ids, strict=True) for _ in each]
    ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(x) for each in ids for x in each], dtype=np.int64)]
    if np.array_equal(ends, np.cumsum([len(x) for x in said], dtype=np.int64)) and got.tobytes() == b"".join(said):
        return [True] * len(texts)
    return [all(decode(v, x.tolist()) == (t or "").replace(MARK, " ") for x in each) for t, each in zip(texts, ids, strict=True)]


def sample(texts: list[str | None], keys: list[int | None], v: Vocabulary, k: int = SAMPLES) -> list[list[tuple[list[int], float, float, float]]]:
    """For each text up to k different segmentations: ids, log probability, perturbed value, inclusion."""
    lattice = Lattice(v, [t or "" for t in texts])
    seeds = mix(np.array([(x if x is not None else -1) & 0xFFFFFFFFFFFFFFFF for x in keys], _U) + _U(77))
    out: list[list] = [[] for _ in texts]
    for got in draw(lattice, seeds, k):
        ids, n = ids_of(lattice, got["path"])
        ends = np.cumsum(n)
        for i in np.flatnonzero(np.isfinite(got["gumbel"])):
            inclusion = 1.0 if got["threshold"][i] == -np.inf else float(-np.expm1(-np.exp(min(got["logp"][i] - got["threshold"][i], 700.0))))
            out[i].append((ids[ends[i] - n[i] : ends[i]], float(got["logp"][i]), float(got["gumbel"][i]), inclusion))
    return out


_SCHEMA = "doc_id long, ids array<array<int>>, log_prob array<double>, gumbel array<double>, inclusion array<double>, decoded boolean"


def sample_documents(docs: DataFrame, model_path: str, k: int = SAMPLES, alpha: float = ALPHA) -> DataFrame:
    """Up to k different segmentations of each row's whole text, by descending perturbed value.

    Returns doc_id, ids, log_prob (over all segmentations of the text), gumbel, inclusion (a list of each) and
    decoded (whether all of them decode to the text; U+2581 reads as a blank). The row key is doc_id: rows of
    equal doc_id and text get equal samples. Null and empty texts have none; texts with fewer than k
    segmentations have all of them. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path, alpha)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                ids, texts = part["doc_id"].to_pylist(), part["text"].to_pylist()
                got = sample(texts, ids, v, k)
                right = decoded_right(v, [[s[0] for s in x] for x in got], texts)
                flat = [s[0] for x in got for s in x]
                inner = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(f) for f in flat]))).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(0, np.int32), *flat]).astype(np.int32)),
                )
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32))
                floats = [pa.ListArray.from_arrays(offsets, pa.array([s[j] for x in got for s in x], pa.float64())) for j in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(offsets, inner), *floats, pa.array(right)], names=["doc_id", "ids", "log_prob", "gumbel", "inclusion", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), _SCHEMA)

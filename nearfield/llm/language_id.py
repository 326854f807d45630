"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are the byte n-grams of its lower-cased UTF-8 form, hashed into ``2 ** BITS`` buckets. The
mean of the buckets' embeddings goes through a linear layer and a softmax; embeddings and layer are trained by
stochastic gradient descent. Both are linear, so a fitted model keeps their product: a score of each bucket
for each language, a table of fixed size that goes to the executors. A temperature, fitted on rows kept from
training, makes the probabilities honest; thresholds from the same rows reject texts that are like no language.
They are set for each length of text apart: by the best language's score, and by the share of the n-grams without
digits that training texts have. For that share n-grams are hashed so finely that unlike texts hardly collide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from nearfield.llm.common import slices, tidy

BITS = 15
#: Hash bits of the n-grams that training texts have.
SEEN_BITS = 24
ORDERS = (3, 4)
#: Bytes of text whose n-grams are held at a time.
BLOCK = 1 << 17
DIM = 16
EPOCHS = 10
RATE = 1.0
#: An n-gram has a small part in a text's mean, so embeddings take larger steps than the linear layer.
LIFT = 20.0
#: The model is fitted on at most so many labelled rows in all, dealt evenly to the languages (20 each at least).
TRAIN_ROWS = 2000
#: Of calibration rows, so large a share may lie under the thresholds.
REJECT_SHARE = 0.001
#: The thresholds stay so far under what calibration rows show.
MARGIN = 0.8
#: No text with known n-grams is rejected whose best language has this probability; one in two languages has half for each.
DOUBT = 0.4
#: Numbers of n-grams from which a text has thresholds of its own.
LENGTHS = (0, 64, 256, 1024, 4096)
#: A length with fewer calibration rows has no stricter thresholds than the next shorter one.
LENGTH_ROWS = 20
#: Temperatures that are tried; the best lies well inside.
TEMPERATURES = np.geomspace(1e-2, 1e2, 121)
#: At most so many languages are learned, those with the most documents.
LANGS = 256
UNKNOWN = "und"

_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of one of Unicode's letter categories."""
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def _piece(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b"    "


def _grams(raw: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of SEEN_BITS of all n-grams of some bytes, and whether they have no digit."""
    raw = raw.astype(np.uint32)
    n = max(0, len(raw) - order + 1)
    h, digits = raw[:n] * np.uint32(0x9E3779B1) if order == 3 else np.full(n, order, np.uint32), np.zeros(n, bool)
    digit = (raw >= 48) & (raw <= 57)
    for k in range(order):
        if order != 3 or k:
            h = (h ^ raw[k : k + n]) * np.uint32(0x01000193)
        digits |= digit[k : k + n]
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SEEN_BITS), ~digits


def _blocks(pieces: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the first text, bytes, and first and last (exclusive) byte of each text, in parts of ``BLOCK`` bytes.

    A part holds whole texts, or a stretch of one longer text with the bytes that its last n-grams reach into; so
    a text's sums depend on nothing else.
    """
    at = 0
    while at < len(pieces):
        if len(pieces[at]) > BLOCK:
            raw = np.frombuffer(pieces[at], np.uint8)
            for a in range(0, len(raw), BLOCK):
                part = raw[a : a + BLOCK + max(ORDERS) - 1]
                yield at, part, np.array([0]), np.array([min(BLOCK, len(raw) - a)])
            at += 1
            continue
        end, size = at, 0
        while end < len(pieces) and size + len(pieces[end]) <= BLOCK:
            size += len(pieces[end])
            end += 1
        ends = np.cumsum([len(x) for x in pieces[at:end]])
        raw = b"".join(pieces[at:end]) + bytes(max(ORDERS) - 1)
        yield at, np.frombuffer(raw, np.uint8), np.concatenate(([0], ends[:-1])), ends
        at = end


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # bucket, language
    bias: np.ndarray
    seen: np.ndarray  # hash of SEEN_BITS: whether training texts have it
    bits: int = BITS
    temperature: float = 1.0
    least_score: tuple[float, ...] = (0.0,) * len(LENGTHS)
    least_seen: tuple[float, ...] = (0.0,) * len(LENGTHS)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (text, language), the share of each text's n-grams without digits that training texts have, and its place in LENGTHS."""
        if not texts:
            return np.zeros((0, len(self.langs))), np.zeros(0), np.zeros(0, int)
        pieces = [_piece(t) for t in texts]
        width = len(self.langs)
        total, n = np.zeros((len(texts), width + 2)), np.zeros(len(texts))
        for first, raw, starts, ends in _blocks(pieces):
            here = slice(first, first + len(starts))
            for order in ORDERS:
                h, plain = (x[: ends[-1]] for x in _grams(raw, order))
                good = None  # a stretch of a longer text
                if len(pieces[first]) <= BLOCK:
                    good = np.arange(len(h)) + order <= np.repeat(ends, ends - starts)  # not across the end of a text
                values = np.empty((len(h), width + 2))
                values[:, :width], values[:, width], values[:, width + 1] = self.table[h >> np.uint32(SEEN_BITS - self.bits)], plain & self.seen[h], plain
                if good is not None:
                    values[~good] = 0.0
                if len(h):
                    total[here] += np.add.reduceat(values, starts, axis=0)
        for order in ORDERS:
            n += np.array([len(x) - order + 1 for x in pieces])
        known, of = total[:, -2], total[:, -1]  # each text has blanks at its end, so ``of`` is not 0
        return total[:, :-2] / n[:, None] + self.bias, known / of, np.searchsorted(LENGTHS, of, "right") - 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection of each text; without a letter: ``und``, 0, rejected."""
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.langs:
            return langs, scores, rejected
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        logits, seen, size = self.logits([texts[i] for i in rows])
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        for k, i in enumerate(rows):
            langs[i], scores[i] = self.langs[best[k]], float(min(1.0, p[k, best[k]]))
            rejected[i] = bool(scores[i] < self.least_score[size[k]] or seen[k] < self.least_seen[size[k]])
        return langs, scores, rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True)) if x.size else x
    return e / e.sum(1, keepdims=True) if x.size else e


def fit(rows: list[tuple[str, str]], bits: int = BITS, seed: int = 1) -> LanguageModel:
    """Train on (text, language) rows; a quarter of the different texts only calibrates."""
    rows = sorted(set(rows))
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = len(rows) // 4 if len(rows) >= 40 else 0
    held, train = [rows[i] for i in order[:cut]], [rows[i] for i in order[cut:]]
    # Texts of a few words are harder than whole ones; excerpts teach both the model and its temperature.
    held, train = held + _excerpts(held, rng), train + _excerpts(train, rng)
    n = len(langs)
    emb, out, bias = rng.normal(0, 0.1, (1 << bits, DIM)), rng.normal(0, 0.1, (DIM, n)), np.zeros(n)
    counts = np.zeros(1 << SEEN_BITS, np.uint8)  # up to 3
    features = []
    for text, lang in train:
        raw = np.frombuffer(_piece(text), np.uint8)
        h = np.concatenate([_grams(raw, order)[0] for order in ORDERS])
        idx, count = np.unique(h, return_counts=True)
        counts[idx] = np.minimum(counts[idx] + np.minimum(count, 3), 3)
        idx, count = np.unique(h >> np.uint32(SEEN_BITS - bits), return_counts=True)
        features.append((idx.astype(np.int32), (count / count.sum()).astype(np.float32), langs.index(lang)))
    of = np.bincount([y for *_, y in features], minlength=n)
    weight_of = np.clip(len(features) / n / np.maximum(of, 1), 0.25, 4.0)  # languages count alike, whatever their share
    steps, at = EPOCHS * len(features), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(features)):
            idx, weight, y = features[k]
            rate = RATE * (1 - at / steps)
            hidden = weight @ emb[idx]
            g = softmax((hidden @ out + bias)[None])[0]
            g[y] -= 1
            g *= weight_of[y]
            back = out @ g
            # The step falls with what it would do to this text's own scores, so that it never overshoots.
            rate /= 1 + hidden @ hidden + LIFT * (weight @ weight) * (out * out).sum()
            out -= rate * np.outer(hidden, g)
            bias -= 0.1 * rate * g
            emb[idx] -= rate * LIFT * weight[:, None] * back
            at += 1
    model = LanguageModel(langs, emb @ out, bias, counts >= 3, bits)
    if not model.seen.any():
        model.seen[:] = counts > 0
    model = calibrate(model, held or train, _excerpts(held or train, rng, 200))
    if not held:  # the n-grams of training texts are known by themselves, and say nothing of other texts
        model.least_seen = (0.0,) * len(LENGTHS)
    return model


def _excerpts(rows: list[tuple[str, str]], rng: np.random.Generator, most: int = 6) -> list[tuple[str, str]]:
    """A run of up to ``most`` words of each text."""
    found = []
    for text, lang in rows:
        words = text.split()
        n = int(rng.integers(1, most + 1))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        found.append((" ".join(words[at : at + n]), lang))
    return [r for r in found if has_letter(r[0])]


def calibrate(model: LanguageModel, rows: list[tuple[str, str]], parts: list[tuple[str, str]] = ()) -> LanguageModel:
    """Set the temperature with the least log loss, and thresholds under which few of these rows and parts lie, by length."""
    rows = [r for r in rows if has_letter(r[0])]
    if not rows:
        return model
    logits, _, _ = model.logits([t for t, _ in rows])
    y = np.array([model.langs.index(lang) for _, lang in rows])
    doubt = 1 / (len(y) + 2)  # as if one more row had any language, so that no errors here don't mean certainty

    def loss(t: float) -> float:
        logp = np.log(softmax(logits / t) + 1e-12)
        return float(-((1 - doubt) * logp[np.arange(len(y)), y] + doubt * logp.mean(1)).mean())

    model.temperature = float(min(TEMPERATURES, key=loss))
    logits, seen, size = model.logits([t for t, _ in [*rows, *parts]])
    p = softmax(logits / model.temperature)
    right = p.argmax(1) == np.array([model.langs.index(lang) for _, lang in [*rows, *parts]])
    # Rows like those it was trained on are sure; what is clearly less sure than nearly all of its length is rejected.
    least_score, least_seen = [], []
    for k in range(len(LENGTHS)):
        here = size == k
        score = p.max(1)[here & right]
        found = float(min(DOUBT, MARGIN * np.quantile(score, REJECT_SHARE))) if len(score) else 0.0, float(MARGIN * np.quantile(seen[here], REJECT_SHARE)) if here.any() else 1.0
        if here.sum() < LENGTH_ROWS:
            found = min(found[0], (least_score or [0.0])[-1]), min(found[1], (least_seen or [0.0])[-1])
        least_score.append(found[0])
        least_seen.append(found[1])
    model.least_score, model.least_seen = tuple(least_score), tuple(least_seen)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on at most ``rows`` labelled rows that are not held out (20 each language at least), picked by a hash of their ids.

    Of more than ``LANGS`` languages those with the most documents are learned.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    ids = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    counts = {r["lang"]: max(1, r["n"]) for r in ids.orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    usable = labelled.where(F.col("text").rlike(r"\p{L}"))
    if not counts:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(0), np.zeros(1))
    n = len(counts)
    each = max(20, rows // n)
    # Ids are thinned by their hash to a few times what is wanted before they are ranked, so no task gets many.
    share = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1.0, 4 * each / c))])
    ids = labelled.where(F.col("lang").isin([*counts])).select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    ids = ids.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = ids.withColumn("r", rank).where(F.col("r") <= each).select(F.col("doc_id").alias("d"), F.col("lang").alias("l"))
    # At most ``each`` ids a language, so the broadcast is bounded.
    chosen = usable.join(F.broadcast(picked), (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l")), "left_semi")
    # An id may stand in many rows: its least text is taken, so that each language keeps its rows, the same in each run.
    found = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return fit([(r["text"], r["lang"]) for r in found])


def classify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` and ``rejected``, from the text alone.

    Null, empty and letterless texts are ``und``, with score 0, and rejected. Equal texts get equal results.
    Columns of ``docs`` with one of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "rejected")
    out = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"))
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["row"].field(place).cast(pa.string())
            for part in slices(pa.RecordBatch.from_arrays([batch["row"], texts], names=["row", "text"])):
                langs, scores, rejected = shared.value.predict(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    schema = StructType([out.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return out.mapInArrow(tidy(run), schema).select("row.*", "lang_pred", "score", "rejected")


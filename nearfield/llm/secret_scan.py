"""Secrets in texts, judged by who else has them.

Candidates are spans that look like credentials. Over the whole corpus each candidate's hash gets its number
of distinct repositories (documents) and owners (sources). A value that several owners carry, or that one carries
in many repositories, is a copied example; one that belongs to few of both and does not look like a placeholder may
be live. Spans of the base kinds are always reported; spans of further kinds are added where they are not copied.
Among these are all long random values, whatever stands before them: only their ownership tells keys from examples.
The span of a private key is its header, but its value is the header and the key that follows. All on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialise

#: From this many owners on, a value counts as a copied example.
COPIED_OWNERS = 3
#: The same for repositories; a template that one owner keeps in all its repositories is no live secret.
COPIED_REPOSITORIES = 10
#: A live-looking value has at least so many different characters.
DISTINCT_CHARS = 6
SALTS = 16

# Kind, pattern, group that holds the value, least length of that group.
BASE_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
MORE_KINDS = [
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("random", r"[A-Za-z0-9+]{32,}", 0, 32),
]
#: A random value (without what joins words in paths and slugs) has a letter and a digit, so many different characters at least, and is no match of the kind hex.
RANDOM_CHARS = 12
HEX = "^[0-9a-f]+$"
# A quicker test for whether a kind can occur at all; a run of digits and letters a-f need only be looked at where it is long enough.
_HINTS = {"hex": r"[0-9a-f]{16}"}
# What follows a match and belongs to its value: a key's text up to the next five dashes. Line ends, also escaped
# ones, quotes and indentation differ among copies of a key; they do not count.
_BODIES = {"pem": r"(?=((?s:.*?))(?:-----|\z))"}
_BODY_NOISE = r"\\[nrt]|[^A-Za-z0-9+/=]"
#: So many characters of a value show whether it looks live; in a whole key, placeholders come up by chance.
SHOWN_CHARS = 128
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|your|xxxx|0000000|1234567|abcdefg"

_SPAN = "array<struct<start:int,stop:int,rank:int,kind:string,value:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind, by code points; matches with a group that is too short are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    if kind in _BODIES:
        bodies = F.regexp_extract_all(text, F.lit(pattern + _BODIES[kind]), F.lit(1))
        value = F.zip_with(whole, bodies, lambda x, b: F.concat(x, F.regexp_replace(b, _BODY_NOISE, "")))
    between = F.transform(F.split(text, pattern), F.length)
    # Each element: length of the text before the match since the last one, of the match, and its value.
    steps = F.zip_with(F.arrays_zip(whole.alias("m"), value.alias("v")), F.slice(between, 1, F.size(whole)), lambda x, n: F.struct(n.alias("gap"), F.length(x["m"]).alias("n"), x["v"].alias("v")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["n"]).alias("stop"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        fits = F.length(x["v"]) >= least
        if kind == "random":
            fits = fits & _looks_random(x["v"])
        out = F.when(fits, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((start + x["n"]).alias("at"), out.cast(_SPAN).alias("out"))

    found = F.aggregate(steps, state, step, lambda acc: acc["out"])
    return F.when(text.rlike(_HINTS.get(kind, pattern)), found).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, owner and all candidate spans of each row, in order of start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), text.alias("text"))
    kinds = enumerate(BASE_KINDS + MORE_KINDS)
    rows = rows.select("doc_id", "owner", F.xxhash64("text").alias("text_hash"), *[_spans(F.col("text"), i, *k).alias(k[0]) for i, k in kinds])
    spans = F.array_sort(F.concat(*[k[0] for k in BASE_KINDS + MORE_KINDS]))
    hashed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["rank"].alias("rank"), s["kind"].alias("kind"), F.sha2(s["value"].cast("binary"), 256).alias("hash"), _looks_live(s["value"]).alias("looks_live")))
    return rows.select("doc_id", "owner", "text_hash", hashed.alias("spans"))


def _looks_live(value: Column) -> Column:
    shown = F.when(value.startswith("-----"), F.substring(value, 1, SHOWN_CHARS)).otherwise(value)
    return (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARS) & ~shown.rlike(PLACEHOLDER)


def _looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(HEX) & (F.size(F.array_distinct(F.split(value, ""))) >= RANDOM_CHARS)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories and n_owners (distinct; rows without an owner count as one owner) of each candidate value.

    Counts by repository come first, so a value that a third of all rows have is added up before it meets in a task.
    """
    held = found.select("doc_id", "owner", F.explode("spans").alias("s")).select("doc_id", "owner", F.col("s.hash").alias("hash"))
    by_doc = held.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = by_doc.groupBy("hash", "owner").agg(F.count("*").alias("docs"))
    return by_owner.groupBy("hash").agg(F.sum("docs").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Secrets of each row.

    Returns doc_id, base and spans (arrays of kind, start, stop; code points, stop exclusive; by start, then
    kind), n_live and n_copied (of all candidates). ``spans`` holds the base spans, and those of further kinds
    that are not copied. Null texts count as empty; an absent or null source is one owner; repeated rows get
    equal results, and count once for ownership. Extra columns are ignored.
    """
    found = materialise(candidates(docs))
    held = ownership(found).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    # A value may stand in a third of all rows: its rows are dealt to several tasks.
    rows = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    rows = rows.select("doc_id", "text_hash", F.explode("spans").alias("s"), F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.withColumn("hash", F.col("s.hash")).join(held, ["hash", "salt"])
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    span = F.struct("s.start", "s.rank", "s.kind", "s.stop")
    judged = rows.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.when(~copied & (F.col("s.rank") >= len(BASE_KINDS)), span))).alias("added"),
        F.count_if(~copied & F.col("s.looks_live")).alias("n_live"), F.count_if(copied).alias("n_copied"),
    ).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "added", "n_live", "n_copied")
    base = F.transform(F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    out = found.select("doc_id", "text_hash", base.alias("base"))
    out = out.join(judged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "base", spans.alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

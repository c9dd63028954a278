"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidate spans in every whole text. The hash of each candidate's value is aggregated over
the corpus by distinct owners and distinct repositories: a value that many owners hold, or that stands in
many repositories of one owner, is a widely copied example; one of few owners in few repositories looks
live. Spans of the base kinds are always reported; a generic token, which a pattern alone can't tell from an
identifier, is added only where its value looks live. Without a repository column each document is one.

Ownership is counted over distinct rows of value, owner and repository, with partial counts before the last
shuffle, so a value that a third of all documents hold is no task of its own.

Defined cases: a null text counts as empty; null owners and repositories own nothing; rows that repeat a document are
reported alike and count once; overlapping spans of different kinds are all reported; a text of many megabytes
is scanned whole, with running sums in blocks, so costs follow its length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize, text_or_empty

#: Kinds in the order of their listing. Runs of a class are matched whole, so a least length in the pattern drops the same runs as a later check.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "token": r"[A-Za-z0-9+/_-]{24,}",
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
#: Owners, and repositories of all of them, up to which a value looks live.
MOST_OWNERS, MOST_REPOSITORIES = 2, 5
#: Elements of an array that are folded at a time.
BLOCK = 256
MARK = "[SECRET]"


def running(values: Column, start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of ``start`` and all values before each one. Blocks are folded by themselves, so no long array is copied for each element."""
    last = lambda a: F.element_at(a, -1)
    fold = lambda part: F.aggregate(part, F.array(start), lambda a, x: F.concat(a, F.array(combine(last(a), x))))
    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / BLOCK).cast("int"))
    inner = F.transform(numbers, lambda b: fold(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    heads = lambda folded: F.aggregate(folded, F.array(start), lambda a, x: F.concat(a, F.array(combine(last(a), last(x)))))
    joined = lambda folded: F.flatten(F.zip_with(folded, F.slice(heads(folded), F.lit(1), F.size(folded)), lambda f, h: F.transform(F.slice(f, F.lit(1), F.size(f) - 1), lambda x: combine(h, x))))
    return bound(inner, joined)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(kind: str, text: Column) -> Column:
    """Spans of one kind as array<struct<start, nth, end, hash>>: what lies between matches gives their places."""
    pattern = F.lit(PATTERNS[kind])
    value = F.regexp_extract_all(text, pattern, F.lit(2 if kind == "assign" else 0))
    parts = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"), value.alias("value"))
    none = F.expr("CAST(array() AS array<struct<start: int, nth: int, end: int, hash: bigint>>)")

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0)))
        return F.zip_with(parts, running(lengths, F.lit(0), lambda a, b: a + b), span)

    def span(part: Column, before: Column) -> Column:
        begin = before + F.length(part["gap"])
        good = part["match"].isNotNull() & (F.length(part["value"]) >= LEAST_VALUE)
        if kind == "token":
            good &= part["value"].rlike("[0-9]") & part["value"].rlike("[A-Z]") & ~part["value"].rlike("^AKIA")
        one = F.struct(begin.alias("start"), F.lit([*PATTERNS].index(kind)).alias("nth"), (begin + F.length(part["match"])).alias("end"), F.xxhash64(part["value"]).alias("hash"))
        return F.when(good, one)

    return F.when(text.rlike(PATTERNS[kind]), F.array_compact(bound(parts, placed))).otherwise(none)


def found(df: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """id, doc (a key of the text), owner, repository and the spans of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc"), F.col(owner_col).alias("owner"), F.col(repository_col).alias("repository"), text_or_empty(text_col).alias("text"))
    spans = F.array_sort(F.concat(*(spans_of(kind, F.col("text")) for kind in PATTERNS)))
    return rows.select("id", "doc", "owner", "repository", spans.alias("spans"))


def ownership(rows: DataFrame) -> DataFrame:
    """hash, owners and repositories of every candidate value."""
    held = rows.where(F.size("spans") > 0).select("owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    return held.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """id, doc, ``spans`` to report (start, nth, end, hash; sorted) and ``live``, the hashes of live-looking values, of every row."""
    rows = materialize(found(df, id_col, text_col, owner_col, repository_col), "spans")
    values = ownership(rows).where((F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)).select("hash")
    some = rows.where(F.size("spans") > 0)
    held = some.select("doc", F.explode(F.transform("spans", lambda s: s["hash"])).alias("hash")).distinct()
    live = held.join(values, "hash").groupBy("doc").agg(F.collect_set("hash").alias("live"))
    none = F.array().cast("array<bigint>")
    # Rows without spans, null texts among them, don't take part in the join.
    out = some.join(live, "doc", "left").withColumn("live", F.coalesce("live", none)).unionByName(rows.where(F.size("spans") == 0).withColumn("live", none))
    report = F.filter("spans", lambda s: (s["nth"] < len(BASE)) | F.array_contains(F.col("live"), s["hash"]))
    return out.select(F.col("id").alias(id_col), "doc", report.alias("spans"), "live")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["nth"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``MARK``. Spans are taken in blocks, each of its own part of the text, because finding a place takes time in proportion to it."""

    def piece(own: Column, base: Column) -> Callable[[Column], Column]:
        before = lambda s: F.substring(own, s["at"] - base + 1, F.greatest(s["start"] - s["at"], F.lit(0)))
        return lambda s: F.concat(before(s), F.when(s["start"] >= s["at"], F.lit(MARK)).otherwise(F.lit("")))

    def block(part: Column) -> Column:
        base = part[0]["at"]
        own = F.substring(text, base + 1, F.array_max(F.transform(part, lambda s: F.greatest(s["start"], s["at"]))) - base)
        return bound(own, lambda own: F.array_join(F.transform(part, piece(own, base)), ""))

    def joined(placed: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(placed) - 1) / BLOCK).cast("int"))
        return F.array_join(F.transform(numbers, lambda b: bound(F.slice(placed, b * BLOCK + 1, F.lit(BLOCK)), block)), "")

    ends = F.transform(spans, lambda s: s["end"])
    placed = F.zip_with(spans, running(ends, F.lit(0), F.greatest), lambda s, at: F.struct(s["start"].alias("start"), at.alias("at")))
    return F.concat(bound(placed, joined), F.substring(text, F.array_max(ends) + 1, F.length(text)))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """``df`` with the reported spans of its texts replaced by ``MARK``."""
    spans = scan(df, id_col, text_col, owner_col, repository_col).where(F.size("spans") > 0)
    spans = spans.select(F.col("doc").alias("_doc"), F.col("spans").alias("_spans")).distinct()
    row = F.col("row")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.xxhash64(text_col).alias("_key")).join(spans, F.col("_key") == F.col("_doc"), "left")
    text = F.when(F.col("_spans").isNull(), row[text_col]).otherwise(redacted(row[text_col], F.col("_spans")))
    return rows.select(*((text if c == text_col else row[c]).alias(c) for c in df.columns))

"""Content hashes, similarities of hashes and vectors, simhash."""

from __future__ import annotations

import hashlib
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import _col, once, squeeze, strip


def comparable(c: Column | str) -> Column:
    """Lower case with single blanks: the form in which contents are compared."""
    return squeeze(F.lower(_col(c)))


def content_hash(c: Column | str, algorithm: str = "sha256") -> Column:
    """Hash of the comparable form; the empty text has the empty hash."""
    hashed = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256)}[algorithm]
    return once(comparable(F.coalesce(_col(c), F.lit(""))), lambda text: F.when(text == "", F.lit("")).otherwise(hashed(text)))


def joined_hash(*columns: Column | str) -> Column:
    """SHA-256 of the non-empty columns joined by a space."""
    return F.sha2(F.concat_ws(" ", *(F.nullif(_col(c), F.lit("")) for c in columns)), 256)


def hex_similarity(a: Column | str, b: Column | str) -> Column:
    """One minus the share of differing digits over four times the length; in [0.75, 1] by construction."""
    left, right = _col(a), _col(b)
    differing = F.size(F.filter(F.zip_with(F.split(left, ""), F.split(right, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(left) == F.length(right), 1 - differing / (4.0 * F.length(left))).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; 1 if both are 0, 0 if one is."""
    least, most = F.least(a, b), F.greatest(a, b)
    return F.when(most == 0, 1.0).otherwise(least / F.nullif(most, F.lit(0)))


def structure_class(length: Column) -> Column:
    """S, M or L: the class of a single line by its length (fixed bounds 20 and 100)."""
    return F.when(length <= 20, "S").when(length <= 100, "M").otherwise("L")


def structure_similarity(a: Column, b: Column) -> Column:
    """1 for equal classes, else the sequence ratio of the MD5 digits of the two, which is a constant of each pair."""
    digits = {c: hashlib.md5(c.encode()).hexdigest() for c in "SML"}
    out = F.when(a == b, 1.0)
    for x in digits:
        for y in digits:
            if x != y:
                out = out.when((a == x) & (b == y), SequenceMatcher(None, digits[x], digits[y]).ratio())
    return out.otherwise(0.0)


def structure(c: Column | str) -> Column:
    """The classes of the lines that aren't blank, in order, as one string."""
    lines = F.filter(F.transform(F.split(_col(c), "\n"), strip), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: structure_class(F.length(x))), "")


def fingerprint(content: Column | str, title: Column | str | None = None, algorithm: str = "sha256") -> Column:
    """What a document is compared by: hashes of content and title, length, words, first and last 100 characters and structure of the comparable form."""
    title = F.lit(None).cast("string") if title is None else _col(title)
    return once(
        comparable(F.coalesce(_col(content), F.lit(""))),
        lambda t: F.struct(
            content_hash(t, algorithm).alias("content_hash"),
            F.when(F.nullif(title, F.lit("")).isNotNull(), content_hash(title, algorithm)).alias("title_hash"),
            F.length(t).alias("content_length"),
            F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).alias("word_count"),
            F.left(t, F.lit(100)).alias("first_line"),
            F.right(t, F.lit(100)).alias("last_line"),
            structure(t).alias("structure"),
        ),
    )


#: The named thresholds of similarity.
THRESHOLDS = {"very_strict": 0.95, "strict": 0.90, "normal": 0.85, "loose": 0.80, "very_loose": 0.75}


def threshold(value: float | str) -> float:
    """A threshold by name or number; outside the named ones it is refused."""
    number = THRESHOLDS[value] if isinstance(value, str) else value
    if not THRESHOLDS["very_loose"] <= number <= THRESHOLDS["very_strict"]:
        raise ValueError(f"a threshold lies from {THRESHOLDS['very_loose']} to {THRESHOLDS['very_strict']}: {value!r}")
    return number


#: How much the hash counts in the weighted score, and each of length, words and structure.
WEIGHTS = (0.4, 0.2)


def composite_similarity(hash_similarity: Column, lengths: Column, words: Column, structure: Column) -> Column:
    """The weighted score of the reference semantics: 0.4 hash, 0.2 each for length, words and structure."""
    return 0.4 * hash_similarity + 0.2 * lengths + 0.2 * words + 0.2 * structure


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 for different lengths, nulls and zero vectors."""
    left, right = _col(a), _col(b)
    length = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(F.size(left) == F.size(right), F.coalesce(F.try_divide(dot(left, right), length), F.lit(0.0))).otherwise(0.0)


def simhash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and a 64-bit simhash over words weighted by their count. Words are counted bit by bit where they stand, so a row moves for each document, not for each of its words."""
    words = df.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?U)\b\w+\b"), F.lit(0))).alias("word"))
    hashed = words.select("id", F.xxhash64("word").alias("h"))
    # Two counts of 32 bits a number: bit ``b`` below, bit ``b + 32`` above.
    sums = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1 << 32 | 1))).alias(f"b{b}") for b in range(32)]
    voted = hashed.groupBy("id").agg(F.count("*").alias("n"), *sums)
    value = F.lit(0).cast("long")
    for b in range(32):
        for bit, ones in ((b, F.col(f"b{b}").bitwiseAND(F.lit((1 << 32) - 1))), (b + 32, F.shiftrightunsigned(f"b{b}", 32))):
            value = value.bitwiseOR(F.when(2 * ones > F.col("n"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return voted.select(F.col("id").alias(id_col), value.alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

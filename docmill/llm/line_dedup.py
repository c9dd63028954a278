"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if the same line, or one within its edit bound, stands earlier in the corpus, in the order
of document id and line number. The edit bound follows from the length: one edit (a character put in,
left out or changed) where both lines have ``least_chars`` code points or more, none for shorter lines,
which go as exact copies only. Lines without a word stay: they are what parts paragraphs.

Copies of a line are pre-aggregated to their first occurrence. Two distinct lines within one edit have
an equal first or second half of the shorter one's length, so a key for each half, counted over all
lines, tells which lines can have a partner at all; the same is then asked of what is outside each of a line's blocks.
The others emit nothing more. For the rest every
deletion variant is emitted as a hashed key. Lines whose variants agree after deletion at the same
place, or a line and the variants that equal it, are within one edit of each other, so each key needs
only its earliest line and no pairs within a key; a key has at most as many lines as the alphabet
offers. The edit distance of a match is then verified on the texts: they have to be equal but for the deleted
place, which takes time in proportion to the line, however long it is. A line that a third of all documents hold
is one row from the first aggregate on; only its later copies are joined back, which AQE splits.

The variant of a long line is hashed in two steps, what is outside a block of about the root of its
length and what is inside it, so that a line of n characters costs n * sqrt(n) and not n * n.

Defined cases: a null text has no lines and stays null; lines without a word stay; rows that repeat a document
(the same id and text) count as one document and get the same result; null ids come first in the order;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize

#: Code points from which the edit bound is one.
LEAST_CHARS = 32
#: A line with a word: any character other than ASCII blanks.
WORD = "[^ \\t-\\r]"


def half_keys() -> str:
    """For both roles, as long as the partner or one longer: the halves outside which an edit would lie."""
    roles = [(least, f"int(floor(({least}) / 2))") for least in ("chars", "chars - 1")]
    return "array(" + ", ".join(f"xxhash64(0, {n}, left(line, {half})), xxhash64(1, {n}, right(line, {half}))" for n, half in roles) + ")"


def occurrences(df: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """id, doc (a key of the row), line_no, key, check, halves (null under ``least_chars``) and line of every line with a word."""
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(WORD)).withColumn("chars", F.length("line"))
    halves = F.when(F.col("chars") >= least_chars, F.expr(half_keys()))
    return lines.select("id", "doc", "line_no", F.xxhash64("line").alias("key"), F.hash("line").alias("check"), halves.alias("halves"), "line")


def with_partners(seen: DataFrame) -> DataFrame:
    """key and check of the distinct lines that share a half with another distinct line."""
    halves = seen.select("key", "check", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high").select("half")
    return halves.join(shared, "half").select("key", "check").distinct()


def blocks(least: str, more: int) -> str:
    """Blocks of about the root of the length: number, hash of what is outside, and the block itself."""
    width = f"int(ceil(sqrt({least}) / 8) * 8)"
    parts = f"b AS b, b * {width} AS base, xxhash64(left(line, b * {width}), substring(line, (b + 1) * {width} + {more + 1})) AS rest, substring(line, b * {width} + 1, {width} + {more}) AS part"
    return f"transform(sequence(0, int(floor(({least} - 1) / {width}))), b -> struct({parts}))"


def agreeing(lines: DataFrame) -> DataFrame:
    """The lines that agree with another one, as long or one longer, outside some block: an edit lies in one block."""
    keys = [f"transform({blocks(least, more)}, x -> xxhash64({least}, x.b, x.rest))" for least, more in (("chars", 0), ("(chars - 1)", 1))]
    each = lines.select("key", F.explode(F.expr(f"concat({', '.join(keys)})")).alias("outside"))
    met = each.groupBy("outside").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high").select("outside")
    return lines.join(each.hint("merge").join(met, "outside").select("key").distinct(), "key", "left_semi")


def variants(lines: DataFrame) -> DataFrame:
    """A row for each deletion variant of each line and its place (from 0); ``role`` is 0 for a change, 1 for the shorter and 2 for the longer line of an insertion.

    Blocks become rows first, so no array is longer than a block.
    """
    places, cut = "sequence(0, length(x.part) - 1)", "concat(left(x.part, i), substring(x.part, i + 2))"
    changed = f"transform({places}, i -> struct(xxhash64(0, chars, x.b, i, x.rest, {cut}) AS variant, 0 AS role, x.base + i AS place))"
    shorter = "array(struct(xxhash64(1, chars, x.b, x.rest, x.part) AS variant, 1 AS role, x.base AS place))"
    longer = f"transform({places}, i -> struct(xxhash64(1, chars - 1, x.b, x.rest, {cut}) AS variant, 2 AS role, x.base + i AS place))"

    def each(least: str, more: int, made: str) -> DataFrame:
        parts = lines.select("key", "chars", F.explode(F.expr(blocks(least, more))).alias("x"))
        return parts.select("key", F.explode(F.expr(made)).alias("v")).select("key", "v.variant", "v.role", "v.place")

    return each("chars", 0, f"concat({changed}, {shorter})").union(each("(chars - 1)", 1, longer))


def near_lines(seen: DataFrame, occ: DataFrame) -> DataFrame:
    """key and check of the distinct lines that have an earlier line within one edit."""
    firsts = seen.join(with_partners(seen), ["key", "check"], "left_semi").select("key", "check", "first")
    # Copies have one text, so any occurrence gives it: neither ids nor places are moved with the lines.
    lines = occ.where("halves IS NOT NULL").select("key", "check", "line").join(firsts.select("key", "check"), ["key", "check"], "left_semi")
    able = lines.groupBy("key", "check").agg(F.first("line").alias("line")).join(firsts, ["key", "check"]).withColumn("chars", F.length("line"))
    texts = materialize(agreeing(materialize(able, "able")), "texts")
    rows = variants(texts)
    met = rows.groupBy("variant").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high").select("variant")
    # Spark takes exploded rows to be as small as the lines that they come from, and must not broadcast them.
    rows = materialize(rows.hint("merge").join(met, "variant"), "variants").join(texts.select("key", "first"), "key")
    one = F.struct("first", "key", "place")
    best = rows.groupBy("variant").agg(*(F.min(F.when(F.col("role") == r, one)).alias(f"best{r}") for r in range(3)))
    other = F.when(F.col("role") == 0, F.col("best0")).when(F.col("role") == 1, F.col("best2")).otherwise(F.col("best1"))
    place = F.when(F.col("role") == 1, F.col("other.place")).otherwise(F.col("place"))  # where the longer line has more
    found = rows.join(best, "variant").withColumn("other", other).where("other.first < first").select("key", F.col("other.key").alias("other_key"), "role", place.alias("place")).distinct()
    left, right = texts.select("key", "check", "line"), texts.select(F.col("key").alias("other_key"), F.col("line").alias("other_line"))
    without = lambda c: f"concat(left({c}, place), substring({c}, place + 2))"
    same = f"CASE role WHEN 0 THEN length(line) = length(other_line) AND {without('line')} = {without('other_line')} WHEN 1 THEN line = {without('other_line')} ELSE {without('line')} = other_line END"
    verified = found.join(left, "key").join(right, "other_key").where(f"line != other_line AND {same}")
    return verified.select("key", "check").distinct()


def drops(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """id, doc and ``dropped``, the numbers (from 0) and kinds (``exact``, ``near``) of the lines to drop, of documents that lose any."""
    occ = occurrences(df, id_col, text_col, least_chars)
    here = F.struct("id", "line_no", "doc")
    seen = materialize(occ.groupBy("key", "check").agg(F.min(here).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")), "lines")
    near = materialize(near_lines(seen, occ), "near").withColumn("near", F.lit(True))
    marked = seen.join(near, ["key", "check"], "left").where("n > 1 OR near").select("key", "check", "first", F.coalesce("near", F.lit(False)).alias("near"))
    kind = F.when(here != F.col("first"), "exact").when(F.col("near"), "near")
    hit = occ.join(marked, ["key", "check"]).withColumn("kind", kind).where("kind IS NOT NULL")
    return hit.groupBy("id", "doc").agg(F.array_sort(F.collect_set(F.struct("line_no", "kind"))).alias("dropped"))


def joined_drops(df: DataFrame, id_col: str, text_col: str, least_chars: int, *columns: F.Column) -> DataFrame:
    """The given columns of ``df`` and ``_dropped`` (null: nothing) of every row."""
    lost = drops(df, id_col, text_col, least_chars).select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), F.col("dropped").alias("_dropped"))
    rows = df.select(*columns, F.col(id_col).alias("_own"), F.xxhash64(id_col, text_col).alias("_key"))
    return rows.join(lost, (F.col("_key") == F.col("_doc")) & F.col("_own").eqNullSafe(F.col("_id")), "left").drop("_own", "_key", "_id", "_doc")


def line_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """id, n_lines, n_exact, n_near and ``dropped``, the numbers of the dropped lines joined by commas, of every document."""
    rows = joined_drops(df, id_col, text_col, least_chars, F.col(id_col), F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).alias("n_lines"))
    of = lambda kind: F.coalesce(F.size(F.filter("_dropped", lambda d: d["kind"] == kind)), F.lit(0)).cast("long")
    numbers = F.array_join(F.transform("_dropped", lambda d: d["line_no"].cast("string")), ",")
    return rows.select(id_col, F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), of("exact").alias("n_exact"), of("near").alias("n_near"), F.coalesce(numbers, F.lit("")).alias("dropped"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``df`` with the kept lines of each text; documents of which no word is left go."""
    row = F.col("row")
    rows = joined_drops(df, id_col, text_col, least_chars, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    kept = F.filter(F.split(row[text_col], "\n"), lambda _, i: ~F.array_contains(F.transform("_dropped", lambda d: d["line_no"]), i))
    text = F.when(F.col("_dropped").isNull(), row[text_col]).otherwise(F.array_join(kept, "\n"))
    left = rows.withColumn("_text", text).where(F.col("_dropped").isNull() | F.col("_text").rlike(WORD))
    return left.select(*((F.col("_text") if c == text_col else row[c]).alias(c) for c in df.columns))

"""Filter interaction audit: what each filter of a list removes, alone and after the others, in every order.

A document's failures are one bit mask. All that is asked of an order follows from how many documents of a part
have each mask, so documents are read once, masks are counted with partial sums, and the orders are worked out on
counts: a step depends on its filter and on the set of filters before it, not on their order, so 5 filters need
80 sums a part for their 120 orders. Over all orders a filter is the first of a document's m failures in one of m,
which gives its Shapley sum from the same counts.

Copies are found by partition refinement. Texts of equal code-point length are one class; a class is split
by the hash of the first block of its texts, then of the next, longer block and so on, and a class that is left with one
row drops out. Block hashes are taken in the one scan, so the rounds move ids and hashes only. What survives
all blocks is compared as whole texts: copies are pre-aggregated to one text a task before they move, and a class
whose hashes agree although its texts don't is told apart by the text itself.

Defined cases: a null text is the empty one, a null part the empty string. Of equal texts the rows with the smallest id
stay, also if that id stands several times; a row with a null id isn't a copy of any other and makes no other a copy.
A document with several labels is good, or toxic, if any of them says so; labels without an id count nowhere.
An empty table has no parts and an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize, text_or_empty

#: Code points of the first block, and how many times longer each next one is. Seven blocks hold any text.
BLOCK, GROWTH, BLOCKS = 256, 16, 7


def block_hashes(text: Column) -> Column:
    """The hash of each block that the text reaches, in order."""
    starts = [BLOCK * (GROWTH**k - 1) // (GROWTH - 1) for k in range(BLOCKS)]
    return F.array_compact(F.array(*(F.when(F.length(text) > s, F.xxhash64(F.substring(text, s + 1, min(BLOCK * GROWTH**k, 2**31 - 1)))) for k, s in enumerate(starts))))


def text_class(length: Column, hashes: Column, bits: int = 64) -> Column:
    """The class after all blocks: the length's hash, refined by one block after the other."""
    return F.aggregate(hashes, narrowed(F.xxhash64(length), bits), lambda c, h: narrowed(F.xxhash64(c, h), bits))


def narrowed(value: Column, bits: int) -> Column:
    """The low ``bits`` of a hash; fewer than 64 make collisions likely, for tests."""
    return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1))


def surviving(rows: DataFrame, bits: int = 64) -> DataFrame:
    """id and class of the rows (id, length, hashes) that share their class with another one after each block."""
    rounds = rows.agg(F.coalesce(F.max(F.size("hashes")), F.lit(0))).first()[0]
    alive = rows.where("id IS NOT NULL").select("id", "hashes", narrowed(F.xxhash64("length"), bits).alias("class"))
    for k in range(rounds + 1):
        if k:
            alive = alive.withColumn("class", F.when(F.size("hashes") >= k, narrowed(F.xxhash64("class", F.get("hashes", F.lit(k - 1))), bits)).otherwise(F.col("class")))
        several = alive.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        alive = materialize(alive.join(several, "class", "left_semi"), "alive")
    return alive.select("id", "class")


def with_first(rows: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``rows`` (id, length, hashes and more, one for each row of ``df``) with ``first``, the smallest id of an equal text; null where no other row has the text."""
    alive = surviving(rows, bits)
    # Merged at every size: the ids grow with the table, so they aren't sent to every task.
    texts = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).hint("merge").join(alive.select("id").distinct().hint("merge"), "id", "left_semi")
    whole = texts.select("id", "text", text_class(F.length("text"), block_hashes(F.col("text")), bits).alias("class"))
    by_text = whole.groupBy("class", "text").agg(F.min("id").alias("first"))
    found = materialize(by_text.groupBy("class").agg(F.min("first").alias("first"), F.count("*").alias("texts")), "classes")
    out = rows.withColumn("class", text_class(F.col("length"), F.col("hashes"), bits)).join(found.where("texts = 1").drop("texts"), "class", "left")
    collided = found.where("texts > 1").select("class")
    if not collided.isEmpty():
        apart = whole.join(collided, "class", "left_semi")
        told = apart.join(apart.groupBy("class", "text").agg(F.min("id").alias("own")), ["class", "text"]).groupBy("id", "class").agg(F.min("own").alias("own"))
        out = out.join(told, ["id", "class"], "left").withColumn("first", F.coalesce("first", "own")).drop("own")
    return out.drop("class", "length", "hashes")


def standard_filters(text: str = "text") -> dict[str, Column]:
    """The measured filters by letter, true where a document fails: words, distinct words, capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size("words")
    return {
        "words": words,
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", bits: int = 64) -> DataFrame:
    """id, part and mask of every row: bit 0 is set where filter A fails, bit 4 where E does, the copy of a text of a smaller id."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text"))
    filters = standard_filters()
    held = rows.withColumn("words", filters.pop("words"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    measured = materialize(held.select("id", "part", mask.alias("mask"), F.length("text").alias("length"), block_hashes(F.col("text")).alias("hashes")), "measures")
    marked = with_first(measured, df, id_col, text_col, bits)
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return marked.select(F.col("id").alias(id_col), "part", F.when(copy, F.col("mask") + (1 << len(filters))).otherwise(F.col("mask")).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``masks`` with ``good`` and ``toxic``, 1 where a label of the row's id says so."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"is_{c}")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(flag("quality"), flag("toxic"))
    both = masks.join(known, id_col, "left")
    return both.select(id_col, "part", "mask", F.coalesce("is_quality", F.lit(0)).alias("good"), F.coalesce("is_toxic", F.lit(0)).alias("toxic"))


def interactions(masks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of the filters; ``masks`` has part, mask, good and toxic, bit k standing for letter k."""
    bits = {letter: 1 << k for k, letter in enumerate(letters)}
    before = {(letter, sum(bits[x] for x in order[:at])) for order in permutations(letters) for at, letter in enumerate(order)}
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    steps = F.array(*(F.struct(F.lit(letter).alias("letter"), F.lit(bits[letter]).alias("bit"), F.lit(earlier).alias("earlier")) for letter, earlier in sorted(before)))
    each = cells.select("*", F.explode(steps).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, gone = F.expr("mask & bit") != 0, F.expr("mask & earlier") != 0
    counted = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")
    sums = each.groupBy("part", "letter", "earlier").agg(
        counted(~fails & ~gone).alias("kept"),
        counted(fails & ~gone).alias("removed"),
        counted(fails & gone).alias("redundant"),
        counted(F.col("mask") == F.col("bit")).alias("unique_fails"),
        counted(fails & ~gone, "good").alias("good_lost"),
        counted(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr(f"{factorial(len(letters))} div bit_count(mask)")).otherwise(0)).cast("long").alias("shapley"),
    )
    orders = [("".join(order), at + 1, letter, sum(bits[x] for x in order[:at])) for order in permutations(letters) for at, letter in enumerate(order)]
    table = masks.sparkSession.createDataFrame(orders, "filter_order string, step int, letter string, earlier int")
    # A row for each order and step, whatever the documents.
    named = sums.join(F.broadcast(table), ["letter", "earlier"])
    return named.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of the standard filters and copies over all documents."""
    return interactions(labelled(failures(df, id_col, text_col, part_col), labels, id_col))

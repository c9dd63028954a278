"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its word shingles. Equal sets are one node from the start, so exact copies cost
nothing. Each tree of the forest is another order of the signature; nodes that share a tree's first
``LEAST_DEPTH`` values are a region, sorted by the rest of that order, in which neighbours have the
longest common prefixes. A region with too many nodes goes one value deeper, again and again; what is
still too large at full depth holds all but equal sets, and is cut into chunks that are linked through
their first nodes. Candidates are the sorted neighbours and the first node of a region, so they grow
in proportion to the nodes, never with the square of a group. Every candidate is confirmed on full sets.
Where a region then still holds several components, each node meets the last one before it of another
component, and the most linked nodes of components that follow each other meet: again a candidate or two
a node. What still isn't one component goes the exact way: all nodes that share a region at least depth
with a node of another component, whatever its size, meet by a prefix filter on their rarest shingles that divides
large buckets again, and these candidates are confirmed on full sets without a look at signatures.

Links are transitive: a document's component is named by the smallest id reachable. With 16 trees of
least depth 3 two sets of similarity 0.8 share no region with probability (1 - 0.8 ** 3) ** 16, 1e-5.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; with fewer words
than a shingle the whole sequence is one shingle; rows with a null id link with nothing; repeated rows
get the same component; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import SLICE_BYTES, by_bytes, materialize, text_or_empty
from docmill.llm.graph import components

TREES, LEAST_DEPTH, MOST_DEPTH = 16, 3, 8
#: Nodes of a region above which it goes deeper, and of a chunk at full depth.
REGION = 1000
#: Nodes of a bucket of the exact way that meet each other directly, and how often larger ones are divided.
MEET, LEVELS = 8, 16
#: The average similarity in a bucket from which on it isn't divided, and the values of signatures that tell it.
ALIKE, FEW = 0.6, 4
VALUES = TREES * LEAST_DEPTH
#: Words of the filter that is broadcast before rows are looked up by id, about 6 MB.
FILTER_WORDS = 1 << 18
#: Values of ``VALUES`` in which two signatures agree at least before full sets are read; at similarity 0.8 fewer agree once in 100,000 pairs.
LEAST_AGREED = 26
#: Odd factors and additions of the hash functions, from a fixed seed.
_draw = np.random.default_rng(20240229)
FACTORS = _draw.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 2**63, VALUES, dtype=np.uint64)
PLACES = _draw.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text; A-Z in lower case, split at ASCII blanks."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(words):
        return hashes
    width = min(width, len(words))
    rows = len(words) - width + 1
    total = np.full(rows, np.uint64(width))
    for k in range(width):
        total += hashes[k : k + rows] * PLACES[k]
    return np.unique(mixed(total))


def signature(items: np.ndarray) -> bytes:
    """``VALUES`` minima of 32 bits, high byte first so that bytes sort as numbers."""
    least = np.full(VALUES, np.uint64(2**32 - 1))
    for at in range(0, len(items), 8192):
        block = items[at : at + 8192]
        least = np.minimum(least, ((block[None, :] * FACTORS[:, None] + TERMS[:, None]) >> np.uint64(32)).min(axis=1))
    return least.astype(">u4").tobytes()


def set_id(items: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(items.tobytes())).astype(np.int64))


def signatures(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_id (null without shingles) and the signature of each row."""
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def work(batches):
        for batch in batches:
            for at, end in by_bytes(batch.column(1), SLICE_BYTES):
                part = batch.slice(at, end - at)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                    ["id", "n_shingles", "set_id", "signature"],
                )

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, set_id long, signature binary")


def full_sets(df: DataFrame, width: int, text_col: str) -> DataFrame:
    """set_id and the whole set, packed, of each row."""

    def work(batches):
        for batch in batches:
            for at, end in by_bytes(batch.column(0), SLICE_BYTES):
                sets = [s for t in batch.column(0).slice(at, end - at).to_pylist() if len(s := shingles(t, width))]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "items"])

    return df.select(text_or_empty(text_col).alias("text")).mapInArrow(work, "set_id long, items binary")


def holding(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is in ``ids`` (distinct). Only rows move whose bit is set in a table of ``FILTER_WORDS`` words of 64 bits at most."""
    h = F.xxhash64(column)
    at = {"word": F.pmod(h, F.lit(FILTER_WORDS)).cast("int"), "bit": F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))}
    words = ids.select(*(c.alias(f"_{n}") for n, c in at.items())).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    likely = rows.join(F.broadcast(words), at["word"] == F.col("_word")).where(F.col("_bits").bitwiseAND(at["bit"]) != 0)
    return likely.select(*rows.columns).join(ids, column, "left_semi")


def regions(nodes: DataFrame) -> DataFrame:
    """set_id, n_shingles, tree, order, base (the region at least depth), region and chunk: each node once in each tree."""
    order = F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(t AS tree, substring(concat(signature, signature), t * {4 * LEAST_DEPTH} + 1, {4 * MOST_DEPTH}) AS order))")
    rows = nodes.select("set_id", "n_shingles", F.explode(order).alias("at")).select("set_id", "n_shingles", "at.tree", "at.order")
    key = lambda depth: F.xxhash64("tree", F.substring("order", 1, 4 * depth))
    rows = rows.withColumn("base", key(LEAST_DEPTH)).withColumn("region", F.col("base"))

    def crowded() -> DataFrame:
        return materialize(rows.groupBy("region").agg(F.count("*").alias("crowd")).where(F.col("crowd") > REGION), "crowded")

    for depth in range(LEAST_DEPTH + 1, MOST_DEPTH + 1):
        over = crowded()
        if over.isEmpty():
            return rows.withColumn("chunk", F.lit(0).cast("long"))
        rows = rows.join(over, "region", "left").withColumn("region", F.when(F.col("crowd").isNotNull(), key(depth)).otherwise(F.col("region"))).drop("crowd")
    chunks = F.ceil(F.coalesce("crowd", F.lit(1)) / REGION)
    return rows.join(crowded(), "region", "left").withColumn("chunk", F.pmod(F.xxhash64("set_id"), chunks)).drop("crowd")


def crowds(nodes: DataFrame) -> DataFrame:
    """The rows whose region at least depth holds two nodes or more."""
    rows = regions(nodes)
    shared = rows.groupBy("base").agg(F.count("*").alias("n")).where("n > 1").select("base")
    return rows.join(shared, "base").select("base", "region", "chunk", "order", F.struct("set_id", "n_shingles").alias("it"))


def as_pairs(found: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of ``it`` and ``with`` whose sizes allow the similarity."""
    small, large = F.least("it.n_shingles", "with.n_shingles"), F.greatest("it.n_shingles", "with.n_shingles")
    able = found.where((F.col("it.set_id") != F.col("with.set_id")) & (100 * small >= percent * large))
    return able.select(F.least("it.set_id", "with.set_id").alias("a"), F.greatest("it.set_id", "with.set_id").alias("b")).distinct()


def first_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """Sorted neighbours, and each node with the first of its region."""
    place = Window.partitionBy("region", "chunk")
    rows = crowd.select("region", "chunk", "it", F.lag("it").over(place.orderBy("order", "it")).alias("before"), F.min("it").over(place).alias("first"))
    firsts = rows.groupBy("region", "chunk").agg(F.min("first").alias("it"))
    heads = firsts.groupBy("region").agg(F.min("it").alias("with"), F.count("*").alias("n")).where("n > 1").select("region", "with")
    across = firsts.join(heads, "region").select("it", "with")
    within = rows.where(F.col("before").isNotNull()).select("it", F.explode(F.array("before", "first")).alias("with"))
    return as_pairs(within.union(across), percent)


def later_pairs(crowd: DataFrame, roots: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """In regions with nodes of several components: each node with the last one before it of another component, and the most linked node of each component with that of the next one."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    known = roots.join(degrees, "node", "left")
    rows = crowd.join(known, F.col("it.set_id") == F.col("node"), "left").select(
        "region", "chunk", "order", "it", F.coalesce("root", "it.set_id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree")
    )
    mixed_up = rows.groupBy("region", "chunk").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("region", "chunk")
    rows = materialize(rows.join(mixed_up, ["region", "chunk"]), "mixed")
    place = Window.partitionBy("region", "chunk")
    sorted_place = place.orderBy("order", "it")
    # Where the component changes, the row before is of another one, and stays the last such row until the next change.
    turn = rows.select("*", F.lag("root").over(sorted_place).alias("before_root"), F.lag("it").over(sorted_place).alias("before"))
    other = F.last(F.when(F.col("before_root") != F.col("root"), F.col("before")), ignorenulls=True).over(sorted_place)
    near = turn.select("it", other.alias("with")).where("with IS NOT NULL")
    best = rows.groupBy("region", "chunk", "root").agg(F.max(F.struct("degree", "it")).alias("best")).select("region", "chunk", "root", F.col("best.it").alias("it"))
    heads = best.select("it", F.lag("it").over(place.orderBy("root")).alias("with")).where("with IS NOT NULL")
    return as_pairs(near.union(heads), percent)


def unsettled(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """set_id, n_shingles and root of the nodes of regions at least depth that hold several components."""
    rows = crowd.join(roots, F.col("it.set_id") == F.col("node"), "left").select("base", "it.set_id", "it.n_shingles", F.coalesce("root", "it.set_id").alias("root"))
    several = rows.groupBy("base").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("base")
    return rows.join(several, "base").select("set_id", "n_shingles", "root").distinct()


def grouped_items(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id, group and weight: the items of each node that others hold too. Items with the same holders are one group, so a passage of a template is one."""

    def unpacked(batches):
        for batch in batches:
            for at, end in by_bytes(batch.column(1), SLICE_BYTES):
                part = batch.slice(at, end - at)
                items = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.list_(pa.int64()))], ["set_id", "items"])

    whole = sets.join(nodes, "set_id", "left_semi").dropDuplicates(["set_id"]).select("set_id", "items")
    each = whole.mapInArrow(unpacked, "set_id long, items array<long>").select("set_id", F.explode("items").alias("item"))
    held = each.groupBy("item").agg(F.count("*").alias("holders"), F.bit_xor(F.xxhash64("set_id")).alias("mark")).where("holders > 1")
    held = materialize(held.select("item", F.xxhash64("holders", "mark").alias("group")), "holders")
    # Spark takes exploded rows to be as small as the sets that they come from, and must not broadcast them.
    return materialize(each.hint("merge").join(held, "item").groupBy("set_id", "group").agg(F.count("*").alias("weight")), "groups")


def placed_groups(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """For each bucket of ``rows`` (bucket, set_id, n_shingles, root, n_groups) and node: child, place and core of the groups in its prefix, with the weight of the bucket's core and its least node.

    In a bucket groups are in the order of how many of its nodes hold them, so what a node has alone comes first and what all
    hold, the core, last. A child is the set of nodes that hold a group, whatever the path to it.
    """
    local = materialize(rows.join(groups, "set_id"), "local")
    mark = F.bit_xor(F.xxhash64("set_id"))
    held = local.groupBy("bucket", "group").agg(F.count("*").alias("holders"), mark.alias("mark"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("n_shingles", "set_id")).alias("least"))
    known = held.join(sizes, "bucket").select("bucket", "group", "holders", F.xxhash64("holders", "mark").alias("child"), (F.col("low") != F.col("high")).alias("several"), (F.col("holders") == F.col("size")).alias("core"), "least")
    node = Window.partitionBy("bucket", "set_id")
    before = F.sum("weight").over(node.orderBy("holders", "group")) - F.col("weight")
    each = local.join(known, ["bucket", "group"]).withColumns({"place": F.col("n_shingles") - F.sum("weight").over(node) + before + 1, "core_weight": F.sum(F.when(F.col("core"), F.col("weight")).otherwise(0)).over(node)})
    inside = F.expr(f"place <= n_shingles + 1 - ({percent} * n_shingles + 99) div 100")
    return each.where(inside & F.col("several")).select("bucket", "set_id", "n_shingles", "root", "n_groups", "child", "place", "core", "core_weight", "least")


def met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different roots within each bucket that can have the similarity, by size and by the place of what they share. Nodes of ``most``, a bucket's commonest root, don't meet each other."""
    rows = materialize(rows.withColumn("often", F.col("root") == F.col("most")).drop("most"), "shared")
    short = rows.where(f"(n_shingles + 1 - place) * {100 + percent} >= {2 * percent} * n_shingles")
    s, t = (F.struct("n_shingles", "set_id", "place", "root").alias(c) for c in "st")
    meets = F.explode(F.when(F.col("often"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("often")
    able = (F.struct("s.n_shingles", "s.set_id") < F.struct("t.n_shingles", "t.set_id")) & (F.col("s.root") != F.col("t.root")) & F.expr(f"100 * s.n_shingles >= {percent} * t.n_shingles")
    left = F.least(F.expr("s.n_shingles - s.place"), F.expr("t.n_shingles - t.place"))
    able &= (1 + left) * (100 + percent) >= percent * (F.col("s.n_shingles") + F.col("t.n_shingles"))
    both = short.select("bucket", meets, s).hint("merge").join(rows.select("bucket", "often", t), ["bucket", "often"]).where(able)
    return both.select(F.least("s.set_id", "t.set_id").alias("a"), F.greatest("s.set_id", "t.set_id").alias("b"))


def alike(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """bucket and ``likeness``: about how similar two nodes of it are on average, by how often they agree in a few values of their signatures."""
    few = F.array(*(F.struct(F.lit(j).alias("j"), F.substring("signature", 4 * j + 1, 4).alias("value")) for j in range(FEW)))
    each = rows.select("bucket", "set_id").join(nodes.select("set_id", F.explode(few).alias("x")), "set_id")
    counts = each.groupBy("bucket", "x").agg(F.count("*").cast("double").alias("n"))
    return counts.groupBy("bucket").agg((FEW * F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("likeness"))


def exact_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b that can have the similarity, enough to link whatever is linked, by a prefix filter that divides large buckets again.

    In a common order of items, two sets with an overlap of o hold their first common item at place a - o + 1
    and b - o + 1 at most, so linked nodes meet in the bucket of a group in both prefixes. A bucket whose nodes meet
    no more others of another root than they have groups is joined. A larger one is a smaller problem of the same kind: its nodes are ordered by what is
    rare in it and meet in buckets of their own, each smaller than it. That pays where nodes are unlike each other, as texts of one template with
    other fillings are; where they are ``ALIKE`` all buckets would hold about the same nodes, which are joined. Where the first common group is the core, which all its nodes hold, the
    overlap is the weight of the core, and sizes alone tell what is linked: each node with the bucket's least, or not at all.
    Buckets of one root are done. So what a node meets of unlike texts is bounded by its own shingles, however many share a template.
    """
    groups = grouped_items(nodes, sets)
    counted = nodes.select("set_id", "n_shingles", "root").join(groups.groupBy("set_id").agg(F.count("*").alias("n_groups")), "set_id")
    rows, found = counted.withColumn("bucket", F.lit(0).cast("long")), []
    for level in range(1, LEVELS + 1):
        placed = materialize(placed_groups(rows, groups, percent), "placed")
        stars = placed.where(F.col("core") & F.expr(f"(n_shingles + least.n_shingles) * {percent} <= {100 + percent} * core_weight") & F.expr("set_id != least.set_id"))
        found.append(stars.select(F.least("set_id", "least.set_id").alias("a"), F.greatest("set_id", "least.set_id").alias("b")))
        first = (F.first(c).alias(c) for c in ("n_shingles", "root", "n_groups"))
        children = placed.where("NOT core").groupBy(F.col("child").alias("bucket"), "set_id").agg(F.min("place").alias("place"), *first)
        children = materialize(children, "children")
        roots = children.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("n_groups").alias("entries"))
        sizes = roots.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top"), F.sum("entries").alias("entries")).where("roots > 1")
        others = F.col("size") - F.col("top.n")
        large = (others > MEET) & (others * F.col("size") > 2 * F.col("entries")) if level < LEVELS else F.lit(False)
        sizes = materialize(sizes.select("bucket", F.col("top.root").alias("most"), large.alias("large")), "sizes")
        if not sizes.where("large").isEmpty():
            near = alike(children.join(sizes.where("large"), "bucket", "left_semi"), nodes)
            sizes = materialize(sizes.join(near, "bucket", "left").select("bucket", "most", (F.col("large") & (F.col("likeness") < ALIKE)).alias("large")), "sizes")
        found.append(met(children.join(sizes.where("NOT large").select("bucket", "most"), "bucket"), percent))
        if sizes.where("large").isEmpty():
            break
        rows = materialize(children.join(sizes.where("large"), "bucket", "left_semi").drop("place"), "buckets")
    return reduce(DataFrame.union, found).distinct()


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in ``LEAST_AGREED`` values or more."""

    @F.pandas_udf("boolean")
    def near(left: pd.Series, right: pd.Series) -> pd.Series:
        agreed = [(np.frombuffer(x, ">u4") == np.frombuffer(y, ">u4")).sum() >= LEAST_AGREED for x, y in zip(left, right)]
        return pd.Series(agreed, dtype=bool)

    left, right = (nodes.select(F.col("set_id").alias(c), F.col("signature").alias(f"signature_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(near("signature_a", "signature_b")).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        def near(x: bytes, y: bytes) -> bool:
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(a) + len(b) - len(np.union1d(a, b))
            return 100 * both >= percent * (len(a) + len(b) - both)

        return pd.Series([near(x, y) for x, y in zip(left, right)], dtype=bool)

    left, right = (sets.select(F.col("set_id").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(linked("items_a", "items_b")).select("a", "b").distinct()


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and ``kept`` of every row."""
    rows = materialize(signatures(df, width, id_col, text_col), "signatures")
    usable = rows.where(F.col("set_id").isNotNull() & F.col("id").isNotNull())
    nodes = materialize(usable.groupBy("set_id").agg(F.min("id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "nodes")
    crowd = materialize(crowds(nodes), "crowd")
    needed = materialize(crowd.select("it.set_id").distinct().join(nodes, "set_id").select(F.col("least").alias("_id")).distinct(), "needed")
    texts = holding(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), needed, "_id")
    sets = materialize(full_sets(texts, width, "text"), "sets")
    tried = materialize(plausible(first_pairs(crowd, percent), nodes), "pairs")
    links = materialize(confirmed(tried, sets, percent), "links")
    roots = components(links)
    more = materialize(plausible(later_pairs(crowd, roots, links, percent).join(tried, ["a", "b"], "left_anti"), nodes), "pairs")
    found = materialize(confirmed(more, sets, percent), "links")
    if not found.isEmpty():
        links, tried = links.unionByName(found), tried.unionByName(more)
        roots = components(links)
    open_nodes = materialize(unsettled(crowd, roots).join(nodes.select("set_id", "signature"), "set_id"), "unsettled")
    if not open_nodes.isEmpty():
        found = materialize(confirmed(exact_pairs(open_nodes, sets, percent).join(tried, ["a", "b"], "left_anti"), sets, percent), "links")
        if not found.isEmpty():
            roots = components(links.unionByName(found))
    roots = roots.withColumnRenamed("node", "set_id")
    rooted = nodes.select("set_id", "least").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_id", "component_id")
    out = rows.drop("signature").join(named, "set_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def kept_documents(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document, that of the smallest id, of each component. Rows that share an id go or stay together."""
    gone = near_duplicates(df, width, percent, id_col, text_col).where("NOT kept").select(id_col).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)

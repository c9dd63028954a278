"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenized, those over the capacity are cut, and the pieces are counted by length. The
histogram has at most ``capacity`` entries whatever the size of the corpus, so the driver plans on
it: multiplicative weights price configurations of length classes by a knapsack dynamic program,
the fractional solution is rounded down, the last place of each configuration takes the longest piece
that fits, and the rest goes best-fit into what is free. The plan is a list of recipes (so many
sequences with these lengths); pieces find their place by their rank among the pieces of their
length, which is counted in salted groups so that a length held by a third of all rows isn't one task.

Defined cases: null and empty texts are one piece that holds the end token alone; repeated rows are
packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.bpe import encoder, in_merge_order
from docmill.llm.common import materialize, sliced, text_or_empty

#: Length classes of the linear program, its rounds and step, and the gap at which it ends.
CLASSES, ROUNDS, STEP, GAP = 128, 4000, 0.1, 0.01
#: Tokens that a rounded configuration may leave free; what doesn't get so close goes best-fit.
SLACK = 1
#: Multiples of the fractional solution that are rounded down.
SHARES = (1.0, 0.5, 0.2, 0.05)
#: Salted groups by which ranks are counted: about this many over all lengths, beside one for each length, and rows of a group.
RANK_GROUPS, LEAST_GROUP, MOST_GROUP = 4096, 64, 100_000


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)  # of the size of one vocabulary
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    end, by_rank = np.array([end_id], "<u4").tobytes(), in_merge_order(tokenizer)

    def work(batches):
        for batch in (part for b in batches for part in sliced(b)):
            owner, piece, start, length, crc = [], [], [], [], []
            for at, ids in enumerate(encoder(shared.value, by_rank).encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(at)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def price(values: np.ndarray, units: int) -> tuple[np.ndarray, float]:
    """The most valuable configuration: a knapsack over class sizes 1 to ``units`` by dynamic programming."""
    best, took = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        totals = best[room - 1 :: -1][:room] + values[:room]
        took[room] = at = int(totals.argmax())
        best[room] = totals[at]
    config, room = np.zeros(units, np.int64), units
    while room > 0:
        config[took[room]] += 1
        room -= took[room] + 1
    return config, float(best[units])


def fractional(demand: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used to cover ``demand``, by multiplicative weights."""
    units = len(demand)
    held = demand > 0
    if not held.any():
        return []
    need = np.where(held, demand, 1).astype(float)
    weights, covered = held.astype(float), np.zeros(units)
    used: dict[bytes, tuple[np.ndarray, float]] = {}
    bound = 0.0
    for _ in range(ROUNDS):
        values = np.where(held, weights / need, 0.0)
        config, value = price(values, units)
        config = np.where(held, config, 0)
        bound = max(bound, weights[held].sum() / value)
        took = config > 0
        step = STEP * (need[took] / config[took]).min()
        key = config.tobytes()
        used[key] = (config, used[key][1] + step if key in used else step)
        covered += config * step
        weights[took] *= np.exp(-config[took] * step / need[took])
        weights /= weights.max()
        least = (covered[held] / need[held]).min()
        if least > 0 and sum(x for _, x in used.values()) / least <= (1 + GAP) * bound:
            break
    least = (covered[held] / need[held]).min() or 1.0
    return [(config, x / least) for config, x in used.values()]


def class_of(length: int, width: int, units: int) -> int:
    """The nearest multiple of ``width``, from 0 for the first; places are filled by true lengths later."""
    return min(max(-(-(length - width // 2) // width), 1), units) - 1


class Histogram:
    """Counts of lengths, with the longest held length up to a bound."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v}
        self.lengths = sorted(self.counts)

    def longest(self, most: int) -> int:
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else 0

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Recipes: lengths of one sequence, and how many sequences are filled so. Each piece is used once.

    The fractional solution is rounded down from several of its multiples; the one with the fewest sequences stays.
    """
    width = -(-capacity // CLASSES)
    units = capacity // width
    demand = np.zeros(units, np.int64)
    for length, n in counts.items():
        if length < capacity:
            demand[class_of(length, width, units)] += n
    solution = sorted(fractional(demand), key=lambda x: -x[1])
    rounds = (rounded([(c, x * share) for c, x in solution], Histogram(counts), capacity, width, units) for share in SHARES)
    return min((best_fit(recipes, left, capacity) for recipes, left in rounds), key=lambda r: sum(n for _, n in r))


def rounded(solution: list[tuple[np.ndarray, float]], left: Histogram, capacity: int, width: int, units: int) -> tuple[list[tuple[tuple[int, ...], int]], Histogram]:
    """Whole sequences of the solution, and what is left of the histogram. The last place takes the longest piece that fits."""
    recipes: list[tuple[tuple[int, ...], int]] = []
    if full := left.counts.get(capacity):
        recipes.append(((capacity,), full))
        left.take(capacity, full)
    for config, times in solution:
        slots = [int(c) for c in np.repeat(np.arange(units), config)[::-1]]
        bins = int(times)
        while bins > 0:
            chosen, room, taken = [], capacity, {}
            for k, slot in enumerate(slots):
                last = k + 1 == len(slots)
                length = left.longest(room if last else min(room, (slot + 1) * width + width // 2))
                if not length or not last and class_of(length, width, units) != slot or taken.get(length, 0) >= left.counts[length]:
                    break
                chosen.append(length)
                taken[length] = taken.get(length, 0) + 1
                room -= length
            if len(chosen) < len(slots) or room > SLACK:
                break
            many = min(bins, *(left.counts[x] // n for x, n in taken.items()))
            for length, n in taken.items():
                left.take(length, n * many)
            recipes.append((tuple(chosen), many))
            bins -= many
    return recipes, left


def best_fit(recipes: list[tuple[tuple[int, ...], int]], left: Histogram, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each piece into the fullest sequence that has room."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(content: tuple[int, ...], n: int) -> None:
        room = capacity - sum(content)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((content, n))

    for content, n in recipes:
        put(content, n)
    for length in list(reversed(left.lengths)):
        n = left.counts[length]
        while n:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = min(n, capacity // length)
                put((length,) * each, n // each)
                n %= each
                continue
            room = rooms[at]
            content, many = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(n, room // length)
            used = min(many, n // each)
            put(content + (length,) * each, used)
            if many > used:
                put(content, many - used)
            n -= used * each
    return [(tuple(c), n) for room in rooms for c, n in groups[room]]


def places(recipes: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the ranks of each length go: from ``rank`` on, ``each`` in a sequence from ``sequence`` and ``offset`` on."""
    rows, base, ranks = [], 0, {}
    for content, n in recipes:
        offset = 0
        for length in sorted(set(content), reverse=True):
            each = content.count(length)
            rank = ranks.get(length, 0)
            rows.append((length, rank, each, base, offset))
            ranks[length] = rank + each * n
            offset += each * length
        base += n
    return pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    spark = df.sparkSession
    cut = materialize(pieces(df, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    total = sum(counts.values())
    group = min(max(LEAST_GROUP, -(-total // RANK_GROUPS)), MOST_GROUP)
    salts = spark.createDataFrame([(k, -(-n // group)) for k, n in counts.items()], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(id, piece, ids_crc32), salts)"))
    # A row for each group: at most capacity + RANK_GROUPS, or one for MOST_GROUP rows.
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "salt"])
    groups["first"] = groups.groupby("length")["n"].cumsum() - groups["n"]
    firsts = spark.createDataFrame([tuple(map(int, r)) for r in groups[["length", "salt", "first"]].itertuples(index=False)], "length long, salt long, first long")
    order = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(F.broadcast(firsts), ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nth") - 1)
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # bounded by lengths and rounds, not by rows

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, span = table.value, total + 1
        at = np.searchsorted((p["length"] * span + p["rank"]).to_numpy(), (length * span + rank).to_numpy(), side="right") - 1
        row = p.iloc[at].reset_index(drop=True)
        nth = rank.to_numpy() - row["rank"]
        return pd.DataFrame({"sequence_id": row["sequence"] + nth // row["each"], "offset": row["offset"] + nth % row["each"] * length.to_numpy()})

    out = ranked.withColumn("at", placed("length", "rank"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")

"""Quality rules with host-level verdicts.

Each document gets word, symbol and repetition measures in one pass over its whole text. Failures of
the rules are added up by host; the failure rate of a host is shrunk towards the corpus by a beta prior
whose two parameters come from the hosts themselves (method of moments), so a host with few documents
isn't condemned by them. A host whose shrunken rate is far over that of the corpus is joined back to its
documents: there a document that fails any soft rule goes too, while its clean documents stay.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated rows
are judged alike and counted each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize, sliced, text_or_empty

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Base rules: the fewest words, and the largest share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Soft rules: symbols for each word, share of repeated lines, and mean word length.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_LENGTH = 0.1, 0.3, (3.0, 10.0)
#: A host is condemned where the odds of failing, by its shrunken rate, are over so many times those of the corpus.
HOST_ODDS = 3.0
#: Documents that the prior counts as: where hosts differ by no more than chance, and at most.
PLAIN_STRENGTH, MOST_STRENGTH = 10.0, 1000.0
#: Condemned hosts up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII blanks only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated, n = 0, len(words)
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts, end = Counter(windows), 0
            for at, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += at + 3 - max(at, end)
                    end = at + 3
    return (
        n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated,
    )


def measures(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text_or_empty(text_col).alias("text"))
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def work(batches):
        for batch in batches:
            found = list(zip(*map(measure, batch.column(2).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in found)], ["id", "host", *names])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "host")]
    return rows.mapInArrow(work, f"id {kinds[0]}, host {kinds[1]}, {MEASURES}")


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < LEAST_WORDS) | (of("n_repeat_words") > MOST_REPEATED * of("n_words"))


def soft_failed(of: Callable[[str], Column] = F.col) -> Column:
    n = of("n_words")
    mean = F.when(n > 0, of("word_chars") / n)
    return (of("n_symbols") > MOST_SYMBOLS * n) | (of("n_dup_lines") > MOST_DUP_LINES * of("n_lines")) | F.coalesce(~mean.between(*WORD_LENGTH), F.lit(False))


def base_fails(m: dict[str, int]) -> bool:
    """``base_failed`` of one document's measures."""
    return m["n_words"] < LEAST_WORDS or m["n_repeat_words"] > MOST_REPEATED * m["n_words"]


def soft_fails(m: dict[str, int]) -> bool:
    """``soft_failed`` of one document's measures."""
    n = m["n_words"]
    return m["n_symbols"] > MOST_SYMBOLS * n or m["n_dup_lines"] > MOST_DUP_LINES * m["n_lines"] or n > 0 and not WORD_LENGTH[0] <= m["word_chars"] / n <= WORD_LENGTH[1]


def host_rates(judged: DataFrame, odds: float = HOST_ODDS) -> DataFrame:
    """host, documents, failures, the shrunken rate and the verdict of each host."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    p = F.col("bad") / F.col("n")
    # One row: failures over all, and how far hosts lie from it, beyond what chance makes of their sizes.
    m = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum(p * p * F.col("n")).alias("square"), F.count("*").alias("hosts")).first()
    alpha, beta = prior(m.bad or 0, m.n or 0, m.square or 0.0, m.hosts)
    mean = alpha / (alpha + beta)
    rate = (F.col("bad") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.select("host", F.col("n").alias("host_docs"), F.col("bad").alias("host_failures"), rate.alias("host_rate"), (rate > odds * mean / (1 - mean + odds * mean)).alias("host_bad"))


def prior(bad: int, n: int, square: float, hosts: int) -> tuple[float, float]:
    """Beta parameters by the method of moments: mean ``bad / n``; ``square``: the sum of documents times rate squared."""
    if not n:
        return 1.0, 1.0
    mean = min(max(bad / n, 1e-6), 1 - 1e-6)
    within = mean * (1 - mean) * hosts / n
    between = square / n - mean * mean - within
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), MOST_STRENGTH) if between > 0 else PLAIN_STRENGTH
    return mean * strength, (1 - mean) * strength


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, the measures, ``base_failed``, ``soft_failed``, what is known of the host, and ``kept``."""
    rows = materialize(measures(df, id_col, text_col, host_col), "measures")
    judged = rows.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed()).withColumn("failed", F.col("base_failed") | F.col("soft_failed"))
    hosts = host_rates(judged).withColumnRenamed("host", "_host")
    out = judged.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    kept = ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed"))
    return out.withColumn("kept", kept).drop("_host", "failed").withColumnRenamed("id", id_col)


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``df`` without the rejected documents. Whole rows pass the rules once and are written with their two flags, so texts are neither measured again nor shuffled; only the condemned hosts are joined."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(host_col).alias("host"), text_or_empty(text_col).alias("text"))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = [rows.schema[c].dataType.simpleString() for c in ("row", "host")]

    def work(batches):
        for batch in (part for b in batches for part in sliced(b)):
            found = [dict(zip(names, measure(t))) for t in batch.column(2).to_pylist()]
            flags = [pa.array([bool(rule(f)) for f in found], pa.bool_()) for rule in (base_fails, soft_fails)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *flags], ["row", "host", "base_failed", "soft_failed"])

    flagged = materialize(rows.mapInArrow(work, f"row {kinds[0]}, host {kinds[1]}, base_failed boolean, soft_failed boolean"), "flagged")
    bad = host_rates(flagged.select("host", (F.col("base_failed") | F.col("soft_failed")).alias("failed"))).where("host_bad").select(F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    bad = materialize(bad, "hosts")
    few = bad.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    found = flagged.join(F.broadcast(bad) if few else bad, F.col("host").eqNullSafe(F.col("_host")), "left")
    return found.where(~F.col("base_failed") & ~(F.coalesce("_bad", F.lit(False)) & F.col("soft_failed"))).select("row.*")

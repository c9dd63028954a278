"""URL filters: pattern rules indexed by their rarest literal token.

A rule table has two kinds of lines. ``allow host/path`` and ``block host/path`` fit a host, its subdomains
and the paths that start so, in the case as written. Any other line is a pattern searched in host and path
together, in any case: ``||`` stands for the start of the host or of a label in it, ``|`` for the start or the
end, ``*`` for anything, ``^`` for a separator or the end; ``@@`` in front makes it an exception. Lines that
start with ``!`` are comments.

Each rule names literals that every URL it matches must hold: whole tokens, or three characters in a row
where no token of it is sure to be whole. The corpus tells how often each of them occurs; a rule is indexed
under its rarest. A URL fetches the rules under its own literals and runs only their regular expressions. Of
the host and path rules that match the longest wins; where none does, a matching exception allows, else a
matching pattern blocks, and anything else is allowed.

Up to ``MOST_BROADCAST`` rules the index is broadcast. A larger table is joined with the URLs by literal: distinct
URLs and rules meet in a shuffle, matches are aggregated by URL and joined back. Both give the same rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; rows keep
their multiplicity; null ids are kept; a rule without a literal is run for every URL; of equal rules one
counts; an empty table of URLs gives an empty result, one of rules allows everything.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import astuple, dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to which the index is broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\Z)"
VERDICT = ["host", "path", "rule", "verdict", "pattern"]


@dataclass(frozen=True)
class Rule:
    """``regex`` is searched in host and path together; all of ``literals`` occur in every URL that it matches."""

    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]
    length: int = 0  # of a host and path rule; 0 for other patterns


RULE = "name string, verdict string, regex string, literals array<string>, length int"

#: The rules of the query: the fixed host and path rules, then patterns.
RULES = """
allow org/
block example.org/es/
block example.org/en/1
allow com/fr/
block com/de/
||casino-*.
||free-bets.
||ads-track.
||ads.
||spam-*.example.
-pills.
/sponsored/*/redirect|
@@||casino-museum.
"""


def grams(text: str) -> set[str]:
    """Three characters in a row, marked so that they are no tokens."""
    return {f"~{text[i : i + 3]}" for i in range(len(text) - 2)}


def site_rule(verdict: str, place: str) -> Rule:
    """A rule for a host, its subdomains and the paths that start with its own; without a path for all of them."""
    host, slash, path = place.partition("/")
    path = slash + path
    tokens = re.findall(TOKEN, host.translate(LOWERED)) + [m.group() for m in re.finditer(TOKEN, path.translate(LOWERED)) if m.end() < len(path)]
    return Rule(place, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path) or '(?=/|$)'}", tuple(tokens) or tuple(sorted(grams(place.translate(LOWERED)))), len(place))


def pattern_rule(line: str) -> Rule:
    """A pattern as a regular expression, with the literals that its matches are sure to hold."""
    body = line.removeprefix("@@")
    start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
    end = "|" if len(body) > len(start) and body.endswith("|") else ""
    core = body[len(start) : len(body) - len(end)].translate(LOWERED)
    regex = {"||": r"\A(?:[^/]*\.)?", "|": r"\A", "": ""}[start]
    regex += "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in core) + (r"\Z" if end else "")
    # A run of letters and digits is a whole token unless it may go on beyond what the pattern says.
    sure = lambda m: (m.start() > 0 and core[m.start() - 1] != "*" or m.start() == 0 and start) and (m.end() < len(core) and core[m.end()] != "*" or m.end() == len(core) and end)
    tokens = tuple(m.group() for m in re.finditer(TOKEN, core) if sure(m))
    return Rule(line, "allow" if line.startswith("@@") else "block", f"(?is){regex}", tokens or tuple(sorted(set().union(*map(grams, re.split(r"[*^]", core))))))


def read_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    """The rules of a table, each once; blank lines and comments are skipped."""
    found: dict[str, Rule] = {}
    for line in map(str.strip, lines):
        if line and not line.startswith("!"):
            verdict, _, place = line.partition(" ")
            found[line] = site_rule(verdict, place) if verdict in ("allow", "block") and place else pattern_rule(line)
    return tuple(found.values())


def rules_of_file(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """The rules of a text file in any file system that Spark reads; a rule table is a list for one machine."""
    return read_rules(r.value for r in spark.read.text(path).collect())


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWERED), re.match(r"[^?#]*", rest[len(host) :]).group()


def literals_of(place: str, by_gram: bool) -> set[str]:
    """What a URL fetches rules by; three characters in a row only where a rule is indexed so."""
    low = place.translate(LOWERED)
    return {*re.findall(TOKEN, low), ""} | (grams(low) if by_gram else set()) if place else set()


@cache
def compiled(regex: str) -> re.Pattern:
    """Each expression once in a worker, when it is first fetched."""
    return re.compile(regex)


def best_of(hits: list[Rule]) -> tuple[str | None, str, str | None]:
    """The deciding host and path rule, the verdict, and the pattern that decides without one."""
    site = max((r for r in hits if r.length), key=lambda r: (r.length, r.name, r.verdict), default=None)
    if site:
        return site.name, site.verdict, None
    pattern = min(hits, key=lambda r: (r.verdict != "allow", r.name), default=None)
    return (None, pattern.verdict, pattern.name) if pattern else (None, "allow", None)


def verdict_of(url: str | None, index: dict[str, list[Rule]]) -> tuple[str, str, str | None, str, str | None]:
    host, path = parts(url)
    by_gram = any(k.startswith("~") for k in index)
    hits = [r for t in literals_of(host + path, by_gram) for r in index.get(t, ()) if compiled(r.regex).search(host + path)]
    return host, path, *best_of(hits)


def urls_with_literals(df: DataFrame, url_col: str, by_gram: bool) -> DataFrame:
    """literal and url of each distinct URL."""
    rows = df.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()

    def work(batches):
        for batch in batches:
            urls, found = [], []
            for url in batch.column(0).to_pylist():
                own = literals_of("".join(parts(url)), by_gram)
                urls += [url] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(found, pa.string())], ["url", "literal"])

    return rows.mapInArrow(work, "url string, literal string")


def literal_counts(df: DataFrame, url_col: str, known: DataFrame, by_gram: bool) -> DataFrame:
    """In how many distinct URLs each of the literals of the rules occurs."""
    return urls_with_literals(df, url_col, by_gram).join(known, "literal", "left_semi").groupBy("literal").agg(F.count("*").alias("n"))


def index_of(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal; those without one under the empty one."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.literals, key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def judge(df: DataFrame, rules: tuple[Rule, ...] | None = None, id_col: str = "page_id", url_col: str = "url", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """id, host, path, rule, verdict and pattern of every URL."""
    spark, rules = df.sparkSession, read_rules(RULES.splitlines()) if rules is None else rules
    by_gram = any(t.startswith("~") for r in rules for t in r.literals)
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    if len(rules) > most_broadcast:
        return judge_by_join(rows, rules, by_gram).withColumnRenamed("id", id_col)
    known = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.literals})], "literal string")
    counts = {r.literal: r.n for r in literal_counts(df, url_col, known, by_gram).collect()}  # at most a row for each literal of a table of bounded size
    index = spark.sparkContext.broadcast(index_of(rules, counts))

    def work(batches):
        for batch in batches:
            found = list(zip(*(verdict_of(u, index.value) for u in batch.column(1).to_pylist()), strict=True)) or [()] * len(VERDICT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in found)], ["id", *VERDICT])

    out = rows.mapInArrow(work, f"id {kind}, " + ", ".join(f"{n} string" for n in VERDICT))
    return out.withColumnRenamed("id", id_col)


def judge_by_join(rows: DataFrame, rules: tuple[Rule, ...], by_gram: bool) -> DataFrame:
    """The same for a rule table of any size: URLs and rules meet by literal, matches are aggregated by URL."""
    spark = rows.sparkSession
    table = spark.createDataFrame([astuple(r) for r in rules], RULE)
    literals = table.select("name", "verdict", F.explode("literals").alias("literal"))
    counts = literal_counts(rows, "url", literals.select("literal").distinct(), by_gram)
    rarest = literals.join(counts, "literal", "left").groupBy("name", "verdict").agg(F.min_by("literal", F.struct(F.coalesce("n", F.lit(0)), "literal")).alias("literal"))
    indexed = table.drop("literals").join(rarest, ["name", "verdict"], "left").withColumn("literal", F.coalesce("literal", F.lit("")))
    met = urls_with_literals(rows, "url", by_gram).join(indexed, "literal")

    def matched(batches):
        for batch in batches:
            keep = [compiled(regex).search("".join(parts(url))) is not None for url, regex in zip(batch.column("url").to_pylist(), batch.column("regex").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["url", "name", "verdict", "length"])

    hits = met.select("url", "name", "verdict", "length", "regex").mapInArrow(matched, "url string, name string, verdict string, length int")
    site = F.max(F.when(F.col("length") > 0, F.struct("length", "name", "verdict"))).alias("site")
    pattern = F.min(F.when(F.col("length") == 0, F.struct(F.col("verdict") != "allow", "name", "verdict"))).alias("other")
    decided = hits.groupBy("url").agg(site, pattern)

    def split(batches):
        for batch in batches:
            host, path = zip(*map(parts, batch.column("url").to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(host, pa.string()), pa.array(path, pa.string())], ["id", "url", "host", "path"])

    places = rows.mapInArrow(split, f"id {rows.schema['id'].dataType.simpleString()}, url string, host string, path string")
    other = F.when(F.col("site").isNull(), F.col("other.name"))
    verdict = F.coalesce("site.verdict", "other.verdict", F.lit("allow"))
    return places.join(decided, "url", "left").select("id", "host", "path", F.col("site.name").alias("rule"), verdict.alias("verdict"), other.alias("pattern"))

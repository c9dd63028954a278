"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3, counted on labelled texts. A text is coded under
the frozen statistics of every language: the longest known context gives a symbol its share of the counts,
or escapes (method C: the number of distinct symbols counts as the frequency of the escape) to the next
shorter context, in which the symbols seen so far are excluded, and at last to the uniform distribution.
The language with the shortest code wins; the score is its share of the probabilities of all languages.

The trees are fitted on a sample of about ``SAMPLE_DOCS`` texts a language, chosen by a hash of the id;
counting runs in Spark, and the counts, bounded by that sample, are broadcast. Every whole text is scored.
Texts are lower-cased and all ASCII other than letters counts as a space.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
was learnt; ties go to the first language by name; rows keep their multiplicity.
"""

from __future__ import annotations

import pickle
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import by_size

SAMPLE_DOCS = 2000
UNKNOWN = "und"
SLICE_BYTES = 1 << 20
PAD = b"   "
#: Bytes as the trees see them: ASCII other than letters is a space.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def folded(text: str) -> bytes:
    return PAD + text.lower().encode("utf-8", "replace").translate(FOLD)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in re.finditer(r"[^\W\d_]", text))


def contexts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, code (four bytes: a context of three and what follows) and how often it occurs."""

    def work(batches):
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(folded(text), np.uint8).astype(np.uint32)
                by_lang.setdefault(lang, []).append(raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:])
            for lang, codes in by_lang.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    found = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL").mapInArrow(work, "lang string, code long, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> pd.DataFrame:
    """The counts of the context trees: lang, code, n."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    docs = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row for each language
    if not docs:
        return pd.DataFrame({"lang": [], "code": [], "n": []})
    share = F.create_map(*(F.lit(x) for lang, n in docs.items() for x in (lang, min(1.0, sample_docs / n))))[F.col(lang_col)]
    draw = F.xxhash64(F.col(id_col), F.lit(5)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return contexts(labelled.where(draw < share), text_col, lang_col).toPandas().sort_values(["lang", "code"], ignore_index=True)


def coded(counts: np.ndarray, seen_below: np.ndarray, below_seen: np.ndarray | None) -> np.ndarray:
    """Bits for each symbol at nodes with ``counts``; ``below_seen`` symbols are excluded and ``seen_below`` are the bits after an escape."""
    free = counts if below_seen is None else np.where(below_seen, 0, counts)
    total, kinds = free.sum(1, keepdims=True), (free > 0).sum(1, keepdims=True)
    some = np.maximum(total + kinds, 1)
    escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / some), 0.0)
    return np.where(free > 0, -np.log2(np.maximum(free, 1) / some), escape + seen_below)


class Trees:
    """Code lengths of every language at every node, laid out for lookup."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        code = counts["code"].to_numpy(np.int64)
        n = counts["n"].to_numpy(np.int64)
        symbols = np.unique(np.concatenate([code >> 24, code >> 16 & 255, code >> 8 & 255, code & 255])) if len(code) else np.array([32])
        self.size = size = len(symbols) + 1  # the last one is any other byte
        self.symbol = np.full(256, size - 1, np.uint8)
        self.symbol[symbols] = np.arange(size - 1)
        a, b, c, d = (self.symbol[code >> shift & 255].astype(np.int64) for shift in (24, 16, 8, 0))
        two, three = b * size + c, (a * size + b) * size + c
        nodes3, at3 = np.unique(three, return_inverse=True)
        nodes2, at2 = np.unique(two, return_inverse=True)
        up2, up1 = np.searchsorted(nodes2, nodes3 % (size * size)), nodes2 % size
        first2, first3 = size + 1, size + 1 + len(nodes2)
        # The deepest known node of each context of three symbols: order 1 nodes, then the root, 2 and 3.
        self.node = np.tile(np.arange(size, dtype=np.int32), size * size)
        by_two = np.full(size * size, -1, np.int32)
        by_two[nodes2] = first2 + np.arange(len(nodes2))
        tiled = np.tile(by_two, size)
        self.node = np.where(tiled >= 0, tiled, self.node)
        self.node[nodes3] = first3 + np.arange(len(nodes3))
        self.bits = []
        for lang in self.langs:
            own = np.where((counts["lang"] == lang).to_numpy(), n, 0)

            def table(rows: int, at: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                return np.bincount(at * size + d, own, rows * size).reshape(rows, size)

            c0, c1, c2, c3 = table(1, d * 0), table(size, c), table(len(nodes2), at2), table(len(nodes3), at3)
            left = np.maximum(256 - (c0 > 0).sum(), 1)
            uniform = lambda seen: np.full(seen.shape, np.log2(left))
            plain = np.full((1, size), 8.0)
            root = coded(c0, uniform(c0), None) if c0.any() else plain
            under1 = coded(np.repeat(c0, size, 0), uniform(c1), c1 > 0) if c0.any() else np.repeat(plain, size, 0)
            one = coded(c1, under1, None)
            under2 = coded(c1[up1], under1[up1], c2 > 0)
            two_bits = coded(c2, under2, None)
            under3 = coded(c2[up2], under2[up2], c3 > 0)
            three_bits = coded(c3, under3, None)
            self.bits.append(np.concatenate([one, root, two_bits, three_bits]).astype(np.float32).ravel())

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (with its pad in front) under each language."""
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts] + len(PAD)
        s = self.symbol[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32)
        context = (s[:-3] * self.size + s[1:-2]) * self.size + s[2:-1]
        at = np.zeros(len(s) + 1, np.int64)
        at[3:-1] = self.node[context].astype(np.int64) * self.size + s[3:]
        borders = np.stack([starts, ends], 1).ravel()
        out = np.stack([np.add.reduceat(bits[at], borders, dtype=np.float64)[::2] for bits in self.bits], 1)
        out[starts == ends] = 0
        return out


@lru_cache(maxsize=2)
def trees_of(packed: bytes) -> Trees:
    """The trees of packed counts, laid out once in each Python worker."""
    return Trees(pickle.loads(packed))


def predict(df: DataFrame, counts: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(counts))  # bounded by the sample
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scored(texts: list[str | None], trees: Trees) -> list[tuple[str, float]]:
        able = [i for i, t in enumerate(texts) if has_letter(t)] if trees.langs else []
        out = [(UNKNOWN, 0.0)] * len(texts)
        if able:
            bits = trees.code_lengths([folded(texts[i]) for i in able])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for i, lang, score in zip(able, best, share):
                out[i] = (trees.langs[lang], float(score))
        return out

    def work(batches):
        for batch in batches:
            trees = trees_of(shared.value)
            for begin, end in by_size([t or "" for t in batch.column(1).to_pylist()], SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                found = scored(part.column(1).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learnt from: a fourth of all, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

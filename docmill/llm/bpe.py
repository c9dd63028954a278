"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A byte-level vocabulary stands each byte for one printable character. Ranks of the tiktoken format
are turned into such a vocabulary and its merges once, on the driver; tasks get the tokenizer as a
string of fixed size. Text is cut before spaces that follow a non-space, which are always borders of
the splitting pattern, so that the ids of a repeated word are looked up instead of merged again.

The strings of special tokens are ordinary text wherever they occur (``encode_special_tokens``).

Defined cases: null and empty texts have no ids and decode to the empty text; ids that end within a
character decode to U+FFFD in ``decoded_text`` while ``decoded`` keeps the raw bytes; rows keep
their multiplicity.
"""

from __future__ import annotations

import base64
import codecs
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import by_size, sliced, text_or_empty

#: Characters encoded at once, and words whose ids a task remembers.
BATCH_CHARS, CACHED_WORDS, LONGEST_CACHED = 1 << 19, 200_000, 48
#: Words given to the tokenizer at once.
WORDS_AT_ONCE = 4096
#: The splitting pattern that byte-level pre-tokenizers use when their file names none (a fixed value).
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> dict[int, str]:
    """The printable character of each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``; None if lower ranks don't lead to it."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks and len(a + b) < len(token)]
        rank, at = min(found, default=(ranks[token], 0))
        if rank >= ranks[token]:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


def tokenizer_of_ranks(path: str, pattern: str) -> str:
    """A serialized tokenizer that gives the ids of the rank file under ``pattern``, without special tokens."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = [last_merge(token, ranks) for token in sorted(ranks, key=ranks.get) if len(token) > 1]
    own = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=[(shown(m[0]), shown(m[1])) for m in merges if m], ignore_merges=True))
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return own.to_str()


def tokenizer_of_file(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, serialized: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(serialized)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), WORDS_AT_ONCE):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + WORDS_AT_ONCE], add_special_tokens=False)]
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """Cut before each space that follows a non-space; a text with NUL stays whole."""
        if "\0" in text:
            return [text]
        if re.search(r"\s ", text):
            return re.sub(r"(?<=\S) ", "\0 ", text).split("\0")
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for begin, end in by_size(texts, BATCH_CHARS):
            cut = [self.words(t) for t in texts[begin:end]]
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
            new = list(set().union(*cut) - self.known.keys())
            found = dict(zip(new, self._ids(new), strict=True))
            long = [w for w in new if len(w) > LONGEST_CACHED]
            self.known.update(found)
            out += [b"".join(map(self.known.__getitem__, words)) for words in cut]
            for word in long:
                del self.known[word]
        return out


class RankEncoder(Encoder):
    """The same ids, merged by tiktoken, for a vocabulary whose ids follow the order of its merges."""

    def __init__(self, serialized: str):
        import tiktoken

        super().__init__(serialized)
        config, back = json.loads(serialized), {c: b for b, c in byte_chars().items()}
        special = {t["content"] for t in config["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in config["model"]["vocab"].items() if token not in special}
        self.merger = tiktoken.Encoding("ranks", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.merger.encode_ordinary(t)).tobytes() for t in texts]


def in_merge_order(serialized: str) -> bool:
    """Whether ranks alone give the ids: each merge makes the next id, and nothing but byte-level splitting by the usual pattern comes before."""
    config = json.loads(serialized)
    model, before = config["model"], config.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not config.get("normalizer")
    plain = plain and all(t["special"] for t in config["added_tokens"]) and not (model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    return bool(plain) and [model["vocab"]["".join(m)] for m in merges] == list(range(256, 256 + len(merges)))


@lru_cache(maxsize=4)
def encoder(serialized: str, by_rank: bool = False) -> Encoder:
    return (RankEncoder if by_rank else Encoder)(serialized)


@lru_cache(maxsize=4)
def token_bytes(serialized: str) -> list[bytes]:
    """The bytes of each id: the byte table reversed."""
    from tokenizers import Tokenizer

    vocab, back = Tokenizer.from_str(serialized).get_vocab(), {c: b for b, c in byte_chars().items()}
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return table


def char_offsets(text: str, ids: bytes, table: list[bytes]) -> np.ndarray:
    """Start of each token in code points; a token that begins within a character starts at it."""
    lengths = np.fromiter((len(table[i]) for i in np.frombuffer(ids, "<u4")), np.int64)
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    heads = np.cumsum((raw & 0xC0) != 0x80)
    return heads[starts] - 1 if len(starts) else starts


def pieces_of(ids: bytes, table: list[bytes]) -> list[str]:
    """The text that each token completes; what a split character still lacks comes with its last token."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    out = [decoder.decode(table[i]) for i in np.frombuffer(ids, "<u4")]
    rest = decoder.decode(b"", True)
    return [*out[:-1], out[-1] + rest] if out and rest else out


def _over_arrow(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: (work(part) for b in batches for part in sliced(b))


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """id, ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and, if asked, ``starts``."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)  # of the size of one vocabulary
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        ids = encoder(shared.value).encode(texts)
        columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
        if offsets:
            table = token_bytes(shared.value)
            columns.append(pa.array([char_offsets(t, i, table) for t, i in zip(texts, ids)], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, ["id", "ids", "n_tokens", "starts"][: len(columns)])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_over_arrow(work), f"id {kind}, ids binary, n_tokens long" + ", starts array<long>" * offsets)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded``, the bytes that its ids stand for (null ids: none)."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = token_bytes(shared.value)
        ids = batch.column(batch.schema.names.index(ids_col)).to_pylist()
        raw = [b"".join(map(table.__getitem__, memoryview(i or b"").cast("I"))) for i in ids]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    clear = df.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clear.schema.fields)
    return clear.mapInArrow(_over_arrow(work), f"{schema}, decoded binary")


def decoded_text(column: str = "decoded") -> F.Column:
    """The decoded bytes as text, broken characters replaced."""
    return F.decode(F.col(column), F.lit("UTF-8"))

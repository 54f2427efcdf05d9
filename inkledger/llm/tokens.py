"""Token counts by field and section, from one encoding of each whole document."""

from __future__ import annotations

import base64
import importlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Ranks of a public byte-level BPE, and how it cuts text into pieces before merging.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS_SQL = "array<struct<field:string,section:int,n_chars:bigint,n_tokens:bigint,n_crossing:bigint>>"
COUNTS = pa.list_(
    pa.struct([("field", pa.string()), ("section", pa.int32()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
)

_loaded: dict = {}


def encoder(ranks: str, pieces: str):
    """The encoding and the bytes of each token, read once in each Python worker."""
    if (ranks, pieces) not in _loaded:
        tiktoken = importlib.import_module("tiktoken")
        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(table_.values()) + 1, np.int64)
        for token, rank in table_.items():
            size[rank] = len(token)
        _loaded[ranks, pieces] = tiktoken.Encoding("ranks", pat_str=pieces, mergeable_ranks=table_, special_tokens={}), size
    return _loaded[ranks, pieces]


def sections(fields: list[tuple[str, str | None]], split: str | None) -> tuple[bytes, list[tuple[str, int]], np.ndarray, np.ndarray]:
    """The document that is encoded, and (field, number) and first byte of each of its sections, and their characters.

    Fields are joined by line feeds, which belong to the field before. The field `split` is
    cut behind each line feed; null fields are empty. Every field has one section at least.
    """
    names, parts = [], []
    for k, (name, text) in enumerate(fields):
        cut = (text or "").split("\n") if name == split else [text or ""]
        for n, part in enumerate(cut):
            last = n == len(cut) - 1
            names.append((name, n))
            parts.append(part + ("" if last and k == len(fields) - 1 else "\n"))
    raw = [p.encode() for p in parts]
    size = np.array([len(r) for r in raw])
    return b"".join(raw), names, np.cumsum(size) - size, np.array([len(p) for p in parts])


def attribute(data: bytes, start: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach into another.

    Interval join of token spans with sections, both sorted: a token belongs to the section
    that holds its first byte that isn't white space, and one of white space alone to the
    section of its first byte.
    """
    end = np.cumsum(sizes[tokens])
    begin = end - sizes[tokens]
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ink = np.append(np.flatnonzero(~blank), len(raw))
    first = ink[np.searchsorted(ink, begin)]
    owner_at = np.where(first < end, first, begin)
    # of sections that begin at one byte only the last can hold any
    owner = np.searchsorted(start, owner_at, side="right") - 1
    crossing = (np.searchsorted(start, begin, side="right") != np.searchsorted(start, end - 1, side="right"))
    return np.bincount(owner, minlength=len(start)), np.bincount(owner[crossing], minlength=len(start))


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), split: str | None = "text", ranks: str = RANKS, pieces: str = PIECES) -> DataFrame:
    """docs with `counts`: for each section its field, number, characters, tokens and crossing tokens.

    Each document is encoded once and whole. Special tokens' names are ordinary text. A
    document of empty fields has sections without tokens. A column `counts` is replaced.
    """

    @F.arrow_udf(COUNTS_SQL)
    def counts(*columns: pa.Array) -> pa.Array:
        encoding, sizes = encoder(ranks, pieces)
        out = []
        for row in zip(*columns, strict=True):
            data, names, start, chars = sections([(f, v.as_py()) for f, v in zip(fields, row, strict=True)], split)
            tokens = np.array(encoding.encode_ordinary(data.decode()), np.int64)
            n, crossing = attribute(data, start, sizes, tokens)
            out.append(
                [
                    {"field": f, "section": s, "n_chars": c, "n_tokens": t, "n_crossing": x}
                    for (f, s), c, t, x in zip(names, chars.tolist(), n.tolist(), crossing.tolist(), strict=True)
                ]
            )
        return pa.array(out, COUNTS)

    # of a function that could give another result when run again, the plan has one call only
    return docs.drop("counts").withColumn("counts", counts.asNondeterministic()(*[F.col(f"`{f}`").cast("string") for f in fields]))


def op5_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return count_tokens(docs).select("doc_id", F.explode("counts").alias("c")).select("doc_id", "c.*")

"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CHARS = 200_000

_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a ranks file; read once per Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(text: str, path: str, piece: int = PIECE_CHARS) -> int:
    """Number of tokens, encoded in pieces of about ``piece`` characters, which bounds the memory for all but text without blanks.

    A piece ends before white space that follows a character that is none, where the splitting pattern ends a word too,
    so the count does not depend on the pieces; a stretch without such a place is one piece.
    """
    enc = encoding(path)
    total = at = 0
    while at < len(text):
        end = min(len(text), at + piece)
        while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):
            end += 1
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_sizes(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` and n_tokens of every row whose text is not null; an empty text has 0 tokens."""
    path = path or f"{TOKENIZER_DIR}/{VOCABULARY}"
    names = [f"c{i}" for i in range(len(keep))]
    src = documents.where(documents[text].isNotNull()).select(*(documents[c].alias(n) for c, n in zip(keep, names)), documents[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.array([count_tokens(t, path) for t in b["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), sizes], names=[*names, "n_tokens"])

    kinds = ", ".join(f"{n} {documents.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    return src.mapInArrow(run, f"{kinds}, n_tokens bigint").toDF(*keep, "n_tokens")

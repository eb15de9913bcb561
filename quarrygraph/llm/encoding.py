"""Problem 8: the whole corpus as ids of a public tokenizer.

Texts are encoded by tiktoken from a local rank file, without special tokens: their strings are ordinary
text. Texts longer than ``LONG`` characters are cut beforehand where the tokenizer's own pattern always
cuts (before a single blank between two other characters, the second no blank), so the ids are the same
and no call holds one huge text. ``decode`` joins the raw bytes of the ids, so that ids that end within a
character are put together before the bytes are read as UTF-8.

Cases: null and empty texts give an empty list; white space, odd characters and strings of special tokens
are encoded as they stand; every row gives a row, also with a repeated id; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizers import DIRECTORY, encoding

LONG = 200_000
_SAFE = re.compile(r"(?<=[^\s']) (?=[^\s'])")


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only at safe boundaries."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(text: str | None, name: str = "byte_bpe_50k", directory: str = DIRECTORY) -> list[int]:
    """The ids of one text."""
    if not text:
        return []
    run = encoding(name, directory).encode_ordinary
    if len(text) <= LONG:
        return run(text)
    return [i for part in pieces(text) for i in run(part)]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", directory: str = DIRECTORY) -> DataFrame:
    """doc_id, ids of every row."""
    narrow = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("own_text"))
    kind = dict(narrow.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "ids": [encode_text(t, name, directory) for t in f["own_text"]]})

    return narrow.mapInPandas(run, f"doc_id {kind}, ids array<int>")


def count_tokens(documents: DataFrame, text_col: str = "text", name: str = "byte_bpe_50k", directory: str = DIRECTORY, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The ``keep`` columns and n_tokens of every row."""
    narrow = documents.select(*keep, F.col(text_col).alias("own_text"))
    kinds = dict(narrow.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[list(keep)].assign(n_tokens=[len(encode_text(t, name, directory)) for t in f["own_text"]])

    return narrow.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_tokens long")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", directory: str = DIRECTORY) -> DataFrame:
    """doc_id, text of every row of ``encode``."""
    narrow = encoded.select("doc_id", "ids")
    kind = dict(narrow.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = encoding(name, directory).decode_single_token_bytes
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": [b"".join(map(one, [] if x is None else list(x))).decode("utf-8", "replace") for x in f["ids"]]})

    return narrow.mapInPandas(run, f"doc_id {kind}, text string")

"""Public tokenizers from local rank files; the directory is a parameter, nothing is copied or fetched."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import tiktoken

DIRECTORY = os.environ.get("PUBLIC_TOKENIZERS_DIR", "/opt/tokenizers")
# fixed value: the pattern that cuts a text into the pieces within which byte pairs are joined
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", directory: str = DIRECTORY) -> tiktoken.Encoding:
    """The tokenizer of a .tiktoken rank file, without special tokens; one a process."""
    ranks = {}
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

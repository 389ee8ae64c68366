"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

#: Folder of the vocabulary files; they are read where they lie on each worker.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: How the vocabulary's texts are cut before merging: a fixed value of this public encoding.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """A function that counts a text's tokens; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))

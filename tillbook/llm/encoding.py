"""Token ids of texts in a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import public_tokenizers
import tiktoken

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


SPECIAL = {"<|endoftext|>": 50256}


@functools.cache
def encoder(path: str = RANKS) -> tiktoken.Encoding:
    """The encoder of a file of ranks, made once for each process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
    )


def encode_with(path: str = RANKS) -> Callable[[str], list[int]]:
    """Text to the ids that the vocabulary's own tokenizer gives with its defaults.

    The string of a special token in a text is that token; none are added.
    """
    return functools.partial(encoder(path).encode, allowed_special="all", disallowed_special=())

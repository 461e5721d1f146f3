"""Byte-level BPE vocabularies of public tokenizers, loaded once per Python worker."""

from __future__ import annotations

import base64
import functools

import public_tokenizers
import tiktoken

#: Default vocabulary files (names understood by ``public_tokenizers.path``).
BPE_50K = "byte_bpe_50k.json"
BPE_50K_RANKS = "byte_bpe_50k.tiktoken"
BPE_MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_32K = "piece_bpe_32k.model"
END_OF_TEXT = "<|endoftext|>"


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def rank_encoding(path: str, end_of_text: int | None) -> tiktoken.Encoding:
    """The rank file as an encoder. ``end_of_text`` is the id of that special string, if the vocabulary has it."""
    special = {} if end_of_text is None else {END_OF_TEXT: end_of_text}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path),
                             special_tokens=special)

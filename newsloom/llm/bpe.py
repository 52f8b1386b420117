"""Byte-pair vocabularies read from a tokenizer file, shared by token counting and packing."""

from __future__ import annotations

import json
from functools import cache

import tiktoken

#: The split pattern of byte-level vocabularies, as the tokenizer file names it by `use_regex`.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes -> id, special string -> id)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_of_letter()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}, special


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary's merges by rank: ids follow the order of the merges, so ids serve as ranks."""
    ranks, special = vocabulary(path)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def reference_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(path: str, text: str) -> list[int]:
    """Ids as the tokenizer file gives them, special strings in the text included as their ids."""
    try:
        return encoder(path).encode(text, allowed_special="all")
    except BaseException as error:  # the pattern engine gives up on some extreme runs; the slower library doesn't
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return reference_tokenizer(path).encode(text, add_special_tokens=False).ids

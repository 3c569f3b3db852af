"""Byte-level BPE helpers: token ids, pre-tokens, and counts that merge only what has to be merged."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


@lru_cache(maxsize=1)
def library_tokenizer(name: str = "byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(maxsize=1)
def rank_encoder(name: str = "byte_bpe_50k.tiktoken"):
    """The same vocabulary as ranks: equal ids, several times faster on texts whose words seldom repeat."""
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
    )


def encode(text: str | None) -> np.ndarray:
    """Token ids as unsigned 32-bit numbers; the special string inside a text is the special token."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    return rank_encoder().encode_to_numpy(text, allowed_special="all", disallowed_special=())


# The pre-token pattern in the classes of `re`. These equal the Unicode classes for the characters of `PLAIN` only.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def strange() -> re.Pattern:
    """Matches a character for which the two ways to class characters might differ.

    Proved by trying every character up to U+024F and the general punctuation; all others count as strange.
    """
    pairs = [(r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")]
    tests = [(re.compile(a), regex.compile(b)) for a, b in pairs]
    plain = [
        chr(c)
        for c in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F))
        if all(bool(a.match(chr(c))) == bool(b.match(chr(c))) for a, b in tests)
    ]
    return re.compile("[^" + "".join(map(re.escape, plain)) + "]")


@lru_cache(maxsize=1)
def whole_tokens() -> dict[str, int]:
    """Pre-tokens that are one token, proved by encoding every vocabulary string by itself."""
    tokenizer = library_tokenizer()
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    strings = [s for s in strings if "�" not in s and s != SPECIAL and PRE_TOKEN.fullmatch(s)]
    made = tokenizer.encode_batch(strings, add_special_tokens=False)
    return {s: 1 for s, e in zip(strings, made, strict=True) if len(e.ids) == 1}


class Counter:
    """Counts tokens of texts: whole tokens by look-up, other pre-tokens merged once and remembered up to a bound."""

    def __init__(self, remember: int = 400_000):
        self.remember = remember
        self.known = dict(whole_tokens())

    def count(self, texts: list[str | None]) -> list[int]:
        tokenizer, odd = library_tokenizer(), strange()
        parts, direct = [], {}
        for i, text in enumerate(texts):
            if not text:
                parts.append(([], 0))
            elif odd.search(text):
                direct[i] = text
                parts.append(([], 0))
            else:
                pieces = text.split(SPECIAL)
                parts.append(([t for p in pieces for t in PRE_TOKEN.findall(p)], len(pieces) - 1))
        rest = list(set().union(*(p for p, _ in parts)) - self.known.keys())
        if len(self.known) + len(rest) > self.remember:
            self.known = dict(whole_tokens())
            rest = list(set().union(*(p for p, _ in parts)) - self.known.keys())
        for token, made in zip(rest, tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.known[token] = len(made.ids)
        counts = [sum(map(self.known.__getitem__, p)) + n for p, n in parts]
        for i, text in direct.items():
            counts[i] = len(tokenizer.encode(text, add_special_tokens=False).ids)
        return counts

"""Token ids of a public byte-level BPE vocabulary, with a bounded cache of words."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"
CACHE_WORDS = 300_000


class WordCache(dict):
    """Ids (little-endian uint16) of a space and the word after it. Starts afresh when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = self.encode(" " + word)
        return ids


class Encoder:
    """Encodes texts as ``tokenizers`` does with the same vocabulary and ``add_special_tokens=False``.

    A token never spans the place in front of a single space, so a text without double
    spaces is encoded word by word. Plain Latin words go through tiktoken's rank file of
    the same vocabulary, anything else through ``tokenizers`` itself, and so does a whole
    text in which an added token of the vocabulary stands, which has an id of its own.
    """

    def __init__(self, vocabulary: str):
        self.full = Tokenizer.from_file(public_tokenizers.path(vocabulary + ".json"))
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = WordCache(self.encode)

    def encode(self, text: str) -> bytes:
        if text.isascii() or max(text) < "ɐ":
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.full.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if "  " in text:
            return self.encode(text)
        first, *rest = text.split(" ")
        return b"".join((self.encode(first) if first else b"", *map(self.words.__getitem__, rest)))


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(vocabulary)

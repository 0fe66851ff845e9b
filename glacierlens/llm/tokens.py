"""Token ids of the byte-level BPE vocabulary, as bytes with four to an id.

The rank file and the JSON file hold one vocabulary.  The rank file's library
merges several times faster, so it takes all texts that both libraries are
known to split alike; the rest (special tokens, rare scripts, long runs without
a break) go through the JSON file's library.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

JSON_FILE = "byte_bpe_50k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"
# fixed values: the vocabulary's published pre-token pattern, without backtracking
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

# outside these ranges the two libraries' Unicode tables may differ in age
_RARE = re.compile("[^\u0000-ɏͰ-ͳ΄-ϿЀ-ԣḀ-ỿ‐-‧‰-⁞₠-₵ぁ-ゖァ-ヺ一-龥가-힣]")
_LONG_RUN = re.compile(r"\s{2000}|\S{20000}")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(text)`` gives what ``tokenizers`` gives with ``add_special_tokens=False``."""

    def __init__(self, json_path: str, rank_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._json = Tokenizer.from_file(json_path)
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._ranks = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        odd = "<|" in text or not text.isascii() and _RARE.search(text) or len(text) > 2000 and _LONG_RUN.search(text)
        if odd:
            return self._json.encode(text, add_special_tokens=False).ids
        return self._ranks.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text))


@lru_cache(maxsize=2)
def encoder(json_path: str, rank_path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(json_path, rank_path)


def default_encoder() -> Encoder:
    return encoder(vocabulary_path(JSON_FILE), vocabulary_path(RANK_FILE))

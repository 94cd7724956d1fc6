"""Token ids of whole texts by the byte-level BPE file of a public tokenizer.

``tokenizers`` defines the ids. It spends about 1 us a byte, so texts of Latin letters go through ``tiktoken``
with the same file's vocabulary and cutting pattern, which gives the same ids several times
faster; texts with other letters, whose classes the two libraries' regular expressions might
take from different Unicode versions, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

_OTHER = re.compile("[ɐ-\U0010ffff]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in the file's vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {x["content"] for x in content["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids as 32-bit unsigned integers."""
        if _OTHER.search(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self._fast.encode_ordinary(text), dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)

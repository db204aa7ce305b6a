"""Token ids with public tokenizers inside Spark tasks.

The vocabulary file's path is a parameter; it is loaded once per Python worker.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Characters for which NFC changes nothing and white space is blank, tab or line end only.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɀ‐-‧]*")


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEnds:
    """Ids of a tokenizer that lower-cases and never joins what white space parts.

    The ids of a text are then those of its white-space-separated pieces, and those of a word with one
    punctuation mark behind it are the word's and the mark's; so each word is encoded once and kept.
    Texts with characters for which that isn't plain, or with the string of a special token, go to the
    tokenizer whole.  The store of words is emptied at ``most`` entries.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        self.tokenizer, self.most, self.kept = _tokenizer(path), most, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, pieces: set[str]) -> None:
        kept, split = self.kept, {}
        for p in pieces:
            if p[-1] in ".,;:!?" and p[:-1].isalpha():
                split[p] = p[:-1]
        new = list({split.get(p, p) for p in pieces} | {p[-1] for p in split})
        new = [p for p in new if p not in kept]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            kept[p] = _bytes(e.ids)
        for p, word in split.items():
            kept[p] = kept[word] + kept[p[-1]]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without added tokens."""
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        pieces = [t.lower().split() if ok else None for t, ok in zip(texts, plain)]
        new = set().union(*(x for x in pieces if x))
        kept = self.kept
        if len(kept) > self.most:
            kept.clear()
        self._learn(new.difference(kept))
        return [b"".join(map(kept.__getitem__, x)) if x is not None else _bytes(self.tokenizer.encode(t, add_special_tokens=False).ids) for t, x in zip(texts, pieces)]


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(4)
def word_ends(path: str, most: int) -> WordEnds:
    return WordEnds(path, most)


@lru_cache(4)
def byte_ranks(path: str, pattern: str):
    """A tiktoken encoding of a rank file, and the number of bytes of each of its tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes

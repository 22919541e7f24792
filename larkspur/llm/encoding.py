"""Token ids of whole texts with a public tokenizer file, word by word with a cache.

The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in order. A cut at a
space or a line feed is therefore exact; whatever else a word holds goes to the library as it stands.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Letters that stay one code point under NFC and lower case, then signs that the tokenizer parts from letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_LIMIT = 500_000


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Letters of two bytes as the byte-level alphabet writes them.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = [b for b in range(256) if b not in set(kept)]
        self.byte = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(shifted)}

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(word)
        if len(self) < _LIMIT:
            self[word] = ids
        return ids

    def ids(self, word: str) -> bytes:
        if not (parts := _PLAIN.fullmatch(word)):
            return self.whole(word)
        letters, rest = parts.groups()
        if rest:
            return self[letters] + self[rest]
        if (lower := letters.lower()) != letters:
            return self[lower]
        if not lower.isascii():
            lower = "".join([self.byte[b] for b in lower.encode()])
        return np.array([t.id for t in self.library.model.tokenize(lower)], "<u4").tobytes()

    def whole(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str | None) -> bytes:
        """All ids of a text; none for null."""
        if not text:
            return b""
        if "\n" in text:
            text = text.replace("\n", " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache for each Python worker and tokenizer file."""
    return WordIds(path)

"""Exact token counts without identifiers: heap-and-linked-list byte-pair merging.

A piece starts as one symbol a byte in a linked list; a heap holds adjacent pairs by (rank, place). The lowest is
popped and merged again and again; the count is the initial symbols less the merges. Texts are cut where the
tokenizer's own pattern always cuts, so counts of pieces between spaces can be kept and summed.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.shared import documents, small_batches

_SPACE = r"\p{White_Space}"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+")
_TWO = regex.compile(rf"{_SPACE}{{2}}")
_LIMIT = 500_000


class Counter:
    """Token counts under one byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.special = [t["content"] for t in file["added_tokens"] if t["content"]]
        self.split = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = [b for b in range(256) if b not in set(kept)]
        self.byte = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(shifted)}
        self.bare, self.spaced = _Kept(self.pieces), _Kept(lambda w: self.pieces(" " + w))
        self.merged: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece of the pattern."""
        symbols = [self.byte[b] for b in text.encode()]
        n = len(symbols)
        if n < 2:
            return n
        rank, after, before = self.rank, [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (r := rank.get((symbols[k], symbols[k + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if right < 0 or symbols[left] != a or symbols[right] != b:
                continue
            merges += 1
            symbols[left], symbols[right] = a + b, ""
            after[left] = follow = after[right]
            if follow >= 0:
                before[follow] = left
                if (r := rank.get((a + b, symbols[follow]))) is not None:
                    heapq.heappush(heap, (r, left, a + b, symbols[follow]))
            if (lead := before[left]) >= 0 and (r := rank.get((symbols[lead], a + b))) is not None:
                heapq.heappush(heap, (r, lead, symbols[lead], a + b))
        return n - merges

    def pieces(self, text: str) -> int:
        total, merged = 0, self.merged
        for piece in _PIECES.findall(text):
            n = merged.get(piece)
            if n is None:
                n = self.piece(piece)
                if len(merged) < _LIMIT and len(piece) < 40:
                    merged[piece] = n
            total += n
        return total

    def ordinary(self, text: str) -> int:
        if _TWO.search(text):
            return self.pieces(text)
        lines = text.split("\n")
        total = (len(lines) - 1) * self.bare["\n"]
        for line in lines:
            first, *rest = line.split(" ")
            total += self.bare[first] + sum(map(self.spaced.__getitem__, rest))
        return total

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for null. A special token's string counts as that token, as by default."""
        if not text:
            return 0
        if self.split is None:
            return self.ordinary(text)
        parts = self.split.split(text)
        return len(parts) - 1 + sum(self.ordinary(p) for p in parts if p)


class _Kept(dict):
    def __init__(self, count) -> None:
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(self) < _LIMIT and len(word) < 60:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text; more columns are ignored).

    Null and empty texts count 0. Repeated rows give repeated results; an empty table gives none.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [count.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

"""Packing of documents into sequences of a fixed length by swap-based local search.

Pieces are dealt to shards of bounded size; each shard starts from a best-fit placement and then takes its emptiest
bins in turn: a piece moves to a fuller bin, or changes places with a smaller one or with two smaller ones there, so
long as the sum of squared fills grows, until the bin is empty or nothing helps. What is left underfull in the shards
meets in fewer shards, until one shard holds it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.encoding import word_ids
from larkspur.llm.shared import documents, forget, keep, runs, small_batches

SHARD = 16_384
#: Open bins are dealt anew so many times at most.
ROUNDS = 60


class Bins:
    """Bins of one shard: which pieces each holds and how full it is."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.held: list[list[int]] = []
        self.fill: list[int] = []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set if a bin has room r
        self.arrays: tuple[np.ndarray, ...] | None = None  # all pieces in open bins, as long as nothing changes
        self.failed: set[int] = set()  # lengths for which no exchange was found since the last change

    def room(self, b: int, fill: int) -> None:
        self.arrays = None
        self.failed.clear()
        old = self.capacity - self.fill[b]
        self.by_room[old].discard(b)
        if not self.by_room[old]:
            self.rooms &= ~(1 << old)
        self.fill[b] = fill
        new = self.capacity - fill
        self.by_room[new].add(b)
        self.rooms |= 1 << new

    def add(self, b: int, piece: int) -> None:
        self.held[b].append(piece)
        self.room(b, self.fill[b] + self.lengths[piece])

    def take(self, b: int, piece: int) -> None:
        self.held[b].remove(piece)
        self.room(b, self.fill[b] - self.lengths[piece])

    def tightest(self, length: int, but: int = -1) -> int | None:
        """The fullest bin that has room for length."""
        rooms = self.rooms >> length
        while rooms:
            low = (rooms & -rooms).bit_length() - 1
            for b in self.by_room[length + low]:
                if b != but and self.held[b]:
                    return b
            rooms &= rooms - 1
        return None

    def best_fit(self) -> None:
        for piece in sorted(range(len(self.lengths)), key=lambda p: -self.lengths[p]):
            b = self.tightest(self.lengths[piece])
            if b is None:
                b = len(self.held)
                self.held.append([])
                self.fill.append(0)
                self.room(b, 0)
            self.add(b, piece)

    def count(self) -> int:
        return sum(1 for h in self.held if h)

    def swap(self, donor: int, piece: int, partners: list[int]) -> bool:
        """Give piece to a fuller bin for one or two smaller pieces of it, filling that as far as can be."""
        want, best = self.lengths[piece], None
        for b in partners:
            if b == donor or not self.held[b] or self.fill[b] < self.fill[donor]:
                continue
            room = self.capacity - self.fill[b]
            if not room:
                continue
            sizes = sorted((self.lengths[p], p) for p in self.held[b])
            k = bisect_left(sizes, (want - room, -1))
            if k < len(sizes) and sizes[k][0] < want and (best is None or want - sizes[k][0] > best[0]):
                best = (want - sizes[k][0], b, [sizes[k][1]])
            for i, (x, p) in enumerate(sizes):  # two for one
                k = bisect_left(sizes, (want - room - x, -1), i + 1)
                if k < len(sizes) and x + sizes[k][0] < want and (best is None or want - x - sizes[k][0] > best[0]):
                    best = (want - x - sizes[k][0], b, [p, sizes[k][1]])
            if best and best[0] == room:
                break
        if best is None:
            return False
        _, b, back = best
        for p in back:
            self.take(b, p)
        self.take(donor, piece)
        self.add(b, piece)
        for p in back:
            self.add(donor, p)
        return True

    def exchange(self, donor: int, piece: int) -> bool:
        """swap() with the best of all bins, found over arrays of all pieces at once.

        Donors come from the emptiest on and give to fuller bins only, so a length that failed once fails until a bin changes.
        """
        want = self.lengths[piece]
        if want in self.failed:
            return False
        if self.arrays is None:
            rows = [(b, self.lengths[p], p) for b, held in enumerate(self.held) if held and self.fill[b] < self.capacity for p in sorted(held, key=self.lengths.__getitem__)]
            self.arrays = tuple(np.array(rows, np.int64).reshape(-1, 3).T)
        own, x, number = self.arrays
        fill = np.array(self.fill)[own]
        allowed = (own != donor) & (fill >= self.fill[donor])
        need = want - (self.capacity - fill)  # what has to come back at least
        gain = np.where(allowed & (x < want) & (x >= need), want - x, 0)
        # The smallest second piece of the same bin, further on, that makes up what is missing.
        key = own * (self.capacity + 1) + x
        second = np.maximum(np.searchsorted(key, own * (self.capacity + 1) + np.clip(need - x, 0, self.capacity)), np.arange(len(x)) + 1)
        there = np.minimum(second, len(x) - 1)
        both = x + x[there]
        two = np.where(allowed & (second < len(x)) & (own[there] == own) & (both < want) & (both >= need), want - both, 0)
        best, best_two = int(gain.argmax()), int(two.argmax())
        if gain[best] == 0 and two[best_two] == 0:
            self.failed.add(want)
            return False
        k, back = (best, [best]) if gain[best] >= two[best_two] else (best_two, [best_two, int(there[best_two])])
        b, back = int(own[k]), [int(number[j]) for j in back]
        for p in back:
            self.take(b, p)
        self.take(donor, piece)
        self.add(b, piece)
        for p in back:
            self.add(donor, p)
        return True

    def search(self, partners_most: int = 64) -> None:
        """Empty the emptiest bins one after another; every step makes the sum of squared fills larger.

        The emptiest partners_most bins are looked at first, then all.
        """
        least = -(-sum(self.lengths) // self.capacity)
        left = self.count()
        tried: set[int] = set()
        while left > least:
            open_bins = [b for b in range(len(self.held)) if self.held[b] and 0 < self.fill[b] < self.capacity]
            donor = min((b for b in open_bins if b not in tried), key=self.fill.__getitem__, default=None)
            if donor is None:
                return
            tried.add(donor)
            others = sorted((b for b in open_bins if b != donor), key=self.fill.__getitem__)[:partners_most]
            changed = True
            while self.held[donor] and changed:
                changed = False
                for piece in sorted(self.held[donor], key=lambda p: -self.lengths[p]):
                    b = self.tightest(self.lengths[piece], donor)
                    if b is not None and self.fill[b] >= self.fill[donor]:
                        self.take(donor, piece)
                        self.add(b, piece)
                        changed = True
                    elif self.swap(donor, piece, others) or (len(open_bins) > partners_most and self.exchange(donor, piece)):
                        changed = True
                        break
            if not self.held[donor]:
                self.room(donor, 0)
                self.by_room[self.capacity].discard(donor)
                left -= 1
                tried.clear()


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of lengths (1 to capacity) by bin."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    return [h for h in bins.held if h]


def _pieces(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.uint32(end_id).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = words.text(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _packed(level: int, capacity: int):
    """Rows of one shard after another with their places; sequence_id is null where the bin may still be filled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in runs(batches, "shard"):
            number = shard.column("shard")[0].as_py()
            shard = shard.combine_chunks()
            lengths = shard.column("length").to_pylist()
            order, ids, offsets = [], [], []
            for k, held in enumerate(pack_lengths(lengths, capacity)):
                at, whole = 0, sum(lengths[p] for p in held) * 32 >= capacity * 31
                for p in held:
                    order.append(p)
                    ids.append((level << 56) + (number << 24) + k if whole else -1 - k)
                    offsets.append(at)
                    at += lengths[p]
            out = shard.drop_columns(["shard"]).take(pa.array(order, pa.int64()))
            out = out.append_column("sequence_id", pa.array([i if i >= 0 else (level << 56) + (number << 24) - 1 - i for i in ids], pa.int64()))
            out = out.append_column("offset", pa.array(offsets, pa.int64())).append_column("open", pa.array([i < 0 for i in ids], pa.bool_()))
            yield from out.to_batches()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of docs (doc_id, text) with the sequence and place of each.

    A null or empty text is its end id alone; extra columns are ignored, whatever their names; repeated rows and rows
    without a doc_id are packed each; which of several pieces of one length goes where is left open; an empty table gives
    no rows. Documents longer than capacity are cut into pieces of capacity, the last maybe shorter. Bins that stay open
    are dealt anew, among other bins, until a round saves none, or ROUNDS times.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = keep(rows.mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    done = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    left, level = pieces.where(F.col("length") < capacity), 1
    n, bins, kept = left.count(), None, None
    while n:
        shards = -(-n // SHARD)
        # The row's own number parts rows that are alike in all else.
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id(), F.lit(level)), F.lit(shards)))
        packed = keep(dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "piece", "ids_crc32").mapInArrow(_packed(level, capacity), f"{_OUT}, open boolean"), f"packed{level}")
        count = packed.agg(F.count_if(F.col("open") & (F.col("offset") == 0)), F.count_if("open"), F.count_if(F.col("offset") == 0)).first()
        still, used = count[1], count[2]
        if kept is not None and used >= bins:  # no bin was saved: the pieces stay where they were
            forget(packed)
            return done.unionByName(kept)
        if shards == 1 or not still or level == ROUNDS:
            return done.unionByName(packed.drop("open"))
        done, kept = done.unionByName(packed.where("not open").drop("open")), packed.where("open").drop("open")
        left, n, bins, level = kept.drop("sequence_id", "offset"), still, count[0], level + 1
    return done


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))

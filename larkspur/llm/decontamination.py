"""Documents that hold benchmark items, up to a share of edits.

Texts are lower-cased and everything but letters and digits becomes one space. Behind each of an item's longest words
the rest of the item is a window; a document's windows start behind its occurrences of those words. A CGK walk reads a whole
window with one pointer that moves on or stays by a random bit for (step, character), so edit distance becomes Hamming
distance between the characters read. Bit-sampling LSH compares a few sampled steps of the walk, some near its start and
the others anywhere; REPEATS walks with their own bits and samples, over the ANCHORS windows of an item, find what has
few edits. Of windows that agree on the samples with an item's, those whose whole walks differ in at most FAR of the
steps are verified by the exact edit distance between the item and the best-fitting stretch.

Where a tenth of the characters or more are edited, walks agree in so few steps (0.25 to 0.4 at a fifth, unlike texts
0.1) that hundreds of repeats would be needed, so every byte of an item is also the start of a gram. Where a text shares
enough grams with an item at about one distance between their places, that stretch is verified too. Items under LONG
bytes need as many as their edits must leave, so no ASCII one is lost. Longer items have longer grams, a few of which random
edits leave, and seeds beside them, which edits at even distances leave: see Seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.shared import documents, small_batches
from larkspur.llm.substring_dedup import hashed_words

#: Walks, least bytes of a window, sampled steps near the start and anywhere, windows of an item, least similarity, items sent to the executors at once.
REPEATS, LEAST, EARLY, LATE, ANCHORS, SIMILARITY, ITEMS = 5, 72, 3, 3, 12, 0.8, 20_000
#: Bytes of items' text sent at once.
ITEM_BYTES = 4_000_000
#: Steps that count as near the start. Walks of unlike texts differ in about nine steps of ten.
NEAR, FAR = 24, 0.6
_END = 0xFF  # stands in no UTF-8 text
_FOLD = np.array([0 if b == _END else b if b >= 128 or (b < 128 and chr(b).isalnum()) else 32 for b in range(256)], np.uint8)
_PRIME = np.uint64(0x100000001B3)
#: Bytes of a gram for items of at least so many bytes; items of LONG bytes and more need a gram for each so many bytes.
LONG, EACH = 64, 10
GRAMS = ((LONG, 7), (20, 4), (8, 3), (4, 2), (1, 1))
#: The share of a long item's seeds, those that fewest items hold, that is looked for; one of so many of these has to be found.
RARE, SEED_EACH = 0.66, 14
#: Distances between places that count as one are this many bits apart; cells of the count; bytes of text counted at once.
_WIDE, _CELLS, _STRETCH = 4, 1 << 20, 1 << 18
_SEEN = 22  # bits of the tables that tell most of what can't match


def folded(texts: list[str]) -> np.ndarray:
    """The normalised bytes of texts, a zero before, between and after."""
    raw = bytes([_END]) + bytes([_END]).join([t.lower().encode() for t in texts]) + bytes([_END])
    b = _FOLD[np.frombuffer(raw, np.uint8)]
    space = b == 32
    return b[~(space & np.concatenate(([False], space[:-1] | (b[:-1] == 0))))]


def edit_distance_within(item: str, text: str) -> int:
    """The least edit distance between item and any stretch of text (bit-parallel dynamic programming)."""
    m = len(item)
    if item in text:
        return 0
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best = m
    for c in text:
        same = masks.get(c, 0)
        x = same | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hn = (minus | ~(plus | d0)) & full, plus & d0
        if hp & top:
            distance += 1
        elif hn & top:
            distance -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        plus, minus = (hn | ~(d0 | hp)) & full, hp & d0
        best = min(best, distance)
    return best


def edit_distances_within(items: list[str], pairs: list[tuple[int, str]]) -> list[int]:
    """edit_distance_within for many (item's number, text), in words of 64 bits side by side."""
    out = [0] * len(pairs)
    if len(pairs) < 48:
        return [edit_distance_within(items[k], text) for k, text in pairs]
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    for begin in range(0, len(order), 2048):
        part = sorted(order[begin : begin + 2048], key=lambda k: -len(items[pairs[k][0]]))
        numbers = sorted({pairs[k][0] for k in part})
        letters = {c: j for j, c in enumerate(sorted({c for n in numbers for c in items[n]}))}
        row = {n: j for j, n in enumerate(numbers)}
        size = np.array([len(items[pairs[k][0]]) for k in part], np.int64)
        words = -(-size // 64)
        lanes = [int((words > w).sum()) for w in range(int(words[0]) + 1)]  # those that have a word w stand first
        masks = np.zeros((len(lanes) - 1, len(numbers), len(letters) + 1), np.uint64)
        for n, j in row.items():
            for at, c in enumerate(items[n]):
                masks[at // 64, j, letters[c]] |= np.uint64(1 << at % 64)
        masks = masks.reshape(len(masks), -1)
        table = np.full(0x110000, len(letters), np.int32)
        table[[ord(c) for c in letters]] = list(letters.values())
        text = np.full((len(part), max(len(pairs[k][1]) for k in part)), len(letters), np.int32)
        for j, k in enumerate(part):
            own = np.frombuffer(pairs[k][1].encode("utf-32-le"), "<u4")
            text[j, : len(own)] = table[own]
        text += np.array([row[pairs[k][0]] for k in part], np.int32)[:, None] * (len(letters) + 1)
        text = np.ascontiguousarray(text.T)
        top, one, last = ((size - 1) % 64).astype(np.uint64), np.uint64(1), np.uint64(63)
        plus, minus = [np.full(n, ~np.uint64(0)) for n in lanes[:-1]], [np.zeros(n, np.uint64) for n in lanes[:-1]]
        rise, fall = np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64)
        distance, best = size.copy(), size.copy()
        for c in text:
            for w, n in enumerate(lanes[:-1]):
                p, m = plus[w], minus[w]
                x = masks[w][c[:n]] | m
                total = (x & p) + p
                more = total < p
                if w:
                    total += carry[:n]
                    more |= total < carry[:n]
                d0 = (total ^ p) | x
                hp, hn = m | ~(p | d0), p & d0
                rise[lanes[w + 1] : n], fall[lanes[w + 1] : n] = hp[lanes[w + 1] :], hn[lanes[w + 1] :]
                right, left = hp << one, hn << one
                if w:
                    right |= up[:n]
                    left |= down[:n]
                plus[w], minus[w] = left | ~(d0 | right), right & d0
                if lanes[w + 1]:
                    carry, up, down = more.astype(np.uint64), hp >> last, hn >> last
            distance += (rise >> top & one).view(np.int64)
            distance -= (fall >> top & one).view(np.int64)
            np.minimum(best, distance, out=best)
        for k, d in zip(part, best.tolist()):
            out[k] = d
    return out


class Lists:
    """Where items hold codes: sorted codes, and the item and place of each."""

    def __init__(self, codes: list[np.ndarray], numbers: list[np.ndarray], places: list[np.ndarray]) -> None:
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.codes, self.first, self.many = np.unique(code[order], return_index=True, return_counts=True)
        self.numbers, self.places = np.concatenate(numbers)[order], np.concatenate(places)[order]
        self.seen = np.zeros(1 << _SEEN, bool)
        self.seen[_slot(self.codes)] = True

    def found(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among code, item's number, place in the item) of each code that an item holds, each time it does."""
        at = np.flatnonzero(self.seen[_slot(code)])
        code = code[at]
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        on = self.codes[k] == code
        at, k = at[on], k[on]
        many = self.many[k]
        which = np.repeat(self.first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(at, many), self.numbers[which], self.places[which]


class Grams:
    """Grams of items of one tier, and how many of each item's a text has to share with it."""

    def __init__(self, size: int, items: list[tuple[int, bytes]], similarity: float) -> None:
        self.size, codes, numbers, places, least = size, [], [], [], {}
        for number, item in items:
            own = self.coded(np.frombuffer(item, np.uint8))
            codes.append(own)
            numbers.append(np.full(len(own), number))
            places.append(np.arange(len(own)))
            plain = item.decode()
            widest, most = max(len(c.encode()) for c in plain), int(len(plain) * (1 - similarity) + 1e-9)
            least[number] = len(item) // EACH if len(item) >= LONG else max(1, len(own) - most * (size - 1 + widest))
        self.lists = Lists(codes, numbers, places)
        self.needing(least, items)

    def needing(self, least: dict[int, int], items: list[tuple[int, bytes]]) -> None:
        self.least = least
        self.leasts = np.zeros(max(least) + 1, np.int64)
        self.leasts[list(least)] = list(least.values())
        self.reach = 2 * max(len(item) for _, item in items) + (1 << _WIDE)

    def coded(self, b: np.ndarray) -> np.ndarray:
        """A code for each gram; those of more than four bytes may agree by chance."""
        n = max(0, len(b) - self.size + 1)
        if self.size <= 4:
            return _stretches(b, self.size)[:n] * _MIX[0]
        left, right = _halves(b)
        return left[:n] + right[self.size - 4 :]

    def found(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in b, item's number, place in the item) of each gram that they share."""
        return self.lists.found(self.coded(b))

    def candidates(self, b: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, likeliest, least and largest place where the item would start)."""
        for begin in range(0, len(b), _STRETCH):
            at, number, place = self.found(b[begin : begin + _STRETCH + self.reach])
            at = at + begin
            start = at - place
            # Cells may be shared by chance; that only lets more through to the exact count.
            cell = (number * 40503 + (start >> _WIDE)) & (_CELLS - 1)
            count = np.bincount(cell, minlength=_CELLS)
            on = np.flatnonzero(count[cell] + np.maximum(count[cell - 1], count[(cell + 1) & (_CELLS - 1)]) >= self.leasts[number])
            if not len(on):
                continue
            at, number, start = at[on], number[on], start[on]
            text = np.searchsorted(begins, at, side="right") - 1
            order = np.lexsort((start, number, text))
            text, number, start = text[order], number[order], start[order]
            edge = np.concatenate(([0], np.flatnonzero((np.diff(text) != 0) | (np.diff(number) != 0)) + 1, [len(text)]))
            enough_of = np.flatnonzero(np.diff(edge) >= self.leasts[number[edge[:-1]]])
            for low, high in zip(edge[enough_of].tolist(), edge[enough_of + 1].tolist()):
                least = self.least[int(number[low])]
                own = start[low:high]
                bucket, from_ = np.unique(own >> _WIDE, return_index=True)
                # Neighbours share a count; those that follow each other are one candidate.
                ends = np.append(from_[1:], len(own))
                open_ = -1
                for j in range(len(bucket)):
                    pair = j + 1 < len(bucket) and bucket[j + 1] == bucket[j] + 1
                    enough = ends[j + pair] - from_[j] >= least
                    if enough and open_ < 0:
                        open_ = j
                    if open_ >= 0 and not (enough and pair and bucket[j] - bucket[open_] < 4):
                        end = ends[j + (enough and pair)]
                        part = own[from_[open_] : end]
                        values, times = np.unique(part, return_counts=True)
                        yield int(text[low]), int(number[low]), int(values[times.argmax()]), int(part[0]), int(part[-1])
                        open_ = -1


_MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _stretches(b: np.ndarray, n: int) -> np.ndarray:
    """The n bytes, four at most, at each place as a number."""
    out = b[: max(0, len(b) - n + 1)].astype(np.uint32)
    for k in range(1, n):
        out <<= np.uint32(8)
        out |= b[k : k + len(out)]
    return out


def _halves(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes at each place, mixed one way for the left half of a code and another way for the right half."""
    four = _stretches(b, 4)
    return four * _MIX[0], four * _MIX[1]


class Seeds(Grams):
    """Two stretches of four bytes side by side or one byte apart, of long items.

    Where one character between clean stretches was replaced, both have the byte between; where one was taken out, the item
    alone has it, where one was put in, the text. So edits at even distances, which leave no long gram, each leave a seed.
    """

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        every = [self.both(np.frombuffer(item, np.uint8)) for _, item in items]
        known, times = np.unique(np.concatenate([own for own, _ in every]), return_counts=True)
        apart, beside, numbers, places, least = [], [], [], [], {}
        for (number, _), (own, next_to) in zip(items, every):
            at = np.sort(np.argsort(times[np.searchsorted(known, own)], kind="stable")[: int(len(own) * RARE)])
            apart.append(own[at])
            beside.append(next_to[at])
            numbers.append(np.full(len(at), number))
            places.append(at)
            least[number] = max(2, len(at) // SEED_EACH)
        self.apart = Lists(apart + beside, numbers * 2, places * 2)
        self.beside = Lists(apart, numbers, places)
        self.needing(least, items)

    @staticmethod
    def both(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the stretches at each place and the one behind it, a byte apart and side by side. Codes of unlike stretches may agree by chance."""
        left, right = _halves(b)
        return left[: max(0, len(left) - 5)] ^ right[5:], left[: max(0, len(left) - 4)] ^ right[4:]

    def found(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart, beside = self.both(b)
        return tuple(np.concatenate(x) for x in zip(self.apart.found(apart), self.beside.found(beside)))


def _slot(codes: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint32:
        return (codes >> np.uint32(32 - _SEEN)).astype(np.int64)
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SEEN)).astype(np.int64)


class Windows:
    """LSH tables of item windows that are read in steps steps: twice their bytes, rounded down to a power of two."""

    def __init__(self, steps: int, windows: list[tuple[int, int, int, bytes]]) -> None:
        """windows: anchor, item's number, place in the item, bytes to the item's end."""
        r = np.random.default_rng(steps)
        self.steps, self.bits = steps, r.integers(0, 2, (REPEATS, steps, 256))
        self.samples = [[*np.sort(r.choice(NEAR, EARLY, replace=False)).tolist(), *np.sort(r.choice(np.arange(NEAR, steps), LATE, replace=False)).tolist()] for _ in range(REPEATS)]
        self.anchors = np.unique(np.array([w[0] for w in windows], np.uint64))
        self.places = np.array([w[1:3] for w in windows], np.int64)
        text = np.zeros(len(windows) * (steps + 1), np.uint8).reshape(len(windows), -1)
        for row, (*_, raw) in zip(text, windows):
            part = np.frombuffer(raw, np.uint8)[: steps + 1]
            row[: len(part)] = part
        starts = np.arange(len(windows)) * (steps + 1)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(REPEATS):
            some = np.zeros((EARLY + LATE, 1 << 16), bool)
            _, codes = self.walk(text.ravel(), starts, k, some, learn=True)
            order = np.argsort(codes, kind="stable")
            self.tables.append((some, codes[order], order, self.read(text.ravel(), starts, k)))

    def read(self, text: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        """The characters that walk k reads from each start: (starts, steps)."""
        at, out = starts.astype(np.int64), np.empty((self.steps, len(starts)), np.uint8)
        for step in range(self.steps):
            out[step] = text.take(at)
            at += self.bits[k, step].take(out[step])
        return out.T

    def walk(self, text: np.ndarray, starts: np.ndarray, k: int, some: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Which starts are left, and their codes, under walk k; after each sample but the first, codes that no item has are dropped."""
        at, code, left, done = starts.astype(np.int64), np.zeros(len(starts), np.uint64), np.arange(len(starts)), 0
        samples = self.samples[k]
        for step in range(samples[-1] + 1):
            c = text.take(at)
            if step == samples[done]:
                code = (code ^ c) * _PRIME
                done += 1
                if done > 1:
                    top = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
                    if learn:
                        some[done - 1, top] = True
                    else:
                        on = some[done - 1, top]
                        at, code, left, c = at[on], code[on], left[on], c[on]
            at += self.bits[k, step].take(c)
        return left, code

    def candidates(self, b: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, item's number, place in the item) of windows of b, behind words of these hashes, that are near an item's."""
        starts = starts[np.isin(hashes, self.anchors)]
        if not len(starts):
            return
        padded = np.concatenate((b, np.zeros(self.steps + 1, np.uint8)))
        for k, (some_codes, known, order, read) in enumerate(self.tables):
            left, code = self.walk(padded, starts, k, some_codes)
            low, high = np.searchsorted(known, code), np.searchsorted(known, code, side="right")
            some = np.flatnonzero(high > low)
            many = (high - low)[some]
            at = np.repeat(starts[left[some]], many)
            window = order[np.repeat(low[some] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            for begin in range(0, len(at), 8192):
                a, w = at[begin : begin + 8192], window[begin : begin + 8192]
                near = (self.read(padded, a, k) != read[w]).sum(1) <= FAR * self.steps
                yield a[near], self.places[w[near], 0], self.places[w[near], 1]


class Index:
    """What is sent of at most ITEMS items: their windows' codes and their grams."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items: list[tuple[int, bytes]] = []
        short: dict[int, list[tuple[int, int]]] = {}
        windows: dict[int, list[tuple[int, int, int, bytes]]] = {}
        for item_id, text in items:
            b = folded([text])[1:-1]
            b = b[: len(b) - (len(b) > 0 and b[-1] == 32)]
            if not len(b):
                continue
            number = len(self.items)
            self.items.append((item_id, b.tobytes()))
            starts, hashes = hashed_words(b, b != 32)
            nexts = np.append(starts[1:], len(b))
            order = np.argsort(-(nexts - starts), kind="stable")
            long = [k for k in order.tolist() if len(b) - nexts[k] >= LEAST][:ANCHORS]
            for k in long:
                steps = 1 << (2 * (len(b) - int(nexts[k]))).bit_length() - 1
                windows.setdefault(steps, []).append((int(hashes[k]), number, int(nexts[k]), b[nexts[k] :].tobytes()))
            if not long:  # too short to walk: each of its few places is verified
                for k in order[:ANCHORS].tolist():
                    short.setdefault(int(hashes[k]), []).append((number, int(starts[k])))
        self.short = short
        self.windows = [Windows(steps, own) for steps, own in sorted(windows.items())]
        self.grams: dict[float, list[Grams]] = {}
        anchors = np.unique(np.array([*short, *(w[0] for own in windows.values() for w in own)], np.uint64))
        self.seen = np.zeros(1 << _SEEN, bool)
        self.seen[_slot(anchors)] = True

    def tiers(self, similarity: float) -> list[Grams]:
        if similarity not in self.grams:
            tier = [next(size for least, size in GRAMS if len(item) >= least) for _, item in self.items]
            own = [(size, [(k, item) for k, (_, item) in enumerate(self.items) if tier[k] == size]) for _, size in GRAMS]
            self.grams[similarity] = [Grams(size, items, similarity) for size, items in own if items]
            self.grams[similarity] += [Seeds(items) for _, items in own[:1] if items]
        return self.grams[similarity]

    def hits(self, texts: list[str], similarity: float = SIMILARITY) -> list[tuple[int, int, int, float, int]]:
        """(text's place, item_id, edit distance, similarity, start in the normalised text's bytes), the best for each text and item."""
        b = folded(texts)
        begins = np.flatnonzero(b == 0)
        starts, hashes = hashed_words(b, (b != 32) & (b != 0))
        nexts, on = np.append(starts[1:], len(b) - 1), self.seen[_slot(hashes)]
        starts, nexts, hashes = starts[on], nexts[on], hashes[on]
        candidates: set[tuple[int, int, int, int, int]] = set()  # (text, item, where the item would start: likeliest, least, largest); the text is the anchor's own
        for windows in self.windows:
            for at, number, place in windows.candidates(b, nexts, hashes):
                own = np.searchsorted(begins, at - 1, side="right") - 1
                start = at - place
                # Starts within a few bytes are one candidate: its stretch covers them all.
                low = start & ~15
                candidates.update(zip(own.tolist(), number.tolist(), (low + 8).tolist(), low.tolist(), (low + 15).tolist()))
        if self.short:
            own = np.searchsorted(begins, starts, side="right") - 1
            for text, at, h in zip(own.tolist(), starts.tolist(), hashes.tolist()):
                candidates.update((text, number, *[at - offset] * 3) for number, offset in self.short.get(h, ()))
        for grams in self.tiers(similarity):
            candidates.update(grams.candidates(b, begins))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        whole, plain = b.tobytes(), [item.decode() for _, item in self.items]
        most = [int(len(item) * (1 - similarity) + 1e-9) for item in plain]
        places: list[tuple[int, int, int, tuple[int, str]]] = []
        for text, number, start, least, largest in sorted(candidates):
            length, low = len(self.items[number][1]), int(begins[text]) + 1
            high = int(begins[text + 1]) if text + 1 < len(begins) else len(b)
            wide = most[number] * 4  # bytes that so many characters may take
            region = whole[max(low, least - wide) : min(high, largest + length + wide)]
            if region.isascii():
                region = whole[max(low, least - most[number]) : min(high, largest + length + most[number])]
            places.append((text, number, max(0, start - low), (number, region.decode(errors="ignore"))))
        pairs = list(dict.fromkeys(x[-1] for x in places))
        checked = dict(zip(pairs, edit_distances_within(plain, pairs)))
        for text, number, start, pair in places:
            if checked[pair] <= most[number]:
                found, key = (checked[pair], start), (text, number)
                best[key] = min(best.get(key, found), found)
        return [(text, self.items[number][0], d, 1 - d / len(plain[number]), start) for (text, number), (d, start) in sorted(best.items())]


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """texts in parts of about four million characters, each with the place of its first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < 4_000_000):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _matched(index: Broadcast, similarity: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for begin, part in _parts(texts):
                rows += [(ids[begin + k], i, d, near, s) for k, i, d, near, s in index.value.hits(part, similarity)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "item_id", "edit_distance", "similarity", "start"])

    return match


def _lots(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in lots of at most about ITEMS rows and ITEM_BYTES bytes of text."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    lots = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    for lot in range(lots):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot).orderBy("item_id", "text").collect()
        yield [(r.item_id, r.text) for r in own]


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edit_distance, similarity, start) for each row of docs and each benchmark item it holds.

    similarity: 1 less the edit distance's share of the item's length. Null and empty texts hold nothing, null and empty
    items are held by none; repeated items and items without an item_id are each reported, repeated rows and rows without a
    doc_id too. Of the places
    where a row holds an item, the one with the smallest distance and then the smallest start is given. More columns are
    ignored, whatever their names; an empty table gives no rows. Items go to the executors in bounded lots, each with a
    pass of its own over docs.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for lot in _lots(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(lot))
        found = rows.mapInArrow(_matched(index, similarity), "doc_id long, item_id long, edit_distance long, similarity double, start long")
        out = found if out is None else out.unionByName(found)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no benchmark item; rows without a doc_id are judged like any other."""
    for lot in _lots(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(lot))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                held = {begin + k for begin, part in _parts(texts) for k, *_ in index.value.hits(part, similarity)}
                yield batch.filter(pa.array([k not in held for k in range(len(texts))], pa.bool_()))

        docs = small_batches(docs).mapInArrow(clean, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

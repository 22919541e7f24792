"""Personal data: fixed base patterns, and spans that a bidirectional character LSTM with CRF transitions adds.

The network is trained in numpy from labelled spans in generated lines. It knows the base kinds in spellings that the
patterns miss (spaced and written-out addresses, national phone numbers, cards parted by dots), and two kinds without a
pattern: secrets, such as tokens and keys, and accounts, long numbers that aren't cards. It reads whole texts: overlapping
windows are scored together, each character takes its scores from the window in whose middle it stands most, and decoding
over the joined scores of a text gives its spans. Where the scores leave no doubt that a stretch holds nothing, the best
path runs through it outside, so only what lies between such stretches is decoded.
"""

from __future__ import annotations

import hashlib
import inspect
import random
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import documents, shared_folder, small_batches

#: Kinds with a base pattern, then those that only the network finds.
BASE, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "secret", "account")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then kind; linear in the text's length."""
    found: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            found.append((start, 0, last))
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


# The network. Tags: 0 outside, 1 + k a character of kind k.

HIDDEN, WIDTH, TAGS = 10, 12, 1 + len(KINDS)
#: Characters of a line when training and of a window when reading; those of two windows' ends that overlap.
LINE, WINDOW, OVERLAP = 112, 512, 64
#: Spans never touch, so no kind follows another.
_BARRED = np.where((np.arange(TAGS)[:, None] > 0) & (np.arange(TAGS) > 0) & (np.arange(TAGS)[:, None] != np.arange(TAGS)), -1e4, 0.0)


def characters(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.int64)


def _squashed(z: np.ndarray) -> np.ndarray:
    """z / (1 + |z|), in place: between -1 and 1 like tanh, and quick to work out."""
    size = np.abs(z)
    size += 1
    z /= size
    return z


def _lstm(x: np.ndarray, table: np.ndarray, wh: np.ndarray, learn: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (time, HIDDEN, rows) over characters (time, rows), and what the way back needs; table (3 * HIDDEN, characters) holds what each brings in.

    The input and output gates are (1 + q) / 2 of squashed sums q, the new content is squashed itself; what isn't let in of
    it stays of the old content, so the forget gate is what the input gate leaves.
    """
    length, n = x.shape
    h = c = np.zeros((HIDDEN, n), np.float32)
    out, kept, wt = np.empty((length, HIDDEN, n), np.float32), [], np.ascontiguousarray(wh.T)
    for begin in range(0, length, 16):
        fed = table.take(x[begin : begin + 16].ravel(), axis=1).reshape(3 * HIDDEN, -1, n)
        for t in range(begin, min(begin + 16, length)):
            q = wt @ h
            q += fed[:, t - begin]
            _squashed(q)
            i, o, g = q[:HIDDEN] * 0.5, q[HIDDEN : 2 * HIDDEN] * 0.5, q[2 * HIDDEN :]
            i += 0.5
            o += 0.5
            before, came, new = c, h, g - c
            c = i * new
            c += before
            s = _squashed(c.copy())
            h = np.multiply(o, s, out=out[t])
            if learn:
                kept.append((q, i, o, new, before, came, s))
    return out, kept


def _lstm_back(d_out: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Of what came in, (time, rows, 3 * HIDDEN), and of wh, from d_out (time, HIDDEN, rows)."""
    length, _, n = d_out.shape
    dh = dc = np.zeros((HIDDEN, n), np.float32)
    dz_all, d_wh = np.empty((length, n, 3 * HIDDEN), np.float32), np.zeros_like(wh)
    for t in range(length - 1, -1, -1):
        q, i, o, new, before, came, s = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - np.abs(s)) ** 2
        dz = np.concatenate([0.5 * dc * new, 0.5 * dh * s, dc * i]) * (1 - np.abs(q)) ** 2
        d_wh += came @ dz.T
        dh, dc = wh @ dz, dc * (1 - i)
        dz_all[t] = dz.T
    return dz_all, d_wh


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        p = self.p = {"embed": r.normal(0, 0.3, (129, WIDTH)), "out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "out_b": np.zeros(TAGS), "next": np.zeros((TAGS, TAGS))}
        for way in ("f", "b"):
            p |= {f"wx{way}": r.normal(0, 0.4, (WIDTH, 3 * HIDDEN)), f"wh{way}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"b{way}": np.concatenate([np.full(HIDDEN, -0.5), np.zeros(2 * HIDDEN)])}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def scores(self, x: np.ndarray, learn: bool = False) -> tuple[np.ndarray, tuple]:
        """(time, rows, TAGS) for characters (time, rows)."""
        p = self.p
        f, kept_f = _lstm(x, np.ascontiguousarray((p["embed"] @ p["wxf"] + p["bf"]).T), p["whf"], learn)
        b, kept_b = _lstm(x[::-1], np.ascontiguousarray((p["embed"] @ p["wxb"] + p["bb"]).T), p["whb"], learn)
        b = b[::-1]
        emit = np.matmul(p["out"][:HIDDEN].T, f)
        emit += np.matmul(p["out"][HIDDEN:].T, b)
        emit += p["out_b"][:, None]
        return emit.transpose(0, 2, 1), (f, b, kept_f, kept_b)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of tags y (time, rows) under the CRF."""
        p = self.p
        emit, (f, b, kept_f, kept_b) = self.scores(x, learn=True)
        emit = np.ascontiguousarray(emit)
        length, n, _ = emit.shape
        step = (p["next"] + _BARRED).astype(np.float32)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, length):
            alpha[t] = emit[t] + _logsum(alpha[t - 1][:, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _logsum(step + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        d_emit = np.exp(alpha + beta - z[:, None])
        pairs = np.zeros_like(step)
        for t in range(1, length):
            pairs += np.exp(alpha[t - 1][:, :, None] + step + (emit[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(pairs, (y[:-1], y[1:]), 1)
        d_emit[np.arange(length)[:, None], np.arange(n), y] -= 1
        d_emit /= n
        h = np.concatenate([f, b], 1).transpose(0, 2, 1)
        dh = (d_emit @ p["out"].T).transpose(0, 2, 1)
        embed = np.zeros_like(p["embed"])
        out = {"embed": embed, "out": h.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS), "out_b": d_emit.sum((0, 1)), "next": pairs / n}
        for way, own, kept, seen in (("f", dh[:, :HIDDEN], kept_f, x), ("b", dh[::-1, HIDDEN:], kept_b, x[::-1])):
            dz, out[f"wh{way}"] = _lstm_back(own, p[f"wh{way}"], kept)
            flat = dz.reshape(-1, 3 * HIDDEN)
            by_character = np.zeros((129, 3 * HIDDEN), np.float32)
            np.add.at(by_character, seen.reshape(-1), flat)
            embed += by_character @ p[f"wx{way}"].T
            out[f"wx{way}"], out[f"b{way}"] = p["embed"].T @ by_character, flat.sum(0)
        return out

    def fit(self, lines: list[tuple[str, list[Span]]], rounds: int = 14, rows: int = 64, rate: float = 0.025) -> Tagger:
        """Adam over labelled lines of at most LINE characters; the rate falls to a tenth."""
        x, y = np.full((LINE, len(lines)), 32), np.zeros((LINE, len(lines)), np.int64)
        for k, (text, spans) in enumerate(lines):
            c = characters(text)[:LINE]
            x[: len(c), k] = c
            for start, kind, end in spans:
                y[start:end, k] = 1 + kind
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        r, step, steps = np.random.default_rng(3), 0, rounds * -(-len(lines) // rows)
        for _ in range(rounds):
            order = r.permutation(len(lines))
            for at in range(0, len(lines), rows):
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                own = order[at : at + rows]
                for k, g in self.gradients(x[:, own], y[:, own]).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, emits: list[np.ndarray]) -> list[list[int]]:
        """The best tags for each of some scores (time, TAGS), between outsides: a kind's tag comes from outside or itself, the outside from any.

        Those of about one length go side by side; behind a shorter one's end is outside.
        """
        step, out = (self.p["next"] + _BARRED).astype(np.float32), [[] for _ in emits]
        enter, leave, stay, rest = step[0, 1:], step[1:, 0], np.diag(step)[1:], step[0, 0]
        order, at = sorted(range(len(emits)), key=lambda k: len(emits[k])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 256 and len(emits[order[end]]) <= 2 * len(emits[order[at]]) + 16:
                end += 1
            part, length = order[at:end], len(emits[order[end - 1]])
            at = end
            emit = np.full((length, len(part), TAGS), -1e4, np.float32)
            emit[..., 0] = 0
            for row, k in enumerate(part):
                emit[: len(emits[k]), row] = emits[k]
            outside, inside = rest + emit[0, :, 0], enter + emit[0, :, 1:]
            from_, stayed = np.zeros((length, len(part)), np.int64), np.zeros((length, len(part), TAGS - 1), bool)
            for t in range(1, length):
                left, kept, came = inside + leave, inside + stay, outside[:, None] + enter
                best, out_ = left.max(1), outside + rest
                from_[t] = np.where(best > out_, left.argmax(1) + 1, 0)
                stayed[t] = kept > came
                inside = np.maximum(kept, came) + emit[t, :, 1:]
                outside = np.maximum(best, out_) + emit[t, :, 0]
            inside = inside + leave
            tag, tags, rows = np.where(inside.max(1) > outside + rest, inside.argmax(1) + 1, 0), np.empty((length, len(part)), np.int64), np.arange(len(part))
            for t in range(length - 1, -1, -1):
                tags[t] = tag
                tag = np.where(tag == 0, from_[t], np.where(stayed[t, rows, tag - 1], tag, 0))
            for row, k in enumerate(part):
                out[k] = tags[: len(emits[k]), row].tolist()
        return out

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each kind against staying outside, without the characters' own scores: one more character, and a span's two ends."""
        step = self.p["next"]
        go = np.diag(step)[1:] - step[0, 0]
        return go, step[0, 1:] + step[1:, 0] - 2 * step[0, 0] - go

    def joined_scores(self, texts: list[str], whole: bool = False) -> list[np.ndarray | None]:
        """(characters, TAGS) of each text; None, unless whole, for a text none of whose windows holds characters in a row whose gains make up for a span's ends.

        Windows share OVERLAP characters, so such a text holds no span of so many characters or fewer.
        """
        go, ends = self.gains()
        windows = [(k, at, min(at + WINDOW, len(t))) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - OVERLAP), WINDOW - OVERLAP) if t]
        held, read, some = [characters(t) for t in texts], [], np.full(len(texts), whole)
        windows.sort(key=lambda w: w[2] - w[1])
        for at in range(0, len(windows), 512):
            part = windows[at : at + 512]
            x = np.full((part[-1][2] - part[-1][1], len(part)), 32)
            for row, (k, b, e) in enumerate(part):
                x[: e - b, row] = held[k][b:e]
            emit = self.scores(x)[0].transpose(0, 2, 1)  # time, TAGS, rows
            gain = emit[:, 1:] - emit[:, :1]
            gain += go[:, None]
            most = best = np.zeros_like(gain[0])
            for g in gain:  # the best sum that ends here, and the best of all
                best = np.maximum(best, 0)
                best += g
                most = np.maximum(most, best)
            enough = (most + ends[:, None] > 0).any(0)
            some[[k for (k, *_), f in zip(part, enough.tolist()) if f]] = True
            read.append((part, emit))
        out: list[np.ndarray | None] = [np.empty((len(t), TAGS), np.float32) if s else None for t, s in zip(texts, some.tolist())]
        for part, emit in read:
            for row, (k, b, e) in enumerate(part):
                if some[k]:
                    # Up to the middle of the overlap with the window before, and from the middle of that with the next.
                    low, high = b + OVERLAP // 2 * (b > 0), e - OVERLAP // 2 * (e < len(texts[k]))
                    out[k][low:high] = emit[low - b : high - b, :, row]
        return out

    def find(self, texts: list[str]) -> list[list[Span]]:
        """The model's spans of each text: the best path through its joined scores.

        A span gains what its characters gain over the outside, and its ends; only where some such sum is above nothing can
        the best path be anywhere but outside, and only there it is looked for.
        """
        go, ends = self.gains()
        stretches: list[tuple[int, int, np.ndarray]] = []
        for at in range(0, len(texts), 256):
            for k, emit in enumerate(self.joined_scores(texts[at : at + 256]), at):
                if emit is None or not len(emit):
                    continue
                gain = emit[:, 1:] - emit[:, :1] + go
                before = np.cumsum(gain, 0, float)
                after = np.maximum.accumulate(before[::-1])[::-1]
                before -= gain
                open_ = (after - np.minimum.accumulate(before) + ends > 0).any(1)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False])).astype(np.int8)))
                for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    low, high = max(0, low - 1), min(len(emit), high + 1)
                    stretches.append((k, low, emit[low:high]))
        found: list[list[Span]] = [[] for _ in texts]
        for (k, low, _), tags in zip(stretches, self.decode([e for *_, e in stretches])):
            found[k] += _read(tags, low)
        return found


def _read(tags: list[int], at: int) -> list[Span]:
    edges = [0, *(k for k in range(1, len(tags)) if tags[k] != tags[k - 1]), len(tags)]
    return [(at + a, tags[a] - 1, at + b) for a, b in zip(edges, edges[1:]) if tags[a]]


_DOT = r"(?:\.|\s\.\s|\s?\bdot\b\s?|\s?[(\[{]dot[)\]}]\s?)"
_SECRET = re.compile(r"[A-Za-z0-9_+/-]{0,80}")
_MAIL = re.compile(rf"[^\W_][\w%+-]*(?:{_DOT}[\w%+-]+)*(?:\s?@\s?|\s?[(\[{{]at[)\]}}]\s?|\sat\s)[^\W_][\w-]*(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}", re.I)


def _plausible(text: str, kind: int) -> bool:
    """What every span that the model adds has to fulfil."""
    digits = _digits(text)
    if kind == 0:
        return bool(_MAIL.fullmatch(text))
    if kind == 1:
        return len(parts := re.findall("[0-9]+", text)) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts) and not re.search("[a-z]", re.sub(r"\bdot\b|\(dot\)|\[dot\]", "", text, flags=re.I), re.I)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9\s./-]*[0-9]", text))
    if kind == 3:
        return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9(][0-9\s()./-]*[0-9]", text)) and bool(re.search(r"[\s()./-]", text))
    if kind == 4:
        return len(text) >= 16 and bool(re.fullmatch(r"[A-Za-z0-9_+/=.-]+", text)) and bool(digits) and bool(re.search("[A-Za-z]", text))
    return 12 <= len(digits) <= 19 and bool(re.fullmatch("[0-9]+", text))


def _spellings(digit, choose, number, word) -> list[tuple[int, list]]:
    """Kinds and makers of their spellings; the last spelling of a kind stands for those never learnt from."""

    def card(sep) -> str:
        body = choose("3456") + digit(choose((12, 13, 14, 14, 14)))
        body += next(d for d in "0123456789" if luhn(body + d))
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def mail(at, dot) -> str:
        name = f"{word()}{choose(('', '.', '_', digit(2), '.' + digit(2)))}{word()}"
        if len(dot) > 1:
            name = name.replace(".", dot)
        return f"{name}{at}{word()}{choose(('', digit(1), dot + word()))}{dot}{choose(('com', 'org', 'net', 'de', 'fr', 'es', 'co' + dot + 'uk'))}"

    octet = lambda: str(number(0, 255))
    address = lambda dot: dot.join(octet() for _ in range(4))
    code = lambda letters, n: "".join(choose(letters) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    spelled = [(a, d) for a in ("(at)", " (at) ", "[at]", " [at] ", " at ", " @ ") for d in (".", " dot ", "[dot]", " (dot) ") if (a, d) not in ((" at ", "."), ("[at]", "[dot]"))]
    return [
        (0, [*[lambda: mail("@", ".")] * 6, *[lambda a=a, d=d: mail(a, d) for a, d in spelled], lambda: mail("[at]", "[dot]")]),
        (1, [*[lambda: address(".")] * 3, *[lambda d=d: address(d) for d in (" . ", "[.]", " dot ", "(.)", "[dot]")], lambda: address(" [.] ")]),
        (2, [*[lambda: card("")] * 2, *[lambda d=d: card(d) for d in (" ", "-", "  ", "/", ".", " / ", " . ", "_", " – ")], lambda: card(" - ")]),
        (3, [lambda: f"+{number(1, 99)} ({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"+{number(1, 99)} {digit(3)} {digit(3)} {digit(4)}", lambda: f"({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"{digit(3)}-{digit(3)}-{digit(4)}", lambda: f"0{digit(2)} {digit(4)} {digit(4)}",
             lambda: f"0{digit(4)} {digit(6)}", lambda: f"{digit(3)}.{digit(3)}.{digit(4)}", lambda: " ".join(["0" + digit(1)] + [digit(2) for _ in range(4)]), lambda: f"(0{digit(3)}) {digit(3)} {digit(4)}", lambda: f"00{number(10, 99)} {digit(3)} {digit(7)}",
             lambda: f"0{digit(2)}-{digit(4)}-{digit(4)}", lambda: ".".join(["0" + digit(1)] + [digit(2) for _ in range(4)]), lambda: f"({digit(3)}) {digit(3)} {digit(4)}", lambda: f"0{digit(3)} {digit(3)} {digit(4)}"]),
        (4, [*[lambda: code("0123456789abcdef", 40)] * 2, lambda: code("0123456789abcdef", 32), lambda: "sk_live_" + code(base64, 24), lambda: "AKIA" + code("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + code(base64, 36), lambda: "AIza" + code(base64, 35),
             lambda: code("0123456789ABCDEF", 40), lambda: code(base64, number(20, 44)), lambda: code(base64, number(20, 44)), lambda: code("0123456789abcdef", 64), lambda: f"{word()}{choose('_-')}{code(base64, number(16, 30))}", lambda: "xoxb-" + code(base64, 24)]),
        (5, [*[lambda: digit(16)] * 3, lambda: choose("123456789") + digit(11), lambda: choose("123456789") + digit(14), lambda: choose("123456789") + digit(12)]),
    ]


#: What may stand before an entity, by kind; the last of each is never learnt from.
_LEADS = [["", "", "mail ", "write to ", "contact: ", "<", "e-mail: "], ["", "", "from ", "host ", "ip=", "server "], ["", "", "card ", "paid with ", "no. ", "visa "], ["", "", "call ", "tel. ", "phone: ", "fax "], ["token = \"", "key: ", "", "password=", "api_key='", "credential ", "secret "], ["", "", "account ", "id ", "konto "]]


def labelled_lines(n: int = 5000, seed: int = 11, unseen: bool = False) -> list[tuple[str, list[Span]]]:
    """Generated lines with labelled spans of all kinds in several spellings, and numbers, words and signs that are none.

    unseen gives lines of the spellings and leads that training never shows.
    """
    r = random.Random(seed)
    letters, digit = "abcdefghijklmnopqrstuvwxyzéüñ", lambda k: "".join(r.choice("0123456789") for _ in range(k))
    syllables = "the and ing er on at to of in re ed is it or an en es le la de que un des les ou ent ment ein ich und sch der die ver ung lo al ar do el ción ña os mas aux être schö ä ö".split()
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9))) if r.random() < 0.3 else "".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3))))

    def sentences() -> str:
        out, big = "", True
        if r.random() < 0.1:
            return " ".join([" ".join(word() for _ in range(r.randint(1, 3)))] * LINE)[:LINE]
        while len(out) < LINE:
            out += (word().capitalize() if big else word()) + r.choice((" ",) * 9 + (", ", ". ", ".\n", " at ", " dot "))
            big = out[-2:] in (". ", ".\n") or r.random() < 0.03
        return r.choice((out,) * 8 + (out.upper(), out.replace(" ", "!! "), out.replace(" ", "*** "), out.replace(" ", " | ")))[:LINE]

    plain = lambda: "".join(r.choice(letters[:26]) for _ in range(r.randint(2, 9)))
    kinds = _spellings(digit, r.choice, r.randint, plain)
    nothing = [
        lambda: str(r.randint(1900, 2030)), lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{digit(2)}:{digit(2)}", lambda: f"{r.randint(1, 99)},{digit(3)}", lambda: digit(r.randint(1, 8)), lambda: f"@{word()}",
        lambda: f"{digit(4)}-{digit(2)}-{digit(2)}", lambda: f"{digit(2)}/{digit(2)}/{digit(4)}", lambda: f"{word()} at {word()}", lambda: f"{word()} dot {word()}", lambda: f"{word()}.{word()}", lambda: f"£{r.randint(1, 99)},{digit(3)}.{digit(2)}",
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{word()}_{word()}", lambda: "".join(r.choice(letters) for _ in range(r.randint(14, 24))), lambda: f"CC BY-NC {r.randint(1, 4)}.0", lambda: f"https://{word()}.org/{word()}/{digit(3)}",
        lambda: f"pp. {digit(3)}-{digit(3)}", lambda: f"{digit(2)} {word()} {digit(4)}", lambda: f"({digit(4)})", lambda: f"{digit(1)}. {word()}", lambda: f"{word()} ({word()}) {word()}", lambda: "".join(r.choice(letters) for _ in range(12)).upper(),
    ]
    lines = []
    while len(lines) < n:
        if not unseen and r.random() < 0.35:
            lines.append((sentences(), []))
            continue
        text, spans = " ".join(word().capitalize() if r.random() < 0.2 else word() for _ in range(r.randint(0, 5))), []
        for _ in range(r.randint(1, 2)):
            text += " " * bool(text)
            if r.random() < 0.6:
                kind, makers = r.choice(kinds)
                maker = makers[-1] if unseen else r.choice(makers[:-1])
                lead, entity = _LEADS[kind][-1] if unseen else r.choice(_LEADS[kind][:-1]), maker()
                if kind == 5 and len(entity) > 12 and luhn(entity):
                    kind = 2
                if r.random() < 0.1:
                    entity, lead = entity.upper() if kind in (0, 4) else entity, lead.upper()
                text += lead
                spans.append((len(text), kind, len(text) + len(entity)))
                text += entity + {"<": ">", '"': '"', "'": "'"}.get(lead[-1:], "")
            else:
                text += r.choice(nothing)()
            text += r.choice(("", "", "", ".", ",", "!!", "***", "###", ";", " |")) + " " + " ".join(word() for _ in range(r.randint(1, 4)))
        if all(s[2] <= LINE for s in spans):
            lines.append((text[:LINE], spans))
    return lines


@lru_cache(maxsize=1)
def trained() -> Tagger:
    return Tagger().fit(labelled_lines())


def tagger_of(spark: SparkSession) -> Tagger:
    """The trained network; its weights are kept in the shared folder, so that they are learnt once."""
    inputs = inspect.getsource(sys.modules[__name__])  # sizes, seeds, rates, rounds and lines are all in this module
    path = f"{shared_folder(spark)}/larkspur-tagger-{hashlib.sha256(inputs.encode()).hexdigest()[:16]}"
    try:
        rows = spark.read.schema("name string, shape array<int>, weights binary").parquet(path).collect()
    except AnalysisException:
        rows = []
    tagger = Tagger()
    if {r.name for r in rows} >= tagger.p.keys():
        tagger.p = {r.name: np.frombuffer(r.weights, np.float32).reshape(r.shape) for r in rows}
        return tagger
    tagger = trained()
    kept = [(k, list(w.shape), w.astype(np.float32).tobytes()) for k, w in tagger.p.items()]
    spark.createDataFrame(kept, "name string, shape array<int>, weights binary").coalesce(1).write.parquet(path, mode="overwrite")
    return tagger


def find_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text; an added span is clear of base ones, of letters and digits beside it, and plausible."""
    held = [t or "" for t in texts]
    out: list[tuple[list[Span], list[Span]]] = []
    for text, model in zip(held, tagger.find(held)):
        base, added = base_spans(text), []
        for start, kind, end in model:
            while start < end and text[start] in " .,;:!*#|<>\"'":
                start += 1
            while end > start and text[end - 1] in " .,;:!*#|<>\"'":
                end -= 1
            if kind == 4:  # the whole run of signs that a secret may hold
                start, end = start - len(_SECRET.match(text[max(0, start - 80) : start][::-1])[0]), end + len(_SECRET.match(text, end)[0])
            if kind in (3, 5) and 13 <= len(digits := _digits(text[start:end])) <= 19 and luhn(digits):
                kind = 2
            clear = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
            if clear and all(end <= s or start >= e for s, _, e in base) and _plausible(text[start:end], kind):
                added.append((start, kind, end))
        out.append((base, added))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """text with the name of its kind in place of each span; overlapping spans become one, named for the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) for each row of docs (doc_id, text; more columns are ignored, whatever their names).

    base holds the spans of the fixed patterns, added those of the network: start, kind (its place in KINDS) and end, in
    order, ties by kind. Null and empty texts have none; very long ones are read whole; rows repeated whole, and rows
    without a doc_id, are reported each. An empty table gives no rows.
    """
    tagger = tagger_of(docs.sparkSession)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", kind), T.StructField("added", kind)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = find_spans(b.column("text").to_pylist(), tagger)
            columns = [pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x[i]] for x in spans], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "base", "added"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with the name of its kind in place of each span of text, and n_chars to match; null texts stay null."""
    tagger, schema = tagger_of(docs.sparkSession), docs.schema

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            texts = [t and redacted(t, base + added) for t, (base, added) in zip(texts, find_spans(texts, tagger))]
            columns = dict(zip(b.schema.names, b.columns))
            columns["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return small_batches(docs).mapInArrow(cleaned, schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [[[(s["start"], s["kind"], s["end"]) for s in x] for x in b.column(c).to_pylist()] for c in ("base", "added")]
            counts = [pa.array([sum(s[1] == k for s in x) for x in both[0]], pa.int64()) for k in range(len(BASE))]
            digests = [hashlib.sha256(joined(x).encode()).hexdigest() for x in both[0]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([joined(sorted(x + y)) for x, y in zip(*both)], pa.string()), pa.array([len(y) for y in both[1]], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_added long"
    return find_pii(documents(spark, sf_dir)).mapInArrow(digest, schema)

"""Runs against brute force over all stretches and periods."""

import hashlib
import random
import zlib

import pytest

from larkspur.llm import periodic

DIR = "/root/testdata/sf0.001"


def brute(w):
    """Every run of w: for each period, maximal stretches of words equal to the one a period later; smallest period first."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def texts(seed):
    r = random.Random(seed)
    kinds = "ab", "abc", "abcdefgh"
    for _ in range(400):
        yield [r.choice(r.choice(kinds)) for _ in range(r.randint(0, 60))]
    for _ in range(300):
        w = []
        while len(w) < r.randint(1, 150):
            block = [r.choice(r.choice(kinds)) for _ in range(r.randint(1, 9))]
            w += (block * r.randint(1, 7))[: r.randint(1, 60)]
            if r.random() < 0.3 and w:
                k = r.randrange(len(w))
                w += w[k : k + r.randint(1, 50)]
        yield w
    for n in (6, 7, 64, 500):
        yield ["a"] * n
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    yield list(b)
    yield list((b[:40] * 5 + "c") * 5)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_brute_force(seed):
    each = list(texts(seed))
    for w in each:
        ids = [ord(c) for c in w]
        assert periodic.runs(ids) == brute(w), w
    assert periodic.runs_of_texts([[c.encode() for c in w] for w in each]) == [sorted(brute(w), key=lambda x: (x[0], x[2])) for w in each]


def test_factors_are_the_longest_earlier_stretches():
    for w in texts(9):
        at = 0
        for begin, end, earlier in periodic.factors([ord(c) for c in w]):
            assert begin == at
            longest = max((k for k in range(1, len(w) - begin + 1) for s in range(begin) if w[s : s + k] == w[begin : begin + k]), default=0) if len(w) < 40 else None
            if earlier >= 0:
                assert earlier < begin and w[earlier : earlier + end - begin] == w[begin:end] and longest in (None, end - begin)
            else:
                assert end == begin + 1 and w[begin] not in w[:begin]
            at = end
        assert at == len(w)


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def expected(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    s, e, q = min(found, key=lambda x: (x[0] - x[1], x[0], x[2]), default=(None, None, None))
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(found, key=lambda x: (x[0], x[2])))
    best = (None,) * 4 if s is None else (s, e - s, q, 1000 * (e - s) // q)
    return (doc_id, len(found), *best, digest(lines), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op13_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = {tuple(r) for r in periodic.op13_periodic_runs(spark, DIR).collect()}
    assert got == {expected(k, t) for k, t in docs if len((t or "").split()) < 3000} | {g for g in got if g[0] in {k for k, t in docs if len((t or "").split()) >= 3000}}
    assert len(got) == len(docs) and sum(g[1] > 0 for g in got) > 5


def test_odd_rows(spark):
    long = " ".join(["over", "and"] * 40_000)
    rows = [(None, "a b a b a b a b"), (None, None), (1, ""), (1, "x " * 9), (1, "x " * 9), (2, long), (3, "a\x0bb\u00a0c " * 8), (None, "tied a b a b a b a b tied")]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, runs string, best int").repartition(3)
    got = periodic.find_runs(df).collect()
    assert len(got) == len(rows) and periodic.find_runs(df.where("false")).count() == 0
    by = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in got}
    assert by == {(None, "a b"): [(0, 8, 2)], (None, ""): [], (1, ""): [], (1, "x"): [(0, 9, 1)], (2, "over and"): [(0, 80_000, 2)], (3, "a b\u00a0c"): [(0, 16, 2)], (None, "tied a b tied"): [(1, 8, 2)]}

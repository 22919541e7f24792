"""Fair queueing against plain loops, over odd rows."""

import hashlib
import math

from larkspur.llm import mixing

COLUMNS = "doc_id long, text string, source string, range int, size string, place string, row string"


def plain(rows):
    """{(doc_id, size, source): [target, taken]} of rows (doc_id, text, source) with distinct doc_ids."""
    size = {k: len((t or "").encode().split()) for k, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(size[k] for k, _, x in rows if x == s) for s in sources}
    weight, total = {s: 1 + k % 3 for k, s in enumerate(sources)}, sum(own.values())
    held = set()
    while True:
        rest = sum(weight[s] for s in sources if s not in held)
        share = (total - sum(3 * own[s] for s in held)) / max(rest, 1)
        more = {s for s in sources if s not in held and weight[s] * share > 3 * own[s]}
        if not more:
            break
        held |= more
    target = {s: 3.0 * own[s] if s in held else weight[s] * share for s in sources}
    taken, packets = dict.fromkeys(size, 0), []
    for n, s in enumerate(sources):
        at, most = 0, math.ceil(target[s])
        queue = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k, _, x in rows if x == s)
        for _ in range(3):
            for _, k in queue:
                if size[k] and at < most:
                    words = min(size[k], most - at)
                    packets.append(((at + words) / target[s], n, at, k, words))
                at += size[k]
    for *_, k, words in sorted(packets):
        got = min(words, total)
        taken[k] += got
        total -= got
    return {k: (size[k], own[s], target[s], taken[k]) for k, _, s in rows}


def test_fair_queueing_is_the_plain_loop(spark):
    rows = [(k, " ".join(["w"] * (k * k % 37)), s) for k, s in enumerate(["hot"] * 60 + ["b", "", None, "ä", "zz", "Z"] * 6)]
    rows += [(1000, "x \x0b y\x1cz q", "one"), (1001, None, "one"), (1002, "", "empty"), (1003, "long " * 5000, "b")]
    df = spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], COLUMNS).repartition(5)
    mix, per_row = mixing.mixture(df)
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in per_row.collect()}
    assert got == plain(rows)
    assert all(taken <= 3 * size for size, _, _, taken in got.values())
    by_source = {}
    for k, _, s in rows:
        by_source.setdefault(s, []).append(got[k])
    assert all(abs(sum(x[3] for x in v) - v[0][2]) <= len(by_source) + 1 for v in by_source.values())
    served = sorted(mix.collect(), key=lambda r: r.begin)
    assert [r.begin for r in served] == [sum(x.words for x in served[:k]) for k in range(len(served))] and all(a.finish <= b.finish for a, b in zip(served, served[1:]))


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (7, "a b", "s"), (7, "a b", "s"), (7, "c", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(df)[1].collect()
    assert len(got) == 6 and sum(r.taken for r in got) == 11
    again = mixing.mixture(df.repartition(4))[1].collect()
    assert sorted(str(r[1:]) for r in got) == sorted(str(r[1:]) for r in again)
    assert mixing.mixture(df.where("false"))[1].count() == 0
    nothing = mixing.mixture(df.where("text IS NULL"))[1].collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)]

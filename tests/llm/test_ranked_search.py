"""The two-level index against scores of all documents, computed plainly."""

import math
import random
import re
from collections import Counter

import pytest

from larkspur.llm import ranked_search

TERM = re.compile(ranked_search.TERM)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """Sorted (item_id, rank, score) and the documents of each score above the last of its item."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // total if total else 10
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


def corpus(seed, n=600):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(400)]
    draw = lambda k: [words[min(399, int(r.paretovariate(0.6)) - 1)] for _ in range(k)]
    docs = [(k, r.choice([" ", ", ", "\x0b", "_"]).join(draw(r.randint(0, 80)))) for k in range(n)]
    docs += [(10_000 + k, docs[5][1]) for k in range(300)]  # copies tie
    docs += [(None, docs[7][1]), (None, docs[7][1]), (3, "Zebra ZEBRA zebra É"), (3, "zebra"), (20_000, None), (20_001, ""), (20_002, "-- ?!"), (20_003, " ".join(draw(60_000)))]
    items = [(k, " ".join(draw(r.randint(1, 30)))) for k in range(40)] + [(5, docs[5][1]), (None, docs[7][1]), (None, "zebra"), (91, None), (92, ""), (93, "nowhere"), (94, "ZEBRA é É"), (94, "zebra")]
    return docs, items


@pytest.mark.parametrize("parts", [1, 7])
def test_search_is_plain_scoring(spark, parts):
    docs, items = corpus(parts)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, block int").repartition(parts)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, query string")
    index = ranked_search.build_index(df)
    as_text = lambda rows: sorted(map(str, rows))
    want = as_text(tuple(x) for x in plain(docs, items))
    for lot in (200_000, 60):
        got = index.search(asked, lot=lot)
        assert as_text(tuple(r) for r in got.collect()) == want
    assert as_text(tuple(r) for r in index.search(asked, k=3).collect()) == as_text(plain(docs, items, 3))
    bounds = {r.term for r in index.table.where("term IS NOT NULL").collect()}
    assert bounds == {t for _, d in docs for t in terms(d)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.build_index(docs.where("false")).search(items).count() == 0
    index = ranked_search.build_index(docs)
    assert index.search(items.where("false")).count() == 0 and index.search(items).count() == 1
    assert index.search(items.where("false")).columns == index.search(items).columns

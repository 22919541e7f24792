"""Quick ways against slow ones: the automaton, and stretches that a pattern needs."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import classify, phrases

PATTERNS = [p for rules in (classify.CONTRACT, classify.HOURS, classify.WORKPLACE) for _, r in rules for p in classify.alternatives(r)] + [p for ps in classify.DISCIPLINES.values() for p in ps]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab +.#_é ", max_size=30), st.lists(st.text(alphabet="ab +.é", max_size=4), max_size=8))
def test_automaton_is_a_pattern_for_each_phrase(text, some):
    want = [k for k, p in enumerate(some) if p and re.search(rf"(?<!\w){re.escape(p)}(?!\w)", text)]
    assert phrases.whole_words(text, tuple(some)) == want


def test_phrases_in(spark):
    df = spark.createDataFrame([("I know C++ and PYTHON.",), (None,), ("",), ("pythons",)], "t string")
    got = df.select(phrases.phrases_in(F.col("t"), ["Python", "c++", "python", ""])).collect()
    assert [r[0] for r in got] == [[0, 1, 2], [], [], []]


def samples(pattern, r):
    """Texts that a pattern matches, by taking its parts one way or the other."""
    p = pattern.replace(r"\b", "")
    p = re.sub(r"\((?:\?:)?([^()]*)\)", lambda m: r.choice(m[1].split("|")), p)
    p = re.sub(r"\[\\s-\]\?", lambda _: r.choice(["", " ", "-"]), p)
    p = re.sub(r"\\s\*", lambda _: r.choice(["", " "]), p)
    p = re.sub(r"\\w\*", lambda _: r.choice(["", "al"]), p)
    p = re.sub(r"([a-z ])\?", lambda m: r.choice(["", m[1]]), p)
    return p.replace(r"\d", "5").replace(r"\.", ".")


def test_no_pattern_matches_without_its_stretch():
    r = random.Random(4)
    for pattern in PATTERNS:
        need = classify.literal(pattern)
        for _ in range(30):
            text = samples(pattern, r)
            assert re.search(pattern, text), (pattern, text)
            assert need in text, (pattern, need, text)
    assert sum(len(classify.literal(p)) > 1 for p in PATTERNS) >= 0.95 * len(PATTERNS)


def test_quick_classes_are_the_patterns(spark):
    r = random.Random(5)
    texts = [" ".join(samples(r.choice(PATTERNS), r) for _ in range(r.randint(0, 2))) + r.choice(["", "x", " zz"]) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (classify.CONTRACT, classify.HOURS, classify.WORKPLACE, [(n, "|".join(p)) for n, p in classify.DISCIPLINES.items()]):
        want = [next((n for n, p in rules if re.search(p, t)), "UNKNOWN") for t in texts]
        assert [x[0] for x in df.select(classify.first_match(F.col("t"), rules)).collect()] == want

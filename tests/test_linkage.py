"""Register candidates and the decision against brute force."""

import re

from larkspur.functions import text
from larkspur.operators import linkage

NAMES = ["Birkbeck College", "University of Bath", "UCL", "Green Institute", "The University", "Kings Academy Northern", "Bath Spa"]
REGISTER = [
    "Birkbeck, University of London and Associated Colleges of the South Eastern Region", "University of Bath", "University College London", "Evergreen Holdings of Somerset and Wales Limited",
    "Northern Ballet School Foundation for Young Dancers", "Bath Spa University", "Academy", "Abc", *[f"Northern Company Number {k}" for k in range(12)],
]


def grams(s):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"\w+", s.lower()) for i in range(len(w) + 1)}


def core(s):
    words = re.sub(r"[^\w\s]", " ", re.sub(r"\blimited\b", " ", s.lower())).split()
    return {w for w in words if w not in text.STOPWORDS + text.GENERIC}


def wanted(name):
    out = []
    for r in REGISTER:
        a, b = grams(name), grams(r)
        similarity = len(a & b) / len(a | b)
        longest = sorted(core(name), key=lambda t: (-len(t), t))[:2]
        if similarity >= 0.31 or any(len(t) >= 4 and t in r.lower() for t in longest):
            out.append((-similarity, r))
    return [r for _, r in sorted(out)[:8]]


def test_candidates_by_similarity_or_token(spark):
    names, register = spark.createDataFrame([(n,) for n in NAMES], "name string"), spark.createDataFrame([(r, "Worker (A rating)", "Skilled Worker") for r in REGISTER], "register_name string, type_rating string, route string")
    found = linkage.candidates(names, register)
    got = {}
    for row in sorted(found.collect(), key=lambda row: (-row.similarity, row.register_name)):
        got.setdefault(row.name, []).append(row.register_name)
        assert abs(row.similarity - len(grams(row.name) & grams(row.register_name)) / len(grams(row.name) | grams(row.register_name))) < 1e-9
    assert got == {n: w for n in NAMES if (w := wanted(n))}
    assert got["Birkbeck College"] == [REGISTER[0]] and REGISTER[3] in got["Green Institute"]
    decided = {row.name: row for row in linkage.decide(names, found, register).collect()}
    assert len(decided) == len(NAMES)
    said = {n: (d.method, d.verdict, d.matched_name, d.needs_review) for n, d in decided.items()}
    assert said["Birkbeck College"] == ("TRIGRAM", "NOT_FOUND", None, True) and said["University of Bath"] == ("EXACT", "CONFIRMED", "University of Bath", False)
    assert said["Bath Spa"] == ("NORMALISED", "CONFIRMED", "Bath Spa University", False) and decided["Bath Spa"].confidence == 0.95


def test_no_candidate_and_acronyms(spark):
    register = spark.createDataFrame([("University College London", "Worker (B rating)", "Skilled Worker")], "register_name string, type_rating string, route string")
    found = spark.createDataFrame([("UCL", "University College London", 0.05), ("Zzz", "University College London", 0.05)], "name string, register_name string, similarity double")
    names = spark.createDataFrame([("UCL",), ("Zzz",), ("Alone",)], "name string")
    got = {row.name: (row.method, row.confidence, row.candidates) for row in linkage.decide(names, found, register).collect()}
    assert got == {"UCL": ("TRIGRAM", 0.9, ["University College London"]), "Zzz": ("NONE", 0.05, ["University College London"]), "Alone": ("NONE", 0.0, [])}


def test_prefix_filter_loses_no_pair(spark):
    import random

    r = random.Random(4)
    parts = ["green", "blue", "works", "of", "the", "steel", "gate", "hill", "river", "stone"]
    names = sorted({" ".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(60)})
    register = sorted({" ".join(r.choices(parts, k=r.randint(1, 4))) + r.choice(["", " ltd", "s"]) for _ in range(80)})
    left, right = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in register], "register_name string")
    got = {(x.name, x.register_name) for x in linkage.candidate_pairs(left, right).collect()}
    want = {(n, m) for n in names for m in register if len(grams(n) & grams(m)) / len(grams(n) | grams(m)) >= 0.31 or any(len(t) >= 4 and t in m for t in sorted(core(n), key=lambda t: (-len(t), t))[:2])}
    assert got == want


def test_what_a_person_decided_stands(spark):
    columns = "institution_id long, verdict string, registered_legal_name string, method string, confidence double, needs_review boolean, resolved_by_human boolean"
    old = spark.createDataFrame([(1, "CONFIRMED", "A", "HUMAN", 1.0, False, True), (2, "NOT_FOUND", "", "NONE", 0.1, True, False)], columns)
    new = spark.createDataFrame([(k, "B_RATED", "X", "EXACT", 1.0, False, False) for k in (1, 2, 3)], columns)
    got = {r.institution_id: (r.verdict, r.resolved_by_human) for r in linkage.updated_matches(old, new).collect()}
    assert got == {1: ("CONFIRMED", True), 2: ("B_RATED", False), 3: ("B_RATED", False)}

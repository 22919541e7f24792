"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import decontamination, embedding_links, language, packing, pii, quality, simhash, substring_dedup, token_count, token_store
from larkspur.llm.shared import Forest, components

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefgéß") for _ in range(R.randint(1, 9))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(70)
TEXTS = [None, "", " \n ", "A", "Don't stop!!  Now\n\n<|endoftext|> 123", prose(40), PASSAGE, PASSAGE, prose(30) + " " + PASSAGE + " " + prose(20), prose(9000), prose(60) + "\n" + PASSAGE, "call +44 (20) 555-1234 or a.b@c.org"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "de" if k % 2 else "fr", "s", 0, "x") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_store(docs, empty, tmp_path):
    library, at = Tokenizer.from_file(WORD), 0
    store = token_store.write_store(docs, str(tmp_path / "a"), WORD)
    got = {r.doc_id: r for r in store.verify().collect()}
    read = {r.doc_id: r.ids for r in store.read().collect()}
    for k, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32, got[k].verified) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert read[k] == ids
        at += len(ids)
    assert store.chunks.count() == store.chunks.select("key").distinct().count()
    assert token_store.write_store(empty, str(tmp_path / "b"), WORD).verify().count() == 0


def test_chunks_are_found_again():
    ids = np.random.default_rng(1).integers(0, 49000, 20000)
    whole, shifted = set(), set()
    for ends, out, x in ((token_store.cut_points(ids), whole, ids), (token_store.cut_points(ids[37:]), shifted, ids[37:])):
        out.update(x[a:b].tobytes() for a, b in zip([0, *ends], ends))
    assert len(whole & shifted) > 0.8 * len(whole)
    assert token_store.crc32_joined(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(BYTE)
    for r in token_count.token_counts(docs, BYTE, limit=50).collect():
        t = TEXTS[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 50)
    assert token_count.token_counts(empty, BYTE).count() == 0


def test_packing(docs, empty):
    library, seen = Tokenizer.from_file(WORD), {}
    rows = packing.pack_documents(docs, WORD, capacity=256).collect()
    for r in rows:
        ids = (library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [0])[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= 256
    assert len(seen) <= -(-sum(r.length for r in rows) // 256) + 1
    assert packing.pack_documents(empty, WORD).count() == 0


def test_local_search_empties_bins():
    lengths = [R.randint(1, 1500) for _ in range(1500)]
    bins = packing.pack_lengths(lengths, 2048)
    assert sorted(p for b in bins for p in b) == list(range(1500)) and max(sum(lengths[p] for p in b) for b in bins) <= 2048
    assert len(bins) <= -(-sum(lengths) // 2048) + 2


def test_pii_base_spans():
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(5000):
        text, want = "".join(R.choice("aA0019.@%+-() ,é\n") for _ in range(R.randint(0, 40))), []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(text) == sorted(want)
    assert pii.base_spans("1" * 300_000 + "@" * 2000) == []


def f1(lines):
    found = [set(a + b) for a, b in pii.find_spans([t for t, _ in lines], pii.trained())]
    right = sum(len(set(want) & got) for (_, want), got in zip(lines, found))
    return 2 * right / (sum(len(want) for _, want in lines) + sum(map(len, found)))


def test_pii_model_and_redaction(spark, docs, empty):
    assert f1(pii.labelled_lines(400, seed=77)) >= 0.9
    unseen = pii.labelled_lines(400, seed=78, unseen=True)  # spellings and leads that training never shows
    assert f1(unseen) >= 0.9
    # The same lines inside long texts, read in overlapping windows.
    whole, want = [], []
    for text, spans in unseen[:60]:
        before = prose(R.randint(1, 400)) + " "
        whole.append(before + text + " " + prose(200))
        want.append({(s + len(before), k, e + len(before)) for s, k, e in spans})
    found = pii.find_spans(whole, pii.trained())
    assert sum(len(w & set(a + b)) for w, (a, b) in zip(want, found)) >= 0.9 * sum(map(len, want))
    assert sum(len(b) for _, b in found) > 40
    emits = pii.trained().joined_scores(whole[:20], True)
    short = lambda found: [[x for x in spans if x[2] - x[0] <= pii.OVERLAP] for spans in found]
    assert short(pii._read(t, 0) for t in pii.trained().decode(emits)) == short(pii.trained().find(whole[:20]))
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[11].text == "call [PHONE] or [EMAIL]" and rows[0].text is None and rows[9].text == TEXTS[9] and rows[11].kept == "x"
    assert pii.find_pii(empty).count() == 0
    again = pii.tagger_of(spark)
    assert all((again.p[k] == w).all() for k, w in pii.trained().p.items())


def without_repeats(rows, window=50):
    """Brute force: (n_words, n_removed, sha of what is left) of each (doc_id, text)."""
    words = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in words:
        for i in range(len(w) - window + 1):
            if k is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, k), k)
    out = []
    for k, w in words:
        gone = {j for i in range(len(w) - window + 1) if k is not None and first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if k is None else k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def reported(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame)[0].collect())


@pytest.mark.parametrize("crowded", [256, 3, 0])
def test_substring_dedup(docs, empty, monkeypatch, crowded):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    assert reported(docs.unionByName(docs.where("doc_id = 8"))) == without_repeats([*enumerate(TEXTS), (8, TEXTS[8])])
    assert substring_dedup.remove_repeats(empty)[0].count() == 0


def test_substring_dedup_of_one_large_group(spark):
    passage, rows = prose(90).split(), []
    for k in range(1200):  # each with a word or two of its own, most of their windows in many of the others
        own = list(passage)
        for _ in range(R.randint(0, 2)):
            own[R.randrange(90)] = f"own{R.randrange(400)}"
        rows.append((k * 7 % 1200, " ".join(own[R.randint(0, 3) :])))
    rows += [(5000, "again " * 40_000), (5001, "again " * 300 + "x"), (None, rows[0][1]), (3, rows[5][1] + " more"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert reported(frame) == without_repeats(rows)
    cleaned = substring_dedup.remove_repeats(frame)[1]
    assert cleaned.columns == ["doc_id", "text"]


def test_decontamination(spark, docs, empty):
    items = [(1, PASSAGE), (2, None), (3, ""), (4, prose(40)), (5, "zzz yyy")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edit_distance) for r in decontamination.find_items(docs, bench).collect()} == {(k, 1, 0) for k in (6, 7, 8, 10)}
    assert decontamination.find_items(empty, bench).count() == 0 and decontamination.find_items(docs, bench.where("false")).count() == 0


def test_edit_distance_and_recall():
    for _ in range(300):
        a, b = ("".join(R.choice("abc ") for _ in range(R.randint(m, n))) for m, n in ((1, 20), (0, 40)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontamination.edit_distance_within(a, b) == min(row)
    items = [prose(40) for _ in range(60)]
    edited = [prose(30) + " " + "".join(R.choice(("", c + "x", "q")) if R.random() < 0.05 else c for c in t) + " " + prose(30) for t in items]
    index = decontamination.Index(list(enumerate(items)))
    assert sum(k == i for k, i, *_ in index.hits(edited)) >= 0.9 * len(items)


def test_items_at_the_ends_of_texts():
    items = [prose(40) for _ in range(40)]
    index = decontamination.Index(list(enumerate(items)))
    for cut in (1, 2, 3):
        opens = [" ".join(t.split()[cut:]) + " " + prose(30) for t in items]
        closes = [prose(30) + " " + " ".join(t.split()[:-cut]) for t in items]
        for texts in (opens, closes):
            together = {(k, i) for k, i, *_ in index.hits(texts)}
            assert together == {(k, i) for k, t in enumerate(texts) for _, i, *_ in index.hits([t])} >= {(k, k) for k in range(40)}


def edited(text, n):
    t = list(text)
    for _ in range(n):
        k = R.randrange(len(t))
        t[k : k + 1] = R.choice(([], ["q"], [t[k], "x"]))
    return "".join(t)


@pytest.mark.parametrize("length", [6, 14, 30, 60, 82, 130, 300])
def test_recall_by_length_up_to_the_threshold(length):
    items = [prose(100)[:length].strip() for _ in range(40)]
    index = decontamination.Index(list(enumerate(items)))
    for share in (0.1, 0.15, 0.2):
        most = [int(len(t) * 0.2 + 1e-9) for t in items]
        texts = [" ".join(f"{prose(20)} {edited(t, int(len(t) * share))} {prose(20)}".split()) for t in items]
        held = {k for k, t in enumerate(items) if decontamination.edit_distance_within(t, texts[k]) <= most[k]}
        found = {k: d for k, i, d, *_ in index.hits(texts) if k == i}
        assert len(held & found.keys()) >= 0.95 * len(held) > 0
        assert all(d == decontamination.edit_distance_within(items[k], texts[k]) <= most[k] for k, d in found.items())


def test_edits_in_the_only_anchors():
    items = [f"{prose(3)} {'y' * 30}{k} {'z' * 30}" for k in range(20)]
    texts = [prose(20) + " " + "q".join(t.split(" ")[:2]) + "q " + " ".join(t.split(" ")[2:]) + " " + prose(20) for t in items]
    found = {(k, i) for k, i, *_ in decontamination.Index(list(enumerate(items))).hits(texts)}
    assert found >= {(k, k) for k in range(20)}


def test_edit_distances_side_by_side():
    items = ["".join(R.choice("abß ") for _ in range(n)) for n in (1, 5, 63, 64, 65, 128, 129, 200)]
    pairs = [(k, prose(R.randint(0, 5)) + edited(items[k], len(items[k]) // 6) + prose(2)) for k in range(8) for _ in range(20)]
    assert decontamination.edit_distances_within(items, pairs) == [decontamination.edit_distance_within(items[k], t) for k, t in pairs]


def test_simhash(docs, empty):
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    forest = Forest()
    prints = {k: simhash.fingerprint(t) & (2**64 - 1) for k, t in enumerate(TEXTS)}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                forest.join(a, b)
    assert {k: (r.fp & (2**64 - 1), r.component_id) for k, r in got.items()} == {k: (prints[k], forest.root(k)) for k in prints}
    assert simhash.groups(empty).count() == 0


def test_close_fingerprints(spark):
    base = [R.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << R.randrange(64) for _ in range(R.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(40)})
    forest, signed = Forest(), [v - (v >> 63 << 64) for v in values]
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                forest.join(i, j)
    want = {}
    for i in range(len(values)):
        want.setdefault(forest.root(i), set()).add(signed[i])
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for edges in (simhash.close_pairs(frame), simhash.ball_links(frame)):
        roots, got = {r.id: r.root for r in components(edges).collect()}, {}
        for v in signed:
            got.setdefault(roots.get(v, v), set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1050)] + [(7, 7)]
    R.shuffle(edges)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1050)}}


@pytest.mark.parametrize("chunk", [256, 8])
def test_embedding_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_links, "CHUNK", chunk)
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 64))
    x = np.repeat(base, 12, 0) + r.normal(size=(480, 64)) * r.choice([0.0, 0.05, 0.12], (480, 1))
    rows = [(k, v.tolist(), int(k % 2), "e") for k, v in enumerate(x.astype(np.float32))]
    rows += [(900, None, 1, "e"), (901, [0.0] * 64, 1, "e"), (902, [float("nan")] * 64, 1, "e"), (903, rows[0][1], None, "e"), (904, [None, 1.0], 1, "e"), (905, [], 1, "e")]
    got = {g.vec_id: g for g in embedding_links.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")).collect()}
    v = np.array([row[1] for row in rows[:480]], float)
    near = (v @ v.T) / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(v, axis=1) >= 0.98
    near &= (np.arange(480)[:, None] % 2) == (np.arange(480) % 2)
    np.fill_diagonal(near, False)
    assert sum(got[k].n_links for k in range(480)) >= 0.97 * near.sum()
    assert all(got[k].n_links <= near[k].sum() for k in range(480))
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(900, 906))


def test_language(spark, empty):
    words = {"aa": ["the", "and", "with", "this"], "bb": ["und", "nicht", "schön", "über"], "cc": ["être", "pour", "avec", "les"]}
    rows = [(k, " ".join(R.choice(words[lang]) for _ in range(40)), lang) for k in range(240) for lang in [("aa", "bb", "cc")[k % 3]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(train)
    test = spark.createDataFrame([(1, "and this with the"), (2, "nicht über und"), (3, "avec les être"), (4, None), (5, "12 !!"), (6, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.lang_rejected) for r in language.identify(test, model).collect()}
    assert got == {1: ("aa", False), 2: ("bb", False), 3: ("cc", False), 4: ("und", True), 5: ("und", True), 6: ("und", True)}
    assert language.identify(empty, language.train(empty)).count() == 0


def test_language_rejects_in_spite_of_letterless_rows(spark):
    words = {"aa": ["the", "and", "with", "this", "town", "house"], "bb": ["und", "nicht", "schön", "über", "haus", "stadt"]}
    clean = [(k, " ".join(R.choice(words[lang]) for _ in range(30)), lang) for k in range(400) for lang in [("aa", "bb")[k % 2]]]
    bare = [(1000 + k, ("", " ", "12 345", "!!")[k % 4], ("aa", "bb")[k // 4 % 2]) for k in range(80)]
    model = language.train(spark.createDataFrame(clean + bare, "doc_id long, text string, lang string"))
    assert (model.limits > 0.1).all()
    kept = model.predict([t for k, t, _ in clean if zlib.crc32(str(k).encode()) % 4 == 2])
    assert kept and not any(rejected for _, _, rejected in kept)
    assert all(rejected for _, _, rejected in model.predict(["qqq xyzzy fjkl pqvvx", "zzzz kkkk", "Привет мир"]))
    assert not any(language.fit([(language.gram_counts([t])[0], "aa") for t in ("the town",)]).predict(["the town"])[0][2:])


def test_quality(spark, docs, empty):
    rows = [(k, prose(60) if k % 2 else " ".join(w + "$$$" for w in prose(60).split())) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    stats = quality.with_statistics(frame)
    trees = quality.train(stats, spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int"))
    right = [(r.score >= 0.5) == bool(r.doc_id % 2) for r in quality.score(stats, trees).collect()]
    assert sum(right) > 390
    assert all(0 <= r.score <= 1 for r in quality.score(quality.with_statistics(docs), trees).collect())
    assert quality.score(quality.with_statistics(empty), trees).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    clean = [prose(50 + k) for k in range(30)]
    leak = prose(60)
    texts = [*clean, clean[3], prose(20) + " " + leak + " " + prose(20), "12 34", clean[5] + " mail me@site.org"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.collect()})
    alone = [simhash.fingerprint(t) & (2**64 - 1) for t in texts]
    forest = Forest()
    for a in seen[0]:
        for b in seen[0]:
            if (alone[a] ^ alone[b]).bit_count() <= 3:
                forest.join(a, b)
    everything = set(range(len(texts)))
    assert seen[0] == everything - {32}
    assert seen[1] == {forest.root(k) for k in seen[0]} and 30 not in seen[1]
    assert seen[2] == seen[3] == seen[1] - {31}
    assert not any("@" in r.text for r in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == seen[3] and all(r.length <= 2048 for r in packed)

"""Each query's contract on the smallest tables, and every operator on rows without ids, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from larkspur.llm import decontamination, embedding_links, language, packing, pii, quality, queries, simhash, substring_dedup, token_count, token_store
from larkspur.llm.shared import Forest, shared_folder

DIR = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
R = random.Random(11)
WORDS = ["".join(R.choice("abcdefgß") for _ in range(R.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def rows_of(spark, name):
    return __spark_entry__.queries()[name](spark, DIR).collect()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op1_finds_what_brute_force_over_all_pairs_finds(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    plain = lambda t: decontamination.folded([t])[1:-1].tobytes().decode().strip()
    some = [(i, plain(t)) for i, t in items][:8]
    want = {(k, i) for k, t in texts.items() if (p := plain(t)) for i, item in some if item and decontamination.edit_distance_within(item, p) <= int(len(item) * 0.2 + 1e-9)}
    found = rows_of(spark, "op1_decontamination")
    got = {(r.doc_id, r.item_id) for r in found if r.item_id in {i for i, _ in some}}
    assert len(want & got) >= 0.9 * len(want) and got <= want
    assert all(0.8 <= r.similarity <= 1 for r in found)


def test_op2_columns(spark, texts):
    for r in rows_of(spark, "op2_pii"):
        base = pii.base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(pii.joined(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added


def test_op3_and_op6_and_op7(spark, texts):
    word, byte, at = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE), 0
    ids = {k: word.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    for r in sorted(rows_of(spark, "op3_token_store")):
        own = np.array([*ids[r.doc_id], 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (at, len(own), zlib.crc32(own.tobytes()), True)
        at += len(own)
    seen, held = {}, {}
    for r in rows_of(spark, "op6_pack"):
        own = np.array([*ids[r.doc_id], 0], "<u4")[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and zlib.crc32(own.tobytes()) == r.ids_crc32 and len(own) == r.length
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == {k: len(v) + 1 for k, v in ids.items()}
    assert len(seen) <= -(-sum(held.values()) // 2048) + 1  # one more than the bound below which no packing can be
    for parts in seen.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
    for r in rows_of(spark, "op7_token_counts"):
        n = len(byte.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_op4_is_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = {(r[0], r[1], r[2], r[3]) for r in db.execute(queries.ORACLES["op4_embedding_links"]).fetchall()}
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in rows_of(spark, "op4_embedding_links")}
    assert len(got & want) >= 0.97 * len(want)


def test_op5_is_brute_force(spark, texts):
    words, first = {k: t.encode().split() for k, t in texts.items()}, {}
    for k in sorted(words):
        for i in range(len(words[k]) - 49):
            first.setdefault(tuple(words[k][i : i + 50]), k)
    for r in rows_of(spark, "op5_substring_dedup"):
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < r.doc_id for j in range(i, i + 50)}
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())


def test_op8_and_op9_columns(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    scored = rows_of(spark, "op8_quality")
    assert {r.doc_id for r in scored} == set(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in scored)
    right = [(r.score >= 0.5) == bool(labels[r.doc_id]) for r in scored if r.doc_id in labels and r.held_out]
    assert sum(right) >= 0.8 * len(right) > 0
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    told = rows_of(spark, "op9_language")
    assert {r.doc_id for r in told} == set(texts) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in told)
    unseen = [r for r in told if r.held_out and lang[r.doc_id] and any(c.isalpha() for c in texts[r.doc_id])]
    assert sum(r.lang_pred == lang[r.doc_id] for r in unseen) >= 0.95 * len(unseen)


def test_signs_are_no_letters(spark):
    model = language.fit([(language.gram_counts([t])[0], "en") for t in (prose(50), prose(50))])
    assert [x[0] for x in model.predict(["½ ²", "③ Ⅷ 12 _", "", None, "½ a", "ª"])] == ["und"] * 4 + ["en"] * 2
    own = next(k for k in range(9) if not held_out(k))
    shared = spark.createDataFrame([(own, prose(30), "en")] * 3000, "doc_id long, text string, lang string")
    assert len(language.train(shared, per_language=10_000).languages) == 1


def test_op10_is_brute_force(spark, texts):
    prints, forest = {k: simhash.fingerprint(t) & (2**64 - 1) for k, t in texts.items()}, Forest()
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                forest.join(a, b)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows_of(spark, "op10_simhash")} == {(k, f"{p:016x}", forest.root(k)) for k, p in prints.items()}


def test_flat_trees_are_plain_trees():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(500, 5)), (r.random(500) < 0.5).astype(float)
    y[x[:, 2] > 0.3] = 1
    trees = quality.fit(x, y, trees=7, depth=3)
    def plain(row):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [plain(row) for row in x])
    first = quality.fit(x, (x[:, 2] > 0.3).astype(float), trees=1, depth=1)
    assert first.feature[0, 0] == 2 and abs(first.cut[0, 0] - 0.3) < 0.15


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, runs string, label int, lang_pred string, stats string, root string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "x", 1, "mine", "x", "x", "x") for i, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, one id for two texts, whole repeats, null and empty texts, and columns named like the operators' own."""
    a, b, c = prose(80), prose(80), prose(120)
    return frame(spark, [(1, a), (1, a), (1, b), (None, c), (None, c), (None, prose(60)), (2, None), (3, ""), (4, a), (5, c + " +44 (20) 555-1234")])


def test_odd_rows_are_kept(spark, odd, tmp_path):
    n, empty = odd.count(), odd.where("false")
    store = token_store.write_store(odd, str(tmp_path / "s"), WORD)
    got = store.verify().collect()
    assert len(got) == n and all(r.verified for r in got) and sorted(r.start for r in got) == list(np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1])
    assert store.read().count() == n
    for run in (lambda d: token_count.token_counts(d, BYTE), pii.find_pii, pii.redact, simhash.groups, lambda d: packing.pack_documents(d, WORD), lambda d: substring_dedup.remove_repeats(d)[0], quality.with_statistics):
        assert run(odd).count() == n and run(empty).count() == 0
    model = language.fit([(language.gram_counts([t])[0], "en") for t in (prose(50), prose(50))])
    assert language.without_rejected(odd, model).columns == odd.columns and language.identify(odd, model).where("lang_pred = 'mine'").count() == 0
    linked = simhash.groups(odd).where("doc_id IS NULL").collect()
    assert {r.component_id for r in linked} <= {None, 5} and len(linked) == 3
    one = simhash.one_of_each_group(odd)
    fingerprints = {simhash.fingerprint(r.text) for r in odd.collect()}
    assert one.columns == odd.columns and len({simhash.fingerprint(r.text) for r in one.collect()}) == one.count() <= len(fingerprints)
    item = odd.where("doc_id = 4").first().text
    bench = spark.createDataFrame([(1, item), (None, "x"), (2, None), (1, item)], "item_id long, text string")
    left = decontamination.without_items(odd, bench)
    assert left.columns == odd.columns and left.count() == n - 3 and decontamination.find_items(odd, bench).count() == 6
    assert decontamination.without_items(empty, bench).count() == 0
    null_item = spark.createDataFrame([(1, odd.where("doc_id IS NULL").first().text)], "item_id long, text string")
    assert decontamination.without_items(odd, null_item).where("doc_id IS NULL").count() < 3
    score = quality.score(quality.with_statistics(odd), quality.train(quality.with_statistics(odd), spark.createDataFrame([], "doc_id long, quality int")))
    assert {r.score for r in score.collect()} == {0.5}


def test_a_changed_store_is_noticed(spark, odd, tmp_path):
    path = str(tmp_path / "s")
    token_store.write_store(odd, path, WORD)
    store = token_store.TokenStore(spark, path)
    assert all(r.verified for r in store.verify_files().collect())
    rows = store.recipes.collect()
    lost = spark.createDataFrame([r for r in rows if r.doc_id != 4], store.recipes.schema)
    lost.write.parquet(f"{path}/fewer")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: B018  the session is up
    import os

    os.rename(f"{path}/recipes", f"{path}/all")
    os.rename(f"{path}/fewer", f"{path}/recipes")
    broken = token_store.TokenStore(spark, path)
    assert not all(r.verified for r in broken.verify_files().collect()) and not all(r.verified for r in broken.verify().collect())
    os.rename(f"{path}/recipes", f"{path}/fewer")
    os.rename(f"{path}/all", f"{path}/recipes")
    chunks = store.chunks.collect()
    bad = spark.createDataFrame([(r.key, bytes(r.payload[:-2]) + b"\0\1" if k == 0 else r.payload, r.width) for k, r in enumerate(chunks)], "key binary, payload binary, width int")
    os.rename(f"{path}/data/kind=chunk", f"{path}/kept")
    bad.write.parquet(f"{path}/data/kind=chunk")
    found = token_store.TokenStore(spark, path).verify().collect()
    assert 0 < sum(not r.verified for r in found) < len(found)
    roots = [hashlib.blake2b(bytes([k]), digest_size=16).digest() for k in range(40)]
    for n in range(41):
        tree = token_store.Merkle()
        for leaf in roots[:n]:
            tree.add(leaf)
        assert tree.root() == token_store.merkle_root(roots[:n])


def test_vectors_without_ids_and_with_shared_ones(spark):
    one, other = [1.0, 0.0, 0.0, 0.01], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, one, 1), (1, other, 1), (None, one, 1), (2, one, 1), (3, other, 2), (None, [0.0] * 4, 1)]
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embedding_links.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == [(-1, 0, -1, True), (-1, 2, 1, False), (1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert embedding_links.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, digest string")).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as Some

    session = lambda master: Some(conf=Some(get=lambda *_: None), sparkContext=Some(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
    assert shared_folder(session("local[4]"))


def test_pipeline_keeps_odd_rows(spark, tmp_path):
    import corpus_pipeline

    clean = [prose(60) for _ in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(clean)] + [(None, prose(60), "en", "s", 1), (3, clean[3], "en", "s", 1), (5, prose(70), "en", "s", 1), (None, clean[7], "en", "s", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert all(stage(spark, d, str(tmp_path)).count() == 0 for d in (docs.where("false"),))
    left = docs.collect()
    assert sum(r.doc_id is None for r in left) == 1 and sum(r.doc_id == 3 for r in left) == 1 and sum(r.doc_id == 5 for r in left) == 2 and len(left) == 42


def test_op5_repeats_and_shared_ids_take_linear_time(spark):
    """20,000 whole repeats of a row and 20,000 texts of one id, against brute force."""
    shared, tail = prose(60), [prose(55) for _ in range(4)]
    rows = [(1, shared + " " + tail[0])] + [(2, tail[1] + "\t" + shared)] * 20_000 + [(3, f"{k} {shared} {k}") for k in range(20_000)] + [(4, shared), (5, tail[3])]
    started = time.time()
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))[0].collect()
    assert time.time() - started < 150
    assert len(got) == len(rows)
    lost = {k: {r.n_removed for r in got if r.doc_id == k} for k in (1, 2, 3, 4, 5)}
    assert lost == {1: {0}, 2: {60}, 3: {60}, 4: {60}, 5: {0}}
    assert {r.kept_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(tail[1].encode()).hexdigest()}
    assert {r.kept_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256(f"{k} {k}".encode()).hexdigest() for k in range(20_000)}

"""Language identification by the nearest of several centroids per language.

A document's vector holds hashed n-grams of the bytes of its lower-cased letters (word ends included), log-damped,
weighted by inverse document frequency and normalised. Spherical k-means gives each language a few centroids; the
highest cosine decides. A document is rejected if its text has no letter or is farther from the nearest centroid than the
limit of its language, which comes from documents that did not make the centroids they are compared with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import documents, forget, keep, small_batches

WIDTH = 4096
#: About so many labelled documents of each language train the model.
SAMPLE_PER_LANGUAGE = 600
#: Of so many languages, the most frequent, and so many documents in all at most, should lang hold anything and everything.
LANGUAGES, SAMPLE = 500, 12_000
CENTROIDS = 4
#: A document is rejected below this share of the cosine that all but so many of a language's documents reach.
REJECT, LOW = 0.6, 0.01
#: ASCII other than letters stands for a space.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def gram_counts(texts: list[str]) -> np.ndarray:
    """A row for each text: counts of its hashed one-, two- and three-byte grams."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for k, text in enumerate(texts):
        raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
        space = raw == 32
        a = raw[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
        if len(a) < 3:
            continue
        pairs = a[:-1] * np.uint32(257) + a[1:]
        triples = pairs[:-1] * np.uint32(263) + a[2:]
        for grams in (a, pairs, triples):
            mixed = grams * np.uint32(2654435761)
            out[k] += np.bincount(mixed >> np.uint32(20), minlength=WIDTH)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row each
    of: np.ndarray  # the language of each centroid
    limits: np.ndarray  # one for each language

    def vectors(self, texts: list[str]) -> np.ndarray:
        return weighted(gram_counts(texts), self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language or und, score, rejected) for each text."""
        out: list[tuple[str, float, bool]] = []
        for at in range(0, len(texts), 256):
            part = [t or "" for t in texts[at : at + 256]]
            if not len(self.centroids):
                out += [("und", 0.0, True)] * len(part)
                continue
            cosines = self.vectors(part) @ self.centroids.T
            best = cosines.argmax(1)
            for t, k, c in zip(part, best.tolist(), cosines.max(1).tolist()):
                out.append((self.languages[self.of[k]], min(1.0, max(0.0, c)), c < self.limits[self.of[k]]) if any(map(str.isalpha, t)) else ("und", 0.0, True))
        return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of unit vectors by spherical k-means; starts far apart, without chance."""
    chosen = [int((v @ v.mean(0)).argmax())]
    nearest = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    centroids = v[chosen]
    for _ in range(rounds):
        of = (v @ centroids.T).argmax(1)
        sums = np.stack([v[of == j].sum(0) if (of == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids


def low_cosine(v: np.ndarray) -> float:
    """The cosine that all but the share LOW of a language's vectors have with centroids of the other half; nan for one vector."""
    halves = [h for h in (v[::2], v[1::2]) if len(h)]
    if len(halves) < 2:
        return float("nan")
    cosines = [(a @ clustered(b, CENTROIDS).T).max(1) for a, b in (halves, halves[::-1])]
    return float(np.quantile(np.concatenate(cosines), LOW))


def fit(rows: list[tuple[np.ndarray, str]]) -> Model:
    """From (gram counts, language); no rows give a model that rejects everything."""
    if not rows:
        return Model([], np.ones(WIDTH, np.float32), np.zeros((0, WIDTH), np.float32), np.zeros(0, int), np.zeros(0))
    counts = np.stack([c for c, _ in rows]).astype(np.float32)
    languages = sorted({lang for _, lang in rows})
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(1)
    v, y = weighted(counts, idf), np.array([languages.index(lang) for _, lang in rows])
    sets = [clustered(v[y == k], CENTROIDS) for k in range(len(languages))]
    low = np.array([low_cosine(v[y == k]) for k in range(len(languages))])
    limits = REJECT * np.where(np.isnan(low), np.nanmin(low) if not np.isnan(low).all() else 0.0, low)
    return Model(languages, idf, np.concatenate(sets), np.repeat(np.arange(len(languages)), [len(c) for c in sets]), limits)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on about per_language documents of each language, drawn by a hash of their ids from the rows not held out.

    The sample is bounded by LANGUAGES and SAMPLE too, in rows: were more drawn because they share an id, the first to come
    would count. Texts without a letter teach nothing about a language and are left
    out, as are rows without a lang; rows without a doc_id aren't drawn, repeated rows are drawn together. Very long texts
    are read whole. An empty table gives a model that rejects everything.
    """
    learned = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).where(~held_out(F.col("doc_id")))
    sizes = learned.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    per_language = min(per_language, SAMPLE // max(1, len(sizes)))
    share = docs.sparkSession.createDataFrame([(r["lang"], per_language / r["count"]) for r in sizes] or [("", 0.0)], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = learned.select("doc_id", "text", "lang").join(F.broadcast(share), "lang").where(drawn < F.col("share")).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = np.minimum(gram_counts(part.column("text").to_pylist()), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), part.column("lang")], ["counts", "lang"])

    kept = keep(small_batches(sample).mapInArrow(counted, "counts binary, lang string"), "sample")
    rows = kept.limit(2 * SAMPLE).collect()
    forget(kept)
    rows.sort(key=lambda r: (r.lang, bytes(r.counts)))
    return fit([(np.frombuffer(r.counts, "<u2"), r.lang) for r in rows])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text) and lang_pred, lang_score, lang_rejected; columns of these names are replaced, others pass as they are.

    Null texts and texts without a letter are und and rejected. Each row is judged by its text alone, so repeated rows get
    the same answer, and rows without a doc_id get one; of centroids at one distance the first language by name wins.
    An empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.predict(b.column("text").to_pylist())
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    return small_batches(docs).mapInArrow(predicted, schema)


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text the model doesn't reject."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not rejected for _, _, rejected in model.predict(b.column("text").to_pylist())], pa.bool_()))

    return small_batches(docs).mapInArrow(kept, docs.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))

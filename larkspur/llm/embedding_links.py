"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a fast Hadamard transform; a vector's hash is the nearest signed axis.
A bucket is named by several rotations together; each of TABLES tables also gives a vector the buckets in which its
least sure hashes take the second nearest axis (multiprobe). Vectors that share a bucket are compared by cosine in
double precision, in blocks, each pair only in the first bucket that its two vectors share. Equal vectors are compared
once, by a class representative. A bucket of more than CHUNK vectors is cut into chunks and compared chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.shared import Forest, components, forget, keep

TABLES, HASHES, PROBES, CHUNK = 8, 3, 2, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of the rows; their length is a power of two."""
    x, step, n = x.copy(), 1, x.shape[1]
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def codes(v: np.ndarray) -> np.ndarray:
    """Buckets of each unit vector: (rows, TABLES, 1 + PROBES); its own first, then the probed ones."""
    n, width = v.shape
    size = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :width] = v
    out = np.zeros((n, TABLES, 1 + PROBES), np.int64)
    for table in range(TABLES):
        best, second, margin = (np.zeros((n, HASHES), t) for t in (np.int64, np.int64, float))
        for k in range(HASHES):
            r = np.random.default_rng(1000 * table + k)
            x = padded
            for _ in range(3):
                x = hadamard(x * r.choice((-1.0, 1.0), size))
            rows, size_of = np.arange(n), np.abs(x)
            top = np.argpartition(-size_of, 1, axis=1)[:, :2]
            swap = size_of[rows, top[:, 0]] < size_of[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            best[:, k] = 2 * top[:, 0] + (x[rows, top[:, 0]] < 0)
            second[:, k] = 2 * top[:, 1] + (x[rows, top[:, 1]] < 0)
            margin[:, k] = size_of[rows, top[:, 0]] - size_of[rows, top[:, 1]]
        place = (2 * size) ** np.arange(HASHES)
        own = best @ place
        out[:, table, 0] = own
        for probe, k in enumerate(np.argsort(margin, axis=1)[:, :PROBES].T):
            out[:, table, 1 + probe] = own + (second[np.arange(n), k] - best[np.arange(n), k]) * place[k]
    return out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["vec_id", "label", "width", "digest", "vector", "codes"]
    for b in batches:
        ids, labels, vectors = (b.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))
        by_width: dict[int, list[int]] = {}
        for k, (label, v) in enumerate(zip(labels, vectors)):
            if label is not None and v and None not in v and np.isfinite(x := np.array(v, float)).all() and (norm := np.linalg.norm(x)) > 0 and np.isfinite(norm):
                by_width.setdefault(len(v), []).append(k)
        rows = [(i, label, None, None, None, None) for i, label in zip(ids, labels)]
        for width, own in by_width.items():
            x = np.array([vectors[k] for k in own], float) + 0.0
            found = codes(x / np.linalg.norm(x, axis=1, keepdims=True))
            for k, v, c in zip(own, x, found):
                digest = hashlib.blake2b(labels[k].encode() + b"\0" + v.tobytes(), digest_size=16).digest()
                rows[k] = (ids[k], labels[k], width, digest, v.tobytes(), c.ravel().tolist())
        types = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _verified(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes | None, int]] = []
            for table, code, members in zip(batch.column("table").to_pylist(), batch.column("code").to_pylist(), batch.column("members")):
                members = members.as_py()
                x = np.stack([np.frombuffer(m["vector"]) for m in members])
                norm = np.linalg.norm(x, axis=1)
                chunk = np.array([m["chunk"] for m in members])
                near = (x @ x.T) / norm[:, None] / norm >= threshold
                near &= np.triu(np.ones_like(near), 1)
                if (chunk != chunk[0]).any():
                    near &= chunk[:, None] != chunk
                a, b = np.nonzero(near)
                if not len(a):
                    continue
                c = np.array([m["codes"] for m in members]).reshape(len(members), TABLES, 1 + PROBES)
                first = np.ones(len(a), bool)  # only in the first bucket that both have
                for t in range(table + 1):
                    same = c[a, t][:, :, None] == c[b, t][:, None, :]
                    if t < table:
                        first &= ~same.any((1, 2))
                    else:
                        shared = np.where(same.any(2), c[a, t], np.iinfo(np.int64).max).min(1)
                        first &= shared == code
                a, b = a[first], b[first]
                ids, copies = [m["digest"] for m in members], np.array([m["copies"] for m in members])
                links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                out += [(ids[k], None, int(links[k])) for k in np.flatnonzero(links)]
                forest = Forest()
                out += [(ids[p], ids[q], 0) for p, q in zip(a.tolist(), b.tolist()) if forest.join(p, q)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "links"])

    return verify


def links(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    A row whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, links with
    nothing; vectors of different lengths don't link. Rows are nodes of their own: rows repeated whole link with each
    other, rows that share a vec_id but not a vector link only if they are close. A row with a null vec_id links and is
    counted like any other; component_id is the smallest vec_id of the component, null if it has none, and kept is whether
    both are the same or both null. More columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = keep(rows.mapInArrow(_prepared, "vec_id long, label string, width int, digest binary, vector binary, codes array<long>"), "vectors")
    first = [F.first(c).alias(c) for c in ("label", "width", "vector", "codes")]
    classes = keep(v.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), *first), "classes")
    key = ["label", "width", "table", "code"]
    places = classes.select("digest", "label", "width", F.posexplode("codes").alias("place", "code")).withColumn("table", F.floor(F.col("place") / (1 + PROBES)).cast("int"))
    places = places.select("digest", *key)
    shared = keep(places.groupBy(*key).count().where("count > 1").withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count"), "buckets")
    cells = places.join(shared, key).withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("digest", *key, "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    full = cells.join(classes.select("digest", "copies", "vector", "codes"), "digest")
    members = full.groupBy(*key, "low", "high").agg(F.collect_list(F.struct("digest", "copies", "vector", "codes", "chunk")).alias("members")).where(F.size("members") > 1)
    found = keep(members.select("table", "code", "members").mapInArrow(_verified(threshold), "a binary, b binary, links long"), "links")
    forget(shared)
    counts = keep(found.where("b IS NULL").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("n")), "counts")
    roots = keep(components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "digest"), "roots")
    rooted = classes.select("digest", "least", "copies").join(counts, "digest", "left").join(roots, "digest", "left")
    rooted = keep(rooted.select("digest", "least", F.coalesce("root", "digest").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = keep(rooted.join(least, "root").select("digest", "n_links", "component_id"), "labelled")
    out = v.select("vec_id", "digest").join(labelled, "digest", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""SimHash near-duplicates, found with BK-trees over shards of fingerprints.

Two fingerprints that differ in at most three bits agree on some blocks of them, so every combination of blocks makes a
shard key and close fingerprints meet in a shard. A shard's BK-tree keys children by their integer Hamming distance to
the parent; a search follows only edges within the radius of its own distance. Shards stay bounded: one with more than
CHUNK fingerprints is cut into chunks, and each pair of chunks is searched on its own; one so large that pairs of chunks
would carry more than the ball of two bits around each fingerprint gives its links by what those balls share. Only
distinct fingerprints are searched, and a shard gives the edges of a spanning forest of its links. Shard trees are built
where they are searched and aren't broadcast, since a broadcast would take all fingerprints through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import Forest, components, documents, forget, keep, small_batches

RADIUS, SHINGLE, CHUNK, _ALL = 3, 3, 256, 0xFFFF_FFFF_FFFF_FFFF
#: A shard of more chunks than this is linked by balls: 65 values within one bit and 2,081 within two of each fingerprint.
BALL = 1 + 64 + 64 * 63 // 2 + 65


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text; 0 for null and for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "little", signed=True)


class Tree:
    """A BK-tree over unsigned 64-bit integers."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                below = self.children[at].setdefault(d, new)
                if below == new:
                    return
                at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Places, in the order added, of the values at most radius away."""
        found, to_do = [], [0] if self.values else []
        while to_do:
            at = to_do.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) > 2 * radius + 1:
                to_do += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
            else:
                to_do += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return found


def block_keys(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Combinations of (shift, bits) such that fingerprints within radius agree on one; finer for larger n."""
    for blocks in range(radius + 1, radius + 5):
        agree = blocks - radius
        edges = [64 * k // blocks for k in range(blocks + 1)]
        chosen = [[(edges[k], edges[k + 1] - edges[k]) for k in c] for c in combinations(range(blocks), agree)]
        if n <= 16 << min(sum(bits for _, bits in c) for c in chosen):
            break
    return chosen


def _shard_edges(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for members in batch.column("members"):
                rows = [(m["fp"], m["chunk"]) for m in members.as_py()]
                first = min(c for _, c in rows)
                apart = any(c != first for _, c in rows)
                tree, values, forest = Tree(), [], Forest()
                for fp, chunk in rows:
                    if apart and chunk == first:
                        tree.add(fp & _ALL)
                        values.append(fp)
                for fp, chunk in rows:
                    if apart and chunk == first:
                        continue
                    for k in tree.within(fp & _ALL, radius):
                        if forest.join(values[k], fp):
                            out_a.append(values[k])
                            out_b.append(fp)
                    if not apart:
                        tree.add(fp & _ALL)
                        values.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return search


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text; more columns are ignored)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long")


def _ball_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(centre, fp, near) of each fp: all values at most two bits away; near where at most one."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
    near = np.arange(len(masks)) <= 64
    for b in batches:
        for at in range(0, b.num_rows, 64):
            own = b.column("fp").slice(at, 64).to_numpy(zero_copy_only=False).view(np.uint64)
            centres = (own[:, None] ^ masks).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(centres), pa.array(np.repeat(own.view(np.int64), len(masks))), pa.array(np.tile(near, len(own)))], ["centre", "fp", "near"])


def ball_links(members: DataFrame) -> DataFrame:
    """Edges (a, b) that span the links within three bits among members (fp), in time linear in their number.

    Two values are within three bits if one is within one bit and the other within two of some centre, so all that share
    a centre with a value within one bit of it are linked, directly or through that value.
    """
    balls = members.select("fp").distinct().mapInArrow(_ball_edges, "centre long, fp long, near boolean")
    hubs = balls.groupBy("centre").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("a IS NOT NULL AND n > 1").select("centre", "a")
    return balls.join(hubs, "centre").where("a <> fp").select("a", F.col("fp").alias("b"))


def close_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that span the links among classes (fp), each fp there once."""
    keys = block_keys(classes.count(), radius)
    masked = lambda shift, bits: F.expr(f"shiftrightunsigned(fp, {shift}) & {(1 << bits) - 1}L")
    one = [F.struct(F.lit(k).alias("kind"), *(masked(s, b).alias(f"v{i}") for i, (s, b) in enumerate(parts))) for k, parts in enumerate(keys)]
    rows = classes.select("fp", F.explode(F.array(*one)).alias("key")).select("fp", "key.*")
    key = [c for c in rows.columns if c != "fp"]
    sizes = keep(rows.groupBy(*key).count().where(F.col("count") > CHUNK).withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count"), "large-shards")
    dealt = rows.join(sizes, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    by_tree = dealt if radius != 3 else dealt.where(F.col("chunks") <= BALL)
    by_tree = by_tree.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = by_tree.withColumn("other", other).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    shards = cells.groupBy(*key, "low", "high").agg(F.collect_list(F.struct("fp", "chunk")).alias("members")).where(F.size("members") > 1)
    edges = shards.select("members").mapInArrow(_shard_edges(radius), "a long, b long")
    if radius == 3 and not sizes.where(F.col("chunks") > BALL).isEmpty():
        edges = edges.unionByName(ball_links(dealt.where(F.col("chunks") > BALL)))
    edges = keep(edges.where("a <> b").distinct(), "links")
    forget(sizes)
    return edges


def components_of(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of each fingerprint of found (doc_id, fp): root names its group, component_id is the group's smallest doc_id."""
    classes = keep(found.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    roots = keep(components(close_pairs(classes.select("fp"), radius)), "roots")
    rooted = keep(classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "id"), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    out = keep(rooted.select("fp", "root").join(least, "root"), "components")
    forget(classes, roots, rooted)
    return out.select("fp", "root", "component_id")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text; more columns are ignored, whatever their names).

    Null and empty texts have fingerprint 0 and link like any other. Rows that share a doc_id or a whole text are rows of
    their own. Rows with a null doc_id link too; they get the smallest id of their group, and null if it has none. An
    empty table gives no rows.
    """
    found = keep(fingerprints(docs, shingle), "fingerprints")
    return found.join(components_of(found, radius).drop("root"), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each group the one with the smallest doc_id stays.

    Where that doc_id stands on several rows of the group, or no row of the group has one, one of those rows stays.
    """
    found = keep(fingerprints(docs, shingle), "fingerprints")
    of = components_of(found, radius)
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = keep(rows.where("n > 1 OR doc_id IS NULL").select("doc_id"), "odd-ids")
    first = found.join(of, "fp").where("doc_id = component_id").select("doc_id").join(odd, "doc_id", "left_anti")
    plain = docs.join(first, docs["doc_id"].cast("long") == first["doc_id"], "left_semi")
    if odd.isEmpty():
        return plain
    # Rows whose id is null or stands on several: their fingerprints tell them apart.
    again = docs.join(F.broadcast(odd) if odd.count() < 100_000 else odd, docs["doc_id"].cast("long").eqNullSafe(odd["doc_id"]), "left_semi")
    named = of.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__component"))
    tagged = _tagged(again, shingle).join(named, "__fp").where(F.col("__component").eqNullSafe(F.col("doc_id").cast("long")))
    return plain.unionByName(tagged.dropDuplicates(["__root"]).select(*docs.columns))


def _tagged(docs: DataFrame, shingle: int) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], pa.int64())], [*b.schema.names, "__fp"])

    return small_batches(docs).mapInArrow(hashed, schema)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

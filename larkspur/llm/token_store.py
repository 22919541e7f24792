"""Token ids in a content-addressed store of files.

Rolling hashes over the ids cut each document's stream into chunks, so equal passages give equal chunks wherever they
stand. A chunk's address is a 128-bit digest of its ids; equal chunks are stored once. A document's recipe lists its
addresses in order and carries the Merkle root over them; each recipe file's manifest holds the root over its documents.

Layout, all Parquet: data/kind=chunk (address, payload of unsigned 16-bit or 32-bit ids, width),
recipes (file, doc_id ascending over the files, start, n_tokens, chunks, root), manifest (file, documents, root).
One pass encodes and one shuffle, combined beforehand, makes chunks unique; recipes ride along under keys of their own.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.encoding import word_ids
from larkspur.llm.shared import documents, forget, keep, shared_folder, small_batches

#: A cut falls after an id where the hash of the last SPAN ids has no bit of MASK; chunks hold LEAST to MOST ids.
SPAN, MASK, LEAST, MOST = 8, 255, 64, 2048
_MULTIPLIER = np.uint32(2654435761)


def cut_candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which a cut may fall. Those under SPAN from a document's start are never used, so documents may follow each other."""
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * _MULTIPLIER
    mixed ^= mixed >> np.uint32(15)
    rolling = mixed.copy()
    for back in range(1, min(SPAN, len(ids))):
        rolling[back:] += mixed[:-back] * np.uint32(pow(0x01000193, back, 1 << 32))
    rolling ^= rolling >> np.uint32(13)
    return np.flatnonzero((rolling & np.uint32(MASK)) == 0) + 1


def cuts(candidates: list[int], length: int) -> list[int]:
    """The ends of the chunks of a document of length ids; decided by nearby ids alone, but for the bounds on length."""
    ends, last = [], 0
    for at in candidates:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while length - last > MOST:
        last += MOST
        ends.append(last)
    if last < length:
        ends.append(length)
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    return cuts(cut_candidates(ids).tolist(), len(ids))


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over leaves; an odd node moves up as it is; none: the digest of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=16).digest()
    while len(leaves) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = up + leaves[len(leaves) // 2 * 2 :]
    return leaves[0]


class Merkle:
    """merkle_root() of leaves that come one by one; holds a root for each bit of their number."""

    def __init__(self) -> None:
        self.n, self.roots = 0, []

    def add(self, leaf: bytes) -> None:
        n = self.n
        while n & 1:
            leaf = hashlib.blake2b(b"\1" + self.roots.pop() + leaf, digest_size=16).digest()
            n >>= 1
        self.roots.append(leaf)
        self.n += 1

    def root(self) -> bytes:
        if not self.roots:
            return merkle_root([])
        out = self.roots[-1]
        for r in self.roots[-2::-1]:
            out = hashlib.blake2b(b"\1" + r + out, digest_size=16).digest()
        return out


def document_leaf(doc_id: int | None, start: int, n_tokens: int, root: bytes) -> bytes:
    """What a recipe file's manifest holds of one of its documents."""
    return hashlib.blake2b(b"\2" + f"{doc_id},{start},{n_tokens},".encode() + root, digest_size=16).digest()


def address(raw: bytes) -> bytes:
    """Of ids as little-endian unsigned 32-bit integers."""
    return hashlib.blake2b(b"\0" + raw, digest_size=16).digest()


def crc32_joined(first: int, second: int, length: int) -> int:
    """crc32 of two joined byte strings from theirs and the second's length."""
    if not first:
        return second
    return _times(_zeros(length), first) ^ second


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product modulo crc32's polynomial, bits reflected."""
    product = 0
    while a:
        if a & 0x80000000:
            product ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
        a = (a << 1) & 0xFFFFFFFF
    return product


_POWERS = [0x40000000]
for _ in range(66):
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))
_ZEROS: dict[int, int] = {}


def _zeros(length: int) -> int:
    """x to the power 8 * length."""
    if length not in _ZEROS:
        power = 0x80000000
        for k in range(60):
            if length >> k & 1:
                power = _times(_POWERS[k + 3], power)
        _ZEROS[length] = power
    return _ZEROS[length]


_ROWS = "key binary, payload binary, width int, doc_id long, n_tokens long, chunks array<binary>, root binary"
_SCHEMA = pa.schema([("key", pa.binary()), ("payload", pa.binary()), ("width", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.binary())), ("root", pa.binary())])


def _encoded(path: str, end_id: int):
    """A row for each chunk not yet seen in its batch, and a recipe row for each document: its key is its id and root."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.uint32(end_id).tobytes()
        width = 2 if max(words.library.get_vocab_size(), end_id + 1) <= 65536 else 4
        for batch in batches:
            ids, texts, at = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            while at < len(ids):
                first, size, raws = at, 0, []
                while at < len(ids) and size < 16_000_000:
                    raws.append(words.text(texts[at]) + end)
                    size += len(raws[-1])
                    at += 1
                whole = np.frombuffer(b"".join(raws), "<u4")
                narrow, candidates = whole.astype(f"<u{width}").tobytes(), cut_candidates(whole)
                begins = np.cumsum([0, *(len(r) // 4 for r in raws)])
                edges = np.searchsorted(candidates, begins, side="right").tolist()
                candidates, begins = candidates.tolist(), begins.tolist()
                seen: set[bytes] = set()
                rows: list[tuple] = []
                for k, (doc_id, raw) in enumerate(zip(ids[first:at], raws)):
                    begin, chunks, last = begins[k], [], 0
                    for stop in cuts([c - begin for c in candidates[edges[k] : edges[k + 1]]], len(raw) // 4):
                        key = address(raw[4 * last : 4 * stop])
                        chunks.append(key)
                        if key not in seen:
                            seen.add(key)
                            rows.append((key, narrow[width * (begin + last) : width * (begin + stop)], width, None, None, None, None))
                        last = stop
                    root = merkle_root(chunks)
                    key = (b"n" if doc_id is None else b"d" + int(doc_id).to_bytes(8, "big", signed=True)) + root
                    rows.append((key, None, None, doc_id, len(raw) // 4, chunks, root))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return encode


_RECIPE = "file int, doc_id long, start long, n_tokens long, chunks array<binary>, root binary"


def _manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, documents, root) from documents in which a file's stand together, in order."""
    file, tree, out = None, Merkle(), []
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("file", "doc_id", "start", "n_tokens", "root")]
        for f, *document in zip(*columns):
            if f != file:
                if tree.n:
                    out.append((file, tree.n, tree.root()))
                file, tree = f, Merkle()
            tree.add(document_leaf(*document))
    if tree.n:
        out.append((file, tree.n, tree.root()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["file", "documents", "root"])


def _rooted(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("file", "doc_id", "start", "n_tokens", "root")
    return rows.repartition("file").sortWithinPartitions("file", "start").mapInArrow(_manifests, "file int, documents long, root binary")


@dataclass
class TokenStore:
    spark: SparkSession
    path: str

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.schema("key binary, payload binary, width int").parquet(f"{self.path}/data/kind=chunk")

    @property
    def recipes(self) -> DataFrame:
        return self.spark.read.schema(_RECIPE).parquet(f"{self.path}/recipes")

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.schema("file int, documents long, root binary").parquet(f"{self.path}/manifest")

    def verify_files(self) -> DataFrame:
        """(file, documents, found, verified): the documents of each recipe file against its manifest."""
        found = _rooted(self.recipes).select("file", F.col("documents").alias("found"), F.col("root").alias("found_root"))
        both = self.manifest.join(found, "file", "full_outer")
        return both.select("file", "documents", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce((F.col("documents") == F.col("found")) & (F.col("root") == F.col("found_root")), F.lit(False)).alias("verified"))

    def read(self) -> DataFrame:
        """(doc_id, start, ids) of every document, put together again from its chunks."""
        parts = self._parts().join(self.chunks.select("key", "payload", "width"), "key")
        ids = parts.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("at", "payload", "width"))).alias("parts"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                whole = [np.concatenate([np.frombuffer(p["payload"], f"<u{p['width']}").astype(np.int64) for p in parts]) for parts in b.column("parts").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(whole, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

        return ids.mapInArrow(join, "doc_id long, start long, ids array<long>")

    def _parts(self) -> DataFrame:
        return self.recipes.select("file", "doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("at", "key"))

    def verify(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32, verified) read back from the files.

        Each stored chunk is read, hashed and summed once; documents then combine their chunks' checksums, so the ids
        themselves aren't shuffled. verified: addresses, lengths, the document's Merkle root and its file's manifest agree.
        """

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for key, payload, width in zip(b.column("key").to_pylist(), b.column("payload").to_pylist(), b.column("width").to_pylist()):
                    raw = payload if width == 4 else np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
                    out.append((key, zlib.crc32(raw), len(raw) // 4, address(raw) == key))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.bool_()))], ["key", "crc", "n", "ok"])

        sums = self.chunks.mapInArrow(summed, "key binary, crc long, n long, ok boolean")
        parts = self._parts().join(sums, "key", "left")
        whole = parts.groupBy("file", "doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("at", "key", "crc", "n", "ok"))).alias("parts"))

        def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                crcs, good = [], []
                for parts, n, root in zip(b.column("parts").to_pylist(), b.column("n_tokens").to_pylist(), b.column("root").to_pylist()):
                    crc = 0
                    for p in parts:
                        crc = crc32_joined(crc, p["crc"] or 0, 4 * (p["n"] or 0))
                    crcs.append(crc)
                    good.append(all(p["ok"] for p in parts) and sum(p["n"] or 0 for p in parts) == n and merkle_root([p["key"] for p in parts]) == root)
                yield pa.RecordBatch.from_arrays([b.column("file"), b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], ["file", "doc_id", "start", "n_tokens", "ids_crc32", "good"])

        documents_ = whole.mapInArrow(combined, "file int, doc_id long, start long, n_tokens long, ids_crc32 long, good boolean")
        # One row for each DOCUMENTS_A_FILE documents.
        files = self.verify_files().select("file", F.col("verified").alias("whole"))
        return documents_.join(files, "file", "left").select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("good") & F.coalesce("whole", F.lit(False))).alias("verified"))


#: About so many documents share a recipe file.
DOCUMENTS_A_FILE = 1_000_000


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> TokenStore:
    """Encode docs (doc_id, text; null text: only the end id; other columns are ignored) into a store at path.

    Documents stand by doc_id, null ones first, then by Merkle root. Rows that share a doc_id are documents of their own,
    rows repeated whole as often as they come. An empty table gives a store without documents.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(tokenizer, end_id), _ROWS)
    first = [F.first(c).alias(c) for c in ("payload", "width", "doc_id", "n_tokens", "chunks", "root")]
    unique = rows.groupBy("key").agg(*first, F.count("*").alias("copies")).withColumn("kind", F.when(F.col("payload").isNull(), "recipe").otherwise("chunk"))
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    data = spark.read.schema(f"{_ROWS}, copies long, kind string").parquet(f"{path}/data")
    # An empty file keeps a kind's folder there for an empty table.
    for kind in ("chunk", "recipe"):
        if data.where(F.col("kind") == kind).isEmpty():
            data.where("false").drop("kind").write.mode("append").parquet(f"{path}/data/kind={kind}")
    recipes = data.where("kind = 'recipe'").select("doc_id", "n_tokens", "chunks", "root", "copies")
    n = max(1, -(-(recipes.agg(F.sum("copies").alias("n")).first().n or 0) // DOCUMENTS_A_FILE))
    order = [F.col("doc_id").asc_nulls_first(), F.col("root")]
    files = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = recipes.repartitionByRange(files, *order).select("doc_id", "n_tokens", "chunks", "root", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    staged = keep(each.sortWithinPartitions(*order, "copy").withColumn("file", F.spark_partition_id()), "recipes")
    # One row for each recipe file: the tokens before it.
    sums = {r.file: r.n for r in staged.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = {}, 0
    for file in sorted(sums):
        before[file], total = total, total + sums[file]
    offsets = spark.createDataFrame([(k, v) for k, v in before.items()] or [(0, 0)], "file int, before long")
    within = Window.partitionBy("file").orderBy(*order, "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged.join(F.broadcast(offsets), "file").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed.select("file", "doc_id", "start", "n_tokens", "chunks", "root").sortWithinPartitions("file", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    store = TokenStore(spark, path)
    _rooted(store.recipes).write.parquet(f"{path}/manifest")
    forget(staged)
    return store


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex[:12]}-store"
    return write_store(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json")).verify()

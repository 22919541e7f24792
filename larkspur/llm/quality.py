"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed once and kept; labelled rows of a bounded sample train the trees in numpy, and
every document is scored from its statistics by walking all trees at once over flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.language import held_out
from larkspur.llm.shared import documents, keep, small_batches

#: About so many labelled rows train the model.
SAMPLE = 8_000
#: What statistics() returns, in order.
STATISTICS = (
    "log_words", "word_length", "distinct_words", "repeated_next", "commonest_word", "log_lines", "line_length", "distinct_lines",
    "upper", "digits", "spaces", "line_feeds", "non_ascii", "stops", "commas", "pipes", "signs", "signs_in_row", "long_words", "short_words", "entropy",
)
_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _b >= 128 else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == " " else 5 if _c == "\n" else 6 if _c == "." else 7 if _c == "," else 8 if _c == "|" else 0 if _c.isalpha() else 9


def statistics(text: str | None) -> list[float]:
    """Of a whole text; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, lines = len(words), raw.split(b"\n")
    byte = np.frombuffer(raw, np.uint8)
    histogram = np.bincount(byte, minlength=256)
    share = np.bincount(_KIND, histogram, minlength=10) / len(raw)
    sign = _KIND[byte] == 9
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    p = histogram[histogram > 0] / len(raw)
    return [
        float(np.log1p(n)), float(lengths.mean()), len(counts) / n, sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values()) / n,
        float(np.log1p(len(lines))), len(raw) / len(lines), len(set(lines)) / len(lines),
        *(float(share[k]) for k in (2, 3, 4, 5, 1, 6, 7, 8, 9)),
        float((sign[1:] & sign[:-1]).sum()) / len(raw), float((lengths > 12).mean()), float((lengths < 4).mean()), float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Trees:
    """Boosted trees of one depth; a node's children stand at 2k + 1 and 2k + 2 of its tree's row."""

    feature: np.ndarray  # tree, inner node; -1: always left
    cut: np.ndarray  # tree, inner node: right if above
    leaf: np.ndarray  # tree, leaf
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Logistic loss, second order, splits at histogram bin edges. Without rows every score is one half."""
    if not len(x):
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    base = float(np.log(mean / (1 - mean)))
    total, nodes, width = np.full(len(x), base), 2**depth - 1, x.shape[1]
    feature, cut, leaf = np.zeros((trees, nodes), int), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, at = y - p, p * (1 - p), np.zeros(len(x), int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            here = at - first
            gain, choice = np.full(count, 1e-6), [(0, bins)] * count
            for j in range(width):
                key = here * bins + binned[:, j]
                gs = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                hs = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                better = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                better[(hs < 1) | (ha - hs < 1)] = 0
                k = better.argmax(1)
                value = better[np.arange(count), k]
                for node in np.flatnonzero(value > gain):
                    gain[node], choice[node] = value[node], (j, int(k[node]))
            for node, (j, k) in enumerate(choice):
                feature[t, first + node] = j
                cut[t, first + node] = edges[j][k] if k < len(edges[j]) else np.inf
            chosen = np.array([j for j, _ in choice]), np.array([k for _, k in choice])
            at = 2 * at + 1 + (binned[np.arange(len(x)), chosen[0][here]] > chosen[1][here])
        end = at - nodes
        leaf[t] = rate * np.bincount(end, g, nodes + 1) / (np.bincount(end, h, nodes + 1) + l2)
        total += leaf[t][end]
    return Trees(feature, cut, leaf, base)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of each row of docs (doc_id, text; more columns are ignored, whatever their names).

    Null texts count as empty, and empty ones have statistics too; very long ones are read whole; repeated rows and rows
    without a doc_id come through each. An empty table gives no rows.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measured, "doc_id long, stats array<double>")


def train(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Trees:
    """Fit on about rows labelled documents that aren't held out, drawn by a hash of doc_id; null labels and null ids don't count.

    Repeated rows are drawn together and count each, twice as many rows at most, by doc_id. Splits that gain the same go to the first statistic and the lowest cut.
    Without labels every score is one half.
    """
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    n = labels.count()
    drawn = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(n, 1)))))
    sample = stats.join(F.broadcast(drawn), "doc_id").orderBy("doc_id", "quality").limit(2 * rows).collect()
    x = np.array([r.stats for r in sample], float).reshape(len(sample), len(STATISTICS))
    return fit(x, np.array([float(r.quality > 0) for r in sample]))


def score(stats: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of with_statistics()."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("stats").flatten().to_numpy().reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(trees.score(x), pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(scored, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = keep(with_statistics(documents(spark, sf_dir)), "statistics")
    trees = train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(stats, trees).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

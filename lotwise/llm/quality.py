"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark tasks turn each whole text into a short vector of statistics. Trees are grown on a bounded,
labelled sample (its binned statistics are a few bytes a row) from per-bin sums of gradients. A
fitted model is five flat arrays, which scoring tasks walk for all rows of a batch at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .labelled import labelled_sample

STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "distinct_words", "top_word", "repeated_next", "repeated_pairs", "upper", "digits", "symbols",
    "commas", "stops", "bars", "exclamations", "spaces", "lines", "line_length", "distinct_lines", "capitalised", "non_ascii", "entropy", "symbol_ends", "short_words",
)
THRESHOLD = 0.3


def statistics(text: str | None) -> list[float]:
    """The document statistics of a text; all are 0 for an empty one."""
    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(len(words), 1)
    tally = Counter(words)
    lines = [line for line in raw.split(b"\n") if line]
    pairs = Counter(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    share = counts[counts > 0] / n
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    symbols = counts[[ord(c) for c in "#$%&*@^~<>{}[]\\/|=+_"]].sum()
    return [
        math.log1p(n), math.log1p(len(words)), lengths.mean(), (lengths > 12).sum() / m, len(tally) / m, max(tally.values(), default=0) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m, 1 - len(pairs) / max(len(words) - 1, 1), upper / max(upper + lower, 1), counts[48:58].sum() / n, symbols / n,
        counts[44] / m, counts[46] / m, counts[124] / m, counts[33] / m, counts[[9, 10, 13, 32]].sum() / n, len(lines) / m, n / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
        sum(w[:1].isupper() for w in words) / m, counts[128:].sum() / n, float(-(share * np.log(share)).sum()), sum(w[-1] in b"#$%&*!|" for w in words) / m, (lengths <= 3).sum() / m,
    ]


@dataclass
class Trees:
    """Flat arrays over all nodes: feature (-1 for a leaf), threshold, left child (right is next to it), value; and roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for rows of statistics; every tree is walked by all rows together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                feature = self.feature[at]
                inner = feature >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(feature, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Gradient boosting of log-loss; splits come from per-bin sums of gradients and hessians.

    With no row of a class the model is its smoothed base rate.
    """
    positive = float((y.sum() + 1) / (len(y) + 2))
    base = math.log(positive / (1 - positive))
    feature, threshold, left, value, roots = [], [], [], [], []
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            gradient, hessian = p - y, p * (1 - p)
            roots.append(len(feature))
            frontier = [(len(feature), np.arange(len(y)))]
            feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
            for level in range(depth + 1):
                following = []
                for node, rows in frontier:
                    g, h = gradient[rows], hessian[rows]
                    value[node] = -rate * g.sum() / (h.sum() + ridge)
                    split = best_split(binned[rows], g, h, cuts, ridge, least) if level < depth and len(rows) >= 2 * least else None
                    if split is None:
                        raw[rows] += value[node]
                        continue
                    k, cut = split
                    child = len(feature)
                    feature[node], threshold[node], left[node] = k, float(cuts[k][cut]), child
                    for side in (binned[rows, k] <= cut, binned[rows, k] > cut):
                        following.append((len(feature), rows[side]))
                        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
                frontier = following
    arrays = (np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), np.array(roots, np.int64))
    return Trees(*arrays, base=base)


def best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], ridge: float, least: int) -> tuple[int, int] | None:
    """Feature and bin with the greatest gain, the first of equals; None if no split gains."""
    gain, found = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for k, cut in enumerate(cuts):
        if len(cut) == 0:
            continue
        size = len(cut) + 1
        gs, hs, ns = (np.bincount(binned[:, k], w, size).cumsum()[:-1] for w in (g, h, None))
        score = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole
        score[(ns < least) | (len(g) - ns < least)] = -np.inf
        best = int(score.argmax())
        if score[best] > gain:
            gain, found = float(score[best]), (k, best)
    return found


def document_statistics(docs: DataFrame) -> DataFrame:
    """All columns but text, and ``statistics`` (array of doubles), which takes the place of a column of that name.

    Null and empty texts have zeros; repeated rows come out alike; an empty table gives no rows.
    """
    others = [f for f in docs.schema.fields if f.name not in ("text", "statistics")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), rows], [*(f.name for f in others), "statistics"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["statistics array<double>"])
    return docs.mapInArrow(run, schema)


def fit(sample: DataFrame) -> Trees:
    """Trees on (doc_id, text, label) rows, at most ``labelled.MAX_LABELLED`` of them; exact copies count once."""
    once = sample.withColumn("copy", F.xxhash64("text", "label")).dropDuplicates(["copy"]).select("doc_id", "text", "label")
    found = document_statistics(once).orderBy("doc_id").toPandas()
    x = np.array(found["statistics"].tolist(), np.float64).reshape(len(found), len(STATISTICS))
    return fit_trees(x, (found["label"].to_numpy() > 0).astype(np.float64))


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, quality (0 to 1).

    Null text is scored as the empty text; repeated rows score alike; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x))], ["doc_id", "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, quality double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(labelled_sample(docs, labels, "quality", shared.crc_bucket("doc_id", 5) != 0))
    return score_quality(docs, model).select(
        "doc_id", F.coalesce(shared.crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}

"""Toxicity by maximum-scoring segments.

Training counts, in Spark, the toxic and clean documents that hold a token. A token's log-odds are smoothed by
Dirichlet priors whose mean is the posterior of its six-letter prefix, that one's of its four-letter
prefix, and that one's of all tokens, so rare forms of a toxic stem borrow its strength. Scoring
scans each text once (Ruzzo-Tompa) for all maximal segments of summed log-odds; extreme-value
statistics (Karlin-Altschul) turn a segment's score into an expected number of equally good segments in a clean
text of that length; the significant passages' evidence is calibrated into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .labelled import labelled_sample
from .shared import BoundedCache

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 6)
#: Weight of the prior in documents, and the z-score from which a token's log-odds count.
PRIOR, MIN_Z = 10.0, 4.0
#: A passage is significant when a clean text of its length is expected to hold at most so many as good.
MAX_E = 0.05
THRESHOLD = 0.3


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


@dataclass
class SegmentModel:
    words: dict[str, float]  # whole tokens, also those that a listed prefix would judge wrongly
    prefixes: dict[str, float]
    rest: float  # log-odds of any other token, below 0
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # its K
    intercept: float = 0.0
    slope: float = 1.0

    def score_of(self, token: str) -> float:
        found = self.words.get(token)
        for n in reversed(PREFIXES):
            if found is None and len(token) >= n:
                found = self.prefixes.get(token[:n])
        return self.rest if found is None else found

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum of -log E over the significant segments of a text of ``n`` tokens."""
        return sum(max(0.0, -self.log_e(s, n)) for _, _, s in segments if self.log_e(s, n) <= math.log(MAX_E))

    def log_e(self, score: float, n: int) -> float:
        return math.log(self.scale * max(n, 1)) - self.decay * score

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.intercept + self.slope * math.log1p(evidence), -30), 30)))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Ruzzo-Tompa: all maximal scoring segments as (begin, end, score), in linear time.

    Each candidate keeps the place of the nearest earlier one with a smaller left sum. A search follows
    these links; a candidate that it steps over is never met again, as the newcomer's link leads past it.
    """
    begins, ends, before, after, link = [], [], [], [], []  # before/after: running sums at a candidate's ends
    total = 0.0
    for i, score in enumerate(scores):
        low, total = total, total + score
        if score <= 0:
            continue
        begin, j = i, len(begins) - 1
        while j >= 0 and before[j] >= low:
            j = link[j]
        while j >= 0 and after[j] < total:  # the candidates from j on merge with this one
            begin, low, up = begins[j], before[j], link[j]
            del begins[j:], ends[j:], before[j:], after[j:], link[j:]
            j = up
        begins.append(begin), ends.append(i + 1), before.append(low), after.append(total), link.append(j)
    return [(b, e, hi - lo) for b, e, lo, hi in zip(begins, ends, before, after, strict=True)]


def segments_of(scores: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """Maximal segments in token positions; runs of unlisted tokens enter the scan as one sum."""
    hits = np.flatnonzero(scores != rest)
    if not len(hits):
        return []
    runs: list[tuple[int, int, float]] = []
    at = 0
    for hit in hits.tolist():
        if hit > at:
            runs.append((at, hit, rest * (hit - at)))
        runs.append((hit, hit + 1, float(scores[hit])))
        at = hit + 1
    return [(runs[b][0], runs[e - 1][1], s) for b, e, s in maximal_segments([r[2] for r in runs])]


def document_counts(sample: DataFrame) -> DataFrame:
    """level, key, toxic, clean: in how many documents a token (level 0) or a prefix of that length occurs.

    Documents are counted, not occurrences: a word that one document repeats proves nothing. Tasks send
    sums per batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, own = set(tokens(text)), sums[1 if label else 0]
                own.update((0, w) for w in words)
                for n in PREFIXES:
                    own.update({(n, w[:n]) for w in words if len(w) >= n})
            for label, own in enumerate(sums):
                zero, n = pa.array([0] * len(own), pa.int64()), pa.array(list(own.values()), pa.int64())
                keys = [pa.array([k[0] for k in own], pa.int32()), pa.array([k[1] for k in own], pa.string())]
                yield pa.RecordBatch.from_arrays([*keys, n if label else zero, zero if label else n], ["level", "key", "toxic", "clean"])

    sent = sample.select("text", "label").mapInArrow(count, "level int, key string, toxic long, clean long")
    return sent.groupBy("level", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds_table(counts: DataFrame) -> DataFrame:
    """level, key, log_odds, z, toxic, clean, covered (a significant prefix would speak for the key)."""
    totals = counts.filter("level = 0").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.coalesce(F.sum("clean"), F.lit(0)).alias("c")).first()
    share = (totals.t + 1) / (totals.t + totals.c + 2)
    base = math.log(share / (1 - share))
    done, parent = None, None
    for n, up_length in zip((*PREFIXES, 0), (0, *PREFIXES), strict=True):
        level = counts.filter(F.col("level") == n)
        if parent is None:
            level = level.withColumn("parent", F.lit(share)).withColumn("covered", F.lit(False))
        else:
            up = parent.select(F.col("key").alias("up"), F.col("share").alias("parent"), ((F.col("z") >= MIN_Z) | F.col("covered")).alias("covered"))
            level = level.withColumn("up", F.substring("key", 1, up_length)).join(up, "up", "left")
            level = level.withColumn("parent", F.coalesce("parent", F.lit(share))).withColumn("covered", F.coalesce("covered", F.lit(False)))
        own = (F.col("toxic") + PRIOR * F.col("parent")) / (F.col("toxic") + F.col("clean") + PRIOR)
        spread = F.sqrt(1 / (F.col("toxic") + PRIOR * F.col("parent")) + 1 / (F.col("clean") + PRIOR * (1 - F.col("parent"))))
        level = level.withColumn("share", own).withColumn("log_odds", F.log(own / (1 - own)) - base).withColumn("z", F.col("log_odds") / spread)
        parent = level.select("level", "key", "share", "log_odds", "z", "toxic", "clean", "covered")
        done = parent if done is None else done.unionByName(parent)
    return done


def fit(sample: DataFrame) -> SegmentModel:
    """Fits the model on (text, label) rows of a bounded sample.

    The driver gets the entries, tokens of that sample that its labels tell apart, and two numbers a row.
    """
    sample = shared.written(sample.withColumn("copy", F.xxhash64("text", "label")).dropDuplicates(["copy"]), "labelled")
    counts = shared.written(document_counts(sample), "token-counts")
    table = log_odds_table(counts).filter((F.col("z") >= MIN_Z) & (F.col("log_odds") > 0) | F.col("covered"))
    rows = table.collect()
    words = {r.key: r.log_odds for r in rows if r.level == 0}
    prefixes = {r.key: r.log_odds for r in rows if r.level and r.z >= MIN_Z}
    total = counts.filter("level = 0").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = total.t or 0, total.c or 0
    listed_t, listed_c = sum(r.toxic for r in rows if r.level == 0), sum(r.clean for r in rows if r.level == 0)
    rest = math.log((t - listed_t + 1) / (t + 1)) - math.log((c - listed_c + 1) / (c + 1))
    model = SegmentModel(words, prefixes, min(rest, -1e-3))
    clean = [(r.log_odds, r.clean / (c + 1)) for r in rows if r.level == 0 and r.clean]
    model.decay = decay_rate([s for s, _ in clean] + [model.rest], [p for _, p in clean] + [1 - sum(p for _, p in clean)])
    found = shared.written(sample.select("text", "label").mapInArrow(_training_rows(model), "label int, n long, segments array<double>"), "segments")
    least = min([s for s in [*words.values(), *prefixes.values()] if s > 0], default=1.0)
    good = F.count(F.when(F.array_max("segments") >= least, 1))
    seen = found.filter("label = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), good.alias("hits")).first()
    model.scale = max(0.5, float(seen.hits)) / max(1.0, seen.n * math.exp(-model.decay * least))
    log_e = lambda s: F.log(F.lit(model.scale) * F.greatest("n", F.lit(1))) - F.lit(model.decay) * s
    significant = F.filter("segments", lambda s: log_e(s) <= math.log(MAX_E))
    evidence = F.aggregate(significant, F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), -log_e(s)))
    pairs = found.select("label", evidence.alias("evidence")).toPandas()
    model.intercept, model.slope = calibrate(pairs["evidence"].to_numpy(), pairs["label"].to_numpy() > 0)
    shared.discard(sample, counts, found)
    return model


def _training_rows(model: SegmentModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches):
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                segments = [s for _, _, s in segments_of(np.array([model.score_of(w) for w in words]), model.rest)]
                rows.append({"label": int(label > 0), "n": len(words), "segments": segments})
            kinds = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def decay_rate(scores: list[float], shares: list[float]) -> float:
    """The positive solution of sum p exp(x s) = 1 for scores of negative mean; 1 where there is none."""
    s, p = np.array(scores), np.maximum(np.array(shares), 0)
    if not (s > 0).any() or (p[s > 0] <= 0).all() or (s * p).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * s, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(np.minimum(middle * s, 700))).sum() < 1 else (low, middle)
    return max(high, 0.05)


def calibrate(evidence: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope (not below 0) of a ridge logistic regression on log(1 + evidence), by Newton steps."""
    x = np.column_stack([np.ones(len(evidence)), np.log1p(evidence)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - toxic) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def score_toxicity(docs: DataFrame, model: SegmentModel) -> DataFrame:
    """doc_id, toxicity (0 to 1) and passages (start, stop in code points of the lower-cased text, score, e_value).

    Null and empty texts have no passage and the score of a text without evidence; ties between segments are
    kept apart as Ruzzo and Tompa define; repeated rows score alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = BoundedCache(model.score_of, 100_000)
        nothing = model.probability(0.0)
        for batch in shared.small_batches(batches):
            probabilities, passages = [], []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                scores = np.fromiter(map(score_of.__getitem__, words), np.float64, len(words))
                segments = segments_of(scores, model.rest)
                found = []
                if segments:
                    spans = [m.span() for m in TOKEN.finditer(text.lower())]
                    for begin, end, score in segments:
                        log_e = model.log_e(score, len(words))
                        if log_e <= math.log(MAX_E):
                            found.append({"start": spans[begin][0], "stop": spans[end - 1][1], "score": score, "e_value": math.exp(max(log_e, -700))})
                passages.append(found)
                probabilities.append(model.probability(model.evidence(segments, len(words))) if segments else nothing)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities, pa.float64()), pa.array(passages, kind)], ["doc_id", "toxicity", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, toxicity double, passages array<struct<start:long,stop:long,score:double,e_value:double>>")


def fit_on(spark: SparkSession, sf_dir: str, docs: DataFrame) -> SegmentModel:
    """The model of the contract: labels of fold 2 of 4 are never read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(labelled_sample(docs, labels, "toxic", shared.crc_bucket("doc_id", 4) != 2))


def drop_toxic(docs: DataFrame, model: SegmentModel) -> DataFrame:
    """The documents whose score stays below THRESHOLD, columns unchanged; text travels to no shuffle.

    Null and empty texts have no evidence and stay; repeated rows fare alike; an empty table stays empty;
    other columns, whatever their names, are passed through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = BoundedCache(model.score_of, 100_000)
        for batch in shared.small_batches(batches):
            keep = []
            for text in batch.column("row").field("text").to_pylist():
                words = tokens(text)
                segments = segments_of(np.fromiter(map(score_of.__getitem__, words), np.float64, len(words)), model.rest)
                keep.append(model.probability(model.evidence(segments, len(words))) < THRESHOLD)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = shared.row_and_columns(docs)
    return rows.mapInArrow(run, rows.schema).select(*shared.row_fields(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, fit_on(spark, sf_dir, docs))
    return scored.select(
        "doc_id", F.coalesce(shared.crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}

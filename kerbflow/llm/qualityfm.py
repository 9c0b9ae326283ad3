"""Quality classifier: a factorisation machine over hashed words and structure."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm import bytewords

HASHED = 1024
#: Hashed words are scaled down by this much: there are many, each of them noisy.
SOFTER = 6.0
#: Structure statistics, in this order after the hashed words.
STATISTICS = (
    "bias_word_length", "log_words", "log_lines", "upper", "digits", "symbols", "exclamations",
    "stops", "commas", "other_bytes", "space", "repeated_lines", "repeated_words", "long_words",
    "short_words", "log_line_length", "log_recorded_chars", "recorded_missing",
)
WIDTH = HASHED + len(STATISTICS)
_CLASSES = {
    "upper": range(65, 91), "digits": range(48, 58), "symbols": map(ord, "#*$%&|<>"),
    "exclamations": map(ord, "!?"), "stops": map(ord, ".;:"), "commas": map(ord, ","),
    "other_bytes": range(128, 256), "space": (9, 10, 11, 12, 13, 32),
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


@dataclass(frozen=True)
class Training:
    """At most ``rows`` labelled documents are learned from: the bound of what one
    machine holds while fitting (``rows`` x WIDTH floats)."""

    rows: int = 4000
    rank: int = 8
    steps: int = 120
    rate: float = 0.02
    decay: float = 0.01
    seed: int = 5


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + w.x + half the sum over factors of (v.x)^2 - (v^2).(x^2))."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(self.standard(x)), -30, 30)))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def raw(self, z: np.ndarray) -> np.ndarray:
        inner = z @ self.v
        squares = (z * z) @ (self.v * self.v)
        return self.bias + z @ self.w + 0.5 * (inner * inner - squares).sum(axis=1)


def features(s: bytewords.Slice, recorded: np.ndarray) -> np.ndarray:
    """One row for each document: hashed word counts (log, unit length) and statistics."""
    n = s.last - s.first
    starts, ends, counts = bytewords.word_bounds(s)
    h = bytewords.segment_hashes(s.data, starts, ends)
    docs = np.repeat(np.arange(n), counts)
    cells = docs * HASHED + (h % np.uint64(HASHED)).astype(np.int64)
    words = np.log1p(np.bincount(cells, minlength=n * HASHED).reshape(n, HASHED)).astype(np.float32)
    words /= np.maximum(np.sqrt((words * words).sum(axis=1, keepdims=True)), 1e-6)
    size = np.maximum(np.diff(s.offsets), 1).astype(float)

    def by_doc(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[s.offsets])

    part = {k: by_doc(t[s.data]) / size for k, t in _TABLES.items()}
    lengths = ends - starts
    words_n = np.maximum(counts, 1)
    line_starts, line_ends, lines_n = bytewords.runs(s, s.data != 10)
    line_docs = np.repeat(np.arange(n), lines_n)
    line_h = bytewords.segment_hashes(s.data, line_starts, line_ends)
    distinct_lines = _distinct(line_docs, line_h, n)
    distinct_words = _distinct(docs, h, n)
    known = ~np.isnan(recorded)
    stats = np.stack([
        np.bincount(docs, lengths, n) / words_n / 10, np.log1p(counts), np.log1p(lines_n),
        *[part[k] for k in ("upper", "digits", "symbols", "exclamations", "stops", "commas",
                            "other_bytes", "space")],
        1 - distinct_lines / np.maximum(lines_n, 1), 1 - distinct_words / words_n,
        np.bincount(docs, lengths > 14, n) / words_n, np.bincount(docs, lengths < 3, n) / words_n,
        np.log1p(size / np.maximum(lines_n, 1)),
        np.log1p(np.maximum(np.where(known, recorded, 0), 0)), (~known).astype(float),
    ], axis=1)
    return np.hstack([words, stats.astype(np.float32)])


def _distinct(docs: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, docs))
    d, x = docs[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def _batch_features(texts: pa.Array, recorded: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    numbers = recorded.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    for s in bytewords.slices(texts):
        yield s.first, s.last, features(s, numbers[s.first : s.last])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from (a null doc_id among them)."""
    third = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1
    return F.coalesce(third, F.lit(True))


def _inputs(docs: DataFrame) -> list[Column]:
    recorded = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.col("doc_id").cast("long").alias("doc_id"), "text", recorded.alias("recorded")]


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Machine:
    """Learn from labelled documents that are not held out.

    The ``training.rows`` labels with the smallest hash of doc_id are taken; their
    features are computed by Spark, of rows with one doc_id the smallest (as bytes) is
    taken, and fitted on the driver by full-batch Adam on the
    logistic loss, classes weighted alike. Without labels of both classes the machine
    gives every document the share of class 1 (or 1 without any label).
    """
    quality = labels.filter("quality is not null").filter(~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max("quality").cast("double").alias("quality"))
    chosen = quality.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.rows)
    rows = docs.select(*_inputs(docs)).join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", "recorded", "quality"
    )  # at most ``training.rows`` rows are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, x in _batch_features(batch.column(1), batch.column(2)):
                some = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(3), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())],
                    names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(run, "doc_id long, quality double, x binary")
    one = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # of repeated doc_ids
    got = one.toArrow().to_pandas().sort_values("doc_id")
    y = got["quality"].to_numpy(float)
    x = np.frombuffer(b"".join(got["x"]), "<f2").reshape(len(y), WIDTH).astype(np.float32)
    return _learn(x, y, training)


def _learn(x: np.ndarray, y: np.ndarray, training: Training) -> Machine:
    rng = np.random.default_rng(training.seed)
    mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH)
    scale = np.where((spread := x.std(axis=0) if len(x) else np.ones(WIDTH)) > 1e-6, spread, 1.0)
    scale[:HASHED] = np.maximum(scale[:HASHED], 0.02) * SOFTER
    share = float(y.mean()) if len(y) else 1.0
    w, v = np.zeros(WIDTH), rng.normal(0, 0.01, (WIDTH, training.rank))
    if not 0 < share < 1:
        return Machine(30.0 if share else -30.0, w, np.zeros_like(v), mean, scale)
    z = np.clip((x - mean) / scale, -4, 4).astype(np.float32)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    theta = [np.zeros(1), w, v]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    z2 = z * z
    for step in range(1, training.steps + 1):
        inner = z @ theta[2]
        out = theta[0] + z @ theta[1] + 0.5 * (inner**2 - z2 @ theta[2] ** 2).sum(axis=1)
        g = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y)
        grads = [
            np.array([g.sum()]), z.T @ g + training.decay * theta[1],
            z.T @ (g[:, None] * inner) - (z2.T @ g)[:, None] * theta[2] + training.decay * theta[2],
        ]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            theta[k] = theta[k] - training.rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(theta[0][0]), theta[1], theta[2], mean, scale)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted class of every document, in one pass.

    The inputs are the text and its recorded length. A null text is empty; null or
    missing ``n_chars`` is a feature of its own; a null doc_id is held out; repeated
    rows score alike; a score of just 0.5 is class 1; no rows give no rows.
    """
    return _scored(docs.select(*_inputs(docs)), machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _scored(rows: DataFrame, machine: Machine) -> DataFrame:
    others = [f for f in rows.schema if f.name not in ("text", "recorded")]
    names = [f.name for f in others] + ["score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", score double"
    model = rows.sparkSession.sparkContext.broadcast(machine)  # WIDTH x (rank + 3) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in ("text", "recorded")]
            parts = [model.value.scores(x) for _, _, x in _batch_features(batch.column(at[0]), batch.column(at[1]))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            kept = [batch.column(k) for k in range(batch.num_columns) if k not in at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=names)

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, all columns as they are."""
    rows = docs.select(*_inputs(docs)[1:], F.struct("*").alias("row_"))
    return _scored(rows, machine).filter(F.col("score") >= least).select("row_.*")

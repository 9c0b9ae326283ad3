"""Hard negatives: high-scoring vectors of other labels, by rotated one-bit codes.

Each vector is coded in levels. A level keeps the signs of what the levels before left
over, rotated, and the vector's alignment with that code. An anchor's inner product with
a code is a sum of popcounts over the bit planes of the rotated anchor, so an estimate
needs codes alone. What estimate and score can differ by is bounded by Cauchy-Schwarz:
|left over| x |anchor| and |vector| x |rounding of the anchor|. Only vectors whose
interval can reach the result are scored, by whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm.common import stage

#: Components of larger size could overflow the whole-number scores.
LARGEST = 1 << 24
PLANES = 8


@dataclass(frozen=True)
class Mining:
    """``anchor_every``: ids divisible by it are anchors. Scores are compared in blocks
    of about ``block_rows`` vectors with about ``block_anchors`` anchors each."""

    anchor_every: int = 100
    positives: int = 5
    negatives: int = 5
    least_percent: int = 80
    most_percent: int = 100
    levels: int = 4
    block_rows: int = 8192
    block_anchors: int = 1024
    seed: int = 11


def rotations(width: int, levels: int, seed: int) -> list[np.ndarray]:
    """Orthogonal matrices of a power-of-two width: two rounds of random signs and a
    Hadamard matrix, so that every machine gets the same numbers."""
    hadamard = np.ones((1, 1))
    while len(hadamard) < width:
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(levels):
        one, two = rng.integers(0, 2, (2, width)) * 2.0 - 1
        out.append((hadamard * one) @ (hadamard * two) / width)
    return out


def padded(width: int) -> int:
    """The power of two, 64 at least, that vectors are filled up to."""
    return max(64, 1 << max(width - 1, 0).bit_length())


def coded(x: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes: rows x levels x 64-bit words, alignments: rows x levels, rest: the length of
    what the levels leave over) of whole-number vectors."""
    width = x.shape[1]
    rest = x.astype(float)
    codes, alignments = [], []
    for turn in turns:
        y = rest @ turn.T
        up = y >= 0
        sign = np.where(up, 1.0, -1.0)
        alignment = (y * sign).sum(axis=1) / width
        rest = rest - alignment[:, None] * (sign @ turn)
        codes.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64))
        alignments.append(alignment)
    return (np.stack(codes, axis=1), np.stack(alignments, axis=1),
            np.sqrt((rest * rest).sum(axis=1)))


class Block:
    """Vectors of a block with their codes, and the intervals of their scores."""

    def __init__(self, table: pa.Table, width: int, turns: list[np.ndarray]):
        levels = len(turns)
        joined = lambda c: b"".join(table.column(c).to_pylist())
        self.key = table.column("row_key").to_numpy()
        ids = table.column("vec_id")
        self.missing = ids.is_null().to_numpy()
        self.id = ids.fill_null(0).to_numpy()
        self.label = table.column("label").to_numpy()
        self.copies = table.column("copies").to_numpy()
        self.x = np.frombuffer(joined("components"), "<i4").reshape(-1, width).astype(np.int64)
        self.codes = np.frombuffer(joined("codes"), np.uint64).reshape(len(self.x), levels, width // 64)
        self.codes = np.ascontiguousarray(self.codes.transpose(1, 2, 0))
        facts = np.frombuffer(joined("facts"), float).reshape(len(self.x), levels + 1)
        self.alignments = np.ascontiguousarray(facts[:, :levels].T)
        self.rest = np.ascontiguousarray(facts[:, levels])
        self.norm = np.sqrt((self.x.astype(float) ** 2).sum(axis=1))
        self.turns = turns

    def intervals(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each vector of the block can have."""
        estimate, rounding = np.zeros(len(self.x)), np.zeros(len(self.x))
        for level, turn in enumerate(self.turns):
            q = turn @ anchor
            low = q.min()
            step = (q.max() - low) / ((1 << PLANES) - 1) or 1.0
            steps = np.rint((q - low) / step).astype(np.int64)
            ones = np.zeros(len(self.x), np.int64)
            members = np.zeros(len(self.x), np.int64)
            for word, code in enumerate(self.codes[level]):
                part = steps[64 * word : 64 * word + 64]
                members += np.bitwise_count(code)
                for plane in range(PLANES):
                    bits = np.packbits((part >> plane & 1).astype(bool), bitorder="little").view(np.uint64)
                    ones += np.bitwise_count(code & bits[0]).astype(np.int64) << plane
            product = low * (2 * members - len(q)) + step * (2 * ones - steps.sum())
            estimate += self.alignments[level] * product
            off = q - (low + step * steps)
            rounding += np.abs(self.alignments[level]) * np.sqrt((off * off).sum() * len(q))
        reach = self.rest * np.sqrt(float(anchor @ anchor)) + rounding
        reach = reach * (1 + 1e-9) + 1e-9 * (np.abs(estimate) + self.norm * np.abs(anchor).max()) + 1e-6
        return estimate - reach, estimate + reach

    def scores(self, some: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.x[some] @ anchor

    def first(self, some: np.ndarray, scores: np.ndarray, copies: np.ndarray, k: int) -> list[tuple]:
        """(vec_id, score, row) of the ``k`` first by score, then vec_id (null last); a row
        comes as often as it has copies."""
        order = np.lexsort((self.key[some], self.id[some], self.missing[some], -scores))[:k]
        order = np.repeat(order, np.minimum(copies[order], k))[:k]
        return [(None if self.missing[some[j]] else int(self.id[some[j]]), int(scores[j]),
                 int(self.key[some[j]])) for j in order]


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def usable(vectors: DataFrame, settings: Mining) -> DataFrame:
    """(vec_id, label, components, copies) of the rows that take part, equal ones counted:
    labels as mined with, components as whole numbers."""
    parts = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    ).filter(
        "label is not null and x is not null and "
        "forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("x", lambda v: F.when(F.abs(F.floor(256 * v)) < LARGEST, F.floor(256 * v).cast("int"))
                        .otherwise(F.raise_error(F.lit("a component is too large for whole scores")).cast("int")))
    rows = parts.select("vec_id", moved.alias("label"), whole.alias("components"))
    return rows.groupBy("vec_id", "label", "components").agg(F.count("*").alias("copies"))


def code_table(rows: DataFrame, width: int, settings: Mining) -> DataFrame:
    """Rows with codes and facts (alignments, length of the rest), stored once."""
    schema = "vec_id long, label long, copies long, components binary, codes binary, facts binary"
    levels, seed = settings.levels, settings.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = rotations(width, levels, seed)
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.zeros((batch.num_rows, width), np.int32)
            x[np.repeat(np.arange(len(sizes)), sizes),
              np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
            codes, alignments, rest = coded(x, turns)
            facts = np.column_stack([alignments, rest])
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], *[
                    pa.array([r.tobytes() for r in part], pa.binary())
                    for part in (x.astype("<i4"), codes, facts)],
            ], names=["vec_id", "label", "copies", "components", "codes", "facts"])

    coded_rows = rows.select("vec_id", "label", "copies", "components").mapInArrow(run, schema)
    return stage(coded_rows.withColumn("row_key", F.monotonically_increasing_id()), "vector-codes")


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int):
    """Both sides grouped by cell, a block of vectors with a block of anchors; every row
    goes to as many cells as the other side has blocks."""

    def side(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row_key"), F.lit(n)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return df.select("*", block).select("*", every).groupBy("block_", "anchors_")

    return side(rows, "block_", blocks, "anchors_", anchor_blocks).cogroup(
        side(anchors, "anchors_", anchor_blocks, "block_", blocks))


def _positives(width: int, settings: Mining):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        turns = rotations(width, settings.levels, settings.seed)
        block, asked = Block(rows, width, turns), Block(anchors, width, turns)
        found = []
        for i, anchor in enumerate(asked.x):
            copies = block.copies - (block.key == asked.key[i])
            some = np.flatnonzero((block.label == asked.label[i]) & (copies > 0))
            if not len(some):
                continue
            low, high = block.intervals(anchor)
            some = some[high[some] >= _kth_largest(low[some], settings.positives)]
            scores = block.scores(some, anchor)
            found.extend((int(asked.key[i]), *f)
                         for f in block.first(some, scores, copies[some], settings.positives))
        return pa.Table.from_pylist(
            [dict(zip(("anchor_key", "positive_id", "positive_score", "row_key"), f)) for f in found],
            pa.schema([("anchor_key", pa.int64()), ("positive_id", pa.int64()),
                       ("positive_score", pa.int64()), ("row_key", pa.int64())]))

    return run


def _negatives(width: int, settings: Mining):
    names = ("anchor_key", "place", "negative_id", "negative_score", "row_key")

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        turns = rotations(width, settings.levels, settings.seed)
        block, asked = Block(rows, width, turns), Block(anchors, width, turns)
        wanted = anchors.column("positive_scores").to_pylist()
        found = []
        for i, anchor in enumerate(asked.x):
            other = np.flatnonzero(block.label != asked.label[i])
            if not len(other):
                continue
            low, high = block.intervals(anchor)
            low, high, known = low[other], high[other], {}
            for place, top in enumerate(wanted[i]):
                least, most = settings.least_percent * top, settings.most_percent * top
                if top not in known:
                    can = (100 * high >= least) & (100 * low <= most)
                    sure = (100 * low >= least) & (100 * high <= most)
                    can &= high >= _kth_largest(low[sure], settings.negatives)
                    some = other[can]
                    scores = block.scores(some, anchor)
                    within = (100 * scores >= least) & (100 * scores <= most)
                    some, scores = some[within], scores[within]
                    known[top] = block.first(some, scores, block.copies[some], settings.negatives)
                found.extend((int(asked.key[i]), place, *f) for f in known[top])
        return pa.Table.from_pylist(
            [dict(zip(names, f)) for f in found], pa.schema([(n, pa.int64()) for n in names]))

    return run


def _firsts(found: DataFrame, group: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``place_`` from 1; the rank filter
    keeps ``k`` rows of a group in each task before the shuffle."""
    order = Window.partitionBy(*group).orderBy(
        F.desc(score), F.col(vec_id).asc_nulls_last(), "row_key")
    return found.withColumn("place_", F.row_number().over(order)).filter(F.col("place_") <= k)


def mine(vectors: DataFrame, settings: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for
    each anchor and each of its positives, the hardest rows of other labels.

    ``vectors`` has vec_id, label and embedding. Positives are an anchor's first other
    rows of the same label; negatives those of a different label that score from
    ``least_percent`` to ``most_percent`` of the positive. Rows come by score, then
    vec_id. Every vector is in the code table and every anchor meets every block, so
    the result is whole: recall is 1.

    Rows with a null label, a null vector or any null or non-finite component take no
    part; a null vec_id is no anchor, keeps its label and ranks last among ties; repeated
    rows are rows of their own (each is another row to its copies, and each an anchor)
    but are coded and compared once; rows that tie in score and vec_id can't be told
    apart in the result; shorter vectors are filled up with zeros; components of 65,536
    or more raise an error; other columns are not read; no anchors give no rows.
    """
    rows = stage(usable(vectors, settings), "vectors")
    widest = rows.agg(F.max(F.size("components"))).first()[0]
    width = padded(widest or 0)
    table = code_table(rows, width, settings)
    anchors = stage(table.filter(F.col("vec_id") % settings.anchor_every == 0), "anchors")
    blocks = max(1, -(-table.count() // settings.block_rows))
    anchor_blocks = max(1, -(-anchors.count() // settings.block_anchors))
    near = _cells(table, anchors, blocks, anchor_blocks).applyInArrow(
        _positives(width, settings),
        "anchor_key long, positive_id long, positive_score long, row_key long")
    positives = stage(
        _firsts(near, ["anchor_key"], "positive_score", "positive_id", settings.positives), "positives")
    lists = positives.groupBy("anchor_key").agg(  # ``settings.positives`` at most
        F.transform(F.array_sort(F.collect_list(F.struct("place_", "positive_score"))),
                    lambda x: x["positive_score"]).alias("positive_scores"))
    asked = stage(
        anchors.join(lists.withColumnRenamed("anchor_key", "row_key"), "row_key"), "asked")
    hard = _cells(table, asked, blocks, anchor_blocks).applyInArrow(
        _negatives(width, settings),
        "anchor_key long, place long, negative_id long, negative_score long, row_key long")
    negatives = _firsts(hard, ["anchor_key", "place"], "negative_score", "negative_id", settings.negatives)
    pairs = positives.select("anchor_key", (F.col("place_") - 1).cast("long").alias("place"),
                             "positive_id", "positive_score")
    ids = anchors.select(F.col("row_key").alias("anchor_key"), F.col("vec_id").alias("anchor_id"),
                         F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return negatives.join(pairs, ["anchor_key", "place"]).join(ids, "anchor_key").select(
        "anchor_id", "positive_id", F.col("place_").alias("rank"), "negative_id",
        "positive_score", "negative_score")

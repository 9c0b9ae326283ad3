"""Near copies by a chosen-path join of word shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm import bytewords
from kerbflow.llm.common import packed_rows, sifted, stage, whole_text
from kerbflow.llm.components import components

SKETCH = "doc_id long, text_hash long, d1 long, d2 long, n_shingles long, mins array<int>"


@dataclass(frozen=True)
class Paths:
    """``width`` words make a shingle, ``least`` is the Jaccard similarity of a link.

    Sets are embedded by ``coordinates`` minhash values. Buckets of up to ``bucket``
    sets are compared by these values, pairs agreeing in at least ``floor`` of them
    go on; larger ones are split up to ``depth`` times, unless members agree in
    ``dense`` of their values on average. ``recall`` is met at the last depth, and
    surpassed at the earlier ones. Sets of a component are compared in blocks of about
    ``block_shingles`` shingles.
    """

    width: int = 5
    least: float = 0.8
    coordinates: int = 64
    bucket: int = 128
    depth: int = 6
    recall: float = 0.99
    floor: float = 0.6
    dense: float = 0.5
    block_shingles: int = 1 << 20
    seed: int = 11

    @property
    def chance(self) -> float:
        """Of a coordinate to be sampled at a node: a linked pair shares one on average."""
        return 1 / (self.least * self.coordinates)

    @property
    def runs(self) -> int:
        """Repetitions after which a pair at the threshold shares a bucket of the last
        depth with probability ``recall``."""
        alive = 1.0
        for _ in range(self.depth):
            alive = 1 - (1 - self.chance * alive) ** (self.least * self.coordinates)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - alive))

    def roots(self) -> list[tuple[int, int]]:
        """(run, coordinate) sampled at the root of each run."""
        rng = np.random.default_rng(self.seed)
        picked = rng.random((self.runs, self.coordinates)) < self.chance
        return [(int(r), int(j)) for r, j in zip(*np.nonzero(picked))]


def _multipliers(n: int) -> np.ndarray:
    rng = np.random.default_rng(29)
    return rng.integers(1, 1 << 63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(h: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima for each set of hashes; sets without any have zeros."""
    out = np.zeros((len(counts), n), np.int32)
    some = counts > 0
    if not some.any():
        return out
    firsts = (np.cumsum(counts) - counts)[some]
    odd, shift = _multipliers(n)
    for j in range(n):
        x = ((h ^ shift[j]) * odd[j]) >> np.uint64(32)
        out[some, j] = np.minimum.reduceat(x, firsts).astype(np.uint32).view(np.int32)
    return out


def _digests(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    ends = np.cumsum(counts)
    out = []
    for salt in (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(bytewords.mix(h ^ np.uint64(salt)), out=total[1:])
        out.append((total[ends] - total[ends - counts]).view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, paths: Paths) -> DataFrame:
    """Digests and minima of the shingle set of every row, stored with a row_key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(whole_text()).alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SKETCH.split(", ")]
        for batch in batches:
            for s in bytewords.slices(batch.column(2)):
                h, counts = bytewords.shingles(s, paths.width)
                d1, d2 = _digests(h, counts)
                mins = minhashes(h, counts, paths.coordinates)
                some = batch.slice(s.first, s.last - s.first)
                offsets = np.arange(len(counts) + 1, dtype=np.int32) * paths.coordinates
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array(d1), pa.array(d2),
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(mins.ravel())),
                ], names=names)

    return stage(rows.mapInArrow(run, SKETCH).withColumn("row_key", F.monotonically_increasing_id()),
                 "shingle-sketches")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (key, path) of paths with company, and the number of keys on each path.

    Counts are aggregated before the shuffle and joined back, so a path shared by very
    many sets is split like any skewed join key.
    """
    n = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    return stage(rows.join(n, "path"), "paths")


def _children(rows: DataFrame, paths: Paths, level: int) -> DataFrame:
    """Sampled coordinates of each node, the same for all its sets, and their values."""
    scale = 1 << 20
    sampled = F.filter(F.sequence(F.lit(0), F.lit(paths.coordinates - 1)), lambda j: F.pmod(
        F.xxhash64("path", j, F.lit(level)), F.lit(scale)) < int(scale * paths.chance))
    return rows.select("key", "path", "mins", F.explode(sampled).alias("j")).select(
        "key", F.xxhash64("path", "j", F.expr("mins[j]")).alias("path")
    ).distinct()


def _dense(rows: DataFrame, paths: Paths) -> DataFrame:
    """Paths whose sets agree with each other in ``dense`` of the coordinates on average:
    splitting wouldn't make them much smaller.

    For each coordinate the sets' values give signs by hash; the square of the sum of
    the signs estimates how many pairs agree. One aggregate, a row for each path.
    """
    sums = [F.sum(1 - 2 * F.pmod(F.xxhash64(F.col("mins")[j], F.lit(j)), F.lit(2))).alias(f"z{j}")
            for j in range(paths.coordinates)]
    agree = sum(F.col(f"z{j}") * F.col(f"z{j}") for j in range(paths.coordinates))
    share = agree / (paths.coordinates * F.col("n") * F.col("n"))
    return rows.groupBy("path", "n").agg(*sums).filter(share >= paths.dense).select("path")


def _stars(rows: DataFrame) -> DataFrame:
    """Edges from every key of a path to its smallest one."""
    least = rows.groupBy("path").agg(F.min("key").alias("b"))
    return rows.join(least, "path").select(F.col("key").alias("a"), "b").filter("a != b")


def _within(n: np.ndarray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) inside runs of lengths ``n``, a bounded number at a time."""
    starts = np.cumsum(n) - n
    row_end = np.repeat(starts + n, n)
    width = row_end - np.arange(len(row_end)) - 1
    total = np.cumsum(width)
    at = 0
    while at < len(width):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")), at + 1)
        w = width[at:to]
        i = np.repeat(np.arange(at, to), w)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        at = to


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes along the pairs."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _bucket_edges(rows: DataFrame, paths: Paths) -> DataFrame:
    """Compares the sets of each small bucket by their minima; a spanning forest of the
    pairs that agree enough, at most one edge for each member of a bucket."""

    def edges(paths_: np.ndarray, keys: np.ndarray, mins: np.ndarray) -> pa.RecordBatch:
        n = np.diff(np.flatnonzero(np.r_[True, paths_[1:] != paths_[:-1], True]))
        need = paths.floor * paths.coordinates
        left, right = [], []
        for i, j in _within(n):
            hit = (mins[i] == mins[j]).sum(axis=1) >= need
            left.append(i[hit])
            right.append(j[hit])
        a = np.concatenate(left) if left else np.zeros(0, int)
        b = np.concatenate(right) if right else np.zeros(0, int)
        root = forest(a, b, len(keys))
        moved = np.flatnonzero(root != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[moved]), pa.array(keys[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                values = some.column(2)
                mins = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, paths.coordinates)
                got = (some.column(0).to_numpy(), some.column(1).to_numpy(), mins)
                p, k, m = (np.concatenate([x, y]) for x, y in zip(held[0], got)) if held else got
                cut = int(np.searchsorted(p, p[-1])) if len(p) else 0
                if cut:  # the last path may go on in the next rows
                    yield edges(p[:cut], k[:cut], m[:cut])
                held = [(p[cut:], k[cut:], m[cut:])]
        if held and len(held[0][0]):
            yield edges(*held[0])

    ordered = rows.select("path", "key", "mins").repartition("path").sortWithinPartitions("path", "key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def candidate_edges(sets: DataFrame, paths: Paths) -> DataFrame:
    """Edges (a, b) among ``sets`` (key, mins) that the chosen paths bring together.

    Runs go side by side, level by level. A path with one set ends; one with at most
    ``bucket`` sets is compared; a larger one is split again. Paths too dense to split,
    or still large at the last depth, are linked as a whole: their sets are all
    compared later, so no pair depends on a cap.
    """
    mins = F.col("mins")
    first = [F.xxhash64(F.lit(r), F.lit(j), mins[j]) for r, j in paths.roots()]
    rows = sets.select("key", F.explode(F.array(*first)).alias("path"))
    leaves, stars = [], []
    for level in range(1, paths.depth + 1):
        marked = _counted(rows)
        leaves.append(marked.filter(F.col("n") <= paths.bucket).select("path", "key"))
        big = marked.filter(F.col("n") > paths.bucket)
        if big.isEmpty():
            break
        if level == paths.depth:
            stars.append(_stars(big))
            break
        held = stage(big.join(sets, "key").select("key", "path", "n", "mins"), "large-paths")
        dense = stage(_dense(held, paths), "dense-paths")
        stars.append(_stars(held.select("key", "path").join(dense, "path", "left_semi")))
        rows = _children(held.join(dense, "path", "left_anti"), paths, level + 1)
    small = reduce(DataFrame.unionByName, leaves).join(sets, "key")
    return reduce(DataFrame.unionByName, [_bucket_edges(small, paths), *stars])


def _overlaps(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, left: np.ndarray,
              right: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between the sets ``left`` and ``right`` (or among ``left``): exact
    intersections by marking one set at a time."""
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    a, b = [], []
    cells = np.concatenate([np.arange(starts[r], starts[r] + counts[r]) for r in right])
    theirs = ids[cells]
    edges = np.cumsum(counts[right]) - counts[right]
    for k, i in enumerate(left):
        from_ = k + 1 if same else 0
        if from_ >= len(right):
            break
        own = ids[starts[i] : starts[i] + counts[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[theirs[edges[from_] :]], edges[from_:] - edges[from_], dtype=np.int64)
        mark[own] = False
        union = counts[i] + counts[right[from_:]] - shared
        hit = right[from_:][shared >= least * union]
        a.append(np.full(len(hit), i))
        b.append(hit)
    return (np.concatenate(a) if a else np.zeros(0, int)), (np.concatenate(b) if b else np.zeros(0, int))


def _linked(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links among the sets of one group of cells: number of linked sets and of their
    documents for each set, and the smallest key reachable."""
    pdf = pdf.drop_duplicates(["component", "x", "y", "key"]).sort_values(
        ["component", "x", "y", "key"], ignore_index=True)
    sets = pdf["shingles"].to_list()
    counts = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(counts) - counts
    _, ids = np.unique(np.concatenate(sets).view(np.uint64), return_inverse=True)
    cell = pdf[["component", "x", "y"]].to_numpy()
    borders = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1), True])
    block = pdf["block"].to_numpy()
    a, b = [], []
    for lo, hi in zip(borders[:-1], borders[1:]):
        rows = np.arange(lo, hi)
        _, x, y = cell[lo]
        left, right = rows[block[lo:hi] == x], rows[block[lo:hi] == y]
        if len(left) and len(right):
            own = ids[starts[lo] : starts[hi - 1] + counts[hi - 1]]
            own = own if hi - lo > 64 else np.unique(own, return_inverse=True)[1]
            p, q = _overlaps(own, starts[lo:hi] - starts[lo], counts[lo:hi], left - lo, right - lo,
                             least, x == y)
            a.append(p + lo)
            b.append(q + lo)
    a = np.concatenate(a) if a else np.zeros(0, int)
    b = np.concatenate(b) if b else np.zeros(0, int)
    copies, n = pdf["copies"].to_numpy(), len(pdf)
    links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    docs = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    key = pdf["key"].to_numpy()
    out = pd.DataFrame({"key": key, "root": key[forest(a, b, n)], "links": links,
                        "doc_links": docs.astype(np.int64)})
    return out[out["links"] > 0]


def _verified(docs: DataFrame, members: DataFrame, paths: Paths) -> DataFrame:
    """(key, root, links, doc_links) in each cell of each component.

    ``members``: key, component, copies, n_shingles, id_, text_hash. Components of many
    shingles are cut into k blocks by hash and compared block by block, so a task holds
    two blocks whatever the component's size; small components share a group.
    """
    size = members.groupBy("component").agg(F.sum("n_shingles").alias("size"))
    k = F.ceil(F.col("size") / paths.block_shingles)
    total = size.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // paths.block_shingles))
    placed = members.join(size.select("component", k.alias("k")), "component").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("k")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id_"),
                       F.xxhash64(whole_text()).alias("text_hash"), "text")
    rows = sifted(rows, F.col("text_hash"), F.col("text_hash"), placed)  # most are no candidates
    rows = rows.groupBy("id_", "text_hash").agg(F.first("text").alias("text"))  # one of repeated rows
    texts = rows.join(placed.drop("n_shingles"), ["id_", "text_hash"]).select(
        "key", "component", "copies", "block", "k", "text")
    schema = "key long, component long, copies long, block long, k long, shingles array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bytewords.slices(batch.column(5)):
                h, counts = bytewords.shingles(s, paths.width)
                some = batch.slice(s.first, s.last - s.first)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in range(5)], lists],
                    names=["key", "component", "copies", "block", "k", "shingles"])

    cells = texts.mapInArrow(run, schema).select("*", F.explode(F.expr("sequence(0L, k - 1)")).alias("other"))
    cells = cells.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    group = F.when(F.col("k") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(
        F.xxhash64("component", "x", "y"))
    least = paths.least
    return cells.withColumn("group_key", group).groupBy("group_key").applyInPandas(
        lambda pdf: _linked(pdf, least), "key long, root long, links long, doc_links long")


def _classes(docs: DataFrame, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows; and for each set (d1, d2, n_shingles) its numbers of links
    and the first row of its class, by doc_id (null last) and text: class_id, class_hash."""
    rows = sketches(docs, paths)
    id_ = F.coalesce("doc_id", F.lit(-1))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row_key")
    classes = stage(
        rows.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(
            F.min(order).alias("first"), F.count("*").alias("copies"),
            F.min_by(F.struct(id_.alias("id_"), "text_hash", "mins"), "row_key").alias("one"),
        ).select("d1", "d2", "n_shingles", "copies", F.col("first.doc_id").alias("least_id"),
                 F.col("first.text_hash").alias("least_hash"), F.col("first.row_key").alias("key"),
                 "one.id_", "one.text_hash", "one.mins"),
        "shingle-sets",
    )
    edges = candidate_edges(classes.select("key", "mins"), paths)
    members = stage(
        components(edges).join(
            classes.select("key", "copies", "n_shingles", "id_", "text_hash"), "key"),
        "candidate-sets",
    )
    found = stage(_verified(docs, members, paths), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    joined = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", "d1", "d2", "n_shingles", "copies", "least_id", "least_hash").join(
        joined, "key", "left").join(links, "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key"))
    least = F.struct(F.col("least_id").isNull(), "least_id", "least_hash")
    ids = named.groupBy("component").agg(F.min(least).alias("least")).select(
        "component", F.col("least.least_id").alias("class_id"), F.col("least.least_hash").alias("class_hash"))
    decided = named.join(ids, "component").select(
        "d1", "d2", "n_shingles", "class_id", "class_hash",
        (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_text_links"),
    )
    return rows, decided


def near_copies(docs: DataFrame, paths: Paths = Paths()) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, n_shingles) of every row.

    Two documents are linked if the Jaccard similarity of their sets of word shingles
    is at least ``least``; ``class_id`` is the smallest doc_id that can be reached by
    links. ``n_links`` counts linked documents, those with the same set among them;
    ``n_text_links`` counts linked sets other than the document's own.

    Documents with one set are joined once. The chosen paths give candidate edges; all
    sets of a component of these edges are then compared exactly, in blocks.

    A null text is empty; a text without words has no set and no link; one of fewer
    words than a shingle has all its words as its shingle; a null doc_id ranks last and
    gives way to the others as class_id; repeated rows are linked documents; other
    columns are not read; no rows give no rows.
    """
    rows, decided = _classes(docs, paths)
    return rows.select("doc_id", "d1", "d2", "n_shingles").join(
        decided, ["d1", "d2", "n_shingles"], "left"
    ).select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"), "n_shingles",
    )


def representatives(docs: DataFrame, paths: Paths = Paths()) -> DataFrame:
    """The documents without the near copies of others: of each class the row with the
    smallest doc_id (null last), then the smallest text hash, stays with all its columns;
    rows without a link all stay.

    Rows are known by doc_id and text: of rows that agree in both one stays, by a second
    pass over the few that repeat.
    """
    rows, decided = _classes(docs, paths)
    none, id_ = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    key = ["id_", "none_", "text_hash"]
    known = rows.join(decided.filter("n_links > 0"), ["d1", "d2", "n_shingles"]).groupBy(
        id_.alias("id_"), none.alias("none_"), "text_hash"
    ).agg(F.max(first).alias("first"), F.count("*").alias("n"))
    drop = stage(known.filter("not first or n > 1"), "near-copies")
    given = packed_rows(docs, id_=id_, none_=none, text_hash=F.xxhash64(whole_text()))
    again = drop.filter("first")
    repeated = sifted(given, F.col("text_hash"), F.col("text_hash"), again).groupBy(*key).agg(
        F.first("row_").alias("row_")).join(again, key, "left_semi")
    return given.join(drop, key, "left_anti").select("row_.*").unionByName(repeated.select("row_.*"))

"""Importance resampling towards a target distribution of hashed words.

Each document is weighed by an array of bucket gains, gets seeded Gumbel noise, and the
highest scores are drawn. The cut-off is found by bisection: count jobs over the stored
scores, then over doc_id among the rows that tie; only drawn rows are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm.common import stage, whole_text

PIECE_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents of ``least_words`` words or more are drawn."""

    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    least_words: int = 20
    #: Thresholds counted by one job of the bisection.
    probes: int = 15


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each segment: byte k of all words that have one, at a time."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, sizes = starts[order], sizes[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(sizes[0]) if len(sizes) else 0, LONG_WORD)):
        m = int(np.searchsorted(-sizes, -k, "left"))
        part = crc[:m]
        crc[:m] = _CRC[(part ^ data[at[:m] + k]) & 0xFF] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-sizes, -LONG_WORD, "left"))):
        crc[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def hashed_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the batch, crc32) of every word, in pieces of about a megabyte.

    Pieces end at a byte outside words or at a document's end, so a text of any length
    takes no more memory than one piece (a word longer than a piece apart).
    """
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return
    body = np.frombuffer(column.buffers()[2], np.uint8)
    a, last = int(offsets[0]), int(offsets[-1])
    while a < last:
        b = min(a + PIECE_BYTES, last)
        stop = int(offsets[np.searchsorted(offsets, b, "left")])
        while b < stop:
            outside = np.flatnonzero(~_WORD[body[b : min(b + 4096, stop)]])
            if len(outside):
                b += int(outside[0])
                break
            b = min(b + 4096, stop)
        data = _LOWER[body[a:b]]
        inside = _WORD[data]
        first, to = np.searchsorted(offsets, [a, b], "left")
        cuts = offsets[first:to] - a
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        new[cuts[cuts < len(new)]] = inside[cuts[cuts < len(new)]]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        end[before] = inside[before]
        starts, ends = np.flatnonzero(new), np.flatnonzero(end) + 1
        yield np.searchsorted(offsets, starts + a, "right") - 1, word_crcs(data, starts, ends)
        a = b


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: at most ``buckets`` rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, crc in hashed_words(batch.column(0)):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's share in the target over its share in all
    documents, both smoothed by one occurrence in each bucket; floors."""
    buckets = len(raw)
    share = ((target + 1.0) * (raw.sum() + float(buckets))) / (
        (raw + 1.0) * (target.sum() + float(buckets)))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weighed(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Adds n_features and weight, the floored mean gain of a text's words, to ``rows``,
    whose column ``text`` goes."""
    others = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in others] + ["n_features", "weight"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    held = rows.sparkSession.sparkContext.broadcast(table)  # ``buckets`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = held.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for docs, crc in hashed_words(batch.column(at)):
                if len(docs):
                    first = np.flatnonzero(np.diff(docs, prepend=-1))
                    n[docs[first]] += np.diff(first, append=len(docs))
                    total[docs[first]] += np.add.reduceat(array[crc % np.uint32(len(array))], first)
            kept = [batch.column(k) for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n), pa.array(total // np.maximum(n, 1))], names=names)

    return rows.mapInArrow(run, schema + "n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number by the hash of seed and doc_id; a null id is empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


#: Rows are drawn in the ascending order of these columns; the last one is unique.
ORDER = ("falling", "id_missing", "id_", "text_hash", "row_key")


def cutoff(rows: DataFrame, order: tuple[str, ...], k: int, probes: int = 15) -> list[int]:
    """Values c of the leading columns of ``order`` (whole numbers without nulls) such
    that just ``k`` rows (1 or more) are at or before c.

    Bisection: a job counts the rows up to each of ``probes`` thresholds and leaves one
    of the parts between them. Where more rows tie at c than are wanted, the next column
    is searched among them. The driver holds counts alone.
    """
    tied, need, found = rows, k, []
    for name in order:
        key = F.col(name)
        least, most, upto = tied.agg(F.min(key), F.max(key), F.count("*")).first()
        below = 0
        while least < most:
            marks = sorted({least + (most - least) * i // (probes + 1) for i in range(1, probes + 1)})
            counts = tied.agg(*[F.count_if(key <= m) for m in marks]).first()
            for mark, n in zip(marks, counts):
                if n >= need:
                    most, upto = mark, n
                    break
                least, below = mark + 1, n
        found.append(least)
        if upto == need:
            break
        need -= below
        tied = tied.filter(key == least)
    return found


def up_to(order: tuple[str, ...], found: list[int]) -> Column:
    """Rows at or before the cut-off, column by column."""
    last = len(found) - 1
    out = F.col(order[last]) <= found[last]
    for name, value in reversed(list(zip(order[:last], found[:last]))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def ranked(drawn: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``drawn`` with its rank from 1: ranges of the order make the partitions, and each
    goes on from the number of rows in those before it."""
    rows = drawn.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(rows.withColumn("at_", F.monotonically_increasing_id()), "drawn").withColumn(
        "part_", F.shiftright("at_", 33))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part_").agg(F.count("*").alias("n_")).select(  # a row a partition
        "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    inside = F.col("at_") - F.shiftleft("part_", 33)
    return rows.join(starts, "part_").withColumn("rank", F.col("start_") + inside + 1)


def resample(docs: DataFrame, target: DataFrame, settings: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document.

    ``target`` (text) holds the texts whose word distribution is wanted. Features are
    words in lower case (A-Z only), hashed; a weight is the floored mean gain, a score
    the weight and the document's noise. The floored ``percent`` of the documents of
    ``least_words`` words or more with the highest scores are drawn; ties go to the
    smaller doc_id, then by text hash, then by row.

    A null or empty text has no features and weight 0; a null doc_id hashes as empty and
    ranks last among ties; rows that repeat are drawn one by one; an empty target leaves
    the smoothing alone; other columns are not read; no rows give no rows.
    """
    table = gains(bucket_counts(docs, settings.buckets), bucket_counts(target, settings.buckets))
    doc_id = F.col("doc_id").cast("long")
    rows = weighed(docs.select(doc_id.alias("doc_id"),
                               F.xxhash64(whole_text()).alias("text_hash"), "text"), table)
    scored = stage(
        rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings.seed))
        .withColumn("falling", -F.col("score"))
        .withColumn("id_missing", F.col("doc_id").isNull().cast("long"))
        .withColumn("id_", F.coalesce("doc_id", F.lit(0)))
        .withColumn("row_key", F.monotonically_increasing_id()),
        "resampling-scores",
    )
    wanted = scored.filter(F.col("n_features") >= settings.least_words)
    k = settings.percent * wanted.count() // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(out)
    chosen = (F.col("n_features") >= settings.least_words) & up_to(
        ORDER, cutoff(wanted.select(*ORDER), ORDER, k, settings.probes))
    rest = scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.filter(chosen), ORDER).select(out).unionByName(rest.select(out))

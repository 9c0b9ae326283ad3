"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import n_words, stage, whole_text

PLACED = ("doc_id long, piece int, start long, n_words long, bin_id long, bin_offset long, "
          "bin_used long, bin_capacity long")


@dataclass(frozen=True)
class BinSizes:
    """Permitted lengths; a sequence costs its length plus a fixed charge."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    charge: float = 32.0

    def cost(self, capacity: int) -> float:
        return capacity + self.charge


class _Remaining:
    """How many items of each length are still to be placed; their lengths as bits."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.count = dict(zip(values.tolist(), counts.tolist()))
        self.bits = sum(1 << v for v in self.count)

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            self.bits ^= 1 << length

    def fill(self, room: int) -> int:
        """Words that the longest fitting items, one after the other, put into ``room``."""
        left = room
        while left:
            below = self.bits & ((1 << (left + 1)) - 1)
            length = below.bit_length() - 1
            if length <= 0:
                break
            n = min(self.count[length], left // length)
            left -= n * length
            if left >= length:  # all of this length are used up
                below ^= 1 << length
                rest = below
                while left and rest:
                    rest &= (1 << (left + 1)) - 1
                    length = rest.bit_length() - 1
                    if length <= 0:
                        break
                    left -= min(self.count[length], left // length) * length
                    rest &= ~(1 << length)
                break
        return room - left


def best_fit(lengths: Sequence[int], sizes: BinSizes) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Bin and offset of each length (longest first), contents and capacity of each bin.

    An item goes to the open bin that it fits most tightly. Where it fits none, the
    permitted size is opened whose cost for each word of its expected contents is
    least: the item and what the remaining items can fill beside it. In the end every
    bin gets the smallest permitted size that holds its contents.
    """
    caps = sorted(sizes.capacities)
    remaining = _Remaining(np.asarray(lengths, np.int64))
    rooms = 0
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    opened: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths):
        remaining.take(length)
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = min(
                (c for c in caps if c >= length),
                key=lambda c: (sizes.cost(c) / (length + remaining.fill(c - length)), -c),
            )
            b = len(used)
            used.append(0)
            opened.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        if left := room - length:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, used, [next(c for c in caps if c >= u) for u in used]


def pieces(docs: DataFrame, longest: int, length: Column | None = None) -> DataFrame:
    """(row_key, doc_id, piece, start, n_words): documents over ``longest`` are cut."""
    size = n_words(whole_text()) if length is None else length
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_key"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(size.cast("long"), F.lit(0)).alias("total"),
        ),
        "packing-lengths",
    )
    last = F.greatest(F.expr(f"(total - 1) div {longest}"), F.lit(0))
    cut = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * longest
    return cut.select(
        "row_key", "doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"),
        F.least(F.lit(longest), F.col("total") - start).cast("long").alias("n_words"),
    )


def pack(
    docs: DataFrame,
    sizes: BinSizes = BinSizes(),
    group_pieces: int = 4096,
    length: Column | None = None,
) -> DataFrame:
    """Every piece of every document with its bin, place, contents and capacity.

    ``length`` counts the units of a document (default: its words). Documents longer
    than the largest size are cut into pieces of that size and a rest; nothing is
    dropped. Pieces are dealt by hash over groups of about ``group_pieces``, and each
    group is packed by itself, so a group fits a task whatever the input holds.

    A null or empty text is one piece of no words outside any bin (null bin columns);
    a null doc_id stays null; repeated rows are packed as often as they occur; ties in
    length go by doc_id and piece; other columns are not read; no rows give no rows.
    """
    longest = max(sizes.capacities)
    rows = pieces(docs, longest, length)
    filled = rows.filter("n_words > 0")
    n_groups = max(1, -(-filled.count() // group_pieces))

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["group_key"].iloc[0])
        pdf = pdf.sort_values(["n_words", "doc_id", "piece", "row_key"],
                              ascending=[False, True, True, True], na_position="first",
                              ignore_index=True)
        bins, offsets, used, capacity = best_fit(pdf["n_words"].tolist(), sizes)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"],
            "start": pdf["start"], "n_words": pdf["n_words"],
            "bin_id": group * (1 << 32) + bins, "bin_offset": offsets,
            "bin_used": np.asarray(used)[bins], "bin_capacity": np.asarray(capacity)[bins],
        })

    key = F.pmod(F.xxhash64("row_key", "piece"), F.lit(n_groups)).alias("group_key")
    placed = filled.select("*", key).groupBy("group_key").applyInPandas(pack_group, PLACED)
    no_bin = [F.lit(None).cast("long").alias(c)
              for c in ("bin_id", "bin_offset", "bin_used", "bin_capacity")]
    empty = rows.filter("n_words = 0").select("doc_id", "piece", "start", "n_words", *no_bin)
    return placed.unionByName(empty)

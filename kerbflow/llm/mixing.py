"""Mixing sources to target weights, by fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm.common import n_words, packed_rows, rest_hash, stage, whole_text, with_copy_number

#: The mix is this share of all words, and no word is taken more often than LIMIT.
SHARE, LIMIT = 1.5, 2
WEIGHTS = (3, 1, 2)
#: Documents of a source are strung together in this many runs, each numbered by itself.
RUNS = 4096
#: Block numbers that one row makes.
SPAN = 1 << 16


@dataclass(frozen=True)
class Mix:
    """Stored parts of a mix.

    ``targets``: source_no, source, source_size, target, blocks, slots. ``words``: row_key,
    doc_id, text_hash, row_hash (of the other columns), size, source_no, begin (place in the
    stream of words of its source).
    ``slots``: shard, source_no, pass, block. ``pieces``: row_key, pass, lo, hi, the words
    of a document that a taken block holds.
    """

    words: DataFrame
    targets: DataFrame
    slots: DataFrame
    pieces: DataFrame


def _words(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        rest_hash(docs).alias("row_hash"),
        n_words(text).alias("size"),
        F.col("source").cast("string").alias("source"),
    )


def targets(words: DataFrame, block: int, share: float, weights: Sequence[int]) -> DataFrame:
    """Words and blocks to take of each source.

    Every source takes its weight's part of ``share`` of all words, but at most LIMIT
    times its own; what it can't take goes to the others by weight. In order of size
    by weight the full sources come first, so the common level of the others follows
    from running sums over the sources (one row each).
    """
    sizes = words.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (place % len(weights) + 1).cast("int"))
    room = LIMIT * F.col("source_size")
    rows = sizes.withColumns({"source_no": place, "weight": weight}).withColumn(
        "room", room.cast("double"))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    rows = rows.withColumns({
        "total": F.sum("source_size").over(whole) * F.lit(share),
        "taken": F.coalesce(F.sum("room").over(before), zero),
        "heavier": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero),
    })
    level = (F.col("total") - F.col("taken")) / F.col("heavier")
    full = F.col("room") <= F.col("weight") * level
    common = F.max(F.when(~full, level)).over(whole)  # the first one's; later ones are lower
    target = F.when(full, F.col("room")).otherwise(
        F.least(F.col("room"), F.col("weight") * F.coalesce(common, zero))
    )
    blocks = F.ceil(F.col("source_size") / block)
    return rows.withColumn("target", target).withColumn("blocks", blocks).select(
        "source_no", "source", "source_size", "target", "blocks",
        F.coalesce(
            F.least(LIMIT * F.col("blocks"),
                    F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")),
            F.lit(0),
        ).alias("slots"),
    )


def _streams(words: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds ``source_no`` and ``begin``, the place of a document in the stream of its source.

    A source is a chain of RUNS runs to which documents are dealt by hash; a window
    numbers the words within one run, and the sums of the runs (at most RUNS rows a
    source) give where each run begins. No task gets a whole source. Rows equal in all
    columns are told apart by the number of the copy, so the streams don't depend on how
    the table is stored, and a frequent row is dealt over all runs.
    """
    names = goals.select("source_no", F.col("source").alias("s_"))
    run = F.pmod(F.xxhash64("text_hash", "row_hash", "copy"), F.lit(RUNS))
    each = with_copy_number(words, ["text_hash", "row_hash"])
    rows = each.join(names, F.col("source").eqNullSafe(F.col("s_"))).select(
        "row_key", "doc_id", "text_hash", "row_hash", "copy", "size", "source_no", run.alias("run"))
    sums = rows.groupBy("source_no", "run").agg(F.sum("size").alias("run_size"))
    starts = _running(sums, ["source_no"], "run", "run_size")
    inside = Window.partitionBy("source_no", "run").orderBy("doc_id", "text_hash", "row_hash", "copy")
    placed = rows.withColumn(
        "begin", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    return placed.join(starts.hint("merge"), ["source_no", "run"]).select(
        "row_key", "doc_id", "text_hash", "row_hash", "size", "source_no",
        (F.col("begin") + F.col("before")).alias("begin"),
    )


def _running(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(*by, order, before): the sum of ``value`` over the rows before."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*by, order, F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("before"))


def _running_long(rows: DataFrame, by: str, order: str, value: str, span: int = SPAN) -> DataFrame:
    """Like ``_running`` where ``order`` numbers many rows: sums of ranges of ``span``
    numbers first, then within each range, so no task gets more than a range of one ``by``."""
    marked = rows.select(by, order, value, F.expr(f"{order} div {span}").alias("range_"))
    sums = marked.groupBy(by, "range_").agg(F.sum(value).alias("sum_"))
    heads = _running(sums, [by], "range_", "sum_").withColumnRenamed("before", "head_")
    earlier = Window.partitionBy(by, "range_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("in_", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return placed.join(heads.hint("merge"), [by, "range_"]).select(
        by, order, (F.col("head_") + F.col("in_")).alias("before"))


def _dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` ranges spread over as many tasks, at most the session's number."""
    if n <= 1:
        return rows
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(n, most), *keys)


def _draws(goals: DataFrame, shard_slots: int, seed: int, span: int = 256) -> DataFrame:
    """(shard, source_no, drawn): multinomial counts of each output shard, those above 0.

    Ranges of ``span`` shards are dealt to the tasks. Every shard draws by a generator of
    its own number, so a repeated task draws the same. Sources without words have no part.
    """
    parts = F.array_sort(F.collect_list(F.struct("source_no", "slots")))
    chance = goals.filter("slots > 0").agg(
        F.transform(parts, lambda x: x["source_no"]).alias("numbers"),
        F.transform(parts, lambda x: x["slots"]).alias("slots"),
        F.sum("slots").alias("n_slots"),
    ).filter("n_slots > 0")
    n_shards = F.expr(f"(n_slots - 1) div {shard_slots} + 1")
    ranges = chance.select("*", n_shards.alias("n_shards"), F.explode(
        F.expr(f"sequence(0L, (n_slots - 1) div {shard_slots}, {span}L)")).alias("from"))
    slots = goals.agg(F.sum("slots")).first()[0] or 0
    shards = _dealt(ranges, -(-slots // (shard_slots * span)), "from").select(
        "numbers", "slots", "n_slots",
        F.explode(F.expr(f"sequence(from, least(from + {span}L, n_shards) - 1)")).alias("shard"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for numbers, slots, n, shard in zip(pdf["numbers"], pdf["slots"], pdf["n_slots"], pdf["shard"]):
                share = np.asarray(slots, float)
                rng = np.random.Generator(np.random.Philox([seed, shard]))
                counts = rng.multinomial(min(shard_slots, n - shard * shard_slots), share / share.sum())
                hit = counts > 0
                yield pd.DataFrame(
                    {"shard": shard, "source_no": np.asarray(numbers)[hit], "drawn": counts[hit]})

    return shards.mapInPandas(draw, "shard long, source_no int, drawn long")


def _planned(goals: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source_no, from, n): runs of consecutive draws of a source in each shard.

    Draws of a source beyond its slots pass to sources that were drawn too rarely: both
    are numbered along one line and joined by number, so each total is met exactly.
    Only that difference, about the square root of a source's slots, is moved.
    """
    drawn = stage(_draws(goals, shard_slots, seed), "mix-draws")
    starts = _running_long(drawn, "source_no", "shard", "drawn")
    rows = drawn.join(starts.withColumnRenamed("before", "from"), ["source_no", "shard"]).join(
        goals.select("source_no", "slots"), "source_no")
    kept = stage(rows.withColumn(
        "n", F.greatest(F.lit(0), F.least("drawn", F.col("slots") - F.col("from")))), "mix-kept")
    line = Window.orderBy("shard", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    surplus = kept.withColumn("extra", F.col("drawn") - F.col("n")).filter("extra > 0").withColumn(
        "base", F.coalesce(F.sum("extra").over(line), F.lit(0))
    ).select("shard", F.explode(F.expr("sequence(base, base + extra - 1)")).alias("place"))
    have = kept.groupBy("source_no").agg(F.sum("n").alias("have"))
    short = goals.select("source_no", "slots").join(have, "source_no", "left").fillna(0, ["have"])
    line = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    lacking = short.filter("have < slots").withColumn(
        "base", F.coalesce(F.sum(F.col("slots") - F.col("have")).over(line), F.lit(0))
    ).select(
        "source_no", "have", "base",
        F.explode(F.expr("sequence(base, base + slots - have - 1)")).alias("place"),
    ).select("source_no", (F.col("have") + F.col("place") - F.col("base")).alias("from"), "place")
    moved = surplus.join(lacking.hint("merge"), "place").select(
        "shard", "source_no", "from", F.lit(1).cast("long").alias("n"))
    return kept.filter("n > 0").select("shard", "source_no", "from", "n").unionByName(moved)


def _blocks(goals: DataFrame, span: int) -> DataFrame:
    """(source_no, block, last): the blocks of the sources that have slots, made from ranges
    of ``span`` blocks that are dealt out first, so a large source is made by many tasks."""
    ranges = goals.filter("slots > 0").select(
        "source_no", "blocks", F.expr("cast((slots - 1) div blocks as int)").alias("last"),
        F.explode(F.expr(f"sequence(0L, blocks - 1, {span}L)")).alias("from"),
    )
    n = goals.filter("slots > 0").agg(F.sum(F.ceil(F.col("blocks") / span))).first()[0] or 0
    return _dealt(ranges, int(n), "source_no", "from").select("source_no", "last", F.explode(F.expr(
        f"sequence(from, least(from + {span}L, blocks) - 1)")).alias("block"))


def block_order(goals: DataFrame, seed: int) -> DataFrame:
    """(source_no, pass, at, block): in each pass the blocks of a source in hashed order.

    Blocks are dealt over buckets by the head of their hash and numbered within a
    bucket, buckets one after the other: a sort of the hashes without one task for a
    source.
    """
    rows = _blocks(goals, SPAN).select("source_no", "block", F.explode(F.expr("sequence(0, last)")).alias("pass"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "source_no", "pass", "block"))
    rows = rows.withColumn("head", F.pmod("h", F.lit(RUNS)))
    sums = rows.groupBy("source_no", "pass", "head").agg(F.count("*").alias("n"))
    starts = _running(sums, ["source_no", "pass"], "head", "n")
    inside = Window.partitionBy("source_no", "pass", "head").orderBy("h", "block")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(starts.hint("merge"), ["source_no", "pass", "head"]).select(
        "source_no", "pass", (F.col("at") + F.col("before")).alias("at"), "block"
    )


def mix(
    docs: DataFrame,
    block: int = 64,
    shard_slots: int = 4096,
    share: float = SHARE,
    weights: Sequence[int] = WEIGHTS,
    seed: int = 17,
) -> Mix:
    """Blocks of ``block`` words of each source, dealt into output shards by weight.

    The words of a source are one stream, cut into blocks. Each output shard draws by
    multinomial how many of its slots go to which source. Slot k of a source takes
    block number k in the source's pseudorandom order (a second pass has another
    order), found by a join on that number.

    A null text has no words and null is a source of its own, the last one; sources
    without words take none; repeated rows are documents of their own; equal ratios and
    hashes go by source and block; other columns are not read; no rows give empty parts.
    """
    sized = stage(_words(docs), "mix-words")
    goals = stage(targets(sized, block, share, weights), "mix-targets")
    words = stage(_streams(sized, goals), "mix-streams")
    planned = stage(_planned(goals, shard_slots, seed), "mix-plan")
    each = planned.join(goals.select("source_no", "blocks"), "source_no").select(
        "shard", "source_no", "blocks", F.explode(F.expr("sequence(from, from + n - 1)")).alias("k"),
    ).select("shard", "source_no", F.expr("cast(k div blocks as int)").alias("pass"),
             (F.col("k") % F.col("blocks")).alias("at"))
    slots = stage(
        each.join(block_order(goals, seed).hint("merge"), ["source_no", "pass", "at"]).select(
            "shard", "source_no", "pass", "block"),
        "mix-slots",
    )
    held = words.filter("size > 0").select(
        "row_key", "begin", "size", "source_no",
        F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")).alias("block"),
    )
    first = F.col("block") * block
    pieces = held.join(slots.select("source_no", "pass", "block").hint("merge"), ["source_no", "block"]).select(
        "row_key", "pass",
        F.greatest(F.lit(0), first - F.col("begin")).cast("long").alias("lo"),
        F.least(F.col("size"), first + block - F.col("begin")).cast("long").alias("hi"),
    )
    return Mix(words, goals, slots, stage(pieces, "mix-pieces"))


def taken(mixed: Mix) -> DataFrame:
    """One row for each document: size, source_size, target and words taken."""
    got = mixed.pieces.groupBy("row_key").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    goal = mixed.targets.select("source_no", "source_size", "target")
    return mixed.words.join(got, "row_key", "left").join(goal, "source_no").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the input's columns: a row for each document and pass,
    its text cut down to the words taken (the text itself where all are), ``n_chars``
    counted again.

    Rows are known by doc_id, text and a hash of all other columns, so null and -1 stay
    apart; rows equal in all columns, being the same, share those of one. A document of
    which no word is taken (a null or empty text among them) has no row; columns of any
    name are kept; no rows give no rows.
    """
    mixed = mix(docs, **options)
    ranges = mixed.pieces.groupBy("row_key", "pass").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"),
        F.sum(F.col("hi") - F.col("lo")).alias("got"),
    )
    plan = ranges.join(mixed.words, "row_key").select(
        "text_hash", "row_hash", "ranges",
        (F.col("got") == F.col("size")).alias("all_"),
    )
    rows = packed_rows(
        docs, text_hash=F.xxhash64(whole_text()), row_hash=rest_hash(docs),
    ).groupBy("text_hash", "row_hash").agg(F.first("row_").alias("row_"))
    parts = F.regexp_extract_all("row_.text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    cut = F.array_join(
        F.flatten(F.transform("ranges", lambda r: F.slice(
            "parts", (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), "")
    joined = plan.join(rows, ["text_hash", "row_hash"]).withColumn(
        "parts", F.when(~F.col("all_"), parts))
    text = F.when(F.col("all_"), F.col("row_.text")).otherwise(cut)
    out = joined.withColumn("text_", text)
    columns = {"text": F.col("text_")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.char_length("text_").cast(kind)
    return out.select(*[columns.get(c, F.col("row_")[c]).alias(c) for c in docs.columns])

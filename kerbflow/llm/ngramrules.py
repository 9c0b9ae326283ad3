"""Quality rules: plain counts of a text, and hashed n-gram log-likelihood ratios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import SPACE, WORD, let, sifted, stage, whole_text

WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """``buckets`` of hashed n-grams, pseudocount of each bucket, and the least mean
    ratio (natural log, per n-gram) of a document that is kept.

    Documents are scored by the half of the corpus they are not in (two folds by text), so
    a label never speaks for its own document. The threshold is chosen on such held-out
    ratios of labelled documents: at least 99.5 % of the good ones are above it from
    200 documents to 10,000.
    """

    buckets: int = 1 << 16
    pseudocount: float = 5.0
    threshold: float = -0.12


def repeated_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more, the first included.

    Windows are compared by hash. Only if some are equal are they sorted with their
    places; a place whose neighbour in that order has the same hash is repeated, and
    each repeated place covers eight words less its overlap with the one before.
    """
    last = F.size(words) - (WINDOW - 1)

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (
                F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def width(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(
                F.least(F.lit(WINDOW), x - F.get(p, k - 1))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(pairs, places), width)

    def of(windows: Column) -> Column:
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, covered(windows)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )
    return F.when(last < 2, F.lit(0).cast("long")).otherwise(let(hashes, of))


def plain_counts(text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words, repeated_words),
    }


def base_failed() -> Column:
    few = F.col("n_words") < 20
    return few | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ngrams(docs: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """A row for the bucket of every word and every pair of neighbouring words; ``first``
    of a document is the number of its first bucket."""
    words = F.regexp_extract_all(whole_text(), F.lit(f"({WORD})"), 1)
    pairs = F.explode(F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")).alias("next")))
    rows = docs.select(*keep, "first", words.alias("words")).select(*keep, "first", pairs.alias("x"))
    one, two = F.xxhash64("x.words"), F.xxhash64("x.words", "x.next")
    both = F.when(F.col("x.next").isNull(), F.array(one)).otherwise(F.array(one, two))
    return rows.select(*keep, "first", F.explode(both).alias("h")).select(
        *keep, (F.pmod("h", F.lit(buckets)) + F.col("first")).cast("int").alias("bucket")
    )


def fold(text_hash: Column) -> Column:
    """The half of the corpus that a text is in; equal texts are in one."""
    return F.pmod(text_hash, F.lit(2)).cast("int")


def ratios(docs: DataFrame, trusted_ids: DataFrame, rules: Rules) -> DataFrame:
    """(bucket, ratio) for the documents of each fold, from the texts of the other: log of
    the bucket's share in trusted texts over its share in all, as a whole number of
    millionths so that sums don't depend on their order. Buckets are numbered on from
    fold to fold, so that one small number is the key.

    Both multinomials are smoothed by the same share for each bucket: ``pseudocount``
    occurrences in the trusted one, and in the raw one as many more as it is larger. An
    n-gram that is rare in both says little, whatever the size of the corpus, and one that
    the other half lacks nothing.

    Counts are added up in the map tasks, so at most 2 x ``buckets`` rows of each task are
    shuffled; texts are only moved to find the trusted ones.
    """
    trusted = trusted_ids.select(F.col("doc_id").cast("long").alias("id_")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("id_"), "text",
                       (fold(F.xxhash64(whole_text())) * rules.buckets).alias("first"))
    chosen = sifted(text, F.col("id_"), F.col("id_"), trusted).join(
        trusted.hint("merge"), "id_", "left_semi")
    raw = ngrams(text, rules.buckets).groupBy("bucket").agg(F.count("*").alias("raw"))
    good = ngrams(chosen, rules.buckets).groupBy("bucket").agg(F.count("*").alias("good"))
    counts = stage(raw.join(good, "bucket", "left").fillna(0, ["good"]), "ngram-counts")
    counts = counts.withColumn("fold", F.floor(F.col("bucket") / rules.buckets).cast("int"))
    sums = counts.groupBy("fold").agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"))
    expected = F.col("raw") / F.col("all_raw") * F.col("all_good")
    ratio = F.log((F.col("good") + rules.pseudocount) / (expected + rules.pseudocount))
    ratio = F.when(F.col("all_good") == 0, F.lit(0.0)).otherwise(ratio)
    other = F.col("bucket") + (1 - 2 * F.col("fold")) * rules.buckets
    return counts.join(sums, "fold").select(
        other.cast("int").alias("bucket"), F.round(ratio * 1_000_000).cast("long").alias("ratio"))


def judge(docs: DataFrame, trusted_ids: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Plain counts, mean log-likelihood ratio and verdict of every document.

    ``trusted_ids`` (doc_id) names the documents of the target multinomial; the raw one
    is the whole of ``docs``. A document is kept if it passes the plain rules and the
    mean ratio of its words and word pairs is at least the threshold.

    A null text has no words and fails; a null doc_id is never trusted; repeated rows
    are judged alike; a mean equal to the threshold keeps; where the other fold has no
    trusted document, or not the n-gram, ratios are 0; other columns are not read; no rows
    give no rows.
    """
    text = whole_text()
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")]
    table = F.broadcast(ratios(docs, trusted_ids, rules))  # at most 2 x ``buckets`` rows
    first = (fold(F.col("text_hash")) * rules.buckets).alias("first")
    keyed = docs.select(*key, "text").select("*", first)
    scored = ngrams(keyed, rules.buckets, "doc_id", "text_hash").join(table, "bucket", "left")
    sums = scored.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id_"), "text_hash").agg(
        (F.coalesce(F.sum("ratio"), F.lit(0)) / F.count("*") / 1_000_000).alias("mean_ratio"))
    plain = docs.select(*key, *[c.alias(k) for k, c in plain_counts(text).items()])
    rows = plain.withColumn("id_", F.coalesce("doc_id", F.lit(-1))).join(
        sums, ["id_", "text_hash"], "left"
    )
    good = F.coalesce(F.col("mean_ratio") >= rules.threshold, F.lit(False))
    return rows.withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & good).alias("kept"),
        F.coalesce("mean_ratio", F.lit(0.0)).alias("mean_ratio"),
    )

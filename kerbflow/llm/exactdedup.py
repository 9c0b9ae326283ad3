"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm.common import SPACE, packed_rows, rest_hash, stage, whole_text
from kerbflow.session import shared_folder

INDEX = "digest string, keep_id long, batch string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


class DigestIndex:
    """Digests of all texts kept so far, one Parquet table bucketed and sorted by digest.

    Opening an existing folder registers it again under a new table name, so the index
    outlives a session. The number of buckets is stored beside the folder
    (``<path>.buckets``); another one is refused, since rows would be looked for in the
    wrong files. Each digest carries the name of the batch that added it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path.rstrip("/")
        stored = self._stored_buckets()
        if stored is None:
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{self.path}.buckets")
        elif stored != buckets:
            raise ValueError(f"{path} has {stored} buckets, not {buckets}")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({INDEX}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{self.path}'"
        )

    def _stored_buckets(self) -> int | None:
        try:
            noted = self.spark.read.schema("buckets int").parquet(f"{self.path}.buckets")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return noted.agg(F.max("buckets")).first()[0]

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows whose digest no batch but ``batch`` has added: a sort-merge anti-join in
        which only ``digests`` (one row for each digest) is shuffled."""
        others = self.read().filter(~F.col("batch").eqNullSafe(F.lit(batch)))
        return digests.hint("merge").join(others.select("digest"), "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str) -> None:
        """Add those of the (digest, keep_id) rows that an earlier run of the batch has not
        added; one file for each bucket."""
        own = self.read().filter(F.col("batch") == batch).select("digest")
        rows = digests.hint("merge").join(own, "digest", "left_anti").select(
            "digest", F.col("keep_id").cast("long"), F.lit(batch).alias("batch"))
        rows = stage(rows, "index-rows")  # a table can't be appended to while it is read
        rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(
            self.buckets, "digest"
        ).sortBy("digest").option("path", self.path).saveAsTable(self.table)

    def close(self) -> None:
        """Forget the table name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests_of(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, chars, digest) of every row, stored once."""
    text = whole_text()
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_key"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.char_length(text).alias("chars"),
            F.sha2(F.encode(normalised(text), "UTF-8"), 256).alias("digest"),
        ),
        "digests",
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each digest: the row that stays and the size of its group.

    The most code points win, then the smallest doc_id (null last), then the first
    row. Partial aggregates go through the shuffle, one row for each digest and task.
    """
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "row_key")
    return rows.groupBy("digest").agg(
        F.min(order).alias("best"), F.count("*").alias("group_size")
    ).select("digest", "group_size", F.col("best.doc_id").alias("keep_id"),
             F.col("best.row_key").alias("keep_row"))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Each row with the row that stays of its text, and whether it is kept.

    Texts are equal when identical without white space. A text that the index holds
    already is dropped for the row kept then (``keep_id``); of the rows with a new text
    one stays, and the new digests are appended to the index. ``group_size`` counts
    the equal texts of this batch.

    ``batch`` names the rows of ``docs``. The same rows under the same name may run again
    after a failure, before or after the append: the digests that the batch added itself
    count as new, so the decisions are the same, and none is added twice. Without a name
    every call is a batch of its own.

    A null text is empty; null doc_ids rank last; of repeated rows one stays; other
    columns are not read; no rows give no rows.
    """
    batch = batch or uuid.uuid4().hex
    rows = digests_of(docs)
    groups = stage(groups_of(rows), "digest-groups")
    others = index.read().filter(~F.col("batch").eqNullSafe(F.lit(batch)))
    known = others.select("digest", F.col("keep_id").alias("old_id"))
    new = stage(index.unseen(groups, batch), "new-digests")
    old = groups.join(known.hint("merge"), "digest").select(
        "digest", "group_size", F.col("old_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row")
    )
    decided = stage(new.select("digest", "group_size", "keep_id", "keep_row").unionByName(old),
                    "decided-digests")
    index.append(new, batch)
    return rows.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("row_key").eqNullSafe(F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    return DigestIndex(spark, shared_folder(spark, "digest-index"), buckets)


def kept_documents(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns.

    A second pass takes the few rows with the doc_id and text of one that stays; of several
    the longest goes on, then one with a doc_id (null is not -1), then the greatest by a hash
    of all columns but the text. A null text is empty, no rows give no rows, and columns
    of any name are kept as they are.
    """
    decided = deduplicate(docs, index, batch).filter("kept").select(
        F.coalesce(F.col("keep_id"), F.lit(-1)).alias("id_"), "text_sha256"
    )
    text = whole_text()
    rows = packed_rows(
        docs,
        id_=F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)),
        text_sha256=F.sha2(F.encode(normalised(text), "UTF-8"), 256),
        rank_=F.struct(F.char_length(text), F.col("doc_id").isNotNull(), rest_hash(docs)),
    )
    same = rows.join(decided, ["id_", "text_sha256"], "left_semi")
    best = F.max_by("row_", "rank_").alias("row_")
    return same.groupBy("id_", "text_sha256").agg(best).select("row_.*")

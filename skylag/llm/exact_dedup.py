"""Exact deduplication against a persistent digest index (operator 7), in DataFrame operations only.

The index is a table bucketed and sorted by digest. New documents are reduced to one row per digest, meet the index in
a sort-merge anti-join on the index's own buckets, and what is new is appended. Two texts are equal when they are
identical after every run of ``[\\x20\\x09-\\x0D]`` became one space; null counts as empty. Of equal texts the row with
the smallest doc_id stays, a null doc_id only where there is no other; of rows that repeat doc_id and text one stays.
Empty tables give empty results. Columns beyond doc_id and text are carried along; names that begin with ``_dedup`` are
reserved.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skylag.llm.tables import shared_path, written

INDEX_BUCKETS = 32
ENTRY = "text_sha256 string, keep_id bigint, group_size bigint"


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lower-case hex."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", " ")
    return F.sha2(F.encode(spaced, "UTF-8"), 256)


def groups(docs: DataFrame) -> DataFrame:
    """One row per digest: ``text_sha256``, ``keep_id``, ``group_size``; combined inside the tasks before the shuffle."""
    return (docs.select(F.col("doc_id").cast("bigint"), text_digest(F.col("text")).alias("text_sha256"))
            .groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


class DigestIndex:
    """The digests seen so far: a table bucketed and sorted by digest, its files at ``path``.

    An entry holds the digest, the document that stays for it, and how many rows the batch had that brought it in.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None,
                 buckets: int = INDEX_BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or shared_path(spark, self.table)
        if not spark.catalog.tableExists(self.table):
            # Made in the JVM: rows from Python would start a second set of Python workers in every executor.
            self._append(spark.range(0).select(F.from_json(F.lit("{}"), ENTRY).alias("entry")).select("entry.*"))

    def _append(self, entries: DataFrame) -> None:
        (entries.write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
         .option("path", self.path).mode("append").format("parquet").saveAsTable(self.table))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, entries: DataFrame) -> DataFrame:
        """Entries whose digest the index lacks: a merge anti-join that leaves the index where it lies."""
        return entries.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def add(self, docs: DataFrame) -> DataFrame:
        """Append the digests of ``docs`` that the index lacks; returns these new entries."""
        fresh = written(self.unseen(groups(docs)), "digests")
        # One file per bucket and batch.
        self._append(fresh.repartition(self.buckets, "text_sha256"))
        return fresh

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def decisions(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Per row of ``docs``, already added to ``index``: doc_id, keep_id, group_size, kept, text_sha256.

    The index is read by its path, without its buckets, so that both sides of the join are shuffled for it: adaptive
    execution can then split a digest that a third of all documents carry, which a bucketed scan would not allow.
    """
    known = index.spark.read.schema(ENTRY).parquet(index.path)
    # Rows that repeat doc_id and text count on; the pair is never hot.
    again = Window.partitionBy("doc_id", "text_sha256").orderBy("text_sha256")
    rows = (docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256"))
            .withColumn("_dedup_again", F.row_number().over(again)))
    return (rows.join(known.hint("merge"), "text_sha256")
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_dedup_again") == 1)).alias("kept"),
                    "text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` whose text is new to ``index``, one per text, with all their columns; adds them to it.

    Texts meet on (doc_id, digest) of the rows that stay, so copies of one text are spread over all tasks.
    """
    fresh = index.add(docs).select(F.col("keep_id").alias("_dedup_id"), F.col("text_sha256").alias("_dedup_key"))
    rows = docs.withColumn("_dedup_digest", text_digest(F.col("text")))
    stay = rows.join(fresh, F.col("doc_id").eqNullSafe(F.col("_dedup_id"))
                     & (F.col("_dedup_digest") == F.col("_dedup_key")), "left_semi")
    # Only rows that repeat doc_id and text meet here.
    again = Window.partitionBy("doc_id", "_dedup_digest").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return (stay.withColumn("_dedup_again", F.row_number().over(again)).filter("_dedup_again = 1")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))

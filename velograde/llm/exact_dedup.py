"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, with one row per distinct
normalised text. A batch is hashed once, into a table of digests, and reduced to one row per digest (map-side, so
a hot text costs one row per task). The digests that the index lacks are found
by a sort-merge anti-join of two sets of unique keys and appended; of those that it
has, the batch's number of rows is appended as a row without an id, so that group sizes count all batches.

Defined cases: a null text counts as empty; texts of white space alone equal
the empty text; a null id loses ties (it sorts last) but is a row like any
other; repeated rows are members of one group, of which every row that equals
the kept id says ``kept``; a later batch's rows follow the text that came first, however long their own; a batch
that is appended twice counts twice; an empty table yields no rows and an empty index;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograde.llm.workdir import table

#: Deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
BUCKETS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, points): the digest of the normalised text, the code points of the original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
    )


def groups(keys: DataFrame) -> DataFrame:
    """One row per digest: the id that stays, its length and the number of rows."""
    best = F.min(F.struct((-F.col("points")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    return (
        keys.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.minus")).alias("points"), "group_size")
    )


class DigestIndex:
    """A table of digests, bucketed and sorted by digest, that batches are matched with."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _write(self, rows: DataFrame) -> None:
        # One task per bucket and so one sorted file per bucket and batch.
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        """(digest, keep_id, points, group_size), one row per distinct text, its rows of all batches counted."""
        first = F.col("first")
        sums = F.max_by("keep_id", first).alias("keep_id"), F.max_by("points", first).alias("points"), F.sum("group_size").alias("group_size")
        # Bucketed by digest, so this needs no shuffle.
        return self.spark.table(self.name).groupBy("digest").agg(*sums)

    def split(self, batch_groups: DataFrame, how: str) -> DataFrame:
        """The groups of a batch whose digest the index holds (left_semi) or lacks (left_anti)."""
        held = self.spark.table(self.name).where("first").select("digest")
        # Unique keys on both sides: no key is hot here, and the index side is read bucket by bucket.
        return batch_groups.hint("merge").join(held, "digest", how)

    def append(self, batch_groups: DataFrame) -> None:
        """Add a batch of one row per digest; what the index says of digests that it has stays as it is, but for their number of rows."""
        fresh = batch_groups
        if self.exists():
            fresh = self.split(batch_groups, "left_anti")
            seen = self.split(batch_groups, "left_semi").withColumns({"keep_id": F.lit(None).cast(batch_groups.schema["keep_id"].dataType), "points": F.lit(None).cast("long")})
            # Written in one go, as of one state of the index.
            self._write(table(fresh.withColumn("first", F.lit(True)).union(seen.withColumn("first", F.lit(False))), "digest-batch"))
        else:
            self._write(fresh.withColumn("first", F.lit(True)))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def resolve(keys: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row with the index's decision on it.

    The rows of a hot text meet one index row; the join is a plain sort-merge
    join of two shuffled sides, which adaptive execution splits where a key is hot. It
    could not split the buckets themselves, so the index side (unique keys) is shuffled too.
    """
    held = index.read().select("digest", "keep_id", "group_size")
    return keys.join(held.repartition("digest").hint("merge"), "digest", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append the new texts of ``docs`` to the index and return the decision on each row.

    Without an index of the caller's, one is made for this call and dropped.
    """
    spark = docs.sparkSession
    # Texts are read and hashed once; from here on rows are digests.
    keys = table(digests(docs, id_col, text_col), "digests")
    if index is not None:
        index.append(groups(keys))
        return resolve(keys, index)
    index = DigestIndex(spark)
    try:
        index.append(groups(keys))
        return table(resolve(keys, index), "exact-decisions")
    finally:
        index.drop()

"""Exact dedup over a log-structured merge index of digests.

Arriving rows fill memtables, one per task; each is flushed as a run sorted by digest, with a filter beside it.
Compaction merges runs so that each digest keeps one identifier and its count. Rows whose digest meets another
one are hits: they pass the filter, and their bytes are compared by grouping them on digest and text. Only the
texts of hits are moved, each distinct one at most once per task. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_small, key_filter, lower_ascii, passing, scratch_path, written


class DigestIndex:
    """Runs of (digest, sha, id) and their compaction, in a folder shared by driver and executors.

    ``largest`` keeps the largest identifier of each digest instead of the smallest. Null identifiers are never
    kept while there is another.
    """

    def __init__(self, largest: bool = False) -> None:
        self.largest = largest
        self.runs: list[DataFrame] = []
        self.merged: DataFrame | None = None

    def _kept(self, ident: str) -> Column:
        return F.max(ident) if self.largest else F.min(ident)

    def flush(self, rows: DataFrame) -> DataFrame:
        """Writes the memtables of a batch (id, digest, sha) as sorted runs; no shuffle."""
        path = scratch_path(rows.sparkSession, "digest-run")
        rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        run = rows.sparkSession.read.schema(rows.schema).parquet(path)
        self.runs.append(run)
        self.merged = None
        return run

    def compact(self) -> DataFrame:
        """One sorted run (digest, id, n) of all flushed ones: the kept identifier and the number of rows."""
        if self.merged is None:
            every = self.runs[0]
            for run in self.runs[1:]:
                every = every.unionByName(run)
            merged = every.groupBy("digest").agg(self._kept("id").alias("id"), F.count("*").alias("n"))
            self.merged = written(merged.sortWithinPartitions("digest"), "digest-merged")
        return self.merged

    def verified(self, texts: DataFrame) -> DataFrame:
        """(digest, sha, keep_id, group_size) of the hits among (id, digest, body), by equal bytes of their bodies.

        Texts that share a digest but not their bytes become groups of their own.
        """
        found = key_filter(self.compact().where("n > 1"), "digest")
        groups = passing(texts, "digest", found).groupBy("digest", "body").agg(self._kept("id").alias("keep_id"), F.count("*").alias("group_size"))
        return groups.where("group_size > 1").select("digest", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", largest: bool = False) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the smallest (``largest``: largest) id is kept. Rows that repeat a kept id with an equal text cannot be told
    apart and are all marked kept, and counted in group_size. If all ids of a group are null, keep_id is null
    and its rows are kept. Other columns are not looked at; an empty table gives no rows.
    """
    body = lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body")).withColumn("digest", F.xxhash64("body"))
    index = DigestIndex(largest)
    run = index.flush(texts.select("id", "digest", F.unhex(F.sha2("body", 256)).alias("sha")))
    groups = index.verified(texts)
    rows = join_small(run.alias("r"), groups.alias("g").select(F.col("digest").alias("d"), F.col("sha").alias("s"), "keep_id", "group_size"), (F.col("digest") == F.col("d")) & (F.col("sha") == F.col("s")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

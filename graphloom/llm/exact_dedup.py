"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 gives every document two slots of a filter and keeps, as a bitmap, the slots taken more than once. Pass 2 probes that bitmap:
a document with a slot of its own can have no equal and passes straight through; only the others are shuffled, by the SHA-256 of
their normalised text. The filter grows with the documents up to 128 MB; beyond 67 million documents more of them become candidates, and the
result stays the same. Slots meet as counts that tasks add up before they shuffle, two small numbers a document at most: a bitmap
per task, of which most would be empty, would be larger. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bitmap_filter, filter_bits, maybe_in, slot_columns, without, written

SPACES = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normal, 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal like any others. Of equal texts the smallest id stays (null ids come last);
    of rows with the same id and equal texts exactly one stays. An empty table gives no rows. Other columns are ignored. ``bits`` sets the size of the filter.
    """
    digest = written(digests(docs, id_col, text_col), "digests")
    bits = bits or filter_bits(digest.count())
    slots = digest.select(F.explode(F.array(*slot_columns(F.col("sha"), bits=bits))).alias("slot"))
    shared = written(bitmap_filter(slots.groupBy("slot").count().where("count > 1"), "slot"), "shared-slots")
    probed = maybe_in(digest, [F.col("sha")], shared, "maybe", bits)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first")
    groups = probed.where("maybe").groupBy(F.col("sha").alias("group_sha")).agg(first, F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # Both sides of the last join are plain scans, so adaptive execution can split a large group of copies.
    groups = written(groups, "groups")
    alone = probed.where("NOT maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    candidates = probed.where("maybe").join(groups, F.col("sha") == F.col("group_sha"), "left").select(
        "id", "sha", F.when(F.col("group_sha").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_sha").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
    )
    return alone.unionByName(candidates).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, by :func:`exact_dedup`; all columns stay.

    Ids are expected to be unique; where rows with one id differ in text, a row goes if its own text is a copy.
    """
    verdicts = written(exact_dedup(docs, id_col, text_col), "verdicts")
    given, lone = F.col(id_col).isNotNull(), F.col(id_col).isNull()
    doubled = written(verdicts.where(given).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay")).where("n > 1 AND stay > 0 AND stay < n").select(id_col), "doubled")
    if not doubled.isEmpty():
        return kept_by_text(docs, verdicts, id_col, text_col)
    left = without(docs, written(verdicts.where("NOT kept").select(id_col), "dropped"), id_col)
    if verdicts.where(lone & ~F.col("kept")).isEmpty():
        return left
    return left.where(given).unionByName(kept_by_text(docs.where(lone), verdicts.where(lone), id_col, text_col))


def kept_by_text(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For ids that repeat or are null: rows that are kept by id and text, and one of the rows that agree in both."""
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    keyed = docs.withColumn("__sha", F.sha2(normal, 256))
    stay = verdicts.where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha256"))
    return keyed.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__sha256")), "left_semi").dropDuplicates([id_col, "__sha"]).drop("__sha")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

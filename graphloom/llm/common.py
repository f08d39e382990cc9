"""Helpers that the training-data operators share: table access, written intermediates and bounded bitmap filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import written, written_any  # noqa: F401

#: Most slots of a bitmap filter: 2^30 bits are 128 MB, which bounds what a probe broadcasts, whatever the input. Slots per key below that bound.
FILTER_BITS, SLOTS = 1 << 30, 16

#: Most keys of a table that is broadcast as it is (16 to 64 bytes each).
MAX_KEYS = 1 << 20


def filter_bits(keys: int) -> int:
    """The slots of a filter for a number of keys: at 16 a key and more, under 2 % of other keys pass; beyond 67 million keys more do."""
    return max(1 << 15, min(FILTER_BITS, 1 << max(0, SLOTS * keys - 1).bit_length()))


def worker_cache(name: str, key=None, make=lambda: None):
    """What ``make`` gives, kept by a Python worker for later tasks of one operator only.

    Workers outlive stages, so another operator's cache is dropped first; operators without one of their own call this to free memory.
    """
    import sys

    held = sys.__dict__.setdefault("_graphloom_cache", {})
    if held.get("of") != (name, key):
        had = bool(held)
        held.clear()
        if had:
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
        held.update({"of": (name, key), "value": make()})
    return held["value"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_columns(*keys: Column, bits: int, level: int = 0) -> list[Column]:
    """Two slots of a bitmap filter for a key, from two seeds of a 64-bit hash; filters of other levels have other seeds."""
    return [F.pmod(F.xxhash64(*keys, F.lit(seed + level)), F.lit(bits)) for seed in (17, 92821)]


def bitmap_filter(slots: DataFrame, slot: str) -> DataFrame:
    """Rows (bucket, bits) of the bitmap that has the given slots set; at most bits / 32768 rows of 4 KB."""
    return slots.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def bit_is_set(bits: Column, slot: Column) -> Column:
    """Whether a slot's bit is set in its bucket's bitmap; false where the bucket has no row."""
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def maybe_in(df: DataFrame, keys: list[Column], bitmap: DataFrame, out: str, bits: int, level: int = 0) -> DataFrame:
    """Add boolean ``out``: false only where the key is certainly not in ``bitmap``, which is broadcast (at most bits / 8 bytes)."""
    names = []
    for k, slot in enumerate(slot_columns(*keys, bits=bits, level=level)):
        side = bitmap.select(F.col("bucket").alias(f"__bucket{k}"), F.col("bits").alias(f"__bits{k}"))
        df = df.withColumn(f"__slot{k}", slot)
        df = df.join(F.broadcast(side), F.bitmap_bucket_number(f"__slot{k}") == F.col(f"__bucket{k}"), "left")
        names += [f"__slot{k}", f"__bucket{k}", f"__bits{k}"]
    hit = bit_is_set(F.col("__bits0"), F.col("__slot0")) & bit_is_set(F.col("__bits1"), F.col("__slot1"))
    return df.withColumn(out, hit).drop(*names)


def filter_of(df: DataFrame, keys: list[Column], bits: int, level: int = 0) -> DataFrame:
    """The bitmap filter of all keys of ``df``."""
    return bitmap_filter(df.select(F.explode(F.array(*slot_columns(*keys, bits=bits, level=level))).alias("slot")), "slot")


def has_null_ids(docs: DataFrame, id_col: str) -> bool:
    return not docs.where(F.col(id_col).isNull()).isEmpty()


def keyed(docs: DataFrame, id_col: str, text_col: str, out: str = "__key") -> DataFrame:
    """Add string ``out``, which is never null: the id or, where that is null, the digest of the text."""
    digest = F.concat(F.lit("t"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return docs.withColumn(out, F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), digest))


def cascade(ids: DataFrame, others: DataFrame) -> list[tuple[DataFrame, int]] | None:
    """Filters (bitmap, bits) that tell ``ids`` from ``others``, both with column __id: the first holds the ids, the next the others that pass it, the third
    the ids that pass the second, until none passes. None where a filter is at its bound and no longer thins out."""
    filters, before, held = [], others, ids
    while n := held.count():
        bits, level = filter_bits(n), len(filters)
        filters.append((written(filter_of(held, [F.col("__id")], bits, level), "filter"), bits))
        passing = written(maybe_in(before, [F.col("__id")], filters[-1][0], "__maybe", bits, level).where("__maybe").select("__id"), "passing")
        if bits == FILTER_BITS and 2 * passing.count() > before.count():
            return None
        before, held = held, passing
    return filters


def without(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", max_keys: int = MAX_KEYS) -> DataFrame:
    """``docs`` less the rows whose id is in ``removed``, a written table of ids. Null ids are never removed; see :func:`keyed`.

    Up to ``max_keys`` ids are broadcast themselves. For more, a :func:`cascade` is built from ids alone, and its broadcast bitmaps judge every row exactly, so no text is shuffled.
    Where the bound of the filters stops that (from some 200 million ids on), texts are shuffled for a join.
    """
    ids = written(removed.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct(), "removed")
    if ids.count() <= max_keys:
        return docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id"), "left_anti")
    given = docs.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    filters = cascade(ids, given.join(ids, "__id", "left_anti"))
    if filters is None:
        return docs.join(ids, F.col(id_col) == F.col("__id"), "left_anti")
    rows, gone = docs, F.lit(False)
    for k, (bitmap, bits) in enumerate(filters):
        rows = maybe_in(rows, [F.col(id_col)], bitmap, f"__in{k}", bits, k)
    for k in reversed(range(len(filters))):
        gone = F.col(f"__in{k}") & ~gone
    return rows.where(F.col(id_col).isNull() | ~gone).select(*docs.columns)

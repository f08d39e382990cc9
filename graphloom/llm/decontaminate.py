"""Benchmark decontamination by a set of test n-grams, in DataFrame operations only.

One scan of the documents splits and hashes words and tests every window inside the row against tables of the benchmark's windows: first the hash of its
leading words, then that of the whole window. Only windows that pass both are kept, with their words, and verified by a join with the exact set of benchmark windows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_filter, has_null_ids, keyed, without, written

#: Separators of words: ASCII that is neither a letter, once lower-cased, nor a digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words of a window that the first test looks at; most slots of a table, of a byte each, and slots per window below that; most windows whose set is broadcast.
LEAD, MAX_SLOTS, SLOTS, MAX_BROADCAST = 4, 1 << 24, 16, 1_000_000


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, n, words) of the windows of each item: ``width`` consecutive words, or all of a shorter item."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (width - 1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, width))).alias("words")).select("item", F.size("words").alias("n"), "words")


def window_slot(hashes: Column, at: Column, n: Column, size: int) -> Column:
    """The slot of the ``n`` words from ``at`` on, by their hashes."""
    return F.pmod(F.xxhash64(n, F.slice(hashes, at + 1, n)), F.lit(size)).cast("int")


def taken(slots: DataFrame, size: int) -> Column:
    """A literal with a byte per slot, 1 where it is taken: at most MAX_SLOTS bytes, read from at most ``size`` / 32768 rows of bitmaps."""
    import numpy as np

    rows = bitmap_filter(slots.select((F.col("slot") + 1).cast("long").alias("slot")), "slot").collect()  # bitmaps count from 1
    table = np.zeros(size, np.uint8)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")[: size - 32768 * (r.bucket - 1)]
        table[32768 * (r.bucket - 1) :][: len(bits)] = bits
    return F.lit(bytearray(table.tobytes()))


def is_taken(table: Column, slot: Column) -> Column:
    return F.substring(table, slot + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted ids as strings), spans (start word and length of each occurrence), contaminated.

    A document word inside any occurrence of a benchmark window is hit; a document is contaminated if ``share`` times its hit words reach its words.
    Null and empty texts have no words and are clean; null or empty items have no windows; items with a null id hit words but are
    not listed. Repeated rows are judged each. Without benchmark rows every document is clean.
    """
    windows = written(benchmark_windows(benchmark, width, item_col, text_col), "windows")
    widths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most ``width`` rows
    total = windows.count()
    split = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("words"))
    if not total:
        none = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,n:int>>")
        zero = F.lit(0).cast("long")
        return split.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), none[0].alias("items"), none[1].alias("spans"), F.lit(False).alias("contaminated"))
    size = 1 << 10
    while size < MAX_SLOTS and size < SLOTS * total:
        size *= 2
    leads = sorted({min(n, LEAD) for n in widths})
    hashed = windows.select(F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), "n")
    lead_table = taken(hashed.select(window_slot(F.col("hashes"), F.lit(0), F.least("n", F.lit(LEAD)), size).alias("slot")), size)
    whole_table = taken(hashed.select(window_slot(F.col("hashes"), F.lit(0), F.col("n"), size).alias("slot")), size)
    split = split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))

    def leads_in(at: Column) -> Column:
        slots = F.array(*(window_slot(F.col("hashes"), at, F.lit(k), size) for k in leads))
        return F.exists(slots, lambda s: is_taken(lead_table, s)) if len(leads) > 1 else is_taken(lead_table, slots[0])

    def windows_at(at: Column) -> Column:
        fit = F.filter(F.array(*map(F.lit, widths)), lambda n: (at + n <= F.size("hashes")) & is_taken(whole_table, window_slot(F.col("hashes"), at, n, size)))
        return F.transform(fit, lambda n: F.struct(at.alias("start"), n.alias("n"), F.array_join(F.slice("words", at + 1, n), " ").alias("gram")))

    # sequence() counts down where its end is below its start, so it runs to at least 0
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("hashes") - widths[0])), leads_in)
    scanned = written(split.select("id", "row", F.size("words").cast("long").alias("n_words"), F.flatten(F.transform(at, windows_at)).alias("found")), "scanned")

    known = written(windows.groupBy(F.array_join("words", " ").alias("gram")).agg(F.collect_set(F.col("item").cast("string")).alias("item_set")), "known")
    if total <= MAX_BROADCAST:
        known = F.broadcast(known)
    hits = scanned.select("row", F.explode("found").alias("f")).select("row", "f.start", "f.n", "f.gram").join(known, "gram")
    per_row = hits.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_set")))).alias("items"),
    )
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["start"] + x["n"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(acc["end"], x["start"]))).alias("hit")
    )
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), step, lambda acc: acc["hit"])
    per_row = per_row.select("row", "spans", "items", covered.cast("long").alias("n_hit"))
    full = scanned.select("id", "row", "n_words").join(per_row, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return full.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of :func:`contamination`."""
    return judged.select(id_col, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the contaminated documents; all columns stay. Of rows that share an id, all go if one is contaminated; of rows with a null id, those whose text is."""
    if has_null_ids(docs, id_col):
        return drop_contaminated(keyed(docs, id_col, text_col), benchmark, "__key", text_col).drop("__key")
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("contaminated").select(id_col)
    return without(docs, written(bad, "contaminated"), id_col)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bp),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM dp),
h AS (SELECT rid, item_id, dw.n, i FROM dw JOIN bw USING (gram)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

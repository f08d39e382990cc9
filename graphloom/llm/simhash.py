"""SimHash near-dedup with a hierarchical index in Gray order.

Fingerprints are linked at ``radius`` or fewer differing bits. Two linked fingerprints agree in one of ``radius + 1`` blocks of bits, so each goes to one
group per block value; a group that is too large is split again by blocks of its open bits, which keeps every group bounded and every
link. Inside a group the fingerprints are sorted by Gray rank, which puts like patterns side by side. Runs of neighbours
become leaves of an index, runs of nodes become upper nodes; each node keeps the bits common to all below it that its parent has not
fixed yet. A search carries the differences added up from the root, and drops a node with all below it once they exceed the radius. A node
whose members are already in the searcher's component is dropped as well, so dense groups don't give all their pairs. Each group
returns a link from every member to the smallest of its component; components across groups come from joins of these links.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_null_ids, keyed, without, worker_cache, written
from .components import roots

#: Members of a group that one task links at once; a larger group is split.
MAX_GROUP = 1 << 14

#: Children of an index node; pairs that a search looks at together.
FANOUT, PAIRS = 16, 1 << 20

WORDS_BLOCK = 1 << 20


def word_blocks(data: bytes, size: int = WORDS_BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, in lists from blocks of about ``size`` bytes."""
    import re

    at, space = 0, re.compile(rb"[\x20\x09-\x0D]")
    while len(data) - at > size and (cut := space.search(data, at + size)):
        yield data[at : cut.start()].split()
        at = cut.start()
    yield data[at:].split()


def fingerprint(text: str | None, width: int = 3, size: int = WORDS_BLOCK) -> int:
    """64 bits; a bit is set if it is set in over half of the XXH64 values (seed 42) of the text's shingles. Zero without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    total, counts, tail = 0, np.zeros(64, np.int64), []
    for words in word_blocks((text or "").encode().lower(), size):
        words = tail + words
        tail = words[-(width - 1) :] if width > 1 else []
        shingles = [b" ".join(s) for s in zip(*(words[k:] for k in range(width)))]
        if not shingles:
            tail = words
            continue
        hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(shingles)
    if not total:
        if not tail:
            return 0
        return xxh64_intdigest(b" ".join(tail), 42)
    return sum(1 << k for k in range(64) if 2 * int(counts[k]) > total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        worker_cache("simhash")
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit pattern in Gray order: the number whose Gray code it is."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def link_groups(keys, fps, radius: int, fanout: int = FANOUT, pairs: int = PAIRS):
    """For rows sorted by (key, Gray rank), the number of the first row of each row's component within its key."""
    import numpy as np

    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label
    x = fps.view(np.uint64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    # levels[k]: start row of each node; node j of level k has the children from child[k][j] to child[k][j + 1] of level k - 1
    starts = [np.arange(n)]
    groups = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    child = [None]
    while len(starts[-1]) > len(groups):
        below = starts[-1]
        first = np.searchsorted(below, groups)  # each group's first node of the level below
        inside = np.arange(len(below)) - np.repeat(first, np.diff(np.r_[first, len(below)]))
        heads = np.flatnonzero(inside % fanout == 0)
        child.append(np.r_[heads, len(below)])
        starts.append(below[heads])
    masks, patterns = [np.full(n, ones)], [x]
    for s in starts[1:]:
        some, every = np.bitwise_or.reduceat(x, s), np.bitwise_and.reduceat(x, s)
        masks.append(~(some ^ every))
        patterns.append(every)
    fresh = [None] * len(starts)  # the bits that a node fixes and its parent doesn't
    fresh[-1] = masks[-1]
    for k in range(len(starts) - 1):
        fresh[k] = masks[k] & ~np.repeat(masks[k + 1], np.diff(child[k + 1]))
    sizes = np.diff(np.r_[groups, n])
    root = np.repeat(np.arange(len(groups)), sizes)
    cost = np.cumsum(np.repeat(sizes, sizes))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + pairs)))
        who, node = np.arange(at, end), root[at:end]
        at = end
        bits = np.bitwise_count((x[who] ^ patterns[-1][node]) & fresh[-1][node])
        for k in range(len(starts) - 1, -1, -1):
            low = np.minimum.reduceat(label, starts[k])
            alike = low == np.maximum.reduceat(label, starts[k])
            keep = (bits <= radius) & (starts[k][node] < who) & ~(alike[node] & (low[node] == label[who]))
            who, node, bits = who[keep], node[keep], bits[keep]
            if k == 0 or not len(who):
                break
            width = child[k][node + 1] - child[k][node]
            ends = np.cumsum(width)
            node = np.repeat(child[k][node] - (ends - width), width) + np.arange(ends[-1])
            who = np.repeat(who, width)
            bits = np.repeat(bits, width) + np.bitwise_count((x[who] ^ patterns[k - 1][node]) & fresh[k - 1][node])
        while len(who):  # join the components of linked rows
            a, b = label[who], label[node]
            differ = a != b
            who, node, a, b = who[differ], node[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def linker(radius: int):
    """Partition function over rows (key, fp), sorted by key and Gray rank: links (child, parent)."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def links(keys, fps):
            label = link_groups(keys, fps, radius)
            low = np.full(len(fps), np.iinfo(np.int64).max)
            np.minimum.at(low, label, fps)
            parent = low[label]
            odd = parent != fps
            return pa.RecordBatch.from_arrays([pa.array(fps[odd]), pa.array(parent[odd])], names=["child", "parent"])

        held_keys, held_fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.r_[held_keys, batch.column(0).to_numpy()]
            fps = np.r_[held_fps, batch.column(1).to_numpy()]
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on
            if whole:
                yield links(keys[:whole], fps[:whole])
            held_keys, held_fps = keys[whole:], fps[whole:]
        if len(held_keys):
            yield links(held_keys, held_fps)

    return work


def blocks_of(mask: int, parts: int) -> list[int]:
    """The open bits of a mask in ``parts`` blocks of consecutive bits, each added to the mask."""
    open_bits = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(open_bits) * j // parts for j in range(parts + 1)]
    return list(dict.fromkeys(mask | sum(1 << b for b in open_bits[cuts[j] : cuts[j + 1]]) for j in range(parts)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_links(fps: DataFrame, radius: int, max_group: int) -> DataFrame:
    """Links (child, parent) that connect all fingerprints within ``radius`` of each other. ``fps``: distinct values in column fp."""
    spark = fps.sparkSession
    rank = gray_rank(F.col("fp"))
    level, rows, parts, out = [0], fps.select("fp", F.lit(0).cast("long").alias("mask")), radius + 1, []
    while True:
        finer = {m: blocks_of(m, parts) for m in level}
        table = spark.createDataFrame([(signed(m), signed(b)) for m, bs in finer.items() for b in bs], "mask long, block long")
        rows = rows.join(F.broadcast(table), "mask").select("fp", F.col("block").alias("mask"), F.xxhash64("block", F.col("fp").bitwiseAND(F.col("block"))).alias("key"))
        hot = written(rows.groupBy("key").count().where(F.col("count") > max_group).select("key"), "hot-groups")
        level = list(dict.fromkeys(b for bs in finer.values() for b in bs))
        last = level == [(1 << 64) - 1]  # no open bits are left, so a group is a single fingerprint
        split = not hot.isEmpty() and not last
        small = rows.join(hot, "key", "left_anti") if split else rows
        sorted_rows = small.select("key", "fp", rank.alias("rank")).repartition("key").sortWithinPartitions("key", "rank").select("key", "fp")
        out.append(written(sorted_rows.mapInArrow(linker(radius), "child long, parent long"), "local-links"))
        if not split:
            break
        rows = written(rows.join(hot, "key", "left_semi").select("fp", "mask").distinct(), "hot-rows")
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, max_group: int = MAX_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links, its own included).

    A-Z are lower-cased; words are runs of anything but ASCII white space; texts of fewer than ``width`` words have one shingle, and texts
    without words (null, empty) have fingerprint zero, which links like any other. Repeated rows share a component. A null id
    never names a component of other ids; a component of null ids only has a null one. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "prints")
    # one row per fingerprint; null ids give no smallest id unless they are alone
    fps = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    labels = roots(local_links(fps.select("fp"), radius, max_group))
    rooted = written(fps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component")), "components")
    named = written(rooted.select("fp", "root").join(least, "root").select("fp", "component"), "named")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document, of the smallest id, from each component; all columns stay. Null ids come last, by their texts' digests."""
    if has_null_ids(docs, id_col):
        docs = keyed(docs, id_col, text_col)
        # one order for all: ids, then the keys of rows without one
        ranked = docs.withColumn("__rank", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__key").alias("key")))
        found = near_duplicates(ranked, id_col="__rank", text_col=text_col, **options)
        left = without(docs, written(found.where("__rank.key <> component_id.key").select("__rank.key").withColumnRenamed("key", "__key"), "near-copies"), "__key")
        lone = left.where(F.col(id_col).isNull()).dropDuplicates(["__key"])
        return left.where(F.col(id_col).isNotNull()).unionByName(lone).drop("__key")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    return without(docs, written(found.where(F.col(id_col) != F.col("component_id")).select(id_col), "near-copies"), id_col)

"""Dedup of repeated byte windows by a radix sort of suffixes that goes only as deep as the window.

A byte goes if a window of 50 bytes over it also starts in a document with a smaller id. Suffixes are ordered by their bytes, eight at a time and most significant first, and
only rows that still tie go on to the next eight (:func:`msd`). Ordering every suffix by itself would move 50 bytes per byte of text; so suffixes move in runs:

1. The anchor of a window is the 12-byte string of least hash in it, so equal windows have equal anchors at equal places. Consecutive windows of one anchor are a run, on average 20
   of them, and its bytes are moved once: those from the anchor on, and those before it in reverse. Runs are dealt out by their leading digit, the anchor.
2. In a bucket the runs are sorted from the anchor on, and, where the leading digits tie across documents, once more before it. The lengths of common prefixes of
   neighbours in the two orders tell, for each place of the anchor in a window, which windows are equal byte by byte: all but those of the smallest document are lost.
3. An anchor that stands in very many different runs is split by its next digits: windows with the anchor in their first half share more bytes behind it, the
   others more bytes before it. Half runs are dealt out again by those longer strings, down to whole windows, so no group is gathered that grows with the data.

Equal runs within a task leave only the smallest document's, so a passage of a third of all documents costs a few records per task. What comes
back to a document are places, not text; texts move only for documents that lose bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, filter_of, maybe_in, worker_cache, written, written_any

#: Bytes of a window and of its anchor; text bytes that one bucket, and one task of a shuffle, stand for; most tasks.
WINDOW, ANCHOR, BUCKET_BYTES, TASK_BYTES, MAX_TASKS = 50, 12, 8 << 20, 12 << 20, 100_000

#: Places of an anchor before the end of a window, counted from 0.
PLACES = WINDOW - ANCHOR

#: Bytes of texts that a worker looks at together; runs that it holds before it passes them on.
SEGMENT, HELD = 1 << 19, 200_000

#: Different runs of one anchor among the runs held, above which the anchor is split by its next digits.
SPLIT = 64

#: A byte that no UTF-8 text has; it fills up runs. More bytes than a text has.
FILL, FAR = 255, 1 << 42


def mix(x):
    """A bijection of 64 bits that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def words(rows):
    """The bytes of each row as big-endian words, a column each, so that their order is the order of the bytes."""
    import numpy as np

    n, k = rows.shape
    out = np.full((n, -(-k // 8) * 8), FILL, np.uint8)
    out[:, :k] = rows
    return list(np.ascontiguousarray(out.view(">u8").astype(np.uint64).T))


def msd(digits: list):
    """Sort rows by digits of eight bytes, most significant first; a pass looks only at rows that all passes before left tied.

    Returns the order, and for each row but the first the leading bytes that it shares with the row before it.
    """
    import numpy as np

    steps = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
    order = np.argsort(digits[0])
    first = digits[0][order]
    x = first[1:] ^ first[:-1]
    shared = 7 - np.searchsorted(steps, x, side="right")
    tied = np.flatnonzero(x == 0)  # rows that tie with the next one
    for k, digit in enumerate(digits[1:], 1):
        if not len(tied):
            break
        rows = np.zeros(len(order), bool)
        rows[tied] = rows[tied + 1] = True
        at = np.flatnonzero(rows)
        where = np.cumsum(rows) - 1
        group = np.ones(len(at), np.int64)
        group[where[tied + 1]] = 0
        group = np.cumsum(group)
        own = digit[order[at]]
        by = np.lexsort((own, group))
        order[at], own = order[at][by], own[by]
        x = own[where[tied] + 1] ^ own[where[tied]]
        shared[tied] = 8 * k + 7 - np.searchsorted(steps, x, side="right")
        tied = tied[x == 0]
    shared[tied] = 8 * len(digits)
    return order, shared


def sliding_min(x, span: int):
    """The least of each ``span`` consecutive values."""
    import numpy as np

    k = 1
    while 2 * k <= span:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (span - k)], x[span - k :]) if span > k else x


def runs_in(pieces: list[tuple[int, int, int]], texts: list[bytes]):
    """Runs of the windows that start in the core of a piece: (bytes from the anchor on, bytes before it in reverse, number of the piece, place of the anchor in its text).

    ``pieces`` has (number, offset of the piece in its text, length of the core); ``texts`` are the pieces, which reach a window beyond their cores.
    """
    import numpy as np

    pad = bytes([FILL]) * 64
    raw = np.frombuffer(pad + b"\xff".join(texts) + pad, np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1 + 64
    two = raw.astype(np.uint64)
    two = two[:-1] << np.uint64(8) | two[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    n = len(eight) - 8
    score = mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + four[8 : 8 + n])
    # of equal scores in a window the first place counts, wherever the window lies
    best = sliding_min(score & ~np.uint64((1 << 24) - 1) | np.arange(n, dtype=np.uint64), PLACES + 1)
    edges = np.zeros(len(raw) + 1, np.int32)
    cores = np.minimum(np.array([c for *_, c in pieces]), lengths - WINDOW + 1)
    some = cores > 0
    edges[starts[some]] += 1
    np.add.at(edges, starts[some] + cores[some], -1)
    at = np.flatnonzero(np.cumsum(edges)[: len(best)])
    anchor = (best[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
    head = np.ones(len(at), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    tail = np.ones(len(at), bool)
    tail[:-1] = head[1:]
    low, high, place = at[head], at[tail], anchor[head]
    right = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[place]
    left = np.lib.stride_tricks.sliding_window_view(raw, PLACES)[place - PLACES][:, ::-1]
    right[np.arange(WINDOW) >= (high + WINDOW - place)[:, None]] = FILL
    left = np.where(np.arange(PLACES) >= (place - low)[:, None], np.uint8(FILL), left)
    own = np.searchsorted(starts, place, side="right") - 1
    offsets = np.array([o for _, o, _ in pieces], np.int64)
    return right, left, own, place - starts[own] + offsets[own]


def segments(texts, size: int) -> Iterator[tuple[list, list]]:
    """Pieces and their texts, of about ``size`` bytes together; long texts come in parts."""
    pieces, held, total = [], [], 0
    for k, t in enumerate(texts):
        if t is None or len(t) < WINDOW:
            continue
        for low in range(0, len(t) - WINDOW + 1, size):
            part = t[low : low + size + WINDOW - 1]
            pieces.append((k, low, size))
            held.append(part)
            total += len(part)
            if total >= size:
                yield pieces, held
                pieces, held, total = [], [], 0
    if held:
        yield pieces, held


#: Columns of runs: both byte matrices, the document, a number that tells rows of one id apart, and the first and last of the anchor's places at most a window apart.
RIGHT, LEFT, DOC, SUB, FIRST, LAST = range(6)


def picked(runs: tuple, which) -> tuple:
    return tuple(c[which] for c in runs)


def joined(parts: list[tuple]) -> tuple:
    import numpy as np

    return tuple(np.concatenate(c) for c in zip(*parts))


def taken(parts: list[tuple]) -> tuple:
    """The parts joined; the list is emptied, so that they are not held twice."""
    runs = joined(parts)
    parts.clear()
    return runs


def extent(runs: tuple):
    """Bytes of each run from the anchor on, and before it."""
    return (runs[RIGHT] != FILL).sum(1, dtype="int64"), (runs[LEFT] != FILL).sum(1, dtype="int64")


def settled(runs: tuple, close: bool):
    """(what is lost, what stays in order, shared bytes): of equal runs those of the smallest document stay.

    What is lost has (document, sub, from, to). With ``close``, places of one document that are at most a window apart become one.
    """
    import numpy as np

    order, shared = msd(words(runs[RIGHT]) + words(runs[LEFT]))
    runs = picked(runs, order)
    head = np.ones(len(order), bool)
    head[1:] = shared < 8 * (-(-WINDOW // 8) + -(-PLACES // 8))
    group = np.cumsum(head) - 1
    least = np.minimum.reduceat(runs[DOC], np.flatnonzero(head))[group] if len(order) else runs[DOC]
    lost = runs[DOC] > least
    behind, before = extent(picked(runs, lost))
    gone = runs[DOC][lost], runs[SUB][lost], runs[FIRST][lost] - before, runs[LAST][lost] + behind
    runs, group = picked(runs, ~lost), group[~lost]
    if close and len(group):
        by = np.lexsort((runs[FIRST], runs[SUB], group))
        runs, group = picked(runs, by), group[by]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (runs[SUB][1:] != runs[SUB][:-1])
        base = np.cumsum(new) * FAR
        reach = np.maximum.accumulate(base + runs[LAST])
        new[1:] |= (base + runs[FIRST])[1:] - reach[:-1] > WINDOW
        last = (reach - base)[np.r_[np.flatnonzero(new)[1:], len(new)] - 1]
        runs, group = picked(runs, new), group[new]
        runs = (*runs[:LAST], last)
    return gone, runs, group


class Node:
    """A range of places of the anchor in a window, and the string that all such windows share; the first node has all places and shares the anchor."""

    def __init__(self, low: int, high: int, depth: int, number: int):
        self.low, self.high, self.depth, self.number = low, high, depth, number

    def parts(self) -> list[Node]:
        middle = (self.low + self.high) // 2
        return [Node(self.low, middle, self.depth + 1, 2 * self.number + 1), Node(middle + 1, self.high, self.depth + 1, 2 * self.number + 2)]

    @staticmethod
    def of(number: int) -> Node:
        path, node = [], Node(0, PLACES, 0, 0)
        while number:
            path.append(number)
            number = (number - 1) // 2
        for n in reversed(path):
            node = node.parts()[(n - 1) % 2]
        return node

    def key(self, runs: tuple):
        """A hash of the shared string of each run."""
        import numpy as np

        rng = np.random.Generator(np.random.PCG64(self.number))
        out = np.zeros(len(runs[DOC]), np.uint64)
        for side, k in ((RIGHT, WINDOW - self.high), (LEFT, self.low)):
            for digit in words(runs[side][:, :k]) if k else ():
                out = mix(out + digit * rng.integers(1, 1 << 63, 1, np.uint64) * np.uint64(2))
        return out

    def cut(self, runs: tuple) -> tuple:
        """The parts of runs that are windows of this node."""
        import numpy as np

        behind, before = extent(runs)
        low, high = np.maximum(WINDOW - behind, self.low), np.minimum(before, self.high)
        some = low <= high
        runs, low, high = picked(runs, some), low[some], high[some]
        right = np.where(np.arange(WINDOW) >= (WINDOW - low)[:, None], np.uint8(FILL), runs[RIGHT])
        left = np.where(np.arange(PLACES) >= high[:, None], np.uint8(FILL), runs[LEFT])
        return (right, left, *runs[DOC:])


def packed(runs: tuple) -> bytes:
    import numpy as np
    import pyarrow as pa

    by = np.lexsort((runs[FIRST], runs[DOC]))
    right, left, doc, sub, first, last = picked(runs, by)
    steps = np.diff(doc, prepend=np.int64(0)), np.diff(first, prepend=np.int64(0)), last - first
    # eight bytes of a number lie apart, as most of them are zeros
    numbers = b"".join(np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes() for x in steps)
    data = right.tobytes() + left.tobytes() + sub.astype("<i4").tobytes() + numbers
    return len(doc).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def unpacked(blob: bytes) -> tuple:
    import numpy as np
    import pyarrow as pa

    n, width = int.from_bytes(blob[:4], "little"), WINDOW + PLACES
    data = np.frombuffer(pa.Codec("zstd", 3).decompress(blob[4:], n * (width + 28), asbytes=True), np.uint8)
    right, left = data[: n * WINDOW].reshape(n, WINDOW), data[n * WINDOW : n * width].reshape(n, PLACES)
    sub = data[n * width : n * (width + 4)].view("<i4")
    doc, first, last = (np.ascontiguousarray(data[n * (width + 4 + 8 * k) :][: 8 * n].reshape(8, n).T).view("<i8")[:, 0] for k in range(3))
    first = np.cumsum(first)
    return right, left, np.cumsum(doc), sub, first, first + last


RECORDS = "node int, bucket int, kind int, doc long, sub int, data binary"

#: Kinds of rows: packed runs of a node's bucket; runs that say that their shared string is split; parts of documents that are lost.
SPLIT_UP, PACKED, LOST = 0, 1, 2


def lost_rows(doc, sub, low, high) -> Iterator[tuple]:
    """Rows with the lost parts of each document, merged."""
    import numpy as np

    if not len(doc):
        return
    by = np.lexsort((low, sub, doc))
    doc, sub, low, high = doc[by], sub[by], low[by], high[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])
    base = np.cumsum(new) * FAR
    reach = np.maximum.accumulate(base + high)
    head = new.copy()
    head[1:] |= (base + low)[1:] > reach[:-1]
    at = np.flatnonzero(head)
    spans = np.stack([low[at], reach[np.r_[at[1:], len(doc)] - 1] - base[at]], 1)
    cuts = np.flatnonzero(new[at])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
        yield -1, -1, LOST, int(doc[at[a]]), int(sub[at[a]]), spans[a:b].tobytes()


def as_batches(rows: Iterator[tuple], size: int = 16 << 20) -> Iterator:
    import pyarrow as pa

    kinds = [("node", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("sub", pa.int32()), ("data", pa.binary())]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), kinds)], names=[n for n, _ in kinds])

    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 60 + len(row[-1])
        if total >= size:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def dealt(node: Node, runs: tuple, key, bits: int) -> Iterator[tuple]:
    """Packed rows of a node's runs by bucket."""
    import numpy as np

    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0]) if len(by) else np.empty(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
        yield node.number, int(bucket[by[a]]), PACKED, None, None, packed(picked(runs, by[a:b]))


def flushed(node: Node, runs: tuple, bits: int, split: int) -> Iterator[tuple]:
    """What a task passes on of the runs of a node: lost parts, runs by bucket, and, of strings with more than ``split`` different runs, half runs of the nodes below."""
    import numpy as np

    gone, runs, group = settled(runs, True)
    yield from lost_rows(*gone)
    key, below = node.key(runs), None
    if node.low < node.high and (hot := crowded(key, group, split)).any():
        mark = np.unique(key[hot])
        bucket = (mark >> np.uint64(64 - bits)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            yield node.number, b, SPLIT_UP, None, None, mark[bucket == b].tobytes()
        below, runs, key = picked(runs, hot), picked(runs, ~hot), key[~hot]
    yield from dealt(node, runs, key, bits)
    if below is not None:
        del gone, runs, group, key, hot, mark, bucket  # only what goes on is held
        for part in node.parts():
            yield from flushed(part, part.cut(below), bits, split)


def crowded(key, group, split: int):
    """Whether each run's key has more than ``split`` different runs, by their groups."""
    import numpy as np

    by = np.lexsort((group, key))
    k, g = key[by], group[by]
    head = np.ones(len(by), bool)
    head[1:] = k[1:] != k[:-1]
    fresh = head.copy()
    fresh[1:] |= g[1:] != g[:-1]
    number = np.cumsum(head) - 1
    hot = np.zeros(len(by), bool)
    hot[by] = (np.bincount(number, fresh) > split)[number] if len(by) else False
    return hot


def run_pass(bits: int):
    """Over (id, sub, bytes): the runs of all windows."""
    split, most, segment = SPLIT, HELD, SEGMENT

    def work(batches: Iterator) -> Iterator:
        import numpy as np

        worker_cache("suffixes")

        def rows():
            parts, size, root = [], 0, Node.of(0)
            for batch in batches:
                ids, subs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                texts = (x.as_buffer().to_pybytes() if i is not None and x.is_valid else None for i, x in zip(ids, batch.column(2)))
                for pieces, held in segments(texts, segment):
                    right, left, own, place = runs_in(pieces, held)
                    doc = np.array([ids[k] for k, *_ in pieces], np.int64)[own]
                    sub = np.array([subs[k] for k, *_ in pieces], np.int32)[own]
                    parts.append((right, left, doc, sub, place, place))
                    size += len(own)
                    if size >= most:
                        yield from flushed(root, taken(parts), bits, split)
                        size = 0
            if parts:
                yield from flushed(root, taken(parts), bits, split)

        yield from as_batches(rows())

    return work


def least_per_window(runs: tuple, node: Node) -> Iterator[tuple]:
    """What documents lose among runs, window by window: for each place of the anchor, windows are equal if they share the bytes behind and before it."""
    import numpy as np

    order, behind_shared = msd(words(runs[RIGHT]))
    runs = picked(runs, order)
    n = len(order)
    by_left, before_shared = msd(words(runs[LEFT]))
    behind, before = extent(runs)
    for place in range(node.low, node.high + 1):
        use = np.flatnonzero((WINDOW - behind <= place) & (place <= before))
        if len(use) < 2:
            continue
        right = np.r_[0, np.cumsum(behind_shared < WINDOW - place)]
        left = np.empty(n, np.int64)
        left[by_left] = np.r_[0, np.cumsum(before_shared < place)]
        key = (right * n + left)[use]
        by = np.argsort(key, kind="stable")
        key, at = key[by], use[by]
        head = np.r_[True, key[1:] != key[:-1]]
        least = np.minimum.reduceat(runs[DOC][at], np.flatnonzero(head))[np.cumsum(head) - 1]
        at = at[runs[DOC][at] > least]
        if len(at):
            yield runs[DOC][at], runs[SUB][at], runs[FIRST][at] - place, runs[LAST][at] - place + WINDOW


def solved(node: Node, runs: tuple, marks, bits: int) -> Iterator[tuple]:
    """What documents lose among a bucket's runs of a node, and half runs of the strings that are split."""
    import numpy as np

    gone, runs, _ = settled(runs, False)
    yield from lost_rows(*gone)
    key = node.key(runs)
    if len(marks):
        hot = np.isin(key, marks)
        for part in node.parts() if hot.any() else ():
            own = part.cut(picked(runs, hot))
            yield from dealt(part, own, part.key(own), bits)
        runs, key = picked(runs, ~hot), key[~hot]
    if not len(key):
        return
    # strings of one document end here
    by = np.argsort(key, kind="stable")
    runs, key = picked(runs, by), key[by]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[cuts, len(key)])
    mixed = np.minimum.reduceat(runs[DOC], cuts) != np.maximum.reduceat(runs[DOC], cuts)
    group = np.repeat(np.arange(len(cuts), dtype=np.uint64), sizes)
    open_ = np.repeat(mixed, sizes)
    runs, group = picked(runs, open_), group[open_]
    if not len(group):
        return
    # so do runs that share fewer bytes, on both sides together, than a window has
    most = []
    for side, k in ((RIGHT, WINDOW), (LEFT, PLACES)):
        order, shared = msd([group, *words(runs[side])])
        shared = np.minimum(np.maximum(shared - 8, 0), k)
        best = np.empty(len(order), np.int64)
        best[order] = np.maximum(np.r_[shared, 0], np.r_[0, shared])
        most.append(best)
    lost = list(least_per_window(picked(runs, most[0] + most[1] >= WINDOW), node))
    if lost:
        yield from lost_rows(*joined(lost))


def bucket_pass(bits: int, depth: int):
    """Over rows of RECORDS, sorted by node and bucket: what documents lose, and rows of deeper nodes."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np

        worker_cache("suffixes")

        def rows():
            at, parts, marks = None, [], []

            def close():
                if parts:
                    yield from solved(Node.of(at[0]), taken(parts), np.concatenate([np.empty(0, np.uint64), *marks]), bits)
                marks.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    number, bucket, kind, _, _, data = row
                    if kind == LOST or Node.of(number).depth > depth:
                        yield row
                        continue
                    if (number, bucket) != at:
                        yield from close()
                        at = number, bucket
                    if kind == SPLIT_UP:
                        marks.append(np.frombuffer(data, np.uint64))
                    else:
                        parts.append(unpacked(data))
            yield from close()

        yield from as_batches(rows())

    return work


def cut_pass(batches: Iterator) -> Iterator:
    """Over (id, sub, bytes, lists of lost parts): id, sub, bytes and runs removed, digest of what stays, what stays."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    worker_cache("suffixes")
    for batch in batches:
        out = []
        for i, sub, text, parts in zip(*(batch.column(k) for k in range(4))):
            text = text.as_buffer().to_pybytes()
            spans = np.frombuffer(b"".join(parts.as_py()), np.int64).reshape(-1, 2)
            steps = np.zeros(len(text) + 1, np.int32)
            np.add.at(steps, spans[:, 0], 1)
            np.add.at(steps, spans[:, 1], -1)
            gone = np.cumsum(steps[:-1]) > 0
            n_spans = int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((i.as_py(), sub.as_py(), int(gone.sum()), n_spans, hashlib.sha256(rest).digest(), rest))
        columns = list(zip(*out)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc", "sub", "removed", "spans", "kept", "rest"])


def lost_parts(texts: DataFrame, bits: int, tasks: int) -> DataFrame:
    """Rows (doc, sub, data) of the parts that documents lose: passes over buckets, one in all unless strings are split."""
    kind, out, depth, more = F.col("kind"), None, 0, True
    rows = texts.mapInArrow(run_pass(bits), RECORDS)
    while more:
        # lost parts pass through, spread evenly; the rest meets by node and bucket, with as many buckets of a node in each task, as they are even
        spread = lambda *of: F.pmod(F.xxhash64(*of), F.lit(tasks))
        where = F.when(kind == LOST, spread("doc", "data")).otherwise(spread("node") + F.col("bucket"))
        dealt_out = rows.withColumn("at", F.pmod(where, F.lit(tasks)).cast("int")).repartitionById(tasks, "at").sortWithinPartitions("node", "bucket", "kind").drop("at")
        done, more = written_any(dealt_out.mapInArrow(bucket_pass(bits, depth), RECORDS), "runs", kind != LOST)
        lost = done.where(kind == LOST).select("doc", "sub", "data")
        out = lost if out is None else out.unionByName(lost)
        rows, depth = done.where(kind != LOST), depth + 1
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summary, cuts): id, sub, n_bytes, sha of every row; and, for documents that lose bytes, doc, sub, removed, spans, kept, rest.

    Ids are integers. Null texts count as empty. Rows with a null id lose nothing and take nothing from others; rows that share an id take nothing from
    each other. ``sub`` tells rows of one id apart by their texts; it is zero where ids are unique.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), data.alias("data"))
    summary = written(texts.select("id", F.octet_length("data").cast("long").alias("n_bytes"), (F.crc32("data") - (1 << 31)).cast("int").alias("crc"), F.unhex(F.sha2("data", 256)).alias("sha")), "summary")
    total = summary.agg(F.sum("n_bytes")).first()[0] or 0
    given = summary.where("id IS NOT NULL")
    repeated = not given.groupBy("id").count().where("count > 1").isEmpty()
    sub = ((F.crc32("data") - (1 << 31)) if repeated else F.lit(0)).cast("int").alias("sub")
    summary = summary.withColumn("sub", F.col("crc") if repeated else F.lit(0)).drop("crc")
    bits = max(8, min(24, (total // BUCKET_BYTES).bit_length()))
    tasks = min(MAX_TASKS, max(8, total // TASK_BYTES))
    texts = texts.select("id", sub, "data")
    parts = lost_parts(texts, bits, tasks).withColumnRenamed("doc", "id").repartition(tasks, "id", "sub")
    # a list no longer than the document has places for
    lost = written(parts.groupBy("id", "sub").agg(F.collect_list("data").alias("parts")), "lost")
    rows = those(texts, lost).repartition(tasks, "id", "sub").join(lost.repartition(tasks, "id", "sub"), ["id", "sub"])
    cuts = rows.select("id", "sub", "data", "parts").mapInArrow(cut_pass, "doc long, sub int, removed long, spans long, kept binary, rest binary")
    return summary, cuts


def those(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts whose id may be among the keys, a written table, by a filter of bounded size; so few others shuffle for the exact join."""
    bits = filter_bits(keys.count())
    bitmap = written(filter_of(keys, [F.col("id")], bits), "id-filter")
    return maybe_in(texts, [F.col("id")], bitmap, "__maybe", bits).where("__maybe").drop("__maybe")


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, as :func:`removals` defines them; an empty table gives no rows."""
    summary, cuts = removals(docs, id_col, text_col)
    cuts = cuts.select("doc", F.col("sub").alias("own"), "removed", "spans", "kept").dropDuplicates(["doc", "own"])
    joined = summary.join(cuts, (F.col("id") == F.col("doc")) & (F.col("sub") == F.col("own")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"))

"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics of each text (shares of kinds of bytes, word and line shapes, repetition) are standardised and mapped by random cosine features, whose inner
products approximate a Gaussian kernel. Partitions sum their parts of the normal equations; the driver adds a few such sums, solves for the
weights, and fits a monotone map from raw scores to label frequencies on rows kept apart. Only labels of rows outside the
held-out fold are used, at most ``MAX_TRAIN`` of them in expectation (a sample by hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_cache, written

#: Labelled rows that a model is fitted on, tasks that sum normal equations, random features, and the ridge added per training row.
MAX_TRAIN, SUMS, FEATURES, RIDGE = 200_000, 16, 256, 1e-4

#: A document is predicted to be of quality at this score.
THRESHOLD = 0.7

#: Bins of raw scores for calibration: between -0.5 and 1.5.
BINS = 2000

#: Characters of a text above which its statistics are added up in blocks of that size.
LONG = 1 << 18


def byte_kinds():
    """A row of membership per kind of byte: lower, upper, digit, space, newline, sentence marks, brackets and quotes, signs, beyond ASCII, control."""
    import numpy as np

    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:", b"!?", b"\"'()[]{}", b"#$%&*+=<>@^_`~|\\/-", bytes(range(128, 256)), bytes([*range(9), 11, 12, *range(14, 32), 127])]
    out = np.zeros((len(kinds), 256))
    for row, kind in enumerate(kinds):
        out[row, list(kind)] = 1
    return out


N_STATS = 11 + 17


def statistics(text: str, kinds) -> list[float]:
    """The statistics of one text, all finite; those of an empty text are zeros."""
    import math
    from collections import Counter

    import numpy as np

    if len(text) > LONG:
        return long_statistics(text, kinds)
    data = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return [0.0] * N_STATS
    shares = (kinds @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)) / len(data)
    n, counts = len(words), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    top = counts.most_common(1)[0][1]
    pairs = Counter(zip(words, words[1:]))
    same = sum(c for (a, b), c in pairs.items() if a == b)
    lines = [x for x in text.split("\n") if x.strip()]
    return [*shares.tolist(), *word_shape(n, counts, float(lengths.mean()), float(lengths.std()), int(lengths.max()), top, same, len(pairs), len(lines), len(set(lines)))]


def word_shape(n: int, counts: dict, mean: float, spread: float, longest: int, top: int, same: int, pairs: int, lines: int, distinct_lines: int) -> list[float]:
    """The statistics of ``n`` words, ``counts`` of each form; ``pairs`` are distinct neighbours, ``same`` neighbours that are equal."""
    import math

    forms = counts.items()
    ends = sum(c for w, c in forms if not w[-1].isalnum())
    odd_ends = sum(c for w, c in forms if not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'")
    upper = sum(c for w, c in forms if len(w) > 1 and w.isupper())
    title = sum(c for w, c in forms if w[0].isupper())
    bare = sum(c for w, c in forms if not any(map(str.isalnum, w)))
    doubled = sum(c for w, c in forms if len(w) > 2 and w[-1] == w[-2] == "!" or len(w) > 3 and w[-3:] == w[-1] * 3 and not w[-1].isalnum())
    return [
        math.log1p(n), mean, spread, math.log1p(longest),
        len(counts) / n, len(counts) / math.sqrt(n), top / n, same / n, max(1, pairs) / max(1, n - 1),
        ends / n, odd_ends / n, upper / n, title / n, bare / n, doubled / n,
        math.log1p(n / max(1, lines)), distinct_lines / max(1, lines),
    ]


def blocks(text: str, pattern: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters, each of which ends before a match of ``pattern``."""
    import re

    at, find = 0, re.compile(pattern).search
    while len(text) - at > size and (cut := find(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def long_statistics(text: str, kinds) -> list[float]:
    """What :func:`statistics` gives, from blocks: the memory is the distinct words, and 8 bytes per distinct pair of them and per distinct line."""
    import numpy as np

    counts, number, sizes = {}, {}, {}
    raw, total = np.zeros(256, np.int64), 0
    pairs, last, same = np.empty(0, np.uint64), None, 0
    for block in blocks(text, r"\s", LONG):
        data = block.encode("utf-8", "replace")
        raw += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        total += len(data)
        words = block.split()
        if not words:
            continue
        for w in words:
            counts[w] = counts.get(w, 0) + 1
            sizes[len(w)] = sizes.get(len(w), 0) + 1
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
        ids = ids if last is None else np.concatenate([[last], ids])
        last = ids[-1]
        same += int((ids[1:] == ids[:-1]).sum())
        pairs = np.union1d(pairs, ids[:-1] << np.uint64(32) | ids[1:])
    if not counts:
        return [0.0] * N_STATS
    n, length = sum(sizes.values()), np.array(list(sizes), np.float64)
    often = np.array(list(sizes.values()), np.float64)
    mean = float((length * often).sum() / n)
    spread = float(np.sqrt((often * (length - mean) ** 2).sum() / n))
    lines, seen = 0, np.empty(0, np.int64)
    for block in blocks(text, "\n", LONG):
        own = [hash(x) for x in block.removeprefix("\n").split("\n") if x.strip()]
        lines += len(own)
        seen = np.union1d(seen, np.array(own, np.int64))
    return [*((kinds @ raw) / total).tolist(), *word_shape(n, counts, mean, spread, max(sizes), max(counts.values()), same, len(pairs), lines, len(seen))]


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, stats) with all columns of ``docs`` but the text left behind; null texts count as empty."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = worker_cache("quality", "kinds", byte_kinds)
        for batch in batches:
            rows = [statistics(t.as_py() or "", kinds) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, stats array<float>")


def held_out(id_column: Column) -> Column:
    """Whether the id belongs to the held-out fold; false for a null id, which no label can join."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Means, scales, random projection, weights and calibration. Without labels of both kinds it has a constant score."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def basis(self, stats):
        """Random Fourier features of standardised statistics, with these themselves and a constant."""
        import numpy as np

        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / FEATURES), z / np.sqrt(N_STATS), np.ones((len(z), 1))])

    def raw(self, stats):
        return self.basis(stats) @ self.weights

    def score(self, stats):
        import numpy as np

        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def matrix(column):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


def summed(train: DataFrame, part) -> list:
    """The sum over at most SUMS tasks of ``part(stats, labels)``, a flat array."""
    import numpy as np

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(matrix(batch.column(0)), batch.column(1).to_numpy().astype(np.float64))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = train.select("stats", "label").coalesce(SUMS).mapInArrow(work, "part binary").collect()
    return sum((np.frombuffer(bytes(r.part)) for r in parts), np.zeros(1))


def isotonic(weights, sums):
    """Pool adjacent violators: the monotone means of bins with the given weights and label sums."""
    blocks: list[list[float]] = []
    for k, (w, s) in enumerate(zip(weights, sums)):
        if w:
            blocks.append([w, s, w * k])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [(at / w, s / w) for w, s, at in blocks]


def chosen(labels: DataFrame, label_col: str = "quality", label_id: str = "doc_id", max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows (label_id, label) outside the held-out fold that a model learns from, a written table of at most ``max_train`` rows in expectation.

    Labels of a repeated id are averaged; null ones are left out.
    """
    usable = F.col(label_id).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(label_id))
    known = written(labels.where(usable).groupBy(F.col(label_id).alias("label_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label")), "labels")
    share = min(1.0, max_train / max(1, known.count()))
    return written(known.where(F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))), "chosen")


def fit(stats: DataFrame, known: DataFrame) -> Model:
    """A model from ``stats`` (id, stats) and the labels of :func:`chosen`, which are bounded and broadcast."""
    import numpy as np

    joined = stats.join(F.broadcast(known), F.col("id") == F.col("label_id"))
    train = written(joined.select("stats", "label", (F.pmod(F.xxhash64("id", F.lit(12)), F.lit(5)) == 0).alias("aside")), "train")
    low, high, n = train.agg(F.min("label"), F.max("label"), F.count(F.lit(1))).first()
    if not n:
        return Model(1.0)  # nothing says what is bad
    if low == high:
        return Model(float(low))
    model = Model()
    moments = summed(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    model.mean = moments[1 : N_STATS + 1] / moments[0]
    model.scale = np.sqrt(np.maximum(moments[N_STATS + 1 :] / moments[0] - model.mean**2, 1e-8)) + 1e-4
    rng = np.random.Generator(np.random.PCG64(4))
    model.directions = rng.standard_normal((N_STATS, FEATURES)) / np.sqrt(N_STATS)
    model.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def normal(x, y):
        b = np.hstack([model.basis(x), y[:, None]])
        return (b.T @ b).ravel()

    fitted = train.where("NOT aside")
    gram = summed(fitted, normal)
    size = FEATURES + N_STATS + 2
    if gram.size != size * size:
        return Model(float(train.agg(F.avg("label")).first()[0]))
    gram = gram.reshape(size, size)
    a, b = gram[:-1, :-1], gram[:-1, -1]
    count = gram[-2, -2]
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, count) * np.eye(size - 1), b)

    def binned(x, y):
        at = np.clip(((model.raw(x) + 0.5) * BINS / 2).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    counts = summed(train.where("aside"), binned)
    if counts.size != 2 * BINS:  # too few rows to set some apart
        counts = summed(train, binned)
    curve = isotonic(counts[:BINS], counts[BINS:])
    # a slight slope keeps the order of raw scores within a flat part of the curve
    ends = [(0.0, curve[0][1]), *curve, (float(BINS - 1), curve[-1][1])]
    model.knots = np.array([2 * (k + 0.5) / BINS - 0.5 for k, _ in ends])
    model.values = np.clip(np.array([v for _, v in ends]), 0, 1) * 0.998 + 0.002 * (model.knots + 0.5) / 2
    return model


def scored(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, held_out, score, predicted) of written ``stats``."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))), pa.float64())], names=["id", "score"])

    kind = stats.schema["id"].dataType.simpleString()
    found = stats.mapInArrow(work, f"id {kind}, score double")
    return found.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (score at least ``threshold``).

    Null texts count as empty; these get a score like any others. Without usable labels every score is 1, and with labels of one
    kind it is that label. Repeated rows are scored each. An empty table gives no rows.
    """
    stats = written(features(docs, id_col, text_col), "stats")
    return scored(stats, fit(stats, chosen(labels, **options)), threshold).withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` that score at least ``threshold``; all columns stay, and no text is shuffled. Statistics are made once for the labelled documents, to learn, and once for all."""
    known = chosen(labels, **options)
    labelled = docs.join(F.broadcast(known.select("label_id")), F.col(id_col) == F.col("label_id"), "left_semi")
    model = fit(features(labelled, id_col, text_col), known)
    schema, place = docs.schema, docs.columns.index(text_col)

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = worker_cache("quality", "kinds", byte_kinds)
        for batch in batches:
            rows = np.array([statistics(t.as_py() or "", kinds) for t in batch.column(place)], np.float32).reshape(-1, N_STATS)
            yield batch.filter(pa.array(model.score(rows.astype(np.float64)) >= threshold))

    return docs.mapInArrow(work, schema)

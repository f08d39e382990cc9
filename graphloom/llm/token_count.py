"""Token counts by byte-pair merging with a heap and a linked list, without making any token ids.

A text falls into pieces by the tokenizer's own pattern. A piece starts as its bytes; the adjacent pair of lowest rank is popped from a heap
and merged until none is left, and its count is the initial symbols less the merges. Counts of pieces are remembered in a
bounded table, since natural text repeats its words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import worker_cache

#: The pieces of a byte-level tokenizer's text (a fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Remembered pieces per worker, and characters of a text that are cut into pieces at a time.
MEMO, CHUNK = 300_000, 1 << 20

#: Bytes of a piece from which its lists are compact arrays.
LONG = 1 << 14


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairMerger:
    """Merge ranks of a byte-level vocabulary, and counts by them."""

    def __init__(self, spec: str):
        """``spec``: the text of a tokenizer's .json file. Any but plain byte-level pieces, without a normalizer, is refused."""
        model = json.loads(spec)
        before = model.get("pre_tokenizer") or {}
        if model.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["model"].get("ignore_merges"):
            raise ValueError("only byte-level tokenizers that cut texts by their usual pattern can be counted")
        if any(t.get(k) for t in model["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("special tokens that take in what is around them can't be counted")
        # of special strings that begin at one place the longest is meant
        self.specials = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.first = [vocab[c] for c in byte_symbols()]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes less the merges."""
        from heapq import heapify, heappop, heappush

        n, pairs = len(piece), self.pairs
        if n < 2:
            return n
        if n >= LONG:
            return self.merged_long(piece)
        symbols = [self.first[b] for b in piece]
        heap = [(rank[0], i) for i in range(n - 1) if (rank := pairs.get(symbols[i] << 20 | symbols[i + 1]))]
        heapify(heap)
        after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] < 0:
                continue
            now = pairs.get(symbols[i] << 20 | symbols[j])
            if now is None or now[0] != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = now[1], -1
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := pairs.get(now[1] << 20 | symbols[k]):
                    heappush(heap, (found[0], i))
            if (h := before[i]) >= 0 and (found := pairs.get(symbols[h] << 20 | now[1])):
                heappush(heap, (found[0], h))
        return n - merges

    def merged_long(self, piece: bytes) -> int:
        """The same for a long piece, in compact arrays: 12 bytes per byte of it for symbols and links, 8 for the sorted pairs it starts with (24 while these are
        sorted), and some 40 per new pair that waits in the heap, of which there is at most one for two bytes."""
        from array import array
        from heapq import heappop, heappush

        import numpy as np

        n, pairs = len(piece), self.pairs
        raw = np.frombuffer(piece, np.uint8)
        ranks = np.full(1 << 16, -1, np.int64)
        for a in range(256):
            for b in range(256):
                if found := pairs.get(self.first[a] << 20 | self.first[b]):
                    ranks[a << 8 | b] = found[0]
        start = ranks[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        start = start[start >= 0] << 32 | np.flatnonzero(start >= 0)
        start.sort()
        symbols = array("i", np.array(self.first, np.int32)[raw].tobytes())
        after, before = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        after[n - 1] = -1
        heap: list[int] = []
        at, block, merges = 0, [], 0  # ``block`` has the next starting pairs, the least last
        while True:
            if not block and at < len(start):
                block = start[at : at + 65536].tolist()[::-1]
                at += 65536
            if block and (not heap or block[-1] < heap[0]):
                entry = block.pop()
            elif heap:
                entry = heappop(heap)
            else:
                return n - merges
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or symbols[i] < 0:
                continue
            now = pairs.get(symbols[i] << 20 | symbols[j])
            if now is None or now[0] != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = now[1], -1
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := pairs.get(now[1] << 20 | symbols[k]):
                    heappush(heap, found[0] << 32 | i)
            if (h := before[i]) >= 0 and (found := pairs.get(symbols[h] << 20 | now[1])):
                heappush(heap, found[0] << 32 | h)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only before a single space or line feed between other characters: there a piece always begins."""
    import re

    at, inside = 0, re.compile(r"(?<=\S)[ \n](?=\S)")
    while len(text) - at > size and (cut := inside.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Counter:
    """Counts tokens of texts, remembering pieces."""

    def __init__(self, merger: PairMerger):
        import regex

        merge = merger.merged

        class Memo(dict):
            def __missing__(self, piece: str) -> int:
                n = merge(piece.encode())
                if len(self) >= MEMO:
                    self.clear()
                self[piece] = n
                return n

        self.memo, self.find = Memo(), regex.compile(PIECES).findall
        self.special = regex.compile("|".join(map(regex.escape, merger.specials))) if merger.specials else None

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        count = self.memo.__getitem__
        return len(parts) - 1 + sum(sum(map(count, self.find(c))) for part in parts for c in chunks(part))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a byte-level .json vocabulary, read on the driver and broadcast. Null texts count as empty: no bytes, no
    tokens. A special string inside a text is one token. Repeated rows are counted each; an empty table gives no rows. A run of letters (or of digits, or of
    signs) without a break is one piece, which takes some 45 bytes of memory per byte; longer texts are otherwise read in parts.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = worker_cache("token counts", hash(spec.value), lambda: Counter(PairMerger(spec.value)))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

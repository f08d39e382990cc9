"""Packing by minimum bin slack: documents become pieces in sequences of at most ``capacity`` tokens.

A document gives full sequences as long as it has ``capacity`` tokens left; its remainder joins a pool. A sequence starts with the longest piece of
the pool, and a bitset subset-sum over the pool's multiset of lengths, longest first, finds the set of further pieces that comes closest
to the capacity; counts of each length come from walking the bitsets back. Sequences that would keep slack wait for more
documents. What is left when a partition ends is cut at powers of two, which need no padding. There is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .common import worker_cache

#: Documents whose remainders are held at a time, and pieces of the pool that are left open between fillings.
POOL, OPEN = 4096, 1024
#: Characters of texts whose new words are learned together.
GROUP = 1 << 18


def best_fill(lengths: list[int], count: Callable[[int], int], room: int) -> tuple[int, dict[int, int]]:
    """The sum closest to ``room``, not above it, of a multiset of ``lengths`` (ascending; each ``count(length)`` times), and how often it takes each length."""
    mask = (1 << (room + 1)) - 1
    reach, steps, k = 1, [], bisect_right(lengths, room)
    while k and not reach >> room & 1:
        k -= 1
        length = lengths[k]
        left, times = min(count(length), room // length), 1
        while left and not reach >> room & 1:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            times *= 2
    total = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return total, used


def fill(pool: dict[int, list], capacity: int, leave: int, close: bool) -> Iterator[list]:
    """Lists of pieces for one sequence each, taken out of ``pool`` (length to pieces) until ``leave`` pieces are left.

    Unless ``close``, a longest piece that finds no exact fill is set aside and goes back to the pool in the end.
    """
    aside: list = []
    size = sum(map(len, pool.values()))
    lengths = sorted(pool)

    def take(length: int):
        piece = pool[length].pop()
        if not pool[length]:
            del pool[length]
            lengths.pop(bisect_left(lengths, length))
        return piece

    while size > leave:
        longest = lengths[-1]
        lead = take(longest)
        size -= 1
        total, used = best_fill(lengths, lambda x: len(pool[x]), capacity - longest) if longest < capacity else (0, {})
        if total + longest < capacity and not close:
            aside.append((longest, lead))
            continue
        size -= sum(used.values())
        yield [lead, *(take(length) for length, n in used.items() for _ in range(n))]
    for length, piece in aside:
        pool.setdefault(length, []).append(piece)


def at_powers(pieces: list[tuple], total: int, capacity: int) -> Iterator[list[tuple]]:
    """The pieces (doc, start, ids, doc_tokens) recut so that each sequence has a power of two of tokens, or ``capacity``."""
    if total == capacity:
        yield pieces
        return
    pieces = pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, out = 1 << bit, []
        while room:
            doc, start, ids, n = pieces.pop()
            take = min(room, len(ids) // 4)
            out.append((doc, start, ids[: 4 * take], n))
            if 4 * take < len(ids):
                pieces.append((doc, start + take, ids[4 * take :], n))
            room -= take
        yield out


class WordIds:
    """Token ids of texts, as little-endian bytes.

    Text of plain letters, marks and spaces goes word by word through a bounded memory; new words are encoded many at a time, and the ids of each
    are told apart by the tokens that end a word. Any other text goes to the tokenizer as a whole.
    """

    def __init__(self, spec: str, remember: int = 1_500_000):
        import json
        import re

        import numpy as np
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.memo: dict[str, bytes] = {}
        self.remember = remember
        model = json.loads(spec)
        steps = (model.get("normalizer") or {}).get("normalizers", [])
        split = ((model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        mark = model["model"].get("end_of_word_suffix")
        known = bool(mark) and [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") is True and split.get("behavior") == "Removed"
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall if known else None
        vocab = model["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if known:
            self.ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        # ASCII without controls, and Latin-1 signs and letters: composed already, and lower-cased one by one
        self.plain = re.compile(r"[\t\n\r\x20-\x7E\u00A1-\u00AC\u00AE-\u00FF]*").fullmatch
        self.specials = [t["content"] for t in model["added_tokens"]]

    def slow(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return next(iter(self.many([text])))

    def many(self, texts) -> Iterator[bytes]:
        """The ids of each text, in turn; new words of about GROUP characters are learned together."""
        from .token_count import chunks

        group: list[bytes | list] = []  # ids, or the parts of a text: ids or words
        size = 0
        for text in texts:
            if not self.pieces or any(s in text for s in self.specials):
                group.append(self.slow(text))
            else:
                parts = []
                for c in chunks(text):
                    lowered = c.lower()
                    if self.plain(c) and not any(s in lowered for s in self.specials):
                        parts.append(lowered.split())
                    else:
                        parts.append(self.slow(c))
                group.append(parts)
            size += len(text)
            if size >= GROUP:
                yield from self.known(group)
                group, size = [], 0
        yield from self.known(group)

    def known(self, group: list) -> Iterator[bytes]:
        words = set().union(*(p for parts in group if isinstance(parts, list) for p in parts if isinstance(p, list)))
        self.trim()
        # the memory is large and slow to reach, so each word of the group is looked up there once
        words = list(words)
        ids = dict(zip(words, map(self.memo.get, words)))
        new = self.learned([w for w in words if ids[w] is None])
        ids.update(new)
        self.memo.update(new)
        get = ids.__getitem__
        for parts in group:
            yield parts if isinstance(parts, bytes) else b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts)

    def trim(self) -> None:
        """Half of the words are left once there are too many: the first ones, as frequent words come early."""
        from itertools import islice

        if len(self.memo) > self.remember:
            self.memo = dict(islice(self.memo.items(), self.remember // 2))

    def learned(self, words: list[str]) -> dict[str, bytes]:
        import numpy as np

        if not words:
            return {}

        lines = [" ".join(words[k : k + 512]) for k in range(0, len(words), 512)]
        ids = np.concatenate([np.asarray(e.ids, "<u4") for e in self.whole.encode_batch_fast(lines, add_special_tokens=False)])
        # a word of letters is one piece, and one more with a sign behind it
        counts = np.fromiter((1 if w.isalpha() else 2 if w[-1] in ",." and w[:-1].isalpha() else len(self.pieces(w)) for w in words), np.int64, len(words))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != counts.sum() or not counts.all():
            return {w: self.slow(w) for w in words}
        data, cuts = ids.tobytes(), (4 * ends[np.cumsum(counts) - 1]).tolist()
        return dict(zip(words, map(data.__getitem__, map(slice, [0, *cuts], cuts))))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", remember: int = 1_500_000) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each token of a document, its closing ``end_id`` included, lies in exactly one piece; a null or empty text is the closing id alone. Sequences
    are gapless from offset 0 and numbered by partition. Sequences hold ``capacity`` tokens or a power of two, so none needs padding.
    Repeated rows and null ids are packed like any others. An empty table gives no rows. ``remember`` bounds the words whose ids a worker keeps
    (about 250 bytes each); it changes the speed only.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator) -> Iterator:
        import os
        from zlib import crc32

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = worker_cache("packing", (hash(spec.value), remember), lambda: WordIds(spec.value, remember))
        end = int(end_id).to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 40
        pool: dict[int, list] = {}
        rows: list[tuple] = []
        held = 0

        def put(pieces: list[tuple]) -> int:
            nonlocal number
            offset = 0
            for doc, start, ids, n in pieces:
                rows.append((doc, start, len(ids) // 4, crc32(ids), n, number, offset))
                offset += len(ids) // 4
            number += 1
            return len(pieces)

        def out():
            columns = list(zip(*rows)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind_arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        kind_arrow = None
        for batch in batches:
            kind_arrow = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), encode.many(t.as_py() or "" for t in batch.column(1))):
                ids += end
                n = len(ids) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    put([(doc, start, ids[4 * start : 4 * (start + capacity)], n)])
                if whole < n:
                    pool.setdefault(n - whole, []).append((doc, whole, ids[4 * whole :], n))
                    held += 1
                if held >= POOL:
                    for pieces in fill(pool, capacity, OPEN, False):
                        put(pieces)
                    held = sum(map(len, pool.values()))
                    if held >= POOL:  # too alike to fill up: close what there is
                        for pieces in fill(pool, capacity, OPEN, True):
                            for part in at_powers(pieces, sum(len(p[2]) // 4 for p in pieces), capacity):
                                put(part)
                        held = sum(map(len, pool.values()))
                if len(rows) >= 20_000:
                    yield out()
        for pieces in fill(pool, capacity, 0, True):
            for part in at_powers(pieces, sum(len(p[2]) // 4 for p in pieces), capacity):
                put(part)
        if rows:
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

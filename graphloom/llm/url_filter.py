"""URL filter: a bit-parallel wildcard automaton that runs all rules at once over each canonical URL.

A rule ``host/path`` becomes the pattern ``*.host#path*`` over the canonical form ``.host#path`` of a URL. All patterns lie end to end in
multiword masks (Shift-And): a state is one bit, a step shifts the states, keeps those whose next symbol fits, and holds
those that stand at a wildcard. The state words of all URLs of an Arrow batch advance together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: The rules of the registered query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def compile_rules(rules: list[tuple[str, str]]) -> dict:
    """Masks over bytes for the rules, longest first. In a rule, ``*`` stands for any run (within the host, or within the path), ``?`` for one byte."""
    import numpy as np

    rules = sorted(((str(r), str(v)) for r, v in rules), key=lambda x: (-len(x[0].encode()), x))
    symbols: list[tuple[int, set[int] | None, set[int] | None]] = []  # (symbol ahead or None, bytes that fit it, bytes that a star before it holds)
    host_bytes, all_bytes = {b for b in range(256) if b != 35}, set(range(256))
    starts, ends = [], []
    stars: dict[int, set[int]] = {}
    fits: dict[int, set[int]] = {}
    at = 0
    for rule, _ in rules:
        host, slash, path = rule.partition("/")
        starts.append(at)
        stars[at] = host_bytes
        for part, allowed in ((f".{host}".encode().lower(), host_bytes), (b"#", None), ((slash + path).encode(), all_bytes)):
            for b in part:
                if b == 42 and allowed is not None:
                    stars[at] = stars.get(at, set()) | allowed
                    continue
                at += 1
                fits[at] = allowed if b == 63 and allowed is not None else {b}
        stars[at] = all_bytes
        ends.append(at)
        at += 1
    words = max(1, -(-at // 64))

    def packed(bits) -> np.ndarray:
        out = np.zeros(words, np.uint64)
        for k in bits:
            out[k // 64] |= np.uint64(1 << (k % 64))
        return out

    def by_byte(sets: dict[int, set[int]]) -> np.ndarray:
        out = np.zeros((256, words), np.uint64)
        for k, chars in sets.items():
            for b in chars:
                out[b, k // 64] |= np.uint64(1 << (k % 64))
        return out

    return {"rules": rules, "ends": ends, "start": packed(starts), "fit": by_byte(fits), "hold": by_byte(stars), "final": packed(ends), "words": words}


def run_automaton(urls: list[bytes], masks: dict) -> list[int]:
    """For each canonical URL, the first rule (in the order of the compiled rules) that fits, or -1."""
    import numpy as np

    out = np.full(len(urls), -1, np.int64)
    order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
    at = 0
    while at < len(order):  # URLs of like length together, in blocks of at most 4 MB
        longest = max(1, len(urls[order[at]]))
        block = order[at : at + max(1, min(8192, (4 << 20) // longest))]
        at += len(block)
        lengths = np.array([len(urls[i]) for i in block])
        chars = np.zeros((len(block), longest), np.uint8)
        for row, i in enumerate(block):
            chars[row, : lengths[row]] = np.frombuffer(urls[i], np.uint8)
        state = np.repeat(masks["start"][None, :], len(block), axis=0)
        for k in range(longest):
            live = int(np.searchsorted(-lengths, -k, side="left"))  # rows longer than k
            if not live or not (state[:live] & ~masks["final"]).any():
                break  # what is left stands at closing wildcards, which hold to the end
            now, c = state[:live], chars[:live, k]
            moved = now << np.uint64(1)
            if masks["words"] > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & masks["fit"][c]) | (now & masks["hold"][c])
        for rank in reversed(range(len(masks["ends"]))):
            end = masks["ends"][rank]
            hit = (state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1
            out[np.array(block)[hit]] = rank
    return out.tolist()


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    import re

    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = re.search(r"[/?#]", rest)
    host = rest if cut is None else rest[: cut.start()]
    rest = rest[len(host) :]
    cut = re.search(r"[?#]", rest)
    path = rest if cut is None else rest[: cut.start()]
    return host.encode().lower().decode(), path


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict; ``default`` where no rule fits.

    The longest fitting rule wins, ties go to the smaller rule text. A null URL, or one without ``://``, has an empty host and path
    and fits no rule. Rows with a null or repeated id are judged like any others. An empty table gives no rows.
    """
    masks = compile_rules(list(rules))

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            first = run_automaton([f".{h}#{p}".encode() for h, p in parts], masks)
            picked = [masks["rules"][k] if k >= 0 else (None, default) for k in first]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([r for r, _ in picked], pa.string()), pa.array([v for _, v in picked], pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT page_id, host, path, '.' || host AS dotted FROM p),
j AS (SELECT page_id, host, path, CASE
  WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN ends_with(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN ends_with(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN ends_with(dotted, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""

"""Chat formatting by quotation linking, in DataFrame operations only.

Each message is parsed in its row: nested quote marks give lines their level, runs of lines of one level and kind are passages, and the text at level 0, less
the lines that introduce a quote, is the body. Normalised passages and lines are hashed. A quoted hash is joined to the first message of its conversation
that has it unquoted; the innermost level that finds an earlier message names the parent. Threads come from doubling parent pointers, and messages
are numbered in reply order (by thread, then turn) from a range partitioning, so that no conversation is gathered in one task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, filter_of, maybe_in, written, written_any

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
INTRO = r"(?i)^.{0,200}\b(wrote|writes|said):[ \t\r]*$"


def normalised(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.regexp_replace(lowered, r"[ \t\r\n]+", " "), r"^ | $", "")


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (row, conv, turn, role, body, n_quoted, max_level, own hashes, quoted (level, hash))."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.monotonically_increasing_id().alias("row"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("raw"))
    rows = rows.withColumn("level", F.transform("raw", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))))
    rows = rows.withColumn("plain", F.transform("raw", lambda x: normalised(F.regexp_replace(x, MARKS, ""))))
    level, plain = (lambda i: F.get(F.col("level"), i)), (lambda i: F.get(F.col("plain"), i))
    places = F.sequence(F.lit(0), F.size("raw") - 1)
    ahead = lambda i: (level(i + 1) > 0) | ((plain(i + 1) == "") & (level(i + 2) > 0))
    # kind of a line: quote level, or -1 for one that introduces a quote
    rows = rows.withColumn("kind", F.transform(places, lambda i: F.when((level(i) == 0) & F.get("raw", i).rlike(INTRO) & F.coalesce(ahead(i), F.lit(False)), F.lit(-1)).otherwise(level(i))))
    kind = lambda i: F.get(F.col("kind"), i)
    rows = rows.withColumn("cut", F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: (i == 0) | (kind(i) != kind(i - 1)) | ((plain(i) == "") != (plain(i - 1) == ""))))
    spans = F.transform("cut", lambda c, k: F.struct(kind(c).alias("level"), normalised(F.array_join(F.slice("plain", c + 1, F.coalesce(F.get("cut", k + 1), F.size("raw")) - c), " ")).alias("text")))
    lines = F.transform(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: F.struct(kind(i).alias("level"), plain(i).alias("text")))
    rows = rows.withColumn("passages", F.filter(F.concat(spans, lines), lambda p: p["text"] != ""))
    hashed = lambda p: F.xxhash64(p["text"])
    kept = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: kind(i) == 0), lambda i: F.get("raw", i)), "\n")
    return rows.select(
        "row", "conv", "turn", "role", F.regexp_replace(kept, r"^\n+|\n+$", "").alias("body"),
        F.size(F.filter("level", lambda x: x > 0)).cast("long").alias("n_quoted"), F.array_max("level").cast("long").alias("max_level"),
        F.array_distinct(F.transform(F.filter("passages", lambda p: p["level"] == 0), hashed)).alias("own"),
        # repeats meet in reply_links: array_distinct compares structs pair by pair
        F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), hashed(p).alias("hash"))).alias("quoted"),
    )


def reply_links(messages: DataFrame) -> DataFrame:
    """Rows (conv, turn, parent) of the messages that quote an earlier one, from :func:`parsed` rows."""
    quotes = written(messages.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.level", "q.hash").distinct(), "quotes")
    keys = [F.col("conv"), F.col("hash")]
    bits = filter_bits(quotes.count())
    bitmap = written(filter_of(quotes, keys, bits), "quoted-filter")
    own = messages.where("turn IS NOT NULL").select("conv", "turn", F.explode("own").alias("hash"))
    first = maybe_in(own, keys, bitmap, "maybe", bits).where("maybe").groupBy("conv", "hash").agg(F.min("turn").alias("first"))
    found = quotes.join(written(first, "originals"), ["conv", "hash"]).where("first < turn")
    return found.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "first"))["first"].alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """Rows (conv, turn, parent, top, depth): the first message of each linked message's thread, and the links up to it."""
    state, moved = written_any(links.select("conv", "turn", "parent", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth")), "threads")
    while moved:
        up = state.select("conv", F.col("turn").alias("top"), F.col("top").alias("above"), F.col("depth").alias("more"))
        state = state.join(up, ["conv", "top"], "left").select("conv", "turn", "parent", F.coalesce("above", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        state, moved = written_any(state, "threads", F.col("moved"))
        state = state.drop("moved")
    return state


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 in the given order, by partitions of a range partitioning and offsets per group and partition."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("__part", F.shiftright("__at", 33))
    parts = ranged.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__own")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # one row per group and partition: a group of any size has no more rows here than there are partitions
    parts = parts.selectExpr("*", "coalesce(sum(__n) OVER (PARTITION BY __group ORDER BY __own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __before")
    joined = ranged.join(written(parts, "offsets"), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__own")))
    return joined.withColumn(out, F.col("__at") - F.col("__first") + F.col("__before")).select(*rows.columns, out)


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, parent_turn, thread_turn, depth, position, n_quoted, max_level, body, chat.

    ``body`` is the text without quotes and the lines that introduce them, ``chat`` the same under its role. ``position`` numbers a conversation's
    messages from 0 by thread, turn, role and body. A message without a found quote starts a thread; only messages of smaller turns are
    found. Null texts count as empty and null roles as ``user`` in ``chat``; a null conversation or turn links to nothing, and null turns come first.
    Rows that repeat a turn share its links. An empty table gives no rows.
    """
    rows = written(parsed(messages, conv, turn, role, text), "messages")
    found = written(threads(reply_links(rows)).withColumnsRenamed({"conv": "__conv", "turn": "__turn"}), "replies")
    joined = rows.join(found, (F.col("conv") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    full = joined.select("conv", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("top", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "n_quoted", "max_level", "body", chat.alias("chat"))
    done = numbered(full, "conv", ["thread_turn", "turn", "role", "body"], "position")
    return done.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "parent_turn", "thread_turn", "depth", "position", "n_quoted", "max_level", "body", "chat")


def digest(linked: DataFrame) -> DataFrame:
    return linked.select("conv_id", "turn", "role", "parent_turn", "thread_turn", "depth", "position", "n_quoted", "max_level", F.sha2("chat", 256).alias("chat_sha256"))


def _normal(x: str) -> str:
    lowered = f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"regexp_replace(regexp_replace({lowered}, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g')"


ORACLE = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS raw FROM conversations),
l0 AS (SELECT id, conv_id, turn, unnest(raw) AS line, unnest(range(len(raw))) AS i FROM m),
l1 AS (SELECT *, length(regexp_replace(regexp_extract(line, '{MARKS}', 1), '[^>]', '', 'g')) AS level, {_normal(f"regexp_replace(line, '{MARKS}', '')")} AS plain FROM l0),
l2 AS (SELECT *, lead(level) OVER w AS l_1, lead(level, 2) OVER w AS l_2, lead(plain) OVER w AS p_1 FROM l1 WINDOW w AS (PARTITION BY id ORDER BY i)),
l3 AS (SELECT *, CASE WHEN level = 0 AND regexp_matches(line, '{INTRO}') AND coalesce(l_1 > 0 OR (p_1 = '' AND l_2 > 0), false) THEN -1 ELSE level END AS kind FROM l2),
l4 AS (SELECT *, CASE WHEN i = 0 OR kind <> lag(kind) OVER w OR (plain = '') <> (lag(plain) OVER w = '') THEN 1 ELSE 0 END AS cut FROM l3 WINDOW w AS (PARTITION BY id ORDER BY i)),
l5 AS (SELECT *, sum(cut) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM l4),
p AS (SELECT DISTINCT * FROM (
  SELECT id, conv_id, turn, kind, plain AS passage FROM l5
  UNION ALL SELECT id, conv_id, turn, kind, {_normal("string_agg(plain, ' ' ORDER BY i)")} FROM l5 GROUP BY id, conv_id, turn, kind, run) WHERE passage <> ''),
o AS (SELECT conv_id, passage, min(turn) AS first FROM p WHERE kind = 0 GROUP BY ALL),
f AS (SELECT p.conv_id, p.turn, p.kind, o.first FROM p JOIN o USING (conv_id, passage) WHERE p.kind > 0 AND o.first < p.turn),
links AS (SELECT conv_id, turn, first AS parent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY kind, first DESC) AS k FROM f) WHERE k = 1),
t AS (SELECT conv_id, turn, parent, parent AS top, 1::BIGINT AS depth FROM links
      UNION ALL SELECT t.conv_id, t.turn, t.parent, links.parent, t.depth + 1 FROM t JOIN links ON links.conv_id = t.conv_id AND links.turn = t.top),
th AS (SELECT conv_id, turn, parent, arg_max(top, depth) AS top, max(depth) AS depth FROM t GROUP BY ALL),
b AS (SELECT id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kind = 0), ''), '^\n+|\n+$', '', 'g') AS body,
             count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level FROM l5 GROUP BY id),
r AS (SELECT m.conv_id, m.turn, m.role, th.parent AS parent_turn, coalesce(th.top, m.turn) AS thread_turn, coalesce(th.depth, 0) AS depth, n_quoted, max_level, body
      FROM m JOIN b USING (id) LEFT JOIN th ON th.conv_id = m.conv_id AND th.turn = m.turn)
SELECT conv_id, turn, role, parent_turn, thread_turn, depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, body) - 1 AS position, n_quoted, max_level,
       sha256('<|' || coalesce(role, 'user') || '|>' || chr(10) || body || chr(10)) AS chat_sha256 FROM r
"""

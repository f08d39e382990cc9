import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quotes as op
from graphloom.llm.queries import op6_quote_linking, oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string"

MAIL = [
    (1, 0, "user", "Hello there.\nI have a question\nabout trains.\n\nWhen do they go?"),
    (1, 1, "assistant", "On Monday, Al wrote:\n> When do they go?\n\nAt nine."),
    (1, 2, "user", "Al said:\n\n> Hello there. I have a\n>   question about trains.\n> \n>> nothing like it\n\nNever mind."),
    (1, 3, "user", "B wrote:\n> > When do they go?\n> At nine.\n\nThanks"),
    (1, 4, "user", "> > when DO they  go?\nlevel two only"),
    (1, 5, "user", "a thread of its own"),
    (1, 6, None, ">At nine.\n> a thread of its own\nboth"),
    (2, 0, "user", "At nine."),
    (2, 1, "user", "> not found anywhere\nx"),
    (2, 2, "user", "> self\nself"),
    (2, 3, "user", ""),
    (2, 4, "user", None),
    (2, 4, "user", "> At nine.\nrepeat"),
    (2, 4, "user", "> At nine.\nrepeat"),
    (None, 0, "user", "> At nine.\nlost"),
    (3, None, "user", "> At nine."),
]


def test_links_and_bodies(spark):
    rows = {(r.conv_id, r.turn): r for r in op.link_quotes(spark.createDataFrame(MAIL, SCHEMA)).collect()}
    get = lambda c, t: (rows[c, t].parent_turn, rows[c, t].thread_turn, rows[c, t].depth)
    assert [get(1, t) for t in range(7)] == [(None, 0, 0), (0, 0, 1), (0, 0, 1), (1, 0, 2), (0, 0, 1), (None, 5, 0), (5, 5, 1)]
    assert get(2, 1) == (None, 1, 0) and get(2, 2) == (None, 2, 0)
    assert get(2, 4) == (0, 0, 1) and get(None, 0) == (None, 0, 0) and get(3, None) == (None, None, 0)
    assert rows[1, 1].body == "At nine." and rows[1, 2].body == "Never mind." and rows[1, 3].chat == "<|user|>\nThanks\n"
    assert (rows[1, 2].n_quoted, rows[1, 2].max_level) == (4, 2)
    order = sorted((r.position, r.turn) for (c, _), r in rows.items() if c == 1)
    assert order == list(enumerate([0, 1, 2, 3, 4, 5, 6]))
    assert op.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def mailbox(seed):
    rng = random.Random(seed)
    out = []
    for c in range(12):
        bodies = []
        for t in range(rng.randint(1, 14)):
            lines = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 4))]
            if bodies and rng.random() < 0.7:
                of = rng.choice(bodies)
                quoted = [rng.choice(["> ", ">", " > "]) + x for x in of[: rng.randint(1, len(of))]]
                lines = rng.choice([[], ["x wrote:"], ["x wrote:", ""], ["said: x"]]) + quoted + rng.choice([[], [""]]) + lines
            bodies.append(lines)
            out.append((c, t, rng.choice(["user", "assistant", None]), "\n".join(lines)))
    return out


@pytest.mark.parametrize("rows", [MAIL, mailbox(1), mailbox(2), [(1, t, "u", f"> m{t - 1}\nm{t}") for t in range(70)]])
def test_query_matches_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.execute(oracle_sql()["op6_quote_linking"])
    names = [c[0] for c in result.description]
    key = lambda r: str(r)
    got = sorted((tuple(r[n] for n in names) for r in op6_quote_linking(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(result.fetchall(), key=key)


def test_long_messages_and_clashing_columns(spark):
    lines = [f"line {k} of a long message" for k in range(100_000)]
    rows = [(1, 0, "user", "\n".join(lines[:10])), (1, 1, "user", "\n".join("> " + x for x in lines))]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "body": F.lit("x"), "conv": F.lit(2), "level": F.lit(None), "position": F.lit(0)})
    got = {r.turn: r for r in op.link_quotes(frame).collect()}
    assert (got[1].n_quoted, got[1].parent_turn, got[1].body) == (100_000, 0, "") and got[0].position == 0

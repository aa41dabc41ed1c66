import duckdb
from gridloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def both(spark, path):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}/conversations.parquet/*.parquet')")
    columns = ("conv_id", "part", "n_turns", "n_equal", "rendered")
    theirs = con.execute(f"select {', '.join(columns)} from ({chat.SQL})").fetchall()
    return sorted(map(tuple, chat.op1_chat(spark, path).select(*columns).collect())), sorted(theirs)


def test_snapshots_and_copies(spark, tables):
    rows = []
    for conv in range(40):  # snapshots of 5 conversations, of 1 to 8 turns, some equal
        base, n = conv % 5, conv // 5 + 1 - (conv == 39)
        rows += [(conv, t, "user" if t % 2 == 0 else "assistant", f"{base} says {t}") for t in range(n)]
    rows += [(100, t, "user", "hello" if t == 0 else f"x{t}") for t in range(3)] + [(101, 0, "user", "hello")]
    mine, theirs = both(spark, tables(conversations=(SCHEMA, rows)))
    assert mine == theirs and len({r[0] for r in mine}) == 6


def test_long_conversations(spark, tables, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 150), (2, 149), (3, 151), (4, 33)) for t in range(n)] + [(5, t, "user", f"turn {t + (t == 40)}") for t in range(60)]
    mine, theirs = both(spark, tables(conversations=(SCHEMA, rows)))
    assert mine == theirs and {r[0] for r in mine} == {3, 5}


def test_odd_rows(spark, tables):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (2, 0, "", ""), (3, None, "user", "a"), (3, None, "user", "b"), (3, 1, "user", "a"), (4, 0, "user", "long " * 50_000), (4, 0, "user", "long " * 50_000), (5, 3, "user", "a"), (5, 9, "user", "b")]
    mine, theirs = both(spark, tables(True, conversations=(SCHEMA, rows)))
    assert mine == theirs
    unnamed = chat.op1_chat(spark, tables(conversations=(SCHEMA, [(None, 0, "user", "a"), (7, 0, "user", "a")]))).collect()
    assert [(r["conv_id"], r["n_equal"]) for r in unnamed] == [(None, 2)]
    assert chat.op1_chat(spark, tables(conversations=(SCHEMA, []))).count() == 0

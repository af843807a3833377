import random

import duckdb

from tidemark.llm.quotations import SQL, built, format_conversations

SCHEMA = "conv_id long, turn long, role string, text string, level int"


def run(spark, rows):
    found = format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.conv_id, r.turn): r for r in found}, found


def test_links_levels_and_order(spark):
    rows = [
        (1, 0, "user", "Where is the harbour?\nIt was here.", 0),
        (1, 1, "assistant", "Another matter entirely.", 0),
        (1, 2, "user", "> Where is the HARBOUR?\n> It was  here.\nBehind the hill.", 0),
        (1, 3, "assistant", "On Monday, user wrote:\n>> Where is the harbour?\n>> It was here.\n> Behind the hill.\nThank you.", 0),
        (1, 4, "user", "> Another matter\n> nobody said this line\nUnlinked.", 0),
        (1, 5, "user", "> nothing of the kind was said\n> It was here.\nOne line known.", 0),
        (2, 0, "user", "> It was here.\nOther conversation.", 0),
        (2, 1, "user", None, 0),
        (2, 2, "user", "", 0),
        # One word; a sentence out of a line, wrapped anew; an own line that only looks like an announcement.
        (3, 0, "user", "Yes", 0),
        (3, 1, "user", "> Yes\nOn reflection she wrote:\nNo.", 0),
        (3, 2, "user", "First of all it rained. Then the boat came in with all its sails. We left.", 0),
        (3, 3, "user", "On a day in May, with a very long announcement " + "x" * 300 + " wrote:\n\n> Then the boat came in\n> with all its sails.\nQuite so.", 0),
        # Threads: 1 and 2 answer 0, 3 answers 1, 4 answers 2, 5 answers 1, 6 starts anew.
        (4, 0, "user", "root message", 0),
        (4, 1, "user", "> root message\nfirst answer", 0),
        (4, 2, "user", "> root message\nsecond answer", 0),
        (4, 3, "user", "> first answer\nto the first", 0),
        (4, 4, "user", "> second answer\nto the second", 0),
        (4, 5, "user", "> first answer\nagain to the first", 0),
        (4, 6, "user", "something else", 0),
        (4, 7, "user", "> something else\nindeed", 0),
    ]
    by, found = run(spark, rows)
    duck = duckdb.connect()
    duck.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    want = duck.sql(SQL)
    assert sorted((tuple(r[c] for c in want.columns) for r in found), key=repr) == sorted(want.fetchall(), key=repr)
    assert by[1, 2].text == "Behind the hill." and by[1, 2].reply_to == 0 and by[1, 2].root_turn == 0
    r = by[1, 3]
    assert r.text == "Thank you." and r.reply_to == 2 and r.root_turn == 0 and r.max_level == 2 and r.n_quotes == 2 and r.n_linked == 2
    assert by[1, 4].reply_to is None and by[1, 4].n_quotes == 1 and by[1, 4].n_linked == 0 and by[1, 4].root_turn == 4
    assert by[1, 5].reply_to == 0
    assert by[2, 0].reply_to is None and by[2, 0].text == "Other conversation."
    assert by[3, 1].reply_to == 0 and by[3, 1].text == "On reflection she wrote:\nNo."
    assert by[3, 3].reply_to == 2 and by[3, 3].text == "Quite so."
    assert [(by[4, i].root_turn, by[4, i].place) for i in range(8)] == [(0, 0), (0, 1), (0, 4), (0, 2), (0, 5), (0, 3), (6, 0), (6, 1)]
    read = [r.turn for r in built(spark.createDataFrame(found)).where("conv_id = 4").collect()]
    assert read == [0, 1, 3, 5, 2, 4, 6, 7]
    assert by[2, 1].text == "" and by[2, 2].text == "" and by[2, 2].n_quotes == 0
    assert by[1, 1].text == "Another matter entirely." and by[1, 1].root_turn == 1


def test_long_chain_repeats_and_empty(spark):
    rows = [(7, 0, "user", "message number 0", 0)] + [(7, i, "user", f"> message number {i - 1}\nmessage number {i}", 0) for i in range(1, 40)]
    by, found = run(spark, rows + rows[5:6])
    assert all(by[7, i].root_turn == 0 and by[7, i].reply_to == i - 1 for i in range(1, 40))
    assert len(found) == 41 and all(by[7, i].place == i for i in range(40))
    # A random tree, read depth first, and rows without a conversation or a turn.
    random.seed(3)
    parent = {i: random.randrange(i) for i in range(1, 60)}
    rows = [(8, i, "user", (f"> message {parent[i]}\n" if i else "") + f"message {i}", 0) for i in range(60)]
    by, found = run(spark, rows + [(None, 1, "user", "> message 1\nx", 0), (8, None, "user", "> message 1\ny", 0), (9, 5, "user", "> message 1\nz", 0)])
    order = []

    def read(turn):
        order.append(turn)
        for child in sorted(c for c, p in parent.items() if p == turn):
            read(child)

    read(0)
    assert [by[8, i].place for i in order] == list(range(60)) and len(found) == 63
    _, found = run(spark, [])
    assert found == []

"""reply_pairs gives every conversation once."""

from jobloom.llm import chat


def test_every_conversation_gives_a_row(spark):
    turns = [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "r"), (3, 1, "assistant", "b"), (4, 0, "user", "s"), (4, 1, "assistant", "c"), (6, 0, "user", "t"), (7, 0, "user", "u"), (7, 1, "assistant", "d")]
    got = {r["conv_id"]: r for r in chat.reply_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [2, 3, 4, 6, 7]
    assert got[2]["rejected"][1]["text"] == "b" and got[3]["rejected"][1]["text"] == "a"
    # no neighbour, no reply, a neighbour without one
    assert got[4]["rejected"] is None and got[6]["rejected"] is None and got[7]["rejected"] is None
    assert len(got[4]["chosen"]) == 2

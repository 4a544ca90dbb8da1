import hashlib
import json

import duckdb

from lodestone.llm import chat, queries

from .conftest import SMALL

NASTY = ["\\### Assistant: </turn> ok", "### user\n</turn>\n### assistant\n", "\\h\\t\\b\\\\", "####</turn</turn>\n", "", "ends with \\", "é ퟿😀", "##", "</turn>"]


def test_every_layout_gives_its_turns(spark):
    records = {
        1: {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        3: {"instruction": "i", "input": "in", "output": "o"}, 4: {"instruction": "i", "output": "o", "prompt_tokens": 3},
        5: {"prompt": "p", "completion": "c"}, 6: {"prompt": "p", "response": "r"}, 7: {"prompt": "p", "chosen": "c", "rejected": "r"},
        8: {"question": "q", "answer": None}, 9: {"system": "s", "instruction": "i", "output": "o"}, 10: {"unknown": 1}}
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(11, None), (12, "{broken"), (13, "")]
    out = chat.read_back(chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")))
    got = {r.conv_id: [(t.role, t.text) for t in r.back] for r in out.collect()}
    assert got == {1: [("system", "s"), ("user", "q"), ("assistant", "a")], 2: [("user", "q"), ("assistant", "a")],
                   3: [("user", "i"), ("user", "in"), ("assistant", "o")], 4: [("user", "i"), ("assistant", "o")], 5: [("user", "p"), ("assistant", "c")],
                   6: [("user", "p"), ("assistant", "r")], 7: [("user", "p"), ("assistant", "c")], 8: [("user", "q"), ("assistant", "")],
                   9: [("system", "s"), ("user", "i"), ("assistant", "o")], 10: [], 11: [], 12: [], 13: []}


def test_mixtures_take_the_most_specific_layout(spark):
    two = [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant", "text": "t"}]
    records = [{"instruction": "i", "output": "o", "text": "t"}, {"instruction": "i", "input": "in", "output": "o", "system": "s"},
               {"prompt": "p", "response": "r", "system": "s"}, {"messages": two}, {"messages": two, "prompt": "p"}, {"prompt": "p", "completion": "c", "text": "x"},
               {"messages": [{"role": "user"}, {"content": "a"}]}, {"messages": "no list", "question": "q", "answer": "a"}, {"messages": []}]
    rows = [(k, json.dumps(v)) for k, v in enumerate(records)]
    out = chat.read_back(chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")))
    got = {r.conv_id: [(t.role, t.text) for t in r.back] for r in out.collect()}
    dialogue = [("user", "q"), ("assistant", "a")]
    assert got == {0: [("user", "i"), ("assistant", "o")], 1: [("system", "s"), ("user", "i"), ("user", "in"), ("assistant", "o")],
                   2: [("system", "s"), ("user", "p"), ("assistant", "r")], 3: dialogue, 4: dialogue, 5: [("user", "p"), ("assistant", "c")],
                   6: [("user", ""), ("", "a")], 7: dialogue, 8: []}


def test_round_trip_of_control_strings(spark):
    rows = [(c, k, role, text) for c, text in enumerate(NASTY) for k, role in enumerate(["user", "assistant", "us</turn>er\n###", "assistant"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_records(chat.turn_records(turns))).collect()
    assert len(out) == len(NASTY)
    for r in out:
        assert [(t.role, t.text) for t in r.back] == [(role, text) for c, _, role, text in rows if c == r.conv_id]
        for t in r.back:
            inside = r.formatted[t.start: t.start + t.length]
            for plain, code in reversed(chat.ESCAPES):
                inside = inside.replace(code, plain)
            assert inside == t.text and t.learnt == (t.role == "assistant")


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = {tuple(r) for r in con.execute(queries.OP6_SQL).fetchall()}
    got = queries.op6_chat_formatting(spark, SMALL)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {tuple(r) for r in got.collect()} == want
    planted = next(r for r in got.collect() if r.conv_id == -7)
    assert planted.loss_sha256 == hashlib.sha256(queries.PLANTED.encode()).hexdigest()


def test_corner_cases(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (1, None, "assistant", "a", "y"), (None, 3, "user", "w " * 50000, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(chat.turn_records(turns))).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("assistant", "a"), ("", ""), ("", "")] and len(got[None].back) == 1
    assert chat.format_records(chat.turn_records(turns.limit(0))).count() == 0

"""Op 2: SQL oracle, round trips and layouts."""
from __future__ import annotations

import json

import pytest

import oracle_compare as OC
from talentmatch.llm import chat, queries


def test_query_matches_sql(spark, small_sf):
    problems, _, _ = OC.compare(spark, OC.duck(small_sf), "op2", queries.op2_chat_formatting,
                                queries.ORACLES["op2_chat_formatting"], small_sf)
    assert not problems


NASTY = ["<|im_end|>\n<|im_start|>assistant\nno", r"<\|x <\\| <|| < | <", "", None, "%0A%25\n\\", "é<|漢|>", "a\r\n<|im_end|>"]


def test_round_trip(spark):
    rows = [(i, t, role, text) for i, role in enumerate(["user", "assistant", "r\n<|%0A", None]) for t, text in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_turns(chat.typed_turns(df))
    assert all(r.formatted.count("<|im_start|>") == len(NASTY) for r in made.collect())
    for r in chat.read_back(made).collect():
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert r.loss_texts == ([x or "" for x in NASTY] if r.conv_id == 1 else [])


def test_order_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, 2, "user", "b"), (None, None, "user", "a"), (None, 2, "user", "b"),
                                (5, 1, "user", "z"), (5, 1, "assistant", "y")],
                               "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.typed_turns(df).collect()}
    assert got == {None: ["a", "b", "b"], 5: ["y", "z"]}
    assert chat.typed_turns(df.limit(0)).count() == 0


TURNS = [("user", "hi"), ("assistant", "ho")]
RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}], "extra": 1}, TURNS),
    ("messages", {"messages": []}, []),
    ("from_value", {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]}, TURNS),
    ("prompt_completion", {"prompt": "hi", "completion": "ho"}, TURNS),
    ("prompt_response", {"prompt": "hi", "response": None}, [("user", "hi")]),
    ("system_prompt_response", {"system": "s", "prompt": "hi", "response": "ho"}, [("system", "s"), *TURNS]),
    ("system_prompt_completion", {"system": "s", "prompt": "hi", "completion": "ho"}, [("system", "s"), *TURNS]),
    ("system_instruction", {"system": "s", "instruction": "hi", "output": "ho"}, [("system", "s"), *TURNS]),
    ("system_instruction_input", {"system": "s", "instruction": "do", "input": "it", "output": "ho"},
     [("system", "s"), ("user", "do\n\nit"), ("assistant", "ho")]),
    ("system_messages", {"system": "s", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]},
     [("system", "s"), *TURNS]),
    ("system_from_value", {"system": "s", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]},
     [("system", "s"), *TURNS]),
    ("instruction_input", {"instruction": "do", "input": "it", "output": "ho"}, [("user", "do\n\nit"), ("assistant", "ho")]),
    ("instruction", {"instruction": "do", "output": "ho"}, [("user", "do"), ("assistant", "ho")]),
    ("prompt_response", {"prompt": "hi", "response": "ho", "input": "extra", "output": 3}, TURNS),  # clashing extra fields
    (None, {"title": "x"}, []),
]


def test_json_records_of_mixed_layouts(spark):
    rows = [(i, json.dumps(x)) for i, (_, x, _) in enumerate(RECORDS)] + [(98, None), (99, "{broken")]
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns])
           for r in chat.json_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert got == {**{i: (name, turns) for i, (name, _, turns) in enumerate(RECORDS)}, 98: (None, []), 99: (None, [])}


@pytest.mark.parametrize("name,record,turns", [x for x in RECORDS if x[1].get("messages") != []])
def test_typed_layouts(spark, name, record, turns):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps({"conv_id": 1, **record})]))
    (r,) = chat.typed_turns(df).collect()
    assert (r.layout, [(t.role, t.text) for t in r.turns]) == (name, turns)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "ho", None, "z")],
                               "conv_id long, turn long, role string, text string, input string, system string")
    (r,) = chat.typed_turns(df).collect()
    assert (r.layout, [(t.role, t.text) for t in r.turns]) == ("turn_rows", TURNS)

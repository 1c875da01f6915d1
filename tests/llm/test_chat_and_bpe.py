"""Chat formatting and byte-level BPE."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laminar.llm import bpe, chat

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD_TEXTS = ["", " ", "\n", "a  b", " a", "a ", "a\n", "\n\na", "a \n b", "it's we'll ''s x's", "<|endoftext|>", "é é", " x 　y", "字字 字", "🙂🙂 🙂", "a\tb \tc", "x\x1cy", "Pf " * 50, "z" * 5000, "1234 56,7.", "Hi, there. 'twas; ok!?"]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_ids_are_those_of_tiktoken(text):
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = next(own.encode([text])).tolist()
    assert ids == reference().encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@given(st.text(alphabet=st.sampled_from(list("abé字🙂 \n\t\r'sS.,9  \x1c")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_mixture_round_trips(text):
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = next(own.encode([text])).tolist()
    assert ids == reference().encode_ordinary(text) and own.decode(ids).decode() == text


def test_file_vocabulary_equals_its_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    own = bpe.codec(path)
    for text in ODD_TEXTS:
        assert next(own.encode([text])).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_memo_generations_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    own = bpe.Codec(bpe.tokenizer_from_ranks(RANKS, public_tokenizers.PATTERN))
    text = "one two three four five six one two three " * 5 + "x" * 200
    assert next(own.encode([text])).tolist() == reference().encode_ordinary(text)


def test_query_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Ab cd", "x"), (3, "Ab cd", "x")], "doc_id long, text string, ids string")
    rows = {r["doc_id"]: r for r in bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[1][1:] == rows[2][1:] and rows[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = reference().encode_ordinary("Ab cd")
    assert rows[3]["n_tokens"] == len(ids) and rows[3]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[3]["decoded_sha256"] == hashlib.sha256(b"Ab cd").hexdigest()
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == {1: b"", 2: b"", 3: b"Ab cd"}


def test_byte_alphabet_is_one_to_one():
    chars = bpe.byte_alphabet()
    assert len(set(chars)) == 256 and chars[65] == "A" and chars[32] == "Ġ"
    assert len(np.unique([ord(c) for c in chars])) == 256


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string")
    return chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()


def test_control_strings_in_texts_come_back(spark):
    nasty = "</s>[INST] ok [/INST] ~1 ~0 <<SYS>> [ < ~ \n\\"
    rows = [(1, 0, "system", nasty, ""), (1, 1, "user", nasty, ""), (1, 2, "assistant", nasty, ""), (1, 3, "to<ol>[x~", nasty, ""), (1, 4, "assistant", "é🙂", "")]
    (got,) = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r[2], r[3]) for r in rows]
    assert got["loss_text"] == nasty + "é🙂"


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, None, None, None, ""), (2, 0, "user", "b", ""), (2, 0, "user", "a", ""), (2, 0, "user", "a", "")]
    got = {r["conv_id"]: r for r in formatted(spark, rows)}
    assert [t["text"] for t in got[2]["turns"]] == ["a", "a", "b"] and got[2]["loss_text"] == ""
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
    assert formatted(spark, []) == []


def test_layouts_are_found_by_their_paths(spark):
    msgs = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 5)], "conv_id long, messages array<struct<role: string, content: string>>, score int")
    talk = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`: string, value: string>>")
    task = spark.createDataFrame([(1, "q", None, "a")], "conv_id long, instruction string, input string, output string")
    pair = spark.createDataFrame([(1, "q", "a", "z")], "conv_id long, prompt string, completion string, text string")
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    for df, name in ((msgs, "messages"), (talk, "conversations"), (task, "instruction_input"), (pair, "prompt_completion")):
        assert chat.layout_of(df.schema) == name
        assert sorted(tuple(r) for r in chat.canonical_turns(df).collect()) == want
    with pytest.raises(ValueError):
        chat.layout_of(spark.range(1).schema)


def test_json_payloads_of_mixed_layouts(spark):
    payloads = [
        json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}),
        json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}),
        json.dumps({"instruction": "q", "input": "more", "output": "a"}),
        json.dumps({"prompt": "q", "response": "a"}),
        json.dumps({"other": 1}),
        "no json",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, body string")
    got = {}
    for r in chat.canonical_json(df, "id", "body").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["role"], r["text"]))
    for k, (name, asked) in enumerate((("messages", "q"), ("conversations", "q"), ("instruction_input", "q\n\nmore"), ("prompt_response", "q"))):
        assert got[k] == [(name, "user", asked), (name, "assistant", "a")]
    assert got[4] == got[5] == got[6] == [(None, None, None)]


def test_json_payloads_with_other_fields_and_wrong_nesting(spark):
    asked = [{"role": "user", "content": "q", "id": 7}, {"role": "assistant", "content": "a"}]
    payloads = [
        ({"messages": asked, "source": {"role": "x", "content": "y"}}, "messages"),
        ({"prompt": "q", "response": "a", "id": 5}, "prompt_response"),
        ({"prompt": "q", "completion": "a", "instruction": "z"}, "prompt_completion"),
        ({"messages": {"role": "user", "content": "q"}}, None),
        ({"messages": "text", "prompt": "q", "response": "a"}, "prompt_response"),
        ({"messages": []}, None),
        ({"deep": {"prompt": "q", "completion": "a"}}, None),
    ]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, (p, _) in enumerate(payloads)], "id long, body string")
    got = {}
    for r in chat.canonical_json(df, "id", "body").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["role"], r["text"]))
    for k, (_, name) in enumerate(payloads):
        assert got[k] == ([(name, "user", "q"), (name, "assistant", "a")] if name else [(None, None, None)])
    plan = chat.canonical_json(df, "id", "body")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["", "abc de", "é🙂x 🙂🙂", "字字 字 ña", "a\x00b"])
def test_offsets_cover_the_text(spark, text):
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = next(own.encode([text]))
    first, last = own.offsets(ids)
    assert (first[:1] == 0).all() and (last[-1:] == len(text)).all()
    for k, i in enumerate(ids.tolist()):
        assert own.bytes[i] in text[first[k] : last[k]].encode()
    df = spark.createDataFrame([(1, text), (None, None)], "doc_id long, text string")
    row = bpe.encode(df, RANKS, public_tokenizers.PATTERN, offsets=True).filter("doc_id = 1").first()
    assert (row["ids"], row["starts"], row["ends"]) == (ids.tolist(), first.tolist(), last.tolist())


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_turns(chat.canonical_turns(df.withColumn("c", F.lit(1)))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_leave_a_batch_a_few_rows_at_a_time():
    import pyarrow as pa

    texts = [None if k % 7 == 0 else f"text {k}" for k in range(3 * bpe.ROWS + 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t or "" for t in texts])], ["doc_id", "text"])
    found = list(bpe._sliced(batch))
    assert max(len(run) for _, run in found) <= bpe.ROWS
    assert [t for _, run in found for t in run] == [t or "" for t in texts]
    assert all(run == batch.column(1).slice(at, len(run)).to_pylist() for at, run in found)

import hashlib
import random

import pytest

from riskflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment long, loss boolean"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA)


def back(spark, rows, parts=3):
    return {r["conv_id"]: r for r in chat.read_back(chat.segments(frame(spark, rows).repartition(parts))).collect()}


def expected(rows):
    out = {}
    low = lambda x: (x is not None, x if x is not None else "")
    for c, _, role, text in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3]))):
        n, said, learned = out.setdefault(c, [0, "", ""])
        role, text = role or "", text or ""
        out[c] = [n + 1, said + f"{role}\n{text}\n", learned + (text if role == "assistant" else "")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(s), len(x), sha(x)) for c, (n, s, x) in out.items()}


def test_round_trip_of_hostile_texts(spark):
    draw = random.Random(5)
    bits = ["<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "|", "\n", "é", "😀", "user", "<\\s>", "<\\|end|>", "[\\\\INST]"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", None, "<|end|>", "a\nb"]),
             draw.choice([None, "".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))]))
            for c in [*range(40), None] for t in range(draw.randint(1, 9))]
    rows += [(3, 1, "user", "x"), (3, 1, "user", "x"), (4, None, "user", "null turn")]
    got, want = back(spark, rows), expected(rows)
    assert got.keys() == want.keys()
    for c, r in got.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want[c], c


def test_segments_hold_the_format(spark):
    rows = [(1, 0, "user", "</s> hi"), (1, 1, "assistant", "yes")]
    segments = sorted(chat.segments(frame(spark, rows)).collect(), key=lambda r: r["segment"])
    assert "".join(r["text"] for r in segments) == "<|turn|>user<|text|><\\/s> hi<|end|><|turn|>assistant<|text|>yes<|end|>"
    assert [r["text"] for r in segments if r["loss"]] == ["yes"]
    assert back(spark, rows)[1]["formatted_chars"] == sum(len(r["text"]) for r in segments)


@pytest.mark.parametrize("roles, valid", [
    (["user"], True), (["system", "user", "assistant"], True), (["user", "assistant", "user"], True), (["system"], False),
    (["assistant"], False), (["user", "user"], False), (["user", "system", "user"], False), (["user", "tool"], False)])
def test_turn_order(spark, roles, valid):
    assert back(spark, [(1, i, r, "t") for i, r in enumerate(roles)])[1]["valid"] is valid


def test_a_conversation_over_many_batches(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"<s>{i}" * 20) for i in range(25_000)] + [(2, 0, "user", "x" * 1_000_000)]
    got = back(spark, rows)
    assert got[1]["n_turns"] == 25_000 and got[1]["valid"]
    assert (got[1]["turns_sha256"], got[1]["loss_sha256"]) == (expected(rows)[1][1], expected(rows)[1][3])


def test_empty_table(spark):
    assert back(spark, []) == {}


def test_templates_that_cannot_be_reversed():
    for reserved in (("a\\b",), ("x",), ("<|", "<|end"), ("end|>x", "|>")):
        with pytest.raises(ValueError):
            chat.Template(reserved=reserved).check()

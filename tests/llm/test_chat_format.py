import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.llm.chat_format import CONTROLS, escape, format_chats, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, piece string"


@given(st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "INST]", "s>", "é", "\n", " "]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    out = escape(text)
    assert unescape(out) == text
    assert not any(c in out for c in CONTROLS)


def test_round_trip(spark):
    rng = random.Random(1)
    parts = [*CONTROLS, "ok", "\\", "é‍日", "\n\n", " ", "<|endoftext|>"]
    rows = []
    for conv in [None, 1, 2, 3]:
        for turn in range(rng.randint(1, 40)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "[INST]", None, ""]), rng.choice([None, "", "".join(rng.choices(parts, k=6))]), "x"))
    rows += [rows[3], (9, 0, "assistant", "z" * 30000, None)]
    got = {r["conv_id"]: r for r in read_back(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    for conv in (None, 1, 2, 3, 9):
        own = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 5


def test_masks_cover_assistant_texts_alone(spark):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", "")]
    a, b = format_chats(spark.createDataFrame(rows, SCHEMA)).orderBy("piece").collect()
    assert sum(a["loss_mask"]) == 0 and a["first"] and not b["first"]
    assert sum(b["loss_mask"]) == len(b["input_ids"])


def test_empty(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvaframe.llm import chat

BITS = st.sampled_from([*chat.CONTROLS, "\\", "<", "|", "[", "a", "é", "\n", " ", "<\\|turn|>", "/INST]"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>"]), st.lists(BITS, max_size=12).map("".join)), max_size=6))
def test_round_trip(turns):
    text, _ = chat.render(turns)
    assert chat.parse(text) == turns
    e = chat.tokenizer(chat.default_tokenizer()).encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
    mask = chat.token_mask(offsets, chat.render(turns)[1])
    assert [chat.unescape(x) for x in chat.masked_text(text, offsets, mask)] == [t for r, t in turns if r == "assistant" and t]


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant"]), rng.choice([None, "", " x ", "</s>[INST] ok [/INST]", "日本é\n", "a" * 5000])))
    rows += [(99, t, "assistant" if t % 2 else "user", f" word {t} " * 50) for t in range(300)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([(*r, "x") for r in shuffled], "conv_id long, turn long, role string, text string, formatted string")
    from sylvaframe.llm.common import written

    got = {r.conv_id: r for r in chat.summarise(written(chat.format_conversations(docs, part_chars=4000), "chat")).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = [(role, text or "") for c, _, role, text in rows if c == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.render(own)[0])


def test_empty_and_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.write_and_read(spark.createDataFrame([], schema)).count() == 0
    got = chat.write_and_read(spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", None)], schema)).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in got) == [("1", 1, 0), ("None", 1, 0)]


def test_parts_encode_as_the_whole(spark):
    """Parts end between turns, at special tokens: their ids and masks, one after the other, are those of one encoding. Equal turns and repeated rows stay."""
    rows = [(1, t // 2, "assistant" if t % 3 else "user", f"  Some words {t}, é日 and </s> more. ") for t in range(60)] + [(1, 5, "user", "same")] * 3
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = []
    for chars in (200, 10**9):
        parts = sorted(chat.format_conversations(docs, part_chars=chars).collect(), key=lambda r: r.part)
        got.append(([i for p in parts for i in p.ids], [m for p in parts for m in p.mask], "".join(p.formatted for p in parts), len(parts)))
    assert got[0][:3] == got[1][:3] and got[0][3] > 10 and got[1][3] == 1
    assert chat.summarise(chat.format_conversations(docs)).first().n_turns == 63

import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, part long, ids string, edge int"
TEMPLATE = chat.Template()


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def by_hand(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    escape, out = chat.Escape(TEMPLATE), {}
    for conv, turns in convs.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(TEMPLATE.opens + escape.escape(r) + TEMPLATE.between + escape.escape(t) + TEMPLATE.closes for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(whole))
    return out


ODD_TURNS = [
    (1, None, "user", "null first"), (1, 0, "assistant", None), (1, 1, None, "<s>\\</s>[INST] <|im_end|>"), (1, 2, "assistant", "<\\s> <\\\\/s> é日😀"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"),
    (2, 0, "assistant", ""), (3, 0, "assistant", " two\n"), (3, 1, "assistant", " in a row "), (4, 0, "<|im_sep|>", "role"), (None, 0, "assistant", "no id"), (None, 1, "user", "no id"),
    (5, 0, "assistant", "long " * 60_000), (6, 3, "assistant", "<"), (6, 4, "user", "|im_end|>"), (-1, 0, "user", "x"),
]


@pytest.mark.parametrize("segment_chars", [1, 50, 1 << 20])
def test_read_back_equals_the_turns(spark, segment_chars):
    rng = random.Random(3)
    pieces = ["<s>", "</s>", "[INST]", "<", "\\", "|im_start|>", "<|im_end|>", "word ", "é", "😀", "\n"]
    rows = ODD_TURNS + [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))) for c in range(20, 60) for t in range(rng.randrange(1, 12))]
    df = turns_table(spark, rows).repartition(3)
    formatted = chat.format_chats(df, PATH, segment_chars=segment_chars)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(formatted, PATH).collect()}
    assert got == by_hand(rows)


def test_mask_and_ids_of_one_conversation(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes, 日本 </s>"), (1, 2, "user", "ok"), (1, 3, "assistant", "bye")]
    row = chat.format_chats(turns_table(spark, rows), PATH).collect()[0]
    tokenizer = chat.ChatTokenizer(PATH, TEMPLATE)
    assert b"".join(tokenizer.bytes[i] for i in row.ids).decode() == row.text
    assert b"".join(tokenizer.bytes[i] for i, m in zip(row.ids, row.loss_mask, strict=True) if m).decode() == "yes, 日本 <\\/s>bye"
    controls = {tokenizer.inner.token_to_id(c) for c in TEMPLATE.controls}
    assert sum(i in controls for i in row.ids) == 3 * len(rows)
    assert not any(m for i, m in zip(row.ids, row.loss_mask, strict=True) if i in controls)


def test_segments_give_the_ids_of_the_whole(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} says é{t}") for t in range(30)]
    whole = chat.format_chats(turns_table(spark, rows), PATH).orderBy("part").collect()
    cut = chat.format_chats(turns_table(spark, rows), PATH, segment_chars=20).orderBy("part").collect()
    assert len(cut) > len(whole)
    for name in ("ids", "loss_mask"):
        assert sum((r[name] for r in cut), []) == sum((r[name] for r in whole), [])


def test_empty_table_and_probe(spark):
    none = turns_table(spark, [])
    assert chat.read_back(chat.format_chats(none, PATH), PATH).collect() == []
    probe = chat.format_and_read_back(chat.with_control_strings(none), PATH).collect()
    text = "</s>[INST] ok [/INST]"
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in probe] == [(-1, 2, len(text), hashlib.sha256(text.encode()).hexdigest())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "s>", "/s>", "[", "INST]", "|im_end|>", "|im_sep|>", "a", "\n"]), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escape = chat.Escape(TEMPLATE)
    safe = escape.escape(text)
    assert escape.unescape(safe) == text
    assert not any(c in safe for c in TEMPLATE.controls)


def test_controls_that_could_overlap_are_refused():
    with pytest.raises(ValueError):
        chat.Escape(chat.Template(foreign=("<a<",)))


def test_mask_takes_tokens_that_a_span_only_touches():
    import numpy as np

    starts, ends = np.array([0, 2, 4, 4, 6]), np.array([2, 4, 6, 6, 8])
    assert chat.mask_of(np.array([[3, 5]]), starts, ends).tolist() == [False, True, True, True, False]
    assert chat.mask_of(np.zeros((0, 2), np.int64), starts, ends).tolist() == [False] * 5

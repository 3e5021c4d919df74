import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgauge.llm import chat
from lexgauge.llm.queries import BYTES
from tests.llm import plain

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "</s>[INST] \\ [/INST]\\"),
    (1, 2, "assistant", ""),
    (1, 3, "assistant", "again <|endoftext|> 😀\n"),
    (2, 5, "judge [ROLE]", "odd role"),
    (2, None, None, None),
    (2, 7, "assistant", None),
    (3, 0, "assistant", "twice"),
    (3, 0, "assistant", "twice"),
    (None, 0, "tool", "no conversation"),
    (None, 1, "assistant", "x " * 20_000),
]


def expected(rows):
    out = {}
    key = lambda r: tuple((x is not None, x) for x in (r[1], r[2] or "", r[3] or ""))
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), plain.sha(whole), len(loss), plain.sha(loss))
    return out


def digests(table):
    chats = chat.format_chats(table, BYTES)
    return {r["conv_id"]: tuple(r)[1:5] for r in chat.digest_chats(chats, BYTES).collect()}


def test_odd_conversations(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    assert digests(table) == expected(ROWS)
    extra = table.selectExpr("text", "'x' AS ids", "role", "'y' AS loss_mask", "turn", "conv_id")
    assert digests(extra) == expected(ROWS)


def test_empty(spark):
    assert digests(spark.createDataFrame([], SCHEMA)) == {}


@given(st.text(alphabet=st.sampled_from("\\<s>/[INST]ROLEy\n"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_escape(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    # No control string is left without a backslash before it.
    at = 0
    while at < len(hidden):
        if hidden[at] == "\\":
            at += 2
            continue
        assert not hidden.startswith(tuple(chat.CONTROL), at)
        at += 1


def test_mask_is_the_prefix_sum_of_its_edges():
    template = chat.Template(100)
    turns = [("user", np.array([1]), np.array([5, 6])), ("assistant", np.array([2]), np.array([7, 8])), ("x", np.array([3]), np.array([9]))]
    ids, mask = chat.assemble(turns, template)
    assert ids.tolist() == [100, 105, 5, 6, 101, 106, 7, 8, 101, 102, 3, 103, 9, 101]
    assert ids[mask == 1].tolist() == [7, 8]

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import chat

PIECES = st.sampled_from([*chat.CONTROL, "\\", "<", "|", "[", "é", "日本", "😀", " ", "\n", "ok", "</", "s>", ""])
TEXT = st.lists(PIECES, max_size=12).map("".join)
TOKENIZER = chat.tokenizer(open(chat.VOCABULARY, encoding="utf-8").read())


@given(TEXT)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<s>"]), TEXT), min_size=1, max_size=6))
def test_round_trip_and_mask(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    coded = TOKENIZER.encode(formatted, add_special_tokens=False)
    import numpy as np

    starts, ends = np.array(coded.offsets).reshape(-1, 2).T
    kept = chat.mask(starts, ends, spans)
    assert kept.tolist() == [any(a <= s and e <= b and e > s for a, b in spans) for s, e in coded.offsets]
    assert list(chat.masked_text(formatted, starts, ends, kept)) == [t for r, t in turns if r == "assistant" and t]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_table(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", None), (1, 2, "assistant", "a\\b"), (1, 2, "assistant", "a\\b"), (2, None, None, None), (2, 1, "assistant", "Ünï 😀" * 300), (None, 0, "assistant", "x"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = chat.digests(chat.format_chats(df)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(rows) and len(got) == 4
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", ""]), TEXT), min_size=1, max_size=8))
def test_pieces_encode_as_the_whole(turns):
    formatted, _ = chat.render(turns)
    whole = TOKENIZER.encode(formatted, add_special_tokens=False)
    for piece in (1, 30, 1 << 20):
        ids, starts, ends = chat.encode(TOKENIZER, formatted, piece)
        assert ids.tolist() == whole.ids and list(zip(starts.tolist(), ends.tolist())) == whole.offsets


def test_long_conversation_is_one_row(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], "wörd <s> " * 20_000) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_chats(df).persist()
    assert found.count() == 1 and found.first().n_turns == 40
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(found).collect()} == expected(rows)

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.chat import SPECIAL, assemble, disassemble, encode, encoder, escape, format_chat, unescape


@pytest.fixture(scope="module")
def coder():
    return encoder()


TEXT = st.one_of(st.text(max_size=40), st.lists(st.sampled_from([*SPECIAL, "<|", "|>", "\\", "<", "|", " a", "é"]), max_size=8).map("".join))


@given(TEXT)
def test_escapes_can_be_undone_and_leave_no_control_string(text):
    assert unescape(escape(text)) == text and not any(s in escape(text) for s in SPECIAL)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|end|>"]), TEXT), max_size=5))
def test_round_trip_and_mask(coder, turns):
    enc, reserved = coder
    ids, mask = assemble(enc, reserved, turns)
    assert disassemble(enc, reserved, ids) == turns
    assert sum(int(i) in reserved.values() for i in ids) == 3 * len(turns) + 1
    expected = []
    for role, text in turns:
        n = len(enc.encode_ordinary(escape(text)))
        expected += [0] * (2 + len(enc.encode_ordinary(escape(role)))) + [int(role == "assistant")] * (n + 1)
    assert mask.tolist() == [*expected, 0]


def test_long_text_is_cut_where_tokens_end(coder):
    text = "some wörds  and\n lines 123 " * 9000
    assert encode(coder[0], text) == coder[0].encode_ordinary(text)
    assert encode(coder[0], "x" * 100_000, 1000)


@pytest.mark.parametrize("text", ["a" + " " * 70_000 + "b  c" + "\n" * 70_000 + "d", " " * 70_001, "x " * 40_000 + "\t \u2003" * 30_000 + "y", "\x1c" * 70_000 + " z"])
def test_long_runs_of_blanks_encode_as_short_ones(coder, text):
    assert encode(coder[0], text) == encode(coder[0], text, 100) == coder[0].encode_ordinary(text)


@pytest.mark.parametrize("piece", [" ", "\n", ".", "x", "<|"])
def test_runs_of_millions_of_characters(coder, piece):
    text = "go " + piece * (5_000_000 // len(piece)) + " on"
    ids = encode(coder[0], escape(text))
    assert unescape(coder[0].decode(ids)) == text


def test_table_against_a_plain_version(spark, coder):
    """Ids and masks from the definition, turn by turn."""
    enc, reserved = coder
    rows = [(c, t, role, f"{role} says {t}\n\nin {c} <|end|> {'é' * t}") for c in range(6) for t, role in enumerate(["system", "user", "assistant"] * 2)]
    got = {r.conv_id: r for r in format_chat(spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")).collect()}
    for c in range(6):
        ids, mask = [], []
        for _, _, role, text in sorted(r for r in rows if r[0] == c):
            body = enc.encode_ordinary(text.replace("<|", "<\\|"))
            head = [reserved["<|start|>"], *enc.encode_ordinary(role), reserved["<|message|>"]]
            ids += [*head, *body, reserved["<|end|>"]]
            mask += [0] * len(head) + [int(role == "assistant")] * (len(body) + 1)
        assert got[c].ids == [*ids, reserved["<|endoftext|>"]] and got[c].mask == [*mask, 0]
        assert (got[c].n_turns, got[c].n_tokens, got[c].n_trained) == (6, len(ids) + 1, sum(mask))


def test_awkward_rows(spark, coder):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (3, None, "user", ""), (None, 0, "user", "lost"), (4, 0, "assistant", "ab " * 60_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as t", "3 as ids")
    got = {r.conv_id: r for r in format_chat(c).collect()}
    enc, reserved = coder
    assert sorted(got) == [1, 2, 3, 4]
    assert disassemble(enc, reserved, got[1].ids) == [("user", "a"), ("assistant", "b")]
    assert disassemble(enc, reserved, got[2].ids) == [("", "")] and got[2].n_trained == 0
    assert got[4].n_tokens == len(got[4].mask) == len(got[4].ids) and sum(got[4].mask) == got[4].n_trained > 60_000
    assert format_chat(c.limit(0)).count() == 0

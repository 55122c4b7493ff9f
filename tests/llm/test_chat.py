"""Template language, and formatting and reading back of conversations."""

import hashlib

import numpy as np
import pytest

from dunlake.llm import chat
from dunlake.llm.chat import TemplateError, compile_template, escape, escape_line, fold_body, format_conversations, parse, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, piece int"


def rendered(template, messages):
    fragments = list(compile_template(template)(messages))
    return "".join(t for t, _, _ in fragments), "".join(t for t, marked, _ in fragments if marked)


def test_language():
    messages = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yes"}]
    template = (
        "{{ 'a' + 'b' | upper }}{% for m in messages %}{% if loop.first and not loop.last %}first:{% elif m.role != 'user' or false %}other:{% else %}-{% endif %}"
        "{% generation %}{{ m.text | trim }}{% endgeneration %}{{ loop.index }}{% if (loop.last) == true %}.{% endif %}{% endfor %}"
    )
    assert rendered(template, messages) == ("aBfirst:Hi1other:yes2.", "Hiyes")
    assert rendered(template, []) == ("aB", "")


def test_folding():
    assert fold_body(parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{% elif true %}d{{ 'e' | upper }}{% else %}no{% endif %}f")) == [("text", "abcdEf")]
    assert fold_body(parse("{% if m.role == 'x' %}a{% elif true %}b{% else %}c{% endif %}"))[0][1][-1] == (("const", True), [("text", "b")])


@pytest.mark.parametrize("template", [
    "{{ message.__class__ }}", "{{ m.text.upper }}", "{{ m | system }}", "{{ m.role", "{% for m in messages %}", "{% endfor %}", "{% if m %}{% endfor %}",
    "{% import os %}", "{{ 1 + 1 }}", "{{ f(x) }}", "{% for m in a.b %}{% endfor %}", "{{ }}", "{{ 'a' 'b' }}", "{% else %}",
])
def test_sandbox(template):
    if template == "{{ m.role":
        assert rendered(template, []) == (template, "")  # an unfinished mark is text
        return
    with pytest.raises(TemplateError):
        compile_template(template)


def test_escape(rng):
    for _ in range(500):
        text = "".join(rng.choice(["<", "|", "\\", "n", "\n", "<|im_end|>", "<|im_start|>", "a"]) for _ in range(rng.randrange(12)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert unescape(escape_line(text)) == text and "<|" not in escape_line(text) and "\n" not in escape_line(text)


def expected(rows):
    out = {}
    key = lambda r: tuple((v is not None, v) for v in (r[1], r[2] or "", r[3] or ""))
    for conv_id in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv_id), key=key)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        chars = sum(len(f"<|im_start|>{escape_line(r[2] or '')}\n{escape(r[3] or '')}<|im_end|>\n") for r in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv_id] = (len(turns), digest(text), len(loss), digest(loss), chars)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in read_back(format_conversations(df)).collect()}
    assert got == expected(rows)


def test_conversations(spark, rng, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", 50)
    monkeypatch.setattr(chat.pieces, "__defaults__", (50,))
    bits = ["hi", "<|im_end|>", "<|im_start|>assistant", "\\", "\\n", "\n", "é🙂", " ", "|>"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 12)):
            text = None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
            role = rng.choice(["user", "assistant", "system", None, "x\ny", "<|im_end|>"])
            rows.append((c if c else None, t if rng.random() > 0.05 else None, role, text, 1))
    rows += rows[:5]
    check(spark, rows)


def test_hot_conversation_and_long_text(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}", 1) for t in range(3000)]
    check(spark, [*rows, (2, 0, "assistant", "x" * 600_000, 1), (3, 0, "user", "", 1)])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert format_conversations(df).collect() == [] and read_back(format_conversations(df)).collect() == []


def test_turns_up_to_the_end_of_each_piece(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "x" * (chat.PIECE_CHARS // c), 1) for c in (1, 2, 100) for t in range(6)]
    out = format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(2)).orderBy("conv_id", "piece").collect()
    found = {c: [r for r in out if r.conv_id == c] for c in (1, 2, 100)}
    assert [len(found[c]) for c in (1, 2, 100)] == [6, 3, 1]
    for pieces in found.values():
        turns = np.cumsum([r.text.count("<|im_start|>") for r in pieces]).tolist()
        assert [r.n_turns for r in pieces] == turns and turns[-1] == 6 and [r.piece for r in pieces] == list(range(len(pieces)))

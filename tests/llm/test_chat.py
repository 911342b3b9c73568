import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import chat
from tidewheel.llm.queries import _digests

TURNS = "conv_id long, turn long, role string, text string"


def render(source, messages=(), **names):
    return "".join(t for t, _ in chat.Template(source).render(list(messages), **names))


@pytest.mark.parametrize(
    "source, want",
    [
        ("plain", "plain"),
        ("{{ 'a' ~ 1 + 2 * 3 }}", "a7"),
        ("{{ (1 + 2) * 3 }}{# gone #}", "9"),
        ("{{ -3 // 2 }} {{ 7 % 4 }}", "-2 3"),
        ("{{ 'yes' if 1 < 2 and not false else 'no' }}", "yes"),
        ("{% if x == 'b' %}B{% elif x == 'a' %}A{% else %}C{% endif %}", "A"),
        ("{% set y = x | upper %}{{ y }}{{ y | length }}", "A1"),
        ("{{ 'a' in 'cat' }} {{ 'z' not in 'cat' }}", "True True"),
        ("{{ missing }}{{ missing | default('d') }}{{ missing.more[2] }}", "d"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role }}{{ ',' if not loop.last }}{% endfor %}", "1u,2a"),
        ("{{ 'a\\n' | replace('a', \"b\") }}", "b\n"),
        ("{{ \"}\" ~ '{' }}", "}{"),
    ],
)
def test_templates(source, want):
    assert render(source, [{"role": "u"}, {"role": "a"}], x="a") == want


@pytest.mark.parametrize(
    "source",
    [
        "{{ x.__class__ }}", "{{ _x }}", "{{ f() }}", "{% import os %}", "{% for x in y %}", "{{ 1 + }}", "{{ a b }}",
        "{{ x | eval }}", "{% if 1 %}{% endfor %}", "{{ 'open }}", "{% endif %}",
    ],
)
def test_what_templates_may_not(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_minus_takes_white_space():
    assert render("a {%- if true %} b{% endif %}") == "a b"
    assert render("a \n {{- 'x' -}} \n b {#- gone -#} c {{ -1 }}{{-2}}") == "axbc -12"
    assert render("{%- if true -%} a {%- endif -%}\n") == "a"


@pytest.mark.parametrize(
    "source", ["{{ 1 // 0 }}", "{{ 'a' * 100000000 }}", "{{ 'a' - 1 }}", "{{ 1 < 'a' }}", "{{ 2 | replace('a') }}"]
)
def test_constants_that_fail_are_template_errors(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_values_that_fail_are_template_errors():
    for source, x in (("{{ 1 // x }}", 0), ("{{ 'ab' * x }}", 10**9), ("{{ x * x }}", 1 << 600_000)):
        with pytest.raises(chat.TemplateError):
            render(source, x=x)
    assert render("{{ 'ab' * x }}{{ x * x }}", x=3) == "ababab9"
    assert render("{{ 2 * x }}", x=1.5) == "3.0"


def test_values_are_reached_by_key_only():
    assert render("{{ m.real }}{{ m.role }}", m={"role": "r"}) == "r"
    assert render("{{ n.real }}{{ s.upper }}", n=3, s="s") == ""


def test_folding_keeps_the_meaning_and_joins_text():
    source = "a{{ 'b' ~ 'c' }}{% if 1 > 2 %}no{% else %}d{{ x }}{% endif %}{{ 2 * 3 }}e"
    tree = chat.fold(chat.parse(source))
    assert tree == (chat.Output(chat.Const("abcd")), chat.Output(chat.Name("x")), chat.Output(chat.Const("6e")))
    assert render(source, x="X") == "abcdX6e"


@settings(deadline=None)
@given(st.text(alphabet="<|\\ab\n>", max_size=40))
def test_escaping_is_reversible_and_leaves_no_mark(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


def wanted(rows):
    """Digests by conversation, from the turns themselves."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        every = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    rows = chat.format_conversations(df).mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
    return {r[0]: tuple(r[1:5]) for r in rows.collect()}


ROWS = [
    (1, 0, "user", "hi <|im_end|>"),
    (1, 1, "assistant", "<|im_start|>assistant\nok <\\|"),
    (2, 1, "assistant", "b"),
    (2, 0, "system", None),
    (2, None, "user", ""),
    (3, 5, None, "é𝄞"),
    (3, 5, "a\nb<|im_sep|>", "x"),
    (3, 5, "a\nb<|im_sep|>", "x"),
    (None, 1, "assistant", "nobody"),
    (None, 0, "user", "asks"),
    (4, 0, "assistant", ""),
]


def test_what_is_read_back_is_what_was_said(spark):
    df = spark.createDataFrame(ROWS, TURNS).selectExpr("*", "'clash' piece", "'clash' loss")
    assert digests(df) == wanted(ROWS)


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    rows = [(7, i, "assistant" if i % 2 else "user", f"{i} " * 60000) for i in range(24)] + ROWS
    df = spark.createDataFrame(rows, TURNS)
    pieces = chat.format_conversations(df).where("conv_id = 7").collect()
    assert len(pieces) > 1 and [p["piece"] for p in pieces] == list(range(len(pieces)))
    assert sum(p["turns"] for p in pieces) == 24
    assert digests(df) == wanted(rows)


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool"]), st.text(max_size=20)), max_size=6))
def test_marks_cover_each_assistant_text(messages):
    out = list(chat.Template(chat.CHATML).render({"role": r, "content": t} for r, t in messages))
    marked = [chat.unescape(t) for t, generated in out if generated]
    assert marked == [t for r, t in messages if r == "assistant" and t]

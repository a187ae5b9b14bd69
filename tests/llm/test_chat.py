import random

import pytest

from keyloom.llm import chat as C

CHAT = C.ChatFormat()


def turn(role, text):
    return {"role": role, "text": text, "index": 0}


def test_round_trip_of_hostile_texts():
    rng = random.Random(6)
    parts = ["\\", "### ", "###", "#", ": ", ":", " ", "</turn>", "</turn", "<", "\n", "Assistant", "User", "é", "🙂", "a", "### Assistant: x</turn>\n"]
    for _ in range(3000):
        turns = [(rng.choice(["assistant", "user", "system", "", "User", "Assistant", "a: b", ":", "\\"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(3)]
        out, spans = CHAT.render([turn(*t) for t in turns])
        assert CHAT.read(out) == turns
        assert "".join(CHAT.unescape(out[a:b]) for a, b in spans) == "".join(text for role, text in turns if role == "assistant")
        cut = list(CHAT.parts([turn(*t) for t in turns], 1))
        assert "".join(x for x, _ in cut) == out and [t for x, _ in cut for t in CHAT.read(x)] == turns


def test_language():
    render = lambda source, **t: C.ChatFormat(source).render([turn("user", "hi") | t])[0]
    assert render("a{{ 'b' + 'c' | upper }}d") == "abCd"
    assert render("{% if role == 'user' and not turn.first %}x{% elif text != 'hi' or turn.first %}{{ text | title }}{% else %}z{% endif %}") == "Hi"
    assert C.parse("a{{ 'b' + 'c' }}{% if 'x' == 'x' %}d{% else %}{{ text }}{% endif %}").parts == [C.Node("constant", "abcd")]
    assert C.ChatFormat("{% generation %}{{ text }}{% endgeneration %}!").render([turn("user", "hi")]) == ("hi!", [(0, 2)])
    for bad in ("{% if role %}", "{{ __import__ }}", "{{ text.x }}", "{% for x in y %}", "{{ text | eval }}", "{{ (text }}", "{% else %}"):
        with pytest.raises(C.TemplateError):
            C.parse(bad)


def test_table(spark):
    rows = [(1, 2, "assistant", "b", 0), (1, 1, "user", "a", 0), (1, 1, "user", "a", 0), (2, None, None, None, 0), (2, 0, "assistant", "x" * 300000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df, CHAT), CHAT).collect()}
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\na\nuser\na\nassistant\nb\n") and got[1].loss_sha256 == sha("b")
    assert got[2].loss_chars == 300000 and got[2].turns_sha256 == sha("\n\nassistant\n" + "x" * 300000 + "\n")
    assert C.read_back(C.format_conversations(df.limit(0), CHAT), CHAT).count() == 0


def test_loops_and_precedence():
    chat = C.ChatFormat("<s>{% for turn in turns %}{% if turn.first %}[{% else %},{% endif %}{{ turn.text }}{% if last %}]{% endif %}{% endfor %}</s>")
    assert chat.render([turn("user", x) for x in "abc"])[0] == "<s>[a,b,c]</s>" and chat.render([])[0] == "<s></s>"
    render = lambda source: C.ChatFormat(source).render([turn("user", "hi")])[0]
    assert render("{% if not role == 'assistant' %}x{% else %}y{% endif %}") == "x"
    assert render("{% if not role == 'user' or text == 'hi' and not not first %}x{% endif %}") == "x"
    whole = C.ChatFormat("{% generation %}{% for turn in turns %}{{ text }}{% endfor %}{% endgeneration %}")
    assert whole.render([turn("a", "x"), turn("b", "yz")]) == ("xyz", [(0, 3)])
    for bad in ("{% for turn in turns %}{% for turn in turns %}{% endfor %}{% endfor %}", "{% for turn in turns %}", "{% for x in turns %}{% endfor %}", "{{ turn.x }}"):
        with pytest.raises(C.TemplateError):
            C.parse(bad)


def test_other_templates_are_read_back():
    source = (
        "<begin>{% for turn in turns %}{% if turn.role == 'system' %}<<S>>{{ text | escape }}<</S>>{% elif role == 'user' %}[I]{{ text | escape }}[/I]"
        "{% elif role == 'assistant' %}{% generation %}{{ text | escape }}<e>{% endgeneration %}{% else %}<{{ role | escape }}|{{ text | escape }}>{% endif %}{% endfor %}<end>"
    )
    chat = C.ChatFormat(source, ("<", ">", "[", "]", "|"), {})
    turns = [("system", "be <<S>> nice"), ("user", "[/I] \\ x"), ("assistant", "a<e>b"), ("tool", "1|2>"), ("user", "")]
    out, spans = chat.render([turn(*t) for t in turns])
    assert chat.read(out) == turns
    assert [chat.unescape(out[a:b]) for a, b in spans] == ["a<e>b<e>"]
    with pytest.raises(C.TemplateError):
        C.ChatFormat("{{ text }}").read("x")


def test_long_conversations_stream(spark, monkeypatch):
    rows = [(i % 2, i, "assistant" if i % 4 > 1 else "user", f"text {i} " + "y" * 5000) for i in range(1200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    parts = C.format_conversations(df, CHAT)
    assert parts.groupBy("conv_id").count().where("count > 2").count() == 2  # several parts each
    for got in (C.read_back(parts, CHAT), C.read_back(parts, CHAT, in_order=True)):
        got = {r.conv_id: r for r in got.collect()}
        for c in (0, 1):
            own = [x for x in rows if x[0] == c]
            assert got[c].n_turns == len(own)
            assert got[c].loss_chars == sum(len(t) for _, _, r, t in own if r == "assistant")

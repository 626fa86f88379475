import random

import brute
from gridloom.llm import chat

BITS = ["</s>", "[INST] ", "[INST]", " [/INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "<s>", "[ROLE]", "[SAYS]", "[/ROLE]", "\\", "\\\\", "<", "[", "/", "]", ">", "s", " ", "\n", "hi", "é", "日"]


def test_reading_back_is_the_inverse():
    rng = random.Random(6)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", text()]), text()) for _ in range(rng.randint(0, 5))]
        parts = chat.DEFAULT.walk(turns)[0]
        formatted = "".join(t for t, _ in parts)
        assert chat.DEFAULT.read(formatted) == turns
        assert "".join(chat.DEFAULT.unescape(t) for t, loss in parts if loss) == "".join(t for r, t in turns if r == "assistant")
        for _, t in turns:
            assert not any(c in chat.DEFAULT.escape(t) for c in chat.DEFAULT.controls)


def test_query_as_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice([None, "", "a</s>", "x" * 100000, "hello\\"])) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(40, 0, "user", "twice"), (40, 0, "user", "twice"), (41, None, "assistant", "null turn first"), (41, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat.format_conversations(spark, df)
    back = formatted.mapInArrow(chat.partial(chat._read_back, template=chat.DEFAULT), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
    got = sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in back.collect())
    assert got == sorted(brute.chat(rows))
    assert chat.format_conversations(spark, df.limit(0)).collect() == []


def test_machine_names_the_first_turn_out_of_order():
    def walk(*roles):
        return chat.DEFAULT.walk([(r, "t") for r in roles])[1:]

    assert walk("user", "assistant") == (None, True) and walk("system", "user", "assistant", "user", "assistant") == (None, True)
    assert walk("assistant") == (0, True) and walk("user", "user") == (1, False) and walk("user") == (None, False)
    assert walk() == (None, False) and walk("user", "tool") == (1, False) and walk("user", "system", "user", "assistant") == (1, True)


def test_segments_are_what_transitions_emit():
    assert chat.DEFAULT.walk([("user", "a"), ("assistant", "b")])[0] == [("<s>", False), ("[INST] ", False), ("a", False), (" [/INST]", False), ("[ANS]", False), ("b", True), ("</s>", False)]
    own = chat.Template(start="", roles={"q": ("Q:", "\n", False), "a": ("A:", "\n", True)}, moves={"start": {"q": "asked"}, "asked": {"a": "start"}}, ends=frozenset({"start"}))
    assert own.walk([("q", "1"), ("a", "2")]) == ([("", False), ("Q:", False), ("1", False), ("\n", False), ("A:", False), ("2", True), ("\n", False)], None, True)


def test_planted_conversation(spark):
    rows = {r.conv_id: r for r in chat.op4_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    r = rows[-7]
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), brute.sha(said))
    assert r.turns_sha256 == brute.sha(f"user\n{said}\nassistant\n{said}\n")

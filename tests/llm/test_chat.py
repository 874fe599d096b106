import hashlib
import random

from fileloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, t int"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[TURN]", "[ROLE]", "[:]", "[/ROLE]", "\\", "[", "<", "]", "INST]", "s>", "ok", "\n", " ", "$1", "é", ""]


def test_exact_round_trip(spark):
    rng = random.Random(5)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "[:]x</s>"])
            rows.append((c if c else None, rng.randint(0, 4), role, rng.choice([None, "".join(rng.choices(PIECES, k=rng.randint(0, 9)))]), "x", 1))
    rows += [(7, 0, "user", "same", None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    turns = {r.conv_id: [(x.role, x.text, x.masked) for x in r.turns] for r in chat.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert turns[c] == [(role, text, role == "assistant") for _, role, text in own]
        loss = "".join(text for _, role, text in own if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_template(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "user", "b </s>"), (1, 3, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "[ROLE]system[:]be kind[/ROLE][INST]a[TURN]b <\\/s>[/INST]<s>c</s>"


def test_empty(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ties_and_long_texts(spark):
    """Rows of the same turn are in order of what they say, not of how it is escaped; a long text comes back whole."""
    long = "[INST] a </s> \\ é\n" * 50_000
    rows = [(1, 0, "user", "[Z"), (1, 0, "user", "[INST]"), (1, 0, "user", "[INSA"), (2, 0, "assistant", long), (2, 1, "assistant", "")]
    back = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    said = {r.conv_id: [t.text for t in r.turns] for r in back.collect()}
    assert said == {1: ["[INSA", "[INST]", "[Z"], 2: [long, ""]}

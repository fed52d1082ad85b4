import hashlib
import random

from sluice.llm import chat as C
from tests.conftest import SF

ODD = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE] x", "%", "%3C", "%25", "%0A", "<", "[", "/s>", "\n", " ", "é😀", "]", "s>", "\\", "$1"]


def told(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def allowed(roles):
    state = "start"
    for r in roles:
        state = r if (state, r) in C.STEPS else "bad"
    return state in C.FINAL


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(1)
    mixed = lambda: "".join(rng.choice(ODD) for _ in range(rng.randrange(8)))
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "", None, mixed()]), rng.choice([None, mixed(), mixed()])) for c in range(200) for t in range(rng.randrange(1, 6))]
    rows += [(None, None, None, None), (None, 1, "user", "x" * 300_000), (500, 1, "user", "a"), (500, 1, "user", "a"), (501, 0, "user", "q"), (501, 1, "assistant", "a"), (501, 2, "user", "q")]
    chats = C.format_chats(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string"))
    chats = chats.withColumn("parsed", C.parse_chats(chats.formatted)).withColumn("learned", C.loss_text(chats.segments)).collect()
    assert len(chats) == len({r[0] for r in rows})
    for chat in chats:
        own = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == chat.conv_id)
        turns = [(r, x) for _, r, x in own]
        assert [tuple(p) for p in chat.parsed] == turns
        assert chat.learned == "".join(x for r, x in turns if r == "assistant")
        assert chat.valid == allowed([r for r, _ in turns])
        assert "".join(s.text for s in chat.segments) == chat.formatted
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    chats = {}
    for r in sorted(rows, key=lambda r: r.turn):
        chats.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    chats[-1] = [("user", C.PLANTED), ("assistant", C.PLANTED)]
    got = {r.conv_id: r for r in C.op9_chat_fsm(spark, SF).collect()}
    assert got.keys() == chats.keys()
    for c, turns in chats.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(turns), told(turns), len(learned))
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()

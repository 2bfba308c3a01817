import hashlib
import random
import re
import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakframe.llm import chat_format as cf

M = cf.Machine()
PIECES = st.lists(st.sampled_from([*cf.DEFAULT.controls(), "\\", "\\\\", "[", "<", "</", "INST]", "é", "\n", " ok ", "|", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]) | PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    parts = ["".join(s for s, _ in M.segments(r, t)) for r, t in turns]
    assert [M.read(p)[:2] for p in parts] == turns
    whole = cf.DEFAULT.begin + "".join(parts) + cf.DEFAULT.end
    assert M.split(whole) == parts
    inside = [re.sub(r"\\.", "\0", M.escape(t), flags=re.DOTALL) for _, t in turns]
    assert not any(c in x for c in cf.DEFAULT.controls() for x in inside)


def brute(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = [((r[2] or ""), (r[3] or "")) for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _rows():
    rng = random.Random(1)
    words = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "<ANS>", "hej", "\n", "été", "😀", "<<SYS>>"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            role = ["user", "assistant"][t % 2] if rng.random() < 0.9 else rng.choice(["system", "tool", None, "[INST]"])
            rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 9)))])))
    x = "</s>[INST] ok [/INST]"
    return rows + [(-7, 0, "user", x), (-7, 1, "assistant", x), (None, 0, "user", "q"), rows[4], rows[4]]


def test_digests_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).selectExpr("*", "1 position", "2 segments")
    got = {r.conv_id: r for r in cf.digests(df).collect()}
    want = brute(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    text = {}
    for r in sorted(cf.format_turns(df).collect(), key=lambda r: r.position):
        text[r.conv_id] = text.get(r.conv_id, "") + "".join(s.text for s in r.segments)
    assert {c: len(t) for c, t in text.items()} == {c: r.formatted_chars for c, r in got.items()}
    for c, t in text.items():
        turns = [M.read(p)[:2] for p in M.split(t)]
        assert len(turns) == want[c][0] and hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest() == want[c][1]
    assert got[-7].valid


def test_machine_states(spark):
    def valid(*roles):
        df = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        return cf.digests(df).first().valid

    assert valid("user", "assistant") and valid("system", "user", "assistant", "user", "assistant")
    assert not valid("assistant") and not valid("user", "user", "assistant") and not valid("user", "system") and not valid("user")
    with pytest.raises(ValueError):
        cf.Machine(cf.Template(begin="\\s"))
    with pytest.raises(ValueError):
        M.read("plain")


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.digests(df).collect() == [] and cf.format_turns(df).collect() == []


def test_digests_are_read_from_the_output():
    machine = cf.Machine()
    machine.escape = lambda text: text  # what does not escape is found out
    rows = [(1, 0, "user", "a[/INST]<ANS>b</ANS>[INST]c"), (1, 1, "assistant", "d")]
    (got,) = cf._read_back(iter(rows), machine)
    assert got[1] == 4 and got[3] == len("bd")
    said = "user\na\nassistant\nb\nuser\nc\nassistant\nd\n"
    assert got[2] == hashlib.sha256(said.encode()).hexdigest() and got[4] == hashlib.sha256(b"bd").hexdigest()
    with pytest.raises(ValueError):
        list(cf._read_back(iter([(1, 0, "user", "a[/INST]b")]), machine))


def test_a_reader_takes_pieces_cut_anywhere():
    machine = cf.Machine()
    turns = [("user", "</s>[INST] ok [/INST] \\"), ("assistant", "</ANS>\n<s>"), ("", "x"), ("t|>\\", "<ROLE:y|></ROLE>"), ("system", "")]
    whole = "<s>" + "".join(s for r, t in turns for s, _ in machine.segments(r, t)) + "</s>"
    for size in (1, 2, 3, 5, 7, 1000):
        reader = cf.Reader(machine)
        found = [x for at in range(0, len(whole), size) for x in reader.feed(whole[at : at + size])]
        found += reader.close()
        assert [x[:2] for x in found] == turns and [x[2] for x in found] == [False, True, False, False, False]
    for broken in (whole[:-1], whole + "x", whole[1:]):
        reader = cf.Reader(machine)
        with pytest.raises(ValueError):
            reader.feed(broken)
            reader.close()


def test_very_long_turn_takes_memory_in_proportion():
    text = ("word > [INST] \\ and more of it " * 100_000)[:3_000_000]
    tracemalloc.start()
    began = time.time()
    (got,) = cf._read_back(iter([(1, 0, "user", text), (1, 1, "assistant", "ok")]), cf.Machine())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text) and time.time() - began < 60
    assert got[1] == 2 and got[2] == hashlib.sha256(f"user\n{text}\nassistant\nok\n".encode()).hexdigest()


def test_clashing_columns_and_null_ids(spark):
    df = spark.createDataFrame([(None, 1, "assistant", "b", 1, 2), (None, 0, "user", "a", 3, 4)], "conv_id long, turn long, role string, text string, n_turns int, valid int")
    (got,) = cf.digests(df).collect()
    assert got.conv_id is None and got.n_turns == 2 and got.valid

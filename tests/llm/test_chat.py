import random

import numpy as np

from gradus.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, roles int"


def conversations(n=120, seed=2):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        if draw.random() < 0.3:
            rows.append((conv, turn, "system", "follow " + "rule " * draw.randrange(20, 30), 0))
            turn += 1
        for i in range(draw.randrange(2, 7)):
            if i % 2 == 0:
                rows.append((conv, turn, "User ", "ask " * draw.randrange(2, 8) + "?", 0))
            else:
                rows.append((conv, turn, "assistant", "say " * draw.randrange(60, 90) + "\n" + "more " * 50, 0))
            turn += 1
    return rows


def model(spark):
    return C.learn(C.records(spark.createDataFrame(conversations(), SCHEMA)))


def test_roles_of_held_out_transcripts(spark):
    table = spark.createDataFrame(conversations(), SCHEMA)
    got = C.format_chats(table).collect()
    assert len(got) == table.count()
    right = [r.roles == r.given for r in got]
    assert sum(right) > 0.97 * len(right)
    assert all(r.n_turns == 1 and r.rendered.startswith(f"<|{r.roles}|>\n") for r in got if r.roles in C.ROLES)


def test_markers_and_odd_rows(spark):
    rows = [
        (1, 0, None, "System: be nice\nUser: hello?\nAssistant: hi\nmore lines\nUser: bye", 0),
        (None, None, None, "text", 0),
        (None, None, None, "text", 0),
        (2, 0, "user", None, 0),
        (2, 1, "user", " \n ", 0),
        (3, 5, "user", "x " * 60_000, 0),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.turn): r for r in C.format_chats(table, model(spark)).collect()}
    assert len(got) == 5
    assert got[1, 0].roles == "system,user,assistant,user"
    assert got[1, 0].rendered.split("<|end|>")[2].strip() == "<|assistant|>\nhi\nmore lines"
    assert got[2, 0].n_turns == got[2, 1].n_turns == 0 and got[2, 0].rendered == ""
    assert got[None, 0].n_turns == 1
    assert C.format_chats(table.limit(0), model(spark)).count() == 0
    assert C.format_chats(table.limit(0)).count() == 0


def test_decoding_equals_all_paths():
    draw = np.random.default_rng(4)
    log = lambda *shape: np.log(draw.random(shape))
    fitted = C.Model(log(C.STATES), log(C.STATES, C.STATES), log(2, C.STATES), log(C.LENGTHS, C.STATES), log(2, C.STATES))
    codes = draw.integers(0, 4 * 2 * C.LENGTHS * 2, 5)
    emitted = fitted.emit(codes)
    paths = np.array(np.meshgrid(*[range(C.STATES)] * 5)).reshape(5, -1).T

    def score(path):
        total = fitted.start[path[0]] + emitted[0, path[0]]
        for i in range(1, 5):
            total += fitted.move[path[i - 1], path[i]] + emitted[i, path[i]]
        return total

    best = max(paths, key=score)
    assert list(fitted.decode(codes, C.STATES, -1)) == list(best)
    # Two chunks and their matrices give the same path.
    edges = C.edges([fitted.matrix(codes[:2]), fitted.matrix(codes[2:])], fitted)
    parts = [fitted.decode(part, *edge) for part, edge in zip((codes[:2], codes[2:]), edges, strict=True)]
    assert list(np.concatenate(parts)) == list(best)


def test_long_transcripts_are_decoded_as_one(spark, monkeypatch):
    rows = [(9, i, None, "word " * (5 + (i * 7) % 60) + f"\nnext {i}" + ("?" if i % 3 else ""), 0) for i in range(700)]
    table, fitted = spark.createDataFrame(rows, SCHEMA), model(spark)
    codes = [C.observe(r[3]) for r in rows]
    states = [int(s) for s in fitted.decode(np.concatenate(codes), C.STATES, -1)]
    want, at = [], 0
    for row, own in zip(rows, codes, strict=True):
        want.append(",".join(C.render(row[3], states[at : at + len(own)])[1]))
        at += len(own)
    for turns, crowd in [(512, 4096), (64, 4096), (512, 50)]:
        monkeypatch.setattr(C, "CHUNK_TURNS", turns)
        monkeypatch.setattr(C, "CHUNK_RECORDS", crowd)
        got = C.format_chats(table, fitted).orderBy("turn").collect()
        assert [r.roles for r in got] == want


def test_no_record_is_lost(spark, monkeypatch):
    rows = [
        (1, None, "user", "yes", 0),
        (1, None, "user", "yes", 0),
        (1, None, "assistant", "yes", 0),
        (1, 3, None, "same", 0),
        (1, 3, "user", "same", 0),
        (None, None, "user", "alone", 0),
        (None, None, "assistant", "alone", 0),
        *[(None, 1, "user", "hot", 0)] * 25,
        *[(2, 1, "user", None, 0)] * 3,
    ]
    fitted = model(spark)
    for most in (100_000, 4):
        monkeypatch.setattr(C, "COPIES_A_TASK", most)
        got = C.format_chats(spark.createDataFrame(rows, SCHEMA), fitted).collect()
        key = lambda conv, turn, role: (conv or -1, turn or 0, role or "")
        assert sorted(key(r.conv_id, r.turn, r.given) for r in got) == sorted(key(*r[:3]) for r in rows)
        assert got[0].__fields__ == ["conv_id", "turn", "given", "roles", "n_turns", "rendered"]
        # A record without a transcript is decoded by itself.
        assert len({(r.roles, r.rendered) for r in got if r.conv_id is None and "hot" in r.rendered}) == 1

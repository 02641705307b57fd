import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

from voxelmill.llm import conversation_repair as cr
from voxelmill.llm import queries

SCHEMA = "key string, text string, turn long, conv_id long, role string, at long"
LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not kept else 2 if (role, text) in seen else 3 if kept[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired rows): the best of all edit strings, cheapest and then least in ASCII."""
    bad = faults(rows)

    def walks(i, initials, cost, audit, out, most):
        if cost > most[0]:
            return
        if i == len(rows):
            if LEGAL.fullmatch(initials):
                best.append((cost, audit, out))
                most[0] = min(most[0], cost)
        else:
            role, text = rows[i]
            extra = 1 if bad[i] == 3 else 0
            walks(i + 1, initials, cost + 3, audit + "D", out, most)
            if bad[i] not in (1, 2):
                if role[:1] in ("s", "u", "a"):
                    walks(i + 1, initials + role[:1], cost + extra, audit + "K", [*out, (role, text)], most)
                for made in ("user", "assistant"):
                    walks(i + 1, initials + made[0], cost + 2 + extra, audit + "R", [*out, (made, text)], most)
        if len(initials) < 2 * len(rows) + 2:
            for made in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", initials + made[0]):
                    walks(i, initials + made[0], cost + 2, audit + "I", [*out, (made, "")], most)

    best, most = [], [3 * len(rows)]
    walks(0, "", 0, "", [], most)
    return min(best, key=lambda b: b[:2])


def expected(conv):
    """The row of the query for one conversation's (turn, role, text) rows."""
    own = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    rows = [(r, x) for _, r, x in own]
    bad, turns = faults(rows), [t for t, _, _ in own if t is not None]
    cost, audit, out = brute(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return gaps, bad.count(1), bad.count(2), bad.count(3), illegal, cost, audit, sha


def random_rows(rng, n):
    texts = ["Yes.", "no", "", " \n", "What?", "cut off,", "ok!  ", None, "x:y.", "A\nB."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    return [(rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def found(spark, convs, chunk):
    rows = [("k", x, t, c, r, 9) for c, conv in convs.items() for t, r, x in conv]
    random.Random(1).shuffle(rows)
    return cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk)


@pytest.mark.parametrize("chunk", [2, 5, 256])
def test_equals_all_edit_strings(spark, chunk):
    rng = random.Random(2)
    convs = {c: random_rows(rng, rng.randint(1, 5)) for c in range(60)} | {None: random_rows(rng, 4), -7: random_rows(rng, 5)}
    got = cr.summary(found(spark, convs, chunk)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: expected(conv) for c, conv in convs.items()}


def test_chunks_do_not_matter(spark):
    """Long conversations give the same edits whatever the chunks are."""
    rng = random.Random(3)
    convs = {c: [(k, rng.choice(["user", "assistant", "system"]), f"t{k if rng.random() < 0.9 else 0}" + rng.choice([".", "", "!"])) for k in range(n)] for c, n in enumerate([1, 700, 3, 250, 64, 65])}
    whole = sorted(map(tuple, cr.summary(found(spark, convs, 4096)).collect()))
    for chunk in (7, 64):
        assert sorted(map(tuple, cr.summary(found(spark, convs, chunk)).collect())) == whole


def test_rows_of_the_repaired_conversation(spark):
    rng = random.Random(4)
    convs = {c: random_rows(rng, 5) for c in range(20)}
    rows = cr.repaired(found(spark, convs, 3)).collect()
    for c in convs:
        own = sorted((r for r in rows if r.conv_id == c), key=lambda r: (r.at, r.step))
        assert LEGAL.fullmatch("".join(r.role[0] for r in own))
        assert all(r.text == "" and r.turn is None for r in own if r.edit == "I")


def test_speculative_vectors_converge(spark):
    """A conversation of many chunks takes few passes; one whose costs never become parallel takes as many as it needs."""
    rows = [(k // 400, k, ["user", "assistant"][k % 2], f"t{k}.") for k in range(4000)]
    made = cr.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    chunks = cr.chunk_rows(made, 16)
    ends, passes = cr.converge(chunks)
    assert passes <= 4
    by_chunk = {r.chunk: r for r in chunks.collect()}
    got = {r.chunk: r.ends for r in ends.collect()}
    vector = None
    for c in sorted(by_chunk, reverse=True):  # one after the other from the end
        want = np.array([vector]) if by_chunk[c].goes_on else np.array([cr.END])
        assert got[c] == want[0].tolist()
        frame = pd.DataFrame([by_chunk[c].asDict()])
        front = cr.Chunks(frame).backward(want)[0][0]
        vector = (front - front.min()).tolist()


def test_states_at_chunks(spark):
    rng = np.random.default_rng(5)
    to = rng.integers(0, 4, (50, 4)).tolist()
    maps = spark.createDataFrame([(k, t) for k, t in enumerate(to)], "chunk long, to array<int>").repartition(4)
    state, want = 0, []
    for t in to:
        want.append(state)
        state = t[state]
    for fan in (3, 1024):
        got = sorted(map(tuple, cr.entered(maps, 50, fan).collect()))
        assert [s for _, s in got] == want


def test_empty_and_nothing_left(spark):
    assert cr.summary(found(spark, {}, 256)).count() == 0
    turns = spark.createDataFrame([("k", "a.", 1, 5, "user", 9)], SCHEMA)
    got = cr.repaired_table(turns, cr.repair(turns.limit(0))).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three? x") for c in range(30) for t in [*range(8), None]]
    got = {}
    for r in cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, "One Two Three x")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got.get((c, t)) == want


def test_query_equals_sql(spark, duck, sf_dir):
    got = queries.op12_conversation_repair(spark, sf_dir)
    want = duck.sql(queries.ORACLE_SQL["op12_conversation_repair"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())

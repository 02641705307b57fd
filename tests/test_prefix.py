import random

import pytest
from pyspark.sql import functions as F

from voxelmill.operators import deck_parsing, deck_writing, prefix
from voxelmill.sources import readers


@pytest.mark.parametrize("seed", range(3))
def test_running_last_equals_a_window(spark, seed):
    """Groups within a part, over many parts, without any value, and a null group."""
    r = random.Random(seed)
    rows = [(g, n, r.choice("abc") if r.random() < share else None) for g, size, share in (("big", 400, 0.02), ("none", 60, 0), (None, 30, 0.3), *((f"s{k:02}", 3, 0.5) for k in range(40))) for n in range(size)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n int, v string").repartition(5)
    got = prefix.running_last(df, "g", "n", {"last": F.col("v"), "at": F.when(F.col("v").isNotNull(), F.col("n"))})
    want, last = {}, {}
    for g, n, v in sorted(rows, key=lambda row: (row[0] or "", row[1])):
        if v is not None:
            last[g] = (v, n)
        want[g, n] = last.get(g, (None, None))
    assert {(f.g, f.n): (f.last, f.at) for f in got.collect()} == want
    assert got.columns == ["g", "n", "v", "last", "at"]


def test_running_last_of_nothing(spark):
    assert prefix.running_last(spark.createDataFrame([], "g string, n int"), "g", "n", {"last": F.col("n")}).count() == 0


def test_headers_over_parts(spark):
    """A deck's header holds for its lines in later parts, and not for the next deck."""
    rows = [("a", n, "*Node" if n == 0 else f"{n}, 1, 2, 3") for n in range(300)] + [("b", 0, "1, 2"), ("b", 1, "*Assembly"), ("b", 2, "*Nset, nset=x"), ("b", 3, "5"), ("b", 4, "*End Assembly"), ("b", 5, "6")]
    found = {(f.deck, f.n): f for f in deck_parsing.headed(spark.createDataFrame(rows, "deck string, n int, line string").repartition(7)).collect()}
    assert all(found["a", n].keyword == "node" and found["a", n].at == 0 for n in range(300))
    assert found["b", 0].keyword is None and found["b", 3].keyword == "nset" and found["b", 3].inside and not found["b", 5].inside


@pytest.mark.parametrize("newline", ["\r\n", "\n"])
def test_line_ends(spark, tmp_path, newline):
    lines = spark.createDataFrame([("d", 0, k, 0, f"line {k}") for k in range(5)], "deck string, part int, n long, sub int, line string")
    deck_writing.write_lines(lines.coalesce(1), str(tmp_path / "decks"), **({} if newline == "\r\n" else {"newline": newline}))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "decks").glob("deck=d/part-*")))
    assert raw.decode() == "".join(f"line {k}{newline}" for k in range(5))
    back = readers.read_deck(spark, str(tmp_path / "decks" / "deck=d")).filter("line <> ''").collect()
    assert sorted(b.line for b in back) == [f"line {k}" for k in range(5)]

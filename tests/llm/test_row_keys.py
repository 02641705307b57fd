from collections import Counter

import pytest

import corpus_pipeline
from voxelmill.llm import exact_dedup

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN = [(1, "a text of its own"), (None, "no id but clean"), (None, "no id and other words"), (7, "one id, first text"), (7, "another text under the same id"), (8, "last")]


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_rows_without_an_id_of_their_own_stay(spark, stage):
    rows = [(k, t, "en", "a", 1) for k, t in CLEAN]
    copies = [(7, CLEAN[1][1], "en", "a", 1), (9, CLEAN[3][1], "en", "a", 1), rows[0]]
    kept = stage(spark, spark.createDataFrame([*rows, *copies], NAMES).repartition(3), "").collect()
    # the copy of a text without an id has one, so it stays in its place
    assert Counter((r[0], r[1]) for r in kept) == Counter([*[r for r in CLEAN if r != CLEAN[1]], (7, CLEAN[1][1])])


def test_longest_of_equal_rows_stays(spark):
    rows = [(1, "a b c", "en", "a", 1), (1, "a  b\n c", "en", "a", 1), (1, "abc", "en", "a", 1)]
    docs = spark.createDataFrame(rows, NAMES)
    found = exact_dedup.exact_dedup(docs, exact_dedup.new_index(spark))
    assert [r["text"] for r in exact_dedup.keep_groups(docs, found).collect()] == ["a  b\n c"]


def test_mix_repeats_rows_not_ids(spark):
    rows = [(k, t + " x" * 40, "en", "a", 1) for k, t in CLEAN] + [(1, CLEAN[0][1] + " x" * 40, "en", "a", 1)]
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, NAMES).repartition(3), "").collect()
    # one source: its target is its size, so each row comes once
    assert Counter((r[0], r[1]) for r in got) == Counter((r[0], r[1]) for r in rows)

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from voxelmill.llm import near_dedup

from .test_documents import brute_components

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=1):
    """Texts, and near copies of each with a few words edited, in chains and crowds."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    out = []
    for family in range(14):
        base = [word() for _ in range(260 if family == 0 else rng.randint(60, 260))]
        out.append(" ".join(base))
        for _ in range(100 if family == 0 else 6):
            now = list(base)
            for _ in range(rng.randint(1, 9)):
                now[rng.randrange(len(now))] = word()
            out.append(" ".join(now))
    return [*out, "one two", "One  two", "one two three", "", None, " \n"]


@pytest.mark.parametrize("crowd", [2, 64])
def test_near_components_against_all_pairs(spark, crowd):
    some = list(enumerate(texts()))
    got = near_dedup.near_components(spark.createDataFrame(some, "doc_id long, text string").repartition(3), crowd=crowd).collect()
    sets = {k: set(near_dedup.shingles(t, 5).tolist()) for k, t in some}
    alike = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    want = brute_components(list(sets.items()), alike)
    assert Counter(Counter(want.values()).values())[1] > 3 and max(Counter(want.values()).values()) > 50
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(some)
    assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())


def test_edited_copies_go(spark):
    """Copies with three words edited: 37 of the 40 pairs differ in 3 to 12 fingerprint bits."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        base = [f"w{x}" for x in rng.integers(0, 4000, 200)]
        edited = list(base)
        for at in rng.choice(200, 3, replace=False):
            edited[at] = "edited"
        rows += [(k, " ".join(base), "en", "a", 1), (100 + k, " ".join(edited), "en", "a", 1)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, NAMES).repartition(3), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_rare_pairs_keep_all_that_are_alike(spark):
    """Sets that share a large common part: pairs by their rarest shingles hold every pair that is alike, and far from all pairs."""
    rng = np.random.default_rng(4)
    common = list(range(40))
    sets = []
    for k in range(300):
        if k % 3 == 0:
            own = [int(x) for x in rng.integers(1000, 1 << 40, 60)]
        elif k % 3 == 1:  # as the one before, but for a few
            own = sets[-1][40:-3] + [int(x) for x in rng.integers(1000, 1 << 40, 3)]
        else:
            own = []
        sets.append(common + own)
    nodes = spark.createDataFrame([(k, len(s), k) for k, s in enumerate(sets)], "node long, n long, component long")
    grams = spark.createDataFrame(list(enumerate(sets)), "node long, grams array<long>")
    got = {(r.u, r.v) for r in near_dedup.rare_pairs(nodes, grams, 0.8).distinct().collect()}
    held = [set(s) for s in sets]
    alike = {(a, b) for a in range(300) for b in range(a + 1, 300) if len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])}
    assert alike <= got and len(alike) > 100 and len(got) < 12_000


def test_rare_pairs_of_a_family_are_hardly_more_than_its_links(spark):
    """Texts with 3 to 30 words of one base edited: most pairs share many shingles and are no links; they aren't made."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    sets = []
    for _ in range(160):
        now = list(base)
        for _ in range(rng.randint(3, 30)):
            now[rng.randrange(len(now))] = f"x{rng.randrange(1 << 30)}"
        sets.append(near_dedup.shingles(" ".join(now), 5).view(np.int64).tolist())
    nodes = spark.createDataFrame([(k, len(s), k) for k, s in enumerate(sets)], "node long, n long, component long")
    grams = spark.createDataFrame(list(enumerate(sets)), "node long, grams array<long>")
    got = {(r.u, r.v) for r in near_dedup.rare_pairs(nodes, grams, 0.8).distinct().collect()}
    held = [set(s) for s in sets]
    alike = {(a, b) for a in range(160) for b in range(a + 1, 160) if len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])}
    assert alike <= got and len(alike) > 20
    assert len(got) < 0.1 * 160 * 159 / 2 and len(got) < 6 * len(alike)


def test_parity_sketches_differ_in_no_more_bits_than_the_sets(spark):
    rng = np.random.default_rng(6)
    sets = [rng.choice(1 << 40, n, replace=False) for n in (0, 1, 5, 300, 5000)]
    sets += [np.concatenate([s[1:], s[:1] + 1]) for s in sets if len(s)]
    grams = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sets)], "k long, grams array<long>")
    rows = {r["k"]: r["bits"] for r in grams.select("k", near_dedup.parity(grams["grams"]).alias("bits")).collect()}
    bits = [sum((x % (1 << 64)) << (64 * k) for k, x in enumerate(rows[n])) for n in range(len(sets))]
    for a in range(len(sets)):
        for b in range(len(sets)):
            assert (bits[a] ^ bits[b]).bit_count() <= len({*sets[a].tolist()} ^ {*sets[b].tolist()})
    assert (bits[3] ^ bits[7]).bit_count() in {0, 2}

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelmill.session import fresh_path
from voxelmill.llm import components, exact_dedup, mixing, packing, simhash

from . import cases


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (5, 5), (None, 3), (300, 200), (300, 250)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 250: 200, 300: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_dedup_and_index(spark):
    docs, index = cases.frame(spark), exact_dedup.new_index(spark)
    rows = cases.rows()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    best = {k: min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0] for k, g in groups.items()}
    want = Counter((r[0], best[norm(r[1])], len(groups[norm(r[1])]), r[0] == best[norm(r[1])], hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    got = exact_dedup.exact_dedup(docs, index)
    assert Counter(map(tuple, got.drop("in_index").collect())) == want
    assert index.rows().count() == len(groups)
    # what comes again is held by the index, what is new is appended
    more = cases.frame(spark, [*rows[:10], (900, "something else", *[None] * 11)])
    again = exact_dedup.exact_dedup(more, index).collect()
    assert {r["doc_id"] for r in again if r["kept"]} == {900}
    assert index.rows().count() == len(groups) + 1
    on = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert on.rows().count() == len(groups) + 1
    plan = index.rows().join(index.rows().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    assert exact_dedup.exact_dedup(cases.empty(spark), exact_dedup.new_index(spark)).count() == 0


def test_keep_documents(spark):
    docs = cases.frame(spark)
    kept = exact_dedup.keep_documents(docs, spark.createDataFrame([(5,), (6,), (7777,)], "i long"))
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [5, 6]


def brute_fingerprint(text, words=3):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall("[^\x20\x09-\x0d]+", low)
    if not parts:
        return 0
    grams = [" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    root = {k: k for k, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(items):
        for b, y in items[:n]:
            if linked(x, y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k, _ in items}


def test_simhash(spark):
    rows = [r for r in cases.rows() if r[0] is not None]
    got = simhash.simhash_components(cases.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(sorted(prints.items()), lambda x, y: (x ^ y).bit_count() <= 2)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(k, f"{prints[k]:016x}", want[k]) for k in prints}
    assert simhash.simhash_components(cases.empty(spark)).count() == 0
    assert simhash.simhash_components(cases.frame(spark)).count() == len(cases.rows())


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_simhash_links_of_crowds(spark, crowd):
    rng = np.random.default_rng(crowd)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    prints = {b for b in base}
    for b in base:
        for _ in range(25):
            x = b
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd)
    pairs = [tuple(r) for r in edges.collect()]
    assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() <= 2 for u, v in pairs)
    links = set(pairs) | {(v, u) for u, v in pairs}
    got = brute_components([(x, x) for x in signed], lambda x, y: (x, y) in links)
    want = brute_components([(x, x) for x in signed], lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 2)
    assert got == want


def test_pivot_tables_find_all_close_pairs_and_discard_others(spark):
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 6, 8):
            for _ in range(6):
                x = b
                for bit in rng.choice(64, n, replace=False):
                    x ^= 1 << int(bit)
                prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    refs = simhash.references()
    table = spark.createDataFrame([(x,) for x in signed], "fp long").withColumn("row", simhash.pivot_row(F.col("fp"), refs))
    keyed = table.select("fp", "row", F.explode(simhash.pivot_keys(simhash.pivot_groups(F.col("row")))).alias("k")).select("fp", "row", "k.groups", "k.value")
    met = {tuple(r) for r in simhash.near_pairs(keyed, 64, 0).distinct().collect()}
    left = {tuple(r) for r in simhash.near_pairs(keyed, 2, len(refs)).distinct().collect()}
    bits = lambda u, v: ((u ^ v) & ((1 << 64) - 1)).bit_count()
    close = {(u, v) for k, u in enumerate(signed) for v in signed[k + 1 :] if bits(u, v) <= 2}
    assert close <= left < met and len(met - left) > len(left - close)


def test_permutations(spark):
    sizes = [1, 2, 3, 7, 64, 100, 1000]
    rows = spark.createDataFrame([(n, k, i) for n in sizes for k in range(3) for i in range(n)], "n long, k long, i long")
    got = rows.select("n", "k", mixing.permuted(F.col("i"), F.col("n"), F.col("k")).alias("p")).groupBy("n", "k").agg(F.sort_array(F.collect_list("p")).alias("p")).collect()
    assert len(got) == len(sizes) * 3 and all(r["p"] == list(range(r["n"])) for r in got)


def test_mix(spark):
    docs, rows = cases.frame(spark), cases.rows()
    got = mixing.mix(docs, block_words=16).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(totals.values()) - sum(3 * totals[s] for s in full)
        share = left / sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * totals[s] if s in full else weight[s] * share for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * totals[s]}
        if not over:
            break
        full |= over
    by_size = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_size[(r["source_size"], round(r["target"], 6))] += r["taken"]
    assert {(totals[s], round(target[s], 6)) for s in names} == set(by_size)
    assert all(abs(taken - t) <= 17 for (_, t), taken in by_size.items())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs, block_words=16).collect()))
    assert mixing.mix(cases.empty(spark)).count() == 0
    again = mixing.repeat_documents(docs, block_words=16)
    assert again.columns == docs.columns and max(Counter(r["doc_id"] for r in again.filter("doc_id <> 5").collect()).values()) <= 3


def test_shard_counts_are_multinomial_and_totals_exact(spark):
    want = {0: 6000, 1: 3000, 2: 990, 3: 10, 4: 0}
    need = spark.createDataFrame(list(want.items()), "n long, want long")
    seen = []
    for seed in range(3):
        slots = mixing.draw_slots(need, 500, seed).collect()
        assert sorted(r["slot"] for r in slots) == list(range(10_000))
        by = Counter((r["shard"], r["n"]) for r in slots)
        assert Counter(r["n"] for r in slots) == Counter({k: v for k, v in want.items() if v})
        for n, v in want.items():
            assert sorted(r["j"] for r in slots if r["n"] == n) == list(range(v))
        # chi-squared of 19 shards (the last ones take what is left) over the three large sources
        chi = sum((by[(s, n)] - 500 * want[n] / 1e4) ** 2 / (500 * want[n] / 1e4) for s in range(16) for n in range(3))
        assert 12 < chi < 60
        seen.append(tuple(sorted(by.items())))
    assert len(set(seen)) == 3


def test_source_targets_stop_at_three_times(spark):
    sized = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    assert got["b"] == 30 and got["c"] == 3 and got[None] == 0 and got["a"] == pytest.approx(978)


def test_word_tokenizer_equals_the_tokenizer(sf_dir):
    import duckdb
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    whole, fast = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = [r[1] or "" for r in cases.rows()] + [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()]
    texts += ["It's 5pm!!! $$$don't", "÷×ªºµßŸǅ", "x²½ _a_ b__c", "a'sb 'll"]
    for t, (ids, closes) in zip(texts, fast.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids
        assert all(0 < c <= len(ids) for c in closes)


def test_best_cuts_against_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        at = np.concatenate(([0], np.cumsum(rng.integers(1, 300, rng.integers(1, 12)))))
        cost = np.concatenate(([0.0], rng.choice([0.0, 16.0, 64.0], len(at) - 1)))
        window = 512
        best = [0.0] + [np.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = at[j] - at[i]
                if n <= window:
                    pad = 0 if n in (256, 512) else window - n
                    best[j] = min(best[j], best[i] + pad + cost[j])
        cuts = packing.best_cuts(at, cost, window)
        total, before = 0.0, 0
        for j in cuts:
            n = at[j] - at[before]
            assert 0 < n <= window
            total, before = total + (0 if n in (256, 512) else window - n) + cost[j], j
        assert cuts[-1] == len(at) - 1 and total == best[-1]


@pytest.mark.parametrize("run", [1 << 18, 6000])
def test_pack_round_trip(spark, run):
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = [r for r in cases.rows() if r[0] is not None and r[0] != 5]
    got = packing.pack(cases.frame(spark, rows), run=run).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] * 4 == len(r["tokens"]) > 0
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for r in rows:
        mine = sorted(pieces[r[0]], key=lambda p: p["start"])
        want = whole.encode(r[1] or "", add_special_tokens=False).ids + [2]
        assert np.concatenate([np.frombuffer(p["tokens"], "<u4") for p in mine]).tolist() == want
        assert [p["start"] for p in mine] == np.cumsum([0] + [p["length"] for p in mine])[:-1].tolist()
        assert {p["doc_tokens"] for p in mine} == {len(want)}
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == np.cumsum([0] + [p["length"] for p in s])[:-1].tolist()
        n = sum(p["length"] for p in s)
        assert n <= 4096
        total, padding = total + n, padding + (0 if n & (n - 1) == 0 else 4096 - n)
    # a task leaves at most one window unfilled; a run of hardly two windows leaves little choice
    assert run < 10_000 or padding < 3 * 4096 + 0.02 * total
    assert all(zlib.crc32(r["tokens"]) >= 0 for r in got)
    assert packing.pack(cases.empty(spark)).count() == 0


def test_tails_are_cut_where_documents_end():
    """What a task has left is one padded window, or windows of a power of two that end where a document or a sentence does."""
    for sizes in ([2047], [1500], [700, 800], [4096, 30], [512, 100], [5000, 90]):
        packer = packing.Packer(4096, 16.0, 64.0, 1 << 18)
        rows = [r for k, n in enumerate(sizes) for r in packer.add(k, np.arange(n), np.zeros(0, np.int64))]
        rows += packer.finish()
        ends = set(np.cumsum(sizes).tolist()) | {4096}
        total, filled = 0, {}
        for _, _, ids, _, sequence, _ in rows:
            filled[sequence] = filled.get(sequence, 0) + len(ids)
        for n in filled.values():
            total += n
            assert total in ends
        assert total == sum(sizes) and len(filled) <= len(sizes) + 1


def test_padding_is_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    sizes = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padding = sum(0 if r["n"] & (r["n"] - 1) == 0 else 4096 - r["n"] for r in sizes)
    assert padding < 0.015 * sum(r["n"] for r in sizes)


def test_word_tokenizer_at_every_latin_letter():
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    whole, fast = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = [form.format(chr(c)) for c in range(9, 0x250) for form in ("{0}", "ab{0}cd", "ab{0}{0}", "x {0}y z")]
    for t, (ids, _) in zip(texts, fast.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, hex(ord(max(t)))


def test_index_reopened_in_another_session_keeps_its_buckets(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    path = fresh_path(spark, "index")
    exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark, path, buckets=8)).collect()
    again = exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark, path)).collect()
    assert not any(r["kept"] for r in again) and all(r["in_index"] for r in again)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, buckets=5)


def test_known_chunks_are_looked_up_once():
    import public_tokenizers

    asked = []

    class Counted(dict):
        get = lambda self, *a: (asked.append(a[0]), dict.get(self, *a))[1]
        __contains__ = lambda self, k: (asked.append(k), dict.__contains__(self, k))[1]
        __getitem__ = lambda self, k: (asked.append(k), dict.__getitem__(self, k))[1]

    words = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    texts = ["One two. Three! Four", "", " two. five?  "]
    first = [(i.tolist(), c.tolist()) for i, c in words.encode(texts)]
    words.chunks.number = Counted(words.chunks.number)
    assert [(i.tolist(), c.tolist()) for i, c in words.encode(texts)] == first
    assert sorted(filter(None, asked)) == sorted({"one", "two.", "three!", "four", "five?"})
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    closes = [whole.encode(x, add_special_tokens=False).ids for x in ("One two.", "Three!")]
    assert first[0][1] == [len(closes[0]), len(closes[0]) + len(closes[1])]

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxelmill.llm import id_coder, queries, token_files
from voxelmill.session import fresh_path

SCHEMA = "doc_id long, text string"
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b\n", "x\n \ny", "x \n y", "tab\t b", "no break  space", "mark\x01 inside \x01", "<|endoftext|> and<|endoftext|>",
    "it's we'll 12 345 a1b2", "é à ü ß 日本語 テスト", " wide   space", "emoji 😀 😀😀", "\x1c \x1d x", "w" * 5000, "ab " * 3000, "a　b 　c",
]


def expected(rows, end=0):
    """doc_id, start, n_tokens, ids_crc32 by the tokenizer itself; rows in the order of the files."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def sample_ids():
    r = np.random.default_rng(5)
    words = r.integers(0, 50257, (300, 3))
    zipf = np.minimum(r.zipf(1.3, 40_000), 300) - 1
    return {
        "none": [], "one": [0], "same": [7] * 5000, "cycle": [1, 2, 3] * 2000, "wide": r.integers(0, 1 << 24, 9000), "words": words[zipf].ravel(), "largest": [(1 << 24) - 1, 0] * 300,
    }


@pytest.mark.parametrize("name", list(sample_ids()))
def test_block_round_trip(name):
    ids = np.array(sample_ids()[name], np.int64)
    block = id_coder.encode(ids)
    assert np.array_equal(id_coder.decode(block), ids)
    assert block == id_coder.encode(ids)
    if name == "words":  # order 1 and 2 pay: within a word of three ids the last two follow from the first
        entropy = np.log2(300) / 3
        assert 8 * len(block) / len(ids) < 2 * entropy


def test_orders_learn():
    r = np.random.default_rng(6)
    word = r.integers(0, 50257, (200, 3))
    ids = word[r.integers(0, 200, 60_000)].ravel()
    shuffled = r.permutation(ids)
    assert len(id_coder.encode(ids)) < 0.62 * len(id_coder.encode(shuffled))


def test_carries_and_small_blocks():
    r = np.random.default_rng(7)
    for n in [*range(1, 40), 127, 128, 129, 255, 256, 257, 1000]:
        ids = r.integers(0, r.integers(1, 60_000), n)
        assert np.array_equal(id_coder.decode(id_coder.encode(ids)), ids)


def test_corrupt_block():
    block = id_coder.encode(np.arange(3000))
    for k in (0, 5, 30, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[k] ^= 4
        with pytest.raises(id_coder.Corrupt):
            id_coder.decode(bytes(bad))
    for bad in (b"", block[:-1], block[:10]):
        with pytest.raises(id_coder.Corrupt):
            id_coder.decode(bad)


def test_chunks_equal_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = np.random.default_rng(8)
    signs = list("ab Z9.'\n\t é  日<|>\x01\x1c") + ["  ", " \n", "<|endoftext|>", "'ll"]
    texts = ODD + ["".join(r.choice(signs, r.integers(1, 60))) for _ in range(400)]
    words = token_files.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):  # new, and from the cache
        ids, counts = words.encode(pa.array(texts))
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_query_equals_tokenizer(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_token_output(spark, sf_dir)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect())) == expected(sorted(map(tuple, rows)))


def test_documents_over_many_blocks(spark):
    """Blocks of 50 ids: documents span blocks, begin at their edges, and are read from any of them."""
    texts = [*ODD, None, "one two three four five six seven eight nine ten " * 40]
    rows = [(n, t) for n, t in enumerate(texts)]
    path = fresh_path(spark, "ids")
    docs = spark.createDataFrame([(t, "x", n) for n, t in rows], "text string, part string, doc_id long").repartition(3)
    token_files.write_ids(docs, path, block=50)
    blocks = token_files.read_blocks(spark, path)
    assert sorted(map(tuple, token_files.documents(blocks).collect())) == expected(rows)
    assert blocks.count() > 20
    one = token_files.read_ids(blocks.filter("block = 1")).collect()  # alone
    assert one and all(p.length == len(p.ids) // 4 for p in one)


def test_null_and_repeated_ids(spark):
    rows = [(None, "first"), (None, None), (4, "b"), (4, "b"), (4, "a longer text"), (-1, "minus")]
    path = fresh_path(spark, "ids")
    token_files.write_ids(spark.createDataFrame(rows, SCHEMA), path)
    got = token_files.documents(token_files.read_blocks(spark, path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, n, c) for i, _, n, c in expected(rows))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, None, -1, 4, 4, 4]
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1].tolist()


def test_empty_table(spark):
    path = fresh_path(spark, "ids")
    token_files.write_ids(spark.createDataFrame([], SCHEMA), path)
    assert token_files.documents(token_files.read_blocks(spark, path)).count() == 0


def test_joined_crc32():
    data = np.random.default_rng(1).bytes(5000)
    cuts = [0, 0, 17, 1000, 5000]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert token_files.joined_crc32([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(data)

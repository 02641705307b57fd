"""Token ids of documents in compressed files, and back.

A file is a Parquet part of coded blocks (`id_coder`), written and committed by
Spark, so that a lost task leaves nothing behind. Parts follow each other in
ascending order of document id; within a part blocks do, and each block can be
read by itself: it lists the documents that begin in it, and where.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import id_coder
from .packing import Store

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: What may count as white space in the tokenizer's own splitting; more than that does no harm.
SPACE = "\t\n\v\f\r\x1c-\x1f \x85\xa0  -     　"
MARK, TAIL = "\x01", ".,;:!?"
CACHED, LONGEST_KEY, RUN = 350_000, 64, 1 << 20
BLOCKS = "part int, block int, first long, n_ids int, docs_before long, doc_ids array<bigint>, doc_starts array<int>, payload binary"
PIECES = "part int, doc long, doc_id long, begins boolean, first long, length int, ids binary"


class ChunkTokenizer:
    """Ids of whole texts with a bounded cache of chunks.

    A text is cut before each space that stands behind other than white space:
    no token of a byte-level tokenizer that splits at spaces crosses such a
    place. Each chunk's ids come from the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)  # ids that begin with a space
        self.opens[[n for name, n in names.items() if name[:1] == "Ġ"]] = True
        self.store, self.came = Store(), np.zeros(0, np.int32)

    def forget(self) -> None:
        """Start the cache anew with what came in several runs of texts."""
        names, often = list(self.store.number), np.flatnonzero(self.came[: len(self.store.number)] > 1)
        ids, _ = self.store.rows(often)
        lengths = self.store.length[often]
        self.store, self.came = Store(), np.zeros(0, np.int32)
        if 0 < len(often) < CACHED // 2:
            self.store.add([names[k] for k in often.tolist()], ids, lengths)

    def add(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the cache."""
        # such pieces may stand one behind the other in one text, in which their first tokens begin with a space and no others do
        words = [c for c in pieces if c[0] == " " and len(c) <= LONGEST_KEY and c.rfind(" ") == 0 and not c[-1].isspace() and "<|" not in c]
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) == len(some) and not begin[0]:
                self.store.add(some, ids, np.diff(begin, append=len(ids)))
        rest = [c for c in pieces if c not in self.store.number]
        if rest:
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self.store.add(rest, np.concatenate(got), np.array([len(x) for x in got]))

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of new chunks into the cache. What ends a word of letters is a piece of its own, as the tokenizer has it."""
        known, split, pieces = self.store.number, [], set()
        for c in chunks:
            word = c.rstrip(TAIL)
            if len(word) < len(c) and word[1:].isalpha():
                split.append((c, word, c[len(word) :]))
                pieces.update(split[-1][1:])
            else:
                pieces.add(c)
        self.add(sorted(pieces.difference(known)))
        if split:
            lengths = self.store.length[self.store.numbers([x for s in split for x in s[1:]])].reshape(-1, 2).sum(1)
            ids, _ = self.store.rows(self.store.numbers([x for s in split for x in s[1:]]))
            self.store.add([s[0] for s in split], ids, lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.store.number) > CACHED or self.store.used > 16 * CACHED:
            self.forget()
        texts = texts.cast(pa.large_string())
        # a line end between signs that aren't white space is a token of its own
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", MARK + "\n" + MARK)
        if pc.any(odd := pc.match_substring_regex(texts, f"[{SPACE}][{SPACE}]|^\n|\n$")).as_py():
            some = pc.replace_substring_regex(texts.filter(odd), f"([^{SPACE}]) ", "\\1" + MARK + " ")
            marked = pc.replace_with_mask(marked, odd, some)
        split = pc.split_pattern(marked, MARK)
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        coded = flat.dictionary_encode()
        names, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self.store.number
        number = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0).tolist()
        if some := [names[k] for k in new if names[k]]:
            self.learn(some)
            number[new] = np.fromiter(map(known.get, [names[k] for k in new], repeat(-1)), np.int64, len(new))
        if len(self.came) < len(known):
            self.came = np.concatenate([self.came, np.zeros(len(known), np.int32)])
        self.came[number[number >= 0]] += 1
        at = number[place] if len(place) else np.zeros(0, np.int64)
        lengths = np.where(at >= 0, self.store.length[at], 0)
        ids, _ = self.store.rows(at[at >= 0])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(ends[offsets])
        if pc.any(has := pc.match_substring(texts, MARK)).as_py():  # the mark itself: those texts go to the tokenizer whole
            own = [self.tokenizer.encode(t, add_special_tokens=False).ids if h else None for t, h in zip(texts.to_pylist(), has.to_pylist(), strict=True)]
            parts = np.split(ids, np.cumsum(counts)[:-1])
            parts = [p if o is None else np.array(o, np.uint32) for p, o in zip(parts, own, strict=True)]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


_tokenizers: dict[str, ChunkTokenizer] = {}


def runs(texts: pa.Array, most: int = RUN) -> Iterator[slice]:
    """Runs of texts of about `most` characters, one text at least."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        base = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, base + most, side="right")))
        yield slice(begin, end)
        begin = end


class Blocks:
    """Takes documents' ids in order, gives rows of BLOCKS."""

    def __init__(self, part: int, block: int):
        self.part, self.most = part, block
        self.held: list[np.ndarray] = []
        self.size = self.first = self.number = self.docs = 0
        self.ids: list[int | None] = []
        self.starts: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        self.ids += doc_ids
        self.starts += (self.first + self.size + np.cumsum(counts) - counts).tolist()
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.most:
            yield from self.give(last=False)

    def give(self, last: bool) -> Iterator[dict]:
        """Full blocks; with last also what is left."""
        ids, at = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32), 0
        while len(ids) - at >= self.most or (last and at < len(ids)):
            some = ids[at : at + self.most]
            at += len(some)
            n = int(np.searchsorted(self.starts, self.first + len(some)))
            yield {
                "part": self.part, "block": self.number, "first": self.first, "n_ids": len(some), "docs_before": self.docs, "doc_ids": self.ids[:n],
                "doc_starts": [s - self.first for s in self.starts[:n]], "payload": id_coder.encode(some.astype(np.int64)),
            }
            self.ids, self.starts = self.ids[n:], self.starts[n:]
            self.number, self.first, self.docs = self.number + 1, self.first + len(some), self.docs + n
        self.held, self.size = [ids[at:]], len(ids) - at


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, block: int = id_coder.BLOCK, text: str = "text", id: str = "doc_id") -> None:
    """Write the ids of all documents, each followed by END_ID, as files of
    blocks in the folder path, in ascending order of document id.

    A null text is empty: END_ID alone. Null ids come first. Rows that repeat an
    id are documents of their own, in the order of a hash of their text; rows
    that are equal in both may lie in several parts. An empty table writes no
    block. A task holds one run of texts and one block of ids, besides the batch
    of rows that Spark hands it. Other columns aren't read. tokenizer: path of a
    file of the tokenizers library with a byte-level pre-tokenizer; block: ids
    of a block, at most id_coder.BLOCK.
    """
    file = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("docs_before", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("payload", pa.binary()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _tokenizers:
            _tokenizers[file] = ChunkTokenizer(file)
        words, blocks = _tokenizers[file], Blocks(TaskContext.get().partitionId(), block)
        row = lambda x: pa.RecordBatch.from_pylist([x], schema)
        for batch in batches:
            for at in runs(batch["text"]):
                ids, counts = words.encode(batch["text"][at.start : at.stop])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(END_ID))
                yield from map(row, blocks.add(batch["doc_id"][at.start : at.stop].to_pylist(), ids, counts + 1))
        yield from map(row, blocks.give(last=True))

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the last key spreads rows that are equal in all columns; which of them goes where makes no difference
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.withColumns({"h": order[1], "n": order[2]})
    order = [order[0], F.col("h"), F.col("n")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    # small row groups, so that a file's blocks are read by several tasks
    placed.mapInArrow(work, BLOCKS).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def read_ids(blocks: DataFrame) -> DataFrame:
    """The pieces of documents in blocks: part, doc (number of the document in
    its part), doc_id (null where the piece goes on with a document of the block
    before), begins, first (ids of the part before it), length, ids
    (little-endian unsigned 32-bit). A block whose checksum is wrong is an error
    (id_coder.Corrupt). Any subset of the blocks can be read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, _, first, n, before, doc_ids, starts, payload = (batch.column(c)[k].as_py() for c in range(8))
                ids = id_coder.decode(payload).astype("<u4")
                if len(ids) != n:
                    raise id_coder.Corrupt(f"block at {first} of part {part} has {len(ids)} ids instead of {n}")
                goes_on = 0 if starts and not starts[0] else 1
                cuts = np.array([0] * goes_on + starts + [n], np.int64)
                m, begins = len(cuts) - 1, np.arange(len(cuts) - 1) >= goes_on
                binary = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, part, np.int32)), pa.array(before - goes_on + np.arange(m)), pa.array([None] * goes_on + doc_ids, pa.int64()),
                        pa.array(begins), pa.array(first + cuts[:-1]), pa.array(np.diff(cuts).astype(np.int32)), binary,
                    ],
                    names=PIECES.replace(",", "").split()[::2],
                )

    return blocks.mapInArrow(work, PIECES)


def joined_crc32(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of parts in a row, from the crc32 and the bytes of each."""
    import zlib

    def past(crc: int, n: int) -> int:
        for at in range(0, n, 1 << 20):
            crc = zlib.crc32(bytes(min(1 << 20, n - at)), crc)
        return crc

    total = crcs[0]
    for crc, n in zip(crcs[1:], sizes[1:], strict=True):
        total = past(total, n) ^ past(0, n) ^ crc
    return total


def documents(blocks: DataFrame) -> DataFrame:
    """One row for each document of all blocks of a folder: doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32. A document's pieces meet as
    lengths and checksums; its ids don't."""

    @F.pandas_udf("long")
    def crc32_of(pieces: pd.Series) -> pd.Series:
        return pd.Series([p[0]["crc"] if len(p) == 1 else joined_crc32([x["crc"] for x in p], [4 * x["length"] for x in p]) for p in pieces])

    pieces = read_ids(blocks).select("part", "doc", "doc_id", "first", F.struct("first", "length", F.crc32("ids").alias("crc")).alias("piece"))
    met = pieces.groupBy("part", "doc").agg(F.max("doc_id").alias("doc_id"), F.min("first").alias("first"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    # one row for each part
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    n = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return met.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), n.alias("n_tokens"), crc32_of("pieces").alias("ids_crc32"))

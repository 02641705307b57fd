"""Order-preserving packing of tokenised documents by dynamic programming.

Documents keep the order in which their table is read. A task walks over its own
part of the table, so no text is shuffled; the tokens of its documents are one
row of ids that is cut into windows of at most `window` tokens. Cuts between
documents are free, cuts after a sentence cost `sentence_cut` padding tokens,
and other cuts, used only where a sentence is longer than a window, `token_cut`.
The best cuts are found for a run of windows at a time, in one pass over the
boundaries with a monotone queue of the starts that can still win; the last run
of a task ends where its documents do, and its last window is padded.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Characters, in lower case, for which splitting into words here is sure to equal the tokenizer's own splitting.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: The tokenizer's words: contractions, runs of letters, single digits, runs of other signs.
LETTER, DIGIT, GAP = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾", "\t\n\r "
WORD = re.compile(f"[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{DIGIT}]|[^{LETTER}{DIGIT}{GAP}]+")
#: Chunks that a worker keeps at most; new ones of one run of texts come on top.
CACHED_WORDS = 300_000
CLOSES = "[.!?]$"
LONGEST_PIECE = 1 << 20


class Store:
    """Rows of ids of different lengths, by number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.begin, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = 0

    def add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.number), len(keys)
        while n + m > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + m] = lengths
        self.used += len(ids)
        self.number.update(zip(keys, range(n, n + m), strict=True))

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows in a row, and where each ends."""
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        many = int(ends[-1]) if len(at) else 0
        return self.ids[np.repeat(self.begin[at] - ends + lengths, lengths) + np.arange(many)], ends


class WordTokenizer:
    """Ids of whole texts, with bounded caches of words and of what stands
    between white space.

    The tokenizer splits lower-cased text into words and merges within each
    word only, so equal words have equal ids everywhere. Texts with characters
    or markers outside the plain case go to the tokenizer itself, in pieces cut
    at white space, which no token crosses.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.final = np.zeros(max(names.values()) + 1, bool)  # ids that end a word
        self.final[[n for name, n in names.items() if name.endswith("</w>")]] = True
        self.words, self.chunks = Store(), Store()

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        ids, lengths = [], []
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            # many words are merged in one call, as a text
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.final[got]) + 1
            if len(ends) == len(some) and ends[-1] == len(got):
                ids.append(got)
                lengths.append(np.diff(ends, prepend=0))
            else:
                each = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in some]
                ids += each
                lengths.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(lengths)

    def learn(self, chunks: list[str]) -> None:
        split = [WORD.findall(c) for c in chunks]
        flat = [w for words in split for w in words]
        new = list(set(flat).difference(self.words.number))
        if new:
            self.words.add(new, *self.merged(new))
        ids, ends = self.words.rows(self.words.numbers(flat))
        last = np.cumsum([len(words) for words in split])
        self.chunks.add(chunks, ids, np.diff(ends[last - 1], prepend=0))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, positions behind a sentence's last id) of each text."""
        if len(self.chunks.number) > CACHED_WORDS:
            self.words, self.chunks = Store(), Store()
        lower = [t.lower() for t in texts]
        plain = ["<|" not in t and PLAIN.fullmatch(t) is not None for t in lower]
        lowered = pa.array([t if p else "" for t, p in zip(lower, plain, strict=True)], pa.large_string())
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        seen, place, first = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        counts = np.diff(first)
        known = self.chunks.number
        number = np.fromiter(map(known.get, seen, repeat(-1)), np.int64, len(seen))
        if new := [k for k in np.flatnonzero(number < 0).tolist() if seen[k]]:
            before = len(known)
            self.learn([seen[k] for k in new])
            number[new] = np.arange(before, len(known))
        closes = pc.match_substring_regex(coded.dictionary, CLOSES).to_numpy(zero_copy_only=False)
        held = number[place] >= 0 if len(place) else np.zeros(0, bool)
        ids, ends = self.chunks.rows(number[place][held])
        text_of = np.repeat(np.arange(len(texts)), counts)[held]
        bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
        closing = closes[place][held]
        at = np.concatenate(([0], ends))
        for n, text in enumerate(texts):
            if not plain[n]:
                yield self.encode_any(text)
                continue
            lo, hi = bounds[n], bounds[n + 1]
            yield ids[at[lo] : at[hi]], at[lo + 1 : hi + 1][closing[lo:hi]] - at[lo]

    def encode_any(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids, closes, at, n = [], [], 0, 0
        while at < len(text):
            end = min(len(text), at + LONGEST_PIECE)
            if end < len(text):
                gap = re.compile("[ \t\n\r]").search(text, end)
                end = gap.start() if gap else len(text)
            for sentence in re.split("(?<=[.!?])(?=[ \t\n\r])", text[at:end]):
                got = self.tokenizer.encode(sentence, add_special_tokens=False).ids
                ids.append(np.array(got, np.uint32))
                n += len(got)
                if sentence[-1:] in {".", "!", "?"}:
                    closes.append(n)
            at = end
        return np.concatenate(ids), np.array(closes, np.int64)


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Of boundaries `at` (rising, at[0] = 0, steps of at most window), those
    that end the windows at least cost: padding to `window`, none for a window
    of a power of two from 256 on, plus the cost of each cut. The last boundary is a cut.
    """
    n = len(at)
    place, price = at.tolist(), cost.tolist()
    exact: dict[int, list[int]] = {}
    for k in range(8, int(window).bit_length() - 1):
        start = np.searchsorted(at, at - (1 << k))
        hit = np.flatnonzero((at >= (1 << k)) & (at[np.minimum(start, n - 1)] == at - (1 << k)))
        for j, i in zip(hit.tolist(), start[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
    total, back = [0.0] * n, [0] * n
    queue, keys = deque([0]), deque([0.0])  # starts in reach, by rising total + place
    pop, pop_key, push, push_key = queue.pop, keys.pop, queue.append, keys.append
    first, least, reach = 0, 0.0, float(window)  # reach: the last place that the first start gets to
    for j, (p, more) in enumerate(zip(place[1:], price[1:], strict=True), 1):
        while reach < p:
            queue.popleft()
            keys.popleft()
            first, least = queue[0], keys[0]
            reach = place[first] + window
        i, best = first, least + window - p
        if j in exact:
            for e in exact[j]:
                if total[e] < best:
                    best, i = total[e], e
        best += more
        total[j], back[j] = best, i
        best += p
        if least >= best:  # then all others are too
            queue.clear()
            keys.clear()
            first, least, reach = j, best, p + window
        else:
            while keys[-1] >= best:
                pop_key()
                pop()
        push(j)
        push_key(best)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents in order, gives pieces (doc number, doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, sentence_cut: float, token_cut: float, run: int):
        self.window, self.sentence_cut, self.token_cut, self.run = window, sentence_cut, token_cut, run
        self.held: deque[list] = deque()  # doc_id, ids, closes, ids given out so far
        self.size, self.sequence = 0, 0

    def add(self, doc_id, ids: np.ndarray, closes: np.ndarray) -> Iterator[tuple]:
        self.held.append([doc_id, ids, closes, 0])
        self.size += len(ids)
        if self.size >= self.run:
            yield from self.give(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.size:
            yield from self.give(last=True)

    def boundaries(self) -> tuple[np.ndarray, np.ndarray]:
        at, cost, base = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, closes, given in self.held:
            inner = closes[(closes > given) & (closes < len(ids))] - given
            whole = len(ids) - given
            at += [base + inner, np.array([base + whole])]
            cost += [np.full(len(inner), self.sentence_cut), np.zeros(1)]
            base += whole
        at, cost = np.concatenate(at), np.concatenate(cost)
        wide = np.flatnonzero(np.diff(at) > self.window)
        if len(wide):
            more = np.concatenate([np.arange(at[k] + self.window, at[k + 1], self.window) for k in wide])
            order = np.argsort(np.concatenate([at, more]), kind="stable")
            cost = np.concatenate([cost, np.full(len(more), self.token_cut)])[order]
            at = np.concatenate([at, more])[order]
        return at, cost

    def give(self, last: bool) -> Iterator[tuple]:
        at, cost = self.boundaries()
        ends = at[best_cuts(at, cost, self.window)].tolist()
        if not last:
            ends = ends[: max(1, len(ends) - 2)]  # what comes next may move the last cuts
        begin = 0
        for end in ends:
            room, offset = end - begin, 0
            while room:
                doc_id, ids, _, given = self.held[0]
                n = min(room, len(ids) - given)
                yield doc_id, given, ids[given : given + n], len(ids), self.sequence, offset
                self.held[0][3] += n
                offset, room = offset + n, room - n
                if self.held[0][3] == len(ids):
                    self.held.popleft()
            begin, self.sequence = end, self.sequence + 1
        self.size -= begin


def split_by_size(texts: list[str], most: int = 1 << 21) -> Iterator[slice]:
    """Runs of texts of about `most` characters, one text at least."""
    begin, held = 0, 0
    for n, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield slice(begin, n + 1)
            begin, held = n + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


SCHEMA = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"
_tokenizers: dict[str, WordTokenizer] = {}


def pack(
    docs: DataFrame,
    window: int = 4096,
    sentence_cut: float = 16.0,
    token_cut: float = 64.0,
    run: int = 1 << 18,
    tokenizer: str | None = None,
    text: str = "text",
    id: str = "doc_id",
) -> DataFrame:
    """One row for each piece: doc_id, start, length, tokens (little-endian
    unsigned 32-bit ids), doc_tokens, sequence_id, offset.

    A document is its ids followed by id 2; a null or empty text is that id
    alone. Each id is in exactly one piece. sequence_id tells the task in its
    upper bits and counts on within it, so the same table read in the same
    splits gives the same rows, also where a task is run again. A long text may
    span many sequences; a task holds `run` ids plus one document's. Rows that
    repeat an id are rows of their own. An empty table has no pieces. Other
    columns aren't read. tokenizer: path of a tokenizers file.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        words, packer = _tokenizers[path], Packer(window, sentence_cut, token_cut, run)
        base = TaskContext.get().partitionId() << 40
        names = SCHEMA.replace(",", "").split()[::2]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            made = [(d, s, len(i), i.astype("<u4").tobytes(), t, base + q, o) for d, s, i, t, q, o in rows]
            return pd.DataFrame(made, columns=names).astype({"doc_id": "Int64"})

        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for at in split_by_size(texts):
                rows: list[tuple] = []
                for doc_id, (found, closes) in zip(ids[at], words.encode(texts[at]), strict=True):
                    rows += packer.add(None if pd.isna(doc_id) else int(doc_id), np.append(found, np.uint32(END_ID)), closes)
                if rows:
                    yield frame(rows)
        if rows := list(packer.finish()):
            yield frame(rows)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(work, SCHEMA)

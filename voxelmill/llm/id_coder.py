"""Adaptive context-mixing range coder for token ids, block by block.

A block is coded from scratch: nothing is carried over from another one. Its ids
are dealt to lanes of equal length, each with a range coder of its own, and all
lanes take a step together, so that a step is a few array operations. One model
serves all lanes:

* order 2 and order 1: tables from the last two ids and from the last id to the
  id that followed last, with how often in a row it was right;
* order 0: how often each id of the block came so far, with an escape for new ids.

P(x) = w2 [x is order 2's id] + w1 [x is order 1's id] + w0 P0(x). The weights
are learned: they are the shares in which the orders were right so far in the
same class (how sure each order is, and whether both name the same id). Model
and weights are updated after 1, 1, 2, 4, ... and then every 32 steps, by coder and decoder
alike, in whole numbers only, so that every machine decodes the same.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"IDC1"
HEAD = struct.Struct("<4sIIIBI")  # magic, ids, lanes, steps, bits of an id, crc32 of the ids
LANES, STEPS, EPOCH = 4096, 512, 32
BLOCK = LANES * STEPS
MIX_BITS, FREQ_BITS = 12, 18
MIX, FREQ = 1 << MIX_BITS, 1 << FREQ_BITS
TABLE_BITS, SURE = 18, 7
LOW, WORD = (1 << 32) - 1, 1 << 32


class Corrupt(ValueError):
    """A block whose checksum, form or content is wrong."""


def epochs(steps: int) -> Iterator[tuple[int, int]]:
    """First and behind-the-last step of each run between two updates."""
    at = 0
    while at < steps:
        end = min(steps, at + max(1, min(EPOCH, at)))
        yield at, end
        at = end


class Model:
    """Predictions of orders 0 to 2 and their weights."""

    def __init__(self, bits: int):
        self.counts = np.zeros(1 << bits, np.int64)
        self.order1 = np.zeros(1 << max(bits, 1), np.int32)  # id << 3 | sure
        self.order2 = np.zeros(1 << TABLE_BITS, np.int32)
        self.right = np.ones((2 * (SURE + 1) ** 2, 3), np.int64)  # class: order 2, order 1, neither
        self.fresh = 1
        self.mix()
        self.rank()

    def mix(self) -> None:
        """The weights of each class, as bounds in MIX parts."""
        total = self.right.sum(1)
        both = np.arange(len(self.right)) & 1 == 1
        w2 = 1 + self.right[:, 0] * (MIX - 3) // total
        w1 = np.where(both, 0, 1 + self.right[:, 1] * (MIX - 3) // total)
        self.bounds = np.stack([np.zeros_like(w2), w2, w2 + w1, np.full_like(w2, MIX)], axis=1)
        self.bound2, self.bound1, self.bound = self.bounds[:, 1].copy(), self.bounds[:, 2].copy(), self.bounds.ravel()

    def rank(self) -> None:
        """Order 0: FREQ parts for the ids seen so far and, first, for new ones."""
        self.seen = np.flatnonzero(self.counts)
        counts = self.counts[self.seen]
        freq = np.empty(len(counts) + 1, np.int64)
        freq[1:] = 1 + counts * (FREQ - len(counts) - 1) // (int(counts.sum()) + self.fresh)
        freq[0] = FREQ - freq[1:].sum()
        # place 0 is the whole range: an id that order 2 or 1 has told; place 1: a new id
        self.freq, self.cum = np.concatenate([[FREQ], freq]), np.concatenate([[0], np.cumsum(freq) - freq])
        self.slot = np.repeat(np.arange(1, len(freq) + 1), freq)
        self.name = np.concatenate([[-2, -1], self.seen])
        self.place = np.ones(len(self.counts), np.int64)
        self.place[self.seen] = np.arange(2, len(self.seen) + 2)

    @staticmethod
    def key(last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return ((before * 40503) ^ (last * 2503)) & ((1 << TABLE_BITS) - 1)

    @staticmethod
    def classes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """A class tells how sure the orders are and whether they agree (the last bit)."""
        return ((two & SURE) << 4) | ((one & SURE) << 1) | ((one ^ two) <= SURE)

    def update(self, ids: np.ndarray, last: np.ndarray, key: np.ndarray, one: np.ndarray, two: np.ndarray, kind: np.ndarray) -> None:
        """Learn from all ids of an epoch, in the order of their steps."""
        got = np.where(two >> 3 == ids, 0, np.where(one >> 3 == ids, 1, 2))
        self.right += np.bincount(kind * 3 + got, minlength=self.right.size).reshape(self.right.shape)
        for table, at, old in ((self.order1, last, one), (self.order2, key, two)):
            # of several steps with one context the last one counts
            table[at] = (ids << 3) | np.where(old >> 3 == ids, np.minimum((old & SURE) + 1, SURE), 0)
        before = len(self.seen)
        self.counts += np.bincount(ids, minlength=len(self.counts))
        self.mix()
        self.rank()
        self.fresh = len(self.seen) - before + 1


def encode(ids: np.ndarray) -> bytes:
    """A block of up to BLOCK ids (unsigned, below 2^24) as bytes."""
    n = len(ids)
    bits = max(int(ids.max()).bit_length(), 1) if n else 1
    lanes = max(1, min(LANES, n // 128))
    steps = -(-n // lanes)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    rows = np.zeros((steps + 2, lanes), np.int64)
    rows[2:] = padded.reshape(lanes, steps).T
    model, lane = Model(bits), np.arange(lanes)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    used, flat = np.zeros(lanes, np.int64), np.zeros((2 * steps + 64) * lanes, np.int32)

    def give() -> None:
        while len(at := np.flatnonzero(width < WORD)):
            now = low[at]
            flat[used[at] * lanes + at] = now >> 32  # a 17th bit is a carry
            low[at] = (now & LOW) << 16
            width[at] <<= 16
            used[at] += 1

    for begin, end in epochs(steps):
        now, last, before = (rows[begin + k : end + k].ravel() for k in (2, 1, 0))
        key = model.key(last, before)
        one, two = model.order1[last], model.order2[key]
        kind = model.classes(one, two)
        is2, is1 = two >> 3 == now, one >> 3 == now
        which = np.where(is2, 0, np.where(is1, 1, 2)) + 4 * kind.astype(np.int64)
        start = model.bound[which]
        part = model.bound[which + 1] - start
        place = model.place[now] * ~(is2 | is1)
        cum, freq = model.cum[place], model.freq[place]
        new = place == 1
        shape = (end - begin, lanes)
        start, part, cum, freq, new = (x.reshape(shape) for x in (start, part, cum, freq, new))
        any_new = new.any(1)
        for k in range(end - begin):
            width >>= MIX_BITS
            low += width * start[k]
            width *= part[k]
            width >>= FREQ_BITS
            low += width * cum[k]
            width *= freq[k]
            give()
            if any_new[k]:
                at = np.flatnonzero(new[k])
                for shift in range((bits - 1) // 8 * 8, -1, -8):
                    width[at] >>= 8
                    low[at] += width[at] * ((rows[begin + k + 2][at] >> shift) & 255)
                    give()
        model.update(now, last, key, one, two, kind)
    for _ in range(3):
        flat[used * lanes + lane] = low >> 32
        low = (low & LOW) << 16
        used += 1
    words = flat.reshape(-1, lanes)[: int(used.max())]
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> 16
    words &= 0xFFFF
    held = np.arange(len(words)) < used[:, None]
    body = HEAD.pack(MAGIC, n, lanes, steps, bits, zlib.crc32(ids.astype("<u4").tobytes()))
    body += used.astype("<u4").tobytes() + words.T[held].astype("<u2").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; Corrupt if it isn't what encode made."""
    if len(block) < HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise Corrupt("a block's checksum is wrong")
    magic, n, lanes, steps, bits, crc = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise Corrupt("not a block of ids")
    used = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(np.int64)
    words = np.zeros((lanes, int(used.max()) + 2), np.int64)
    words[np.arange(words.shape[1]) < used[:, None]] = np.frombuffer(block, "<u2", int(used.sum()), HEAD.size + 4 * lanes)
    flat = np.ascontiguousarray(words.T).ravel()
    lane = np.arange(lanes)
    code = (flat[lane] << 32) | (flat[lanes + lane] << 16) | flat[2 * lanes + lane]
    width, at_word = np.full(lanes, 1 << 48, np.int64), 3 * lanes + lane
    model, rows = Model(bits), np.zeros((steps + 2, lanes), np.int64)

    def take() -> None:
        nonlocal code
        while len(at := np.flatnonzero(width < WORD)):
            code[at] = (code[at] << 16) | flat[at_word[at]]
            width[at] <<= 16
            at_word[at] += lanes

    for begin, end in epochs(steps):
        kept: list[tuple] = []
        for k in range(begin, end):
            last = rows[k + 1]
            key = model.key(last, rows[k])
            one, two = model.order1[last], model.order2[key]
            kind = model.classes(one, two)
            kept.append((key, one, two, kind))
            width >>= MIX_BITS
            # exact: both are below 2^48, so the quotient's floor is right in double precision
            mixed = code / width
            none = mixed >= model.bound1[kind]
            which = 4 * kind
            which += mixed >= model.bound2[kind]
            which += none
            start = model.bound[which]
            code -= width * start
            width *= model.bound[which + 1] - start
            width >>= FREQ_BITS
            place = model.slot[np.minimum((code / width).astype(np.int64), FREQ - 1)]
            place *= none
            code -= width * model.cum[place]
            width *= model.freq[place]
            now = model.name[place]
            told = np.flatnonzero(place == 0)
            now[told] = np.where(which[told] & 3 == 0, two[told], one[told]) >> 3
            take()
            if (place == 1).any():
                at = np.flatnonzero(place == 1)
                now[at] = 0
                for _ in range(0, bits, 8):
                    width[at] >>= 8
                    byte = np.minimum((code[at] / width[at]).astype(np.int64), 255)
                    code[at] -= width[at] * byte
                    now[at] = (now[at] << 8) | byte
                    take()
            rows[k + 2] = now
        joined = [np.concatenate(x) for x in zip(*kept, strict=True)]
        model.update(rows[begin + 2 : end + 2].ravel(), rows[begin + 1 : end + 1].ravel(), *joined)
    ids = rows[2:].T.ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise Corrupt("a block's ids don't match their checksum")
    return ids

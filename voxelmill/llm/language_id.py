"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters beside no digit (where a text has no other, all runs
of letters are its words). A word's features are its affixes and inner n-grams
of two to four letters (the place before and behind the word counts as one) and
the word itself as a lexicon entry, all hashed into fixed tables of weights; the
chain adds a weight for each pair of labels of neighbouring words. Weights are
fitted by maximum likelihood, with the exact gradient by forward-backward, on
whole words of labelled documents and on sequences that switch between two of
them. A text's words get their labels' probabilities by forward-backward over
the whole text; the language is the one with the largest mean probability.

Texts are cut in segments of SEGMENT words only to work on many at once: each
segment's product of potentials is multiplied up first, so that all segments
know what stands before and behind them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

TABLE_BITS = 16
ORDERS = (2, 3, 4)
SEGMENT = 64
SLICE = 1 << 20
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


@dataclass
class Words:
    """Words of several texts: features of each position, and where words begin."""

    features: list[np.ndarray]  # for each order, a table entry for each position; -1 is none
    begins: np.ndarray
    lexicon: np.ndarray
    text: np.ndarray  # the number of each word's text


def words_of(texts: list[str], all_runs: bool = False) -> Words:
    """The words of texts; all_runs: also runs of letters that touch a digit."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code] if len(code) else np.zeros(0, bool)
    digit = (code >= 48) & (code <= 57)
    if not all_runs and digit.any():
        either = letter | digit
        run = np.cumsum(either & ~np.concatenate(([False], either[:-1])))
        mixed = np.bincount(run[digit], minlength=run[-1] + 1) > 0
        letter = letter & ~mixed[run]
    first = letter & ~np.concatenate(([False], letter[:-1]))
    # letters, and the place before each word
    before = np.concatenate((first[1:], [False])) if len(code) else first
    lead = bool(len(letter)) and bool(letter[0])
    keep = letter | before
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    text_of = np.repeat(np.arange(len(texts)), sizes)[: len(code)]
    owner = text_of[first]
    c = np.where(letter, code, 0)[keep].astype(np.int64)
    if lead:
        c = np.concatenate(([0], c))
    begins = np.flatnonzero(c == 0)
    c = np.concatenate((c, np.zeros(max(ORDERS), np.int64)))
    n = len(c) - max(ORDERS)
    mask = (1 << TABLE_BITS) - 1
    features, h, inner = [], c[:n] * 0x9E3779B1, np.ones(n, bool)
    for order in range(2, max(ORDERS) + 1):
        h = (h ^ (h >> 15)) * 0x2545F491 + c[order - 1 : order - 1 + n]
        if order > 2:
            inner = inner & (c[order - 2 : order - 2 + n] != 0)
        mixed = (h * 0x7F4A7C15) >> 13
        features.append(np.where(inner, mixed & mask, -1))
    place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n))) if n else np.zeros(0, np.int64)
    spread = c[:n] * ((place * 0x5BD1E995 + 0x2545F491) ** 2 | 1)
    word = np.add.reduceat(spread, begins) if len(begins) else np.zeros(0, np.int64)
    return Words(features, begins, ((word ^ (word >> 17)) * 0x2545F491 >> 11) & mask, owner)


@dataclass
class Model:
    labels: list[str]
    tables: np.ndarray  # (orders + 1, entries + 1, labels); the last entry is 0, for none
    switch: np.ndarray  # (labels, labels) log weights

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.begins):
            return np.zeros((0, len(self.labels)))
        score = self.tables[0][words.features[0]]
        for table, entries in zip(self.tables[1:], words.features[1:], strict=False):
            score += table[entries]
        return np.add.reduceat(score, words.begins, axis=0) + self.tables[-1][words.lexicon]


def posteriors(emissions: np.ndarray, owner: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """The label probabilities of each word, by forward-backward over each run
    of equal `owner` (sorted)."""
    count, size = emissions.shape
    if not count:
        return emissions
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    a = np.exp(switch)
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    lengths = np.diff(np.append(begins, count))
    per = -(-lengths // SEGMENT)
    segment_text = np.repeat(np.arange(len(begins)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = begins[segment_text] + number * SEGMENT
    many = np.minimum(lengths[segment_text] - number * SEGMENT, SEGMENT)
    order = np.argsort(-many, kind="stable")  # segments that are over drop off the end
    at, many = at[order], many[order]
    live = [int(np.searchsorted(-many, -k, side="left")) for k in range(SEGMENT)]
    product = np.broadcast_to(np.eye(size), (len(at), size, size)).copy()
    for k in range(SEGMENT):
        m = live[k]
        if not m:
            break
        p = (product[:m] @ a) * e[at[:m] + k][:, None, :]
        product[:m] = p / p.sum(axis=(1, 2), keepdims=True)
    # what comes into a segment from its text's start, and back from its end
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    ins, outs = np.full((len(at), size), 1 / size), np.full((len(at), size), 1 / size)
    firsts = np.cumsum(per) - per
    for k in range(1, int(per.max())):
        s = firsts[per > k] + k
        x = np.einsum("ni,nij->nj", ins[back[s - 1]], product[back[s - 1]])
        ins[back[s]] = x / x.sum(axis=1, keepdims=True)
        s = (firsts + per - 1)[per > k] - k
        x = np.einsum("nij,nj->ni", product[back[s + 1]], outs[back[s + 1]])
        outs[back[s]] = x / x.sum(axis=1, keepdims=True)
    forward = np.empty_like(e)
    state = ins.copy()
    for k in range(SEGMENT):
        m = live[k]
        if not m:
            break
        x = (state[:m] @ a) * e[at[:m] + k]
        state[:m] = x / x.sum(axis=1, keepdims=True)
        forward[at[:m] + k] = state[:m]
    state = outs
    for k in reversed(range(SEGMENT)):
        m = live[k]
        if not m:
            continue
        here = at[:m] + k
        forward[here] *= state[:m]
        x = (e[here] * state[:m]) @ a.T
        state[:m] = x / x.sum(axis=1, keepdims=True)
    return forward / forward.sum(axis=1, keepdims=True)


def words_in_parts(texts: list[str], part_chars: int = 1 << 19) -> Words:
    """words_of(texts), a part of the texts at a time, in little memory."""
    parts, held, size, before, at = [], [], 0, 0, 0
    for n, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= part_chars or n + 1 == len(texts):
            w = words_of(held)
            parts.append(Words([f.astype(np.int32) for f in w.features], w.begins + at, w.lexicon.astype(np.int32), w.text + before))
            before, at, held, size = n + 1, at + len(w.features[0]), [], 0
    if not parts:
        return words_of([])
    joined = [np.concatenate([w.features[k] for w in parts]) for k in range(len(ORDERS))]
    return Words(joined, *(np.concatenate([getattr(w, name) for w in parts]) for name in ("begins", "lexicon", "text")))


def fit(texts: list[str], langs: list[str], words_most: int = 160_000, passes: int = 30, rate: float = 0.15, decay: float = 1e-6, seed: int = 5) -> Model:
    """A model of the languages in langs, from at most words_most words in
    sequences of 32, drawn from all parts of the texts; every third switches
    halfway to a sequence of another language."""
    labels = sorted(set(langs))
    number = {name: k for k, name in enumerate(labels)}
    entries = 1 << TABLE_BITS
    model = Model(labels, np.zeros((len(ORDERS) + 1, entries + 1, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    if len(labels) < 2:
        return model
    rng = np.random.default_rng(seed)
    words = words_in_parts(texts)
    gold = np.array([number[x] for x in langs])[words.text] if len(words.text) else np.zeros(0, np.int64)
    length = 32
    # windows run over the words of one language, text after text; a language
    # with fewer words than a window repeats them
    windows = []
    for k in range(len(labels)):
        own = np.flatnonzero(gold == k)
        if len(own):
            at = np.arange(0, max(1, len(own) - length + 1), length)[:, None] + np.arange(length)
            windows.append(own[at % len(own)])
    rows = np.concatenate(windows) if windows else np.zeros((0, length), np.int64)
    rows = rng.permutation(rows)[: words_most // length]
    third = np.arange(0, len(rows), 3)
    rows[third, length // 2 :] = rows[rng.permutation(third), length // 2 :]
    if not len(rows):
        return model
    spans = np.diff(np.append(words.begins, len(words.features[0])))
    batches = []  # of whole sequences, so that a pass needs little memory
    for some in np.array_split(rows, -(-len(rows) // 1024)):
        flat = some.ravel()
        own = spans[flat]
        first = np.cumsum(own) - own
        positions = np.repeat(words.begins[flat] - first, own) + np.arange(own.sum())
        chosen = Words([f[positions] for f in words.features], first, words.lexicon[flat], np.repeat(np.arange(len(some)), length))
        batches.append((chosen, gold[flat].astype(np.int8), np.repeat(np.arange(len(flat), dtype=np.int32), own), some.shape))
    del words, spans
    total = rows.size
    y = gold[rows]
    seen = np.zeros((len(labels), len(labels)))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    moment, spread = np.zeros_like(model.tables), np.zeros_like(model.tables)
    m2, s2 = np.zeros_like(model.switch), np.zeros_like(model.switch)
    for t in range(1, passes + 1):
        grad, pairs = np.zeros_like(model.tables), np.zeros_like(model.switch)
        for chosen, right, word_of, shape in batches:
            emissions = model.emissions(chosen)
            p = posteriors(emissions, chosen.text, model.switch)
            error = (np.eye(len(labels))[right] - p) / total
            for k, f in enumerate(chosen.features):
                for c in range(len(labels)):
                    grad[k, :, c] += np.bincount(np.where(f < 0, entries, f), error[word_of, c], entries + 1)
            for c in range(len(labels)):
                grad[-1, :, c] += np.bincount(chosen.lexicon, error[:, c], entries + 1)
            pairs += pair_counts(emissions, p, model.switch, shape)
        grad[:, -1] = 0
        grad -= decay * model.tables
        g2 = (seen - pairs) / total
        for value, g, m, s in ((model.tables, grad, moment, spread), (model.switch, g2, m2, s2)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            value += rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
    model.tables[:, -1] = 0
    return model


def pair_counts(emissions: np.ndarray, p: np.ndarray, switch: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Expected counts of neighbouring labels over sequences of one length."""
    size = p.shape[1]
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).reshape(*shape, size)
    a, p = np.exp(switch), p.reshape(*shape, size)
    back, total = np.full((shape[0], size), 1.0), np.zeros_like(switch)
    front = [e[:, 0] * (np.full((1, size), 1 / size) @ a)]
    for k in range(1, shape[1]):
        x = (front[-1] @ a) * e[:, k]
        front.append(x / x.sum(axis=1, keepdims=True))
    for k in reversed(range(1, shape[1])):
        right = e[:, k] * back
        joint = front[k - 1][:, :, None] * a[None] * right[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = right @ a.T
        back /= back.sum(axis=1, keepdims=True)
    return total


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, mean probability) of each whole text; (und, 0) without letters."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    held: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        words, number = words_of([t for _, t in held]), np.array([n for n, _ in held])
        label(model.emissions(words), number[words.text])
        left = [(n, t) for n, t in held if names[n] == UNKNOWN and any(map(str.isalpha, t))]
        if left:
            words, number = words_of([t for _, t in left], all_runs=True), np.array([n for n, _ in left])
            label(model.emissions(words), number[words.text])
        held.clear()

    def label(emissions: np.ndarray, owner: np.ndarray) -> None:
        if not len(owner):
            return
        p = posteriors(emissions, owner, model.switch)
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        mean = np.add.reduceat(p, begins, axis=0) / np.diff(np.append(begins, len(owner)))[:, None]
        for n, m in zip(owner[begins].tolist(), mean, strict=True):
            names[n], scores[n] = model.labels[int(m.argmax())], min(1.0, float(m.max()))

    for n, t in enumerate(texts):
        if len(t) > 2 * SLICE:
            for all_runs in (False, True):
                whole = np.concatenate([model.emissions(words_of([piece], all_runs)) for piece in pieces(t)])
                label(whole, np.full(len(whole), n))
                if names[n] != UNKNOWN:
                    break
            continue
        held.append((n, t))
        size += len(t)
        if size > SLICE:
            flush()
            size = 0
    flush()
    return names, scores


def pieces(text: str) -> Iterator[str]:
    """A very long text in parts that no word crosses."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end - 1].isalnum():
            end += 1
        yield text[at:end]
        at = end


def held_out(id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    docs: DataFrame, per_language: int = 250, languages: int = 2000, sample_chars: int = 12_000_000, text: str = "text", id: str = "doc_id", lang: str = "lang"
) -> Model:
    """Fit on about per_language documents of each language, picked by a hash of
    id and text among those with a language that aren't held out.

    Documented bounds of the sample: at most twice per_language documents of each
    language and sample_chars code points in all, of a longer text a part from a
    place given by the hash. More than `languages` different labels are an
    error, as then the labels are hardly languages.
    """
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    if not counts:
        return Model([], np.zeros((len(ORDERS) + 1, (1 << TABLE_BITS) + 1, 0), np.float32), np.zeros((0, 0)))
    longest = sample_chars // (2 * per_language * len(counts))
    # rows that repeat an id differ in their texts; equal rows are alike
    drawn = F.xxhash64("i", "t")
    spot = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_language / n))]), F.col("l"))
    over = F.greatest(F.length("t") - longest, F.lit(0)) + 1
    part = F.substring("t", (F.pmod(F.xxhash64("i", F.lit(1)), over.cast("long")) + 1).cast("int"), F.lit(longest))
    picked = rows.filter(spot < share).select("i", part.alias("t"), "l", drawn.alias("h")).orderBy("h", "l").limit(2 * per_language * len(counts)).collect()
    picked = sorted(picked, key=lambda r: (r["l"], str(r["i"]), r["t"]))
    return fit([r["t"] for r in picked], [r["l"] for r in picked])


OUT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """docs with the column `out`: struct of lang, a label of the model or und,
    and score, 0 to 1.

    Null texts and texts without a letter are und with score 0, and so is all
    text where the model has no label. Whole texts are read, of any length. The
    rows and other columns stay as they are; a column called `out` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.labels, model.tables, model.switch))

    @F.pandas_udf(OUT)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*held.value)
        for batch in batches:
            texts = [t or "" for t in batch]
            if model.labels:
                names, scores = predict(model, texts)
            else:
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pd.DataFrame({"lang": names, "score": scores})

    return docs.withColumn(out, label.asNondeterministic()(F.col(text)))

"""Chat formatting: turns of a transcript by a hidden Markov model over lines.

A transcript is a conversation's texts in order, without roles; a text may hold
the lines of several speakers. The hidden state of a line is its speaker's role
and whether the line begins a turn or goes on with one. What is seen of a line
is its speaker marker, if it has one, whether it heads its text, and features of
the line; a text's first line also shows how many lines and characters the text
has, unless markers inside say that it holds several turns. Weights are counts
over labelled texts, whose first line begins a turn. Lines are decoded by
Viterbi, runs become turns, and each turn is rendered canonically.

Long conversations are decoded in chunks of CHUNK rows: each chunk is
first reduced to the best score from each state to each state, those small
tables are chained on two levels, and then every chunk is decoded on its own
between its known ends, so no conversation has to fit in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import group_index
from ..session import cut

CHUNK = 256
#: Speaker markers at the head of a line, and the role each stands for.
MARKERS = {
    "system": r"<\|(?:im_start\|>)?system(?:\|>)?|\[system\]|#+ *system *:?|system *:|<<sys>>",
    "user": r"<\|(?:im_start\|>)?(?:user|human)(?:\|>)?|\[(?:user|human|inst)\]|#+ *(?:user|human|instruction) *:?|(?:user|human|q|question|customer) *:",
    "assistant": r"<\|(?:im_start\|>)?(?:assistant|bot)(?:\|>)?|\[(?:assistant|bot|/inst)\]|#+ *(?:assistant|response|bot) *:?|(?:assistant|bot|ai|a|answer|agent) *:",
    "tool": r"<\|(?:im_start\|>)?(?:tool|function)(?:\|>)?|\[(?:tool|function)\]|#+ *(?:tool|function) *:?|(?:tool|function|observation) *:",
}
MARKER = re.compile(r"[^\S\n]*(?:" + "|".join(f"(?P<{r}>{p})" for r, p in MARKERS.items()) + r")[^\S\n]*", re.IGNORECASE)
MAY_MARK = frozenset("<[#suhqcabtfoSUHQCABTFO \t")
LINE_FEATURES = ("marker", "head", "size", "asks", "ends")
TEXT_FEATURES = ("lines", "length")
FEATURES = LINE_FEATURES + TEXT_FEATURES
VALUES = 17
NEVER = -1e9


def _log_size(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(n + 1)), VALUES - 1).astype(np.int64)


def lines_of(texts: list[str], roles: list[str]) -> tuple[list[str], np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """The lines of texts, the number of each line's text, its features (small
    integers; text features are -1 where they don't count) and the length of its
    marker. A text has one line at least."""
    number = {r: k + 1 for k, r in enumerate(roles)}
    split = [t.split("\n") for t in texts]
    lines = [line for part in split for line in part]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    owner = np.repeat(np.arange(len(split)), counts)
    head = np.zeros(len(lines), np.int64)
    first = np.cumsum(counts) - counts
    head[first] = 1
    marker, skip = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    for k, line in enumerate(lines):
        if line[:1] in MAY_MARK and (m := MARKER.match(line)) and (r := number.get(m.lastgroup)):
            marker[k], skip[k] = r, m.end()
    last = [line.rstrip()[-1:] for line in lines]
    ending = {".": 1, "!": 1, "?": 2, ":": 3, ",": 3, "": 4}
    inner = np.bincount(owner[(marker > 0) & (head == 0)], minlength=len(split)) > 0
    shown = (head == 1) & ~inner[owner]
    seen = {
        "marker": marker,
        "head": head,
        "size": _log_size(np.fromiter(map(len, lines), np.int64, len(lines))),
        "asks": np.fromiter(("?" in line for line in lines), np.int64, len(lines)),
        "ends": np.fromiter((ending.get(x, 0) for x in last), np.int64, len(last)),
        "lines": np.where(shown, np.minimum(counts, 8)[owner], -1),
        "length": np.where(shown, _log_size(np.fromiter(map(len, texts), np.int64, len(texts)))[owner], -1),
    }
    return lines, owner, seen, skip


class RoleModel:
    """roles, and log weights of states (the roles' begins, then the roles'
    continuations): start (states), step (states, states), see[feature]
    (states, values)."""

    def __init__(self, roles: list[str], start: np.ndarray, step: np.ndarray, see: dict[str, np.ndarray]):
        self.roles, self.start, self.step, self.see = roles, start, step, see

    @classmethod
    def learn(cls, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_roles: int = 64) -> RoleModel:
        """Counts over all texts of turns that have a role, one added to each.

        Roles are those of the labels and those that have markers; more than
        most_roles are an error. A marker weighs as if one turn in twenty of its
        role had it, and one turn in a thousand is taken to begin inside a text, as
        corpora may hold neither; a role without labelled turns is told by its
        markers alone. Only counts reach the driver.
        """
        known = turns.select(
            F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(role).cast("string").alias("role"),
        ).filter("role IS NOT NULL")
        names = [r["role"] for r in known.select("role").distinct().limit(most_roles + 1).collect()]
        roles = [*MARKERS, *sorted(set(names) - set(MARKERS))]
        if len(roles) > most_roles + len(MARKERS):
            raise ValueError(f"more than {most_roles} roles")
        count = len(roles)
        number = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role")).cast("int") - 1
        near = Window.partitionBy("conv_id", "chunk").orderBy("turn", "r")
        ordered = _placed(known.withColumn("r", number)).filter("NOT alone").select("conv_id", "turn", "r", "chunk")
        pairs = ordered.withColumn("p", F.lag("r").over(near)).groupBy("p", "r", (F.col("chunk") == 0).alias("early")).count().collect()
        begin, follow = np.ones(count), np.ones((count, count))
        for s in pairs:
            if s["p"] is not None:
                follow[s["p"], s["r"]] += s["count"]
            elif s["early"]:
                begin[s["r"]] += s["count"]

        def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(FEATURES), 2 * count, VALUES), np.int64)
            for batch in batches:
                _, owner, seen, _ = lines_of([t.replace("\r\n", "\n").replace("\r", "\n") for t in batch["text"]], roles)
                state = batch["r"].to_numpy()[owner] + np.where(seen["head"] == 1, 0, count)
                for k, f in enumerate(FEATURES):
                    used = seen[f] >= 0
                    np.add.at(total[k], (state[used], seen[f][used]), 1)
            f, s, v = np.nonzero(total)
            yield pd.DataFrame({"f": f, "s": s, "v": v, "n": total[f, s, v]})

        counts = known.select("text", number.alias("r")).mapInPandas(tally, "f long, s long, v long, n long").groupBy("f", "s", "v").agg(F.sum("n").alias("n"))
        see = {f: np.zeros((2 * count, VALUES)) for f in FEATURES}
        for s in counts.collect():
            see[FEATURES[s["f"]]][s["s"], s["v"]] += s["n"]
        turns_of, lines_after = see["head"][:count, 1].copy(), see["head"][count:, 0].copy()
        longer = np.maximum(0, turns_of - see["lines"][:count, 1])  # turns of more than one line
        for x in see.values():  # what a state has not shown, others may have
            pooled = x.sum(axis=0) + 1
            x += 4 * pooled / pooled.sum()
        see["head"][:] = 1e-9
        see["head"][:count, 0], see["head"][:count, 1], see["head"][count:, 0] = 0.001, 0.999, 1.0
        see["marker"][:, 0] += 1
        see["marker"][:, 1:] *= 1e-6
        for k in range(len(MARKERS)):
            see["marker"][k, k + 1] = 1 + 0.05 * turns_of[k]
            if not turns_of[k]:
                see["marker"][k, 0] = 1e-6
        go = np.stack([(longer + 1) / (turns_of + 2), (lines_after - longer + 1) / (lines_after + 2)])
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        step = np.full((2 * count, 2 * count), NEVER)
        for k in range(2):
            at = slice(k * count, (k + 1) * count)
            step[at, :count] = norm(follow) + np.log(1 - go[k])[:, None]
            step[np.arange(k * count, (k + 1) * count), np.arange(count) + count] = np.log(go[k])
        return cls(roles, np.concatenate([norm(begin), np.full(count, NEVER)]), step, {f: norm(x) for f, x in see.items()})

    def scores(self, seen: dict[str, np.ndarray]) -> np.ndarray:
        """(lines, states): the log weight of what is seen."""
        total = np.zeros((len(seen["head"]), len(self.start)))
        for f in FEATURES:
            value = seen[f]
            total += np.where(value[:, None] >= 0, self.see[f].T[np.maximum(value, 0)], 0.0)
        # a text's first line begins a turn
        count = len(self.roles)
        total[seen["head"] == 1, count:] = NEVER
        return total


def viterbi(seen: np.ndarray, lengths: np.ndarray, step: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The best states of sequences that lie one after another in seen. enter
    (sequences, states): scores before the first line by its state, the step
    into it included; leave: best scores of what follows by the last state. Ties
    go to the lower state."""
    states = np.zeros(len(seen), np.int64)
    if not len(lengths):
        return states
    order = np.argsort(-lengths, kind="stable")  # sequences that are over drop off the end
    size = lengths[order]
    at = (np.cumsum(lengths) - lengths)[order]
    best = enter[order] + seen[at]
    back = np.zeros(seen.shape, np.int16)  # states are two for each role, far below 2^15
    live = len(size)
    for k in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -k, side="left"))
        ways = best[:live, :, None] + step
        arg = ways.argmax(axis=1)
        back[at[:live] + k] = arg
        best[:live] = np.take_along_axis(ways, arg[:, None], axis=1)[:, 0] + seen[at[:live] + k]
    state = (best + leave[order]).argmax(axis=1)
    for k in reversed(range(int(size[0]))):
        live = int(np.searchsorted(-size, -k, side="left"))
        states[at[:live] + k] = state[:live]
        if k:
            state[:live] = back[at[:live] + k, state[:live]]
    return states


def transfer(seen: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(first state, last state): the best score of a run of lines."""
    best = np.full(step.shape, -np.inf)
    np.fill_diagonal(best, seen[0])
    for s in seen[1:]:
        best = (best[:, :, None] + step[None]).max(axis=1) + s
    return best


def joined(tables: list[np.ndarray], step: np.ndarray) -> np.ndarray:
    """The transfer of runs one after another."""
    best = tables[0]
    for t in tables[1:]:
        best = ((best[:, :, None] + step[None]).max(axis=1)[:, :, None] + t[None]).max(axis=1)
    return best


def chained(tables: list[np.ndarray], step: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What comes into each run, and what follows it, between the given ends."""
    into, after = [enter], [leave]
    for t in tables[:-1]:
        x = ((into[-1][:, None] + t).max(axis=0)[:, None] + step).max(axis=0)
        into.append(x - x.max())
    for t in reversed(tables[1:]):
        x = (step + (t + after[-1][None]).max(axis=1)[None]).max(axis=1)
        after.append(x - x.max())
    return into, after[::-1]


UNIT = ["conv_id", "chunk", "alone"]


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole units from batches sorted by unit, and the number of each
    row's unit. A row that stands alone is a unit."""
    held = None

    def numbered(frame: pd.DataFrame) -> np.ndarray:
        c, k, a = frame["conv_id"].fillna(-(1 << 62)).to_numpy(), frame["chunk"].to_numpy(), frame["alone"].to_numpy(bool)
        new = np.ones(len(frame), bool)
        new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | a[1:] | a[:-1]
        return np.cumsum(new) - 1

    for batch in batches:
        if not len(batch):
            continue
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        unit = numbered(frame)
        whole = int(np.searchsorted(unit, unit[-1]))
        if whole:
            yield frame.iloc[:whole], unit[:whole]
        held = frame.iloc[whole:]
    if held is not None and len(held):
        yield held, numbered(held)


def _placed(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, text) with chunk, a run of CHUNK rows of a
    conversation in order of turn and text, and alone: whether the row has no
    place among others."""
    has = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    placed = group_index(rows.filter(has), "conv_id", [F.col("turn"), F.col("text")], "__n")
    chunked = placed.withColumn("chunk", F.floor(F.col("__n") / CHUNK).cast("long")).drop("__n").withColumn("alone", F.lit(False))
    single = rows.filter(~has).withColumns({"chunk": F.lit(0).cast("long"), "alone": F.lit(True)})
    return cut(chunked.unionByName(single))


def transcripts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv_id, turn, text, chunk, alone: texts with plain line ends, and what is
    decoded together."""
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n").alias("text"),
    )
    return _placed(rows)


def recover_roles(turns: DataFrame, model: RoleModel, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv_id, turn, part, role, text, skip: one row for each turn found in a
    text. part numbers them within the text; text is the turn's lines, of which
    the first `skip` characters are the marker of its role.

    The first line of a text always begins a turn. Texts that share a turn
    number stand by text. A text without conversation or turn number stands
    alone. A conversation, of whatever length, is decoded as one, in chunks of
    CHUNK rows. Null texts are empty; an empty text is one empty turn. A
    role column of turns is not read. An empty table gives no rows.
    """
    order = [F.col("conv_id").asc_nulls_first(), "chunk", "alone", F.col("turn").asc_nulls_first(), "text"]
    spread = F.when(F.col("alone"), F.xxhash64("text")).otherwise(0)
    placed = lambda df: df.repartition("conv_id", "chunk", spread).sortWithinPartitions(*order)
    rows = transcripts(turns, conv, turn, text)
    chunk = F.col("chunk")
    long = rows.filter("NOT alone").groupBy("conv_id").agg(F.min(chunk).alias("lo"), F.max(chunk).alias("hi")).filter("lo < hi").select("conv_id")
    count, step = len(model.start), model.step

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, unit in _units(batches):
            out = []
            for _, part in frame.groupby(unit):
                _, _, seen, _ = lines_of(part["text"].tolist(), model.roles)
                out.append((part["conv_id"].iloc[0], part["chunk"].iloc[0], transfer(model.scores(seen), step).ravel()))
            yield pd.DataFrame(out, columns=["conv_id", "chunk", "table"])

    square = lambda part: [t.reshape(count, -1) for t in part["table"]]

    def over(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "super": [key[1]], "table": [joined(square(part.sort_values("chunk")), step).ravel()]})

    def outer(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("super")
        into, after = chained(square(part), step, model.start, np.zeros(count))
        return pd.DataFrame({"conv_id": part["conv_id"], "super": part["super"], "enter": into, "leave": after})

    def inner(key: tuple, tables: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        tables = tables.sort_values("chunk")
        into, after = chained(square(tables), step, np.asarray(ends["enter"].iloc[0]), np.asarray(ends["leave"].iloc[0]))
        return pd.DataFrame({"conv_id": tables["conv_id"], "chunk": tables["chunk"], "enter": into, "leave": after})

    longer = placed(rows.filter("NOT alone").join(long, "conv_id", "left_semi"))
    tables = longer.mapInPandas(reduce, "conv_id long, chunk long, table array<double>").withColumn("super", F.floor(chunk / CHUNK))
    tables = cut(tables)
    supers = tables.groupBy("conv_id", "super").applyInPandas(over, "conv_id long, super long, table array<double>")
    ends = supers.groupBy("conv_id").applyInPandas(outer, "conv_id long, super long, enter array<double>, leave array<double>")
    both = tables.groupBy("conv_id", "super").cogroup(ends.groupBy("conv_id", "super"))
    ends = cut(both.applyInPandas(inner, "conv_id long, chunk long, enter array<double>, leave array<double>"))
    rows = rows.join(ends.withColumn("alone", F.lit(False)), ["conv_id", "chunk", "alone"], "left")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, unit in _units(batches):
            lines, owner, seen, skip = lines_of(frame["text"].tolist(), model.roles)
            line_unit = unit[owner]
            lengths = np.bincount(line_unit)
            first = np.searchsorted(unit, np.arange(len(lengths)))
            enter, leave = np.tile(model.start, (len(lengths), 1)), np.zeros((len(lengths), count))
            given = frame["enter"].iloc[first]
            for n in np.flatnonzero(given.notna().to_numpy()):
                enter[n], leave[n] = given.iloc[n], frame["leave"].iloc[first[n]]
            state = viterbi(model.scores(seen), lengths, step, enter, leave)
            begin = np.flatnonzero(state < len(model.roles))
            of = owner[begin]
            ends = np.append(begin[1:], len(lines))
            role = state[begin]
            yield pd.DataFrame(
                {
                    "conv_id": frame["conv_id"].to_numpy()[of],
                    "turn": frame["turn"].to_numpy()[of],
                    "part": np.arange(len(begin)) - np.searchsorted(of, of),
                    "role": np.array(model.roles)[role],
                    "text": ["\n".join(lines[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)],
                    "skip": np.where(seen["marker"][begin] == role + 1, skip[begin], 0),
                }
            ).astype({"conv_id": "Int64", "turn": "Int64"})

    found = placed(rows).mapInPandas(decode, "conv_id long, turn long, part long, role string, text string, skip long")
    return found


def render(turns: DataFrame) -> DataFrame:
    """turns (role, text, skip) with `rendered`: the role line, the text without
    its own marker, a closing end marker and outer white space, and an end
    marker. Inside a text `<|` becomes `<\\|`, and `<\\` becomes `<\\\\`, so no text
    can close its turn or open another."""
    body = F.substring("text", (F.col("skip") + 1).cast("int"), F.length("text"))
    body = F.regexp_replace(body, r"^\s+|(?:\s*<\|im_end\|>)?\s*$", "")
    body = F.replace(F.replace(body, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))
    return turns.withColumn("rendered", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), body, F.lit("<|im_end|>\n")))

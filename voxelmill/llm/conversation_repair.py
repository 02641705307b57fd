"""Repair of conversations: the cheapest edits after which roles follow (system)? (user assistant)+.

Rows are Kept (0), given another role (Rerole, 2), Deleted (3), and empty rows
Inserted (2); a blank row or a copy must go, and a truncated row that stays
costs 1. The cheapest edits are a shortest path over rows and five states: none
so far, system, user, assistant. Rerole and Insert have no choice: each state
allows one of the two roles.

Rows are numbered through the whole table in the order of conversation and turn,
and a chunk is a run of numbers, so that no conversation, however long, is one
task's. Each chunk takes its rows' costs backwards, from the vector of costs at
its end. Where a conversation goes on behind a chunk, that vector is not known:
chunks begin with a speculative one (none costs more than another) and are
run again with the vector that the next chunk found, until no chunk's result
changes but by a constant. Adding a constant to all states changes no decision,
so vectors are kept less their least value, and only those values are added
up along a conversation. Convergence takes a few passes, as a few rows usually
make the vectors parallel; at worst each pass settles one more chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import dense_index
from ..session import cut

SPACE = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
CHUNK, LANES = 256, 4096
NONE, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: The state after a kept row, by state and initial (system, user, assistant, other); -1: not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: The state after a rerole or an insert, and its role.
MADE = np.array([USER, USER, ASSISTANT, USER])
#: Costs of ending in a state: complete, or the cheapest inserts that complete it.
END = np.array([0, 2 * INSERT, INSERT, 0])
ROLE_OF = np.array([".", ".", "u", "a"], object)
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults


def faults(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """turns as (key, conv_id, turn, role, text, at, initial, fault): at numbers
    all rows in order of conversation, turn (nulls first), role and text."""
    own = {"conv_id": F.col(conv), "turn": F.col(turn).cast("long"), "role": F.coalesce(F.col(role), F.lit(" ")), "text": F.coalesce(F.col(text), F.lit(" "))}
    rows = turns.select(*[c.alias(n) for n, c in own.items()])
    key = F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("+"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = cut(dense_index(rows.withColumn("key", key), order, "at"))
    # the first of equal rows: a minimum combines before the shuffle, so that a common row is no hot key
    same = placed.select("key", "at", F.sha2("role", 256).alias("r"), F.sha2("text", 256).alias("t"))
    first = same.groupBy("key", "r", "t").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    stripped = F.regexp_replace("text", f"{SPACE}+$", "")
    fault = F.when(stripped == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    return cut(placed.join(first, "at", "left").select("key", "conv_id", "turn", "role", "text", "at", initial.alias("initial"), fault.alias("fault")))


class Chunks:
    """Many chunks side by side: rows of codes (initial + 4 x fault), -1 behind a
    chunk's end; begins and closes: a conversation begins or ends with the row."""

    def __init__(self, batch: pd.DataFrame):
        self.many, sizes = len(batch), [len(c) for c in batch["codes"]]
        self.rows = max(sizes)
        self.codes = np.full((self.rows, self.many), -1, np.int64)
        self.begins = np.zeros((self.rows, self.many), bool)
        self.closes = np.zeros((self.rows, self.many), bool)
        self.next_initial = np.full((self.rows, self.many), -1, np.int64)
        for m, (n, codes, begins, goes_on, behind) in enumerate(zip(sizes, *(batch[c] for c in ("codes", "begins", "goes_on", "next_initial")), strict=True)):
            self.codes[:n, m], self.begins[:n, m] = codes, begins
            self.closes[: n - 1, m] = self.begins[1:n, m]
            self.closes[n - 1, m] = not goes_on
            self.next_initial[: n - 1, m] = self.codes[1:n, m] & 3
            self.next_initial[n - 1, m] = behind if goes_on else -1
        self.lane = np.arange(self.many)

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether there is a row, its initial, its cost of being truncated, whether it must go."""
        fault = self.codes[k] >> 2
        return self.codes[k] >= 0, self.codes[k] & 3, np.where(fault == CUT, TRUNCATED, 0), (fault == BLANK) | (fault == DUPLICATE)

    def after(self, k: int, costs: np.ndarray) -> np.ndarray:
        return np.where(self.closes[k][:, None], END, costs)

    def backward(self, ends: np.ndarray) -> list[np.ndarray]:
        """Costs by state before each row, and behind the last; ends: those behind each chunk."""
        costs = [ends]
        for k in range(self.rows - 1, -1, -1):
            after = self.after(k, costs[-1])
            real, initial, extra, must = self.row(k)
            out = np.empty_like(ends)
            for q in range(4):
                to = KEPT[q][initial]
                keep = np.where((to < 0) | must, FAR, KEEP + extra + after[self.lane, to])
                made = np.where(must, FAR, REROLE + extra + after[:, MADE[q]])
                out[:, q] = np.minimum(np.minimum(keep, made), DELETE + after[:, q])
            costs.append(np.where(real[:, None], inserted(out), costs[-1]))
        return costs[::-1]

    def trace(self, costs: list[np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the states before each chunk: (edits, roles) of each row and chunk,
        and the states behind. edits: the inserts before a row, its own edit and,
        with a conversation's last row, the inserts behind it; roles: u or a for
        what is made, . for what is kept or gone."""
        edits = np.full((self.rows, self.many), "", object)
        roles = edits.copy()
        for k in range(self.rows):
            state = np.where(self.begins[k], NONE, state)
            real, initial, extra, must = self.row(k)
            here, after = costs[k], self.after(k, costs[k + 1])
            open_ = real.copy()
            while open_.any():
                now, to, made = here[self.lane, state], KEPT[state, initial], MADE[state]
                # the least sign of those that are cheapest
                delete = open_ & (now == DELETE + after[self.lane, state])
                insert = open_ & ~delete & (now == INSERT + here[self.lane, made])
                keep = open_ & ~delete & ~insert & (to >= 0) & ~must & (now == KEEP + extra + after[self.lane, to])
                other = open_ & ~delete & ~insert & ~keep
                for some, sign in ((delete, "D"), (insert, "I"), (keep, "K"), (other, "R")):
                    edits[k][some] += sign
                    roles[k][some] += "." if sign in "DK" else ROLE_OF[made[some]]
                state = np.where(keep, to, np.where(insert | other, made, state))
                open_ &= insert
            while (more := real & self.closes[k] & (END[state] > 0)).any():
                edits[k][more] += "I"
                roles[k][more] += ROLE_OF[MADE[state][more]]
                state = np.where(more, MADE[state], state)
        return edits, roles, state


def inserted(costs: np.ndarray) -> np.ndarray:
    """Costs by state when rows may also be inserted first."""
    user = np.minimum(costs[:, USER], INSERT + costs[:, ASSISTANT])
    assistant = np.minimum(costs[:, ASSISTANT], INSERT + costs[:, USER])
    none, system = (np.minimum(costs[:, q], INSERT + user) for q in (NONE, SYSTEM))
    return np.stack([none, system, user, assistant], axis=1)


CODED = ["chunk", "codes", "begins", "goes_on", "next_initial"]


def chunk_rows(rows: DataFrame, size: int) -> DataFrame:
    """One row for each chunk: chunk, codes and begins of its rows, goes_on (its
    last conversation goes on in the next chunk), next_initial (of that row)."""
    row = F.struct("at", "key", (F.col("initial") + 4 * F.col("fault")).alias("code"))
    met = rows.groupBy(F.floor(F.col("at") / size).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    begins = F.transform("rows", lambda r, i: (i > 0) & (r["key"] != F.get("rows", F.greatest(i - 1, F.lit(0)))["key"]))
    codes = F.transform("rows", lambda r: r["code"])
    own = cut(met.select("chunk", codes.alias("codes"), begins.alias("begins"), F.get("rows", F.lit(0))["key"].alias("first_key"), F.element_at("rows", -1)["key"].alias("last_key")))
    after = own.select((F.col("chunk") - 1).alias("chunk"), F.col("first_key").alias("next_key"), (F.get("codes", F.lit(0)) % 4).alias("next_initial"))
    before = own.select((F.col("chunk") + 1).alias("chunk"), F.col("last_key").alias("key_before"))
    goes_on = F.coalesce(F.col("next_key") == F.col("last_key"), F.lit(False))
    starts = F.coalesce(F.col("key_before") != F.col("first_key"), F.lit(True))
    begins = F.transform("begins", lambda b, i: F.when(i == 0, starts).otherwise(b))
    met = own.join(after, "chunk", "left").join(before, "chunk", "left")
    return cut(met.select("chunk", "codes", begins.alias("begins"), goes_on.alias("goes_on"), F.when(goes_on, F.col("next_initial")).otherwise(-1).alias("next_initial")))


def parts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of at most LANES chunks."""
    for batch in batches:
        for at in range(0, len(batch), LANES):
            yield batch.iloc[at : at + LANES]


def vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64)


def converge(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(chunk and ends: the costs behind it, less their least; passes made).
    A chunk is run again only if the vector behind it isn't the one it ran with."""
    kind = "chunk long, ends array<bigint>, vector array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts_of(batches):
            found = Chunks(batch).backward(vectors(batch["ends"]))[0]
            yield pd.DataFrame({"chunk": batch["chunk"], "ends": batch["ends"], "vector": list(found - found.min(1, keepdims=True))})

    known, guess = (F.array(*map(F.lit, v)).cast("array<bigint>") for v in (END.tolist(), [0] * 4))
    work, state, passes = chunks.withColumn("ends", F.when(F.col("goes_on"), guess).otherwise(known)), None, 0
    while True:
        found = cut(work.mapInPandas(run, kind))
        passes += 1
        state = found if state is None else cut(state.join(found.select("chunk"), "chunk", "left_anti").unionByName(found))
        behind = found.select((F.col("chunk") - 1).alias("chunk"), F.col("vector").alias("behind"))
        moved = chunks.filter("goes_on").join(behind, "chunk").join(state.select("chunk", "ends"), "chunk").filter("behind <> ends")
        work = cut(moved.select(*CODED, F.col("behind").alias("ends")))
        if work.isEmpty():
            return state.select("chunk", "ends"), passes


def entered(maps: DataFrame, many: int, fan: int = 1024) -> DataFrame:
    """(chunk, state): in which state each of `many` chunks is entered. maps:
    chunk, to (the state behind it by the state before it). The maps of `fan`
    chunks in a row are one map, again and again, until one is left."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        to = np.arange(4)
        for own in pdf.sort_values("chunk")["to"]:
            to = np.asarray(own)[to]
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0] // fan], "to": [to.tolist()]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, states = pdf["state"].iloc[0], []
        for to in pdf["to"]:
            states.append(state)
            state = to[state]
        return pd.DataFrame({"chunk": pdf["chunk"], "state": states})

    group = F.floor(F.col("chunk") / fan).cast("long")
    if many > fan:
        groups = cut(maps.groupBy(group).applyInPandas(whole, "chunk long, to array<int>"))
        starts = entered(groups, -(-many // fan), fan).select(F.col("chunk").alias("g"), "state")
    else:
        starts = maps.sparkSession.createDataFrame([(0, NONE)], "g long, state int")
    return maps.withColumn("g", group).join(starts, "g").groupBy("g").applyInPandas(walk, "chunk long, state int")


def edit_rows(chunks: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(at, edits, roles, cost, illegal of each row; passes of converge)."""
    ends, passes = converge(chunks)
    ready = cut(chunks.join(ends, "chunk"))

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts_of(batches):
            own = Chunks(batch)
            costs = own.backward(vectors(batch["ends"]))
            to = [own.trace(costs, np.full(own.many, q))[2] for q in range(4)]
            yield pd.DataFrame({"chunk": batch["chunk"], "to": np.stack(to, axis=1).tolist()})

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts_of(batches):
            own = Chunks(batch)
            costs = own.backward(vectors(batch["ends"]))
            signs, roles, _ = own.trace(costs, batch["state"].to_numpy(np.int64))
            # what a conversation costs from here on, where it begins; what its chunk adds, where it goes on
            cost = np.where(own.begins, np.stack([c[:, NONE] for c in costs[:-1]]), 0)
            cost[0] += np.where(own.begins[0], 0, costs[0].min(1))
            initial = own.codes & 3
            legal = ((initial == 0) & (own.next_initial == 1)) | ((initial == 1) & (own.next_initial == 2)) | ((initial == 2) & (own.next_initial == 1))
            k, m = np.nonzero(own.codes >= 0)
            illegal = ((own.next_initial >= 0) & ~own.closes & ~legal)[k, m]
            at = batch["chunk"].to_numpy(np.int64)[m] * size + k
            yield pd.DataFrame({"at": at, "edits": signs[k, m], "roles": roles[k, m], "cost": cost[k, m], "illegal": illegal.astype(np.int64)})

    maps = cut(ready.mapInPandas(exits, "chunk long, to array<int>"))
    states = entered(maps, maps.count())
    return cut(ready.join(states, "chunk").mapInPandas(edits, "at long, edits string, roles string, cost long, illegal long")), passes


def repair(turns: DataFrame, chunk: int = CHUNK, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each row of turns, in the order `at`: key (of the conversation;
    never null), conv_id, turn, role, text, at, initial, fault (0, blank 1,
    duplicate 2, truncated 3), edits (I for each row inserted before it, then K,
    R or D, and with the last row of a conversation the inserts behind it),
    roles (u or a for each edit that makes a role), cost (parts of the
    conversation's: they add up to it), illegal (1 if the next row of the
    conversation may not follow).

    A row is blank if its text has no sign but white space, a duplicate if an
    earlier row of the conversation has its role and text, truncated if its last
    sign isn't one of .!?; the first of these counts. Null roles and texts count
    as one space; a role that is empty or begins with other than s, u or a can't
    be kept. Rows of a null conv_id are one conversation; rows of a null turn
    come first; rows of one turn are ordered by role and text. Of the cheapest
    edits those least in ASCII are taken. Rows are sorted once and numbered, and
    a task sees chunks of `chunk` rows without their texts, so a conversation
    may hold any share of the table. An empty table gives no rows. Other columns
    aren't read.
    """
    rows = faults(turns, conv, turn, role, text)
    edits, _ = edit_rows(chunk_rows(rows, chunk), chunk)
    return cut(rows.join(edits, "at"))


def repaired(found: DataFrame) -> DataFrame:
    """The repaired conversations from what repair gives: key, conv_id, at, step
    (order of rows that stem from one row), edit, turn (null if inserted), role, text."""
    steps = F.transform(F.split("edits", ""), lambda e, i: F.struct(i.cast("int").alias("step"), e.alias("edit"), F.substring("roles", i + 1, F.lit(1)).alias("made")))
    each = found.withColumn("e", F.explode(steps)).select("*", "e.*").filter("edit NOT IN ('D', '')")
    made = F.when(F.col("made") == "u", "user").otherwise("assistant")
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(made)
    own = lambda c, none: F.when(F.col("edit") == "I", none).otherwise(F.col(c)).alias(c)
    return each.select("key", "conv_id", "at", "step", "edit", own("turn", F.lit(None)), role.alias("role"), own("text", F.lit("")))


def digests(rows: DataFrame) -> DataFrame:
    """key and repaired_sha256: role:text of its rows, newline-joined. A digest
    needs its rows one after the other: they pass through a task as a sorted
    stream, of which one batch is held, never as a group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None

        def done(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [k for k, _ in pairs], "repaired_sha256": [h.hexdigest() for _, h in pairs]}, pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))

        for batch in batches:
            out = []
            for k, line in zip(batch["key"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if k != key:
                    if now is not None:
                        out.append((key, now))
                    key, now = k, hashlib.sha256()
                else:
                    now.update(b"\n")
                now.update(line.encode())
            yield done(out)
        if now is not None:
            yield done([(key, now)])

    lines = rows.select("key", "at", "step", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("key").sortWithinPartitions("key", "at", "step").select("key", "line").mapInArrow(work, "key string, repaired_sha256 string")


def summary(found: DataFrame) -> DataFrame:
    """One row for each conversation of what repair gives: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256. An audit is one
    value, a letter or so for each row of its conversation."""
    of = lambda n: F.count_if(F.col("fault") == n)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "edits"))), lambda s: s["edits"])
    counts = found.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), of(BLANK).alias("blank"), of(DUPLICATE).alias("duplicate"), of(CUT).alias("truncated"),
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(ordered, "").alias("audit"),
    )
    holes = found.groupBy("key").agg(gaps.alias("gaps"))
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    met = counts.join(holes, "key").join(digests(repaired(found)), "key", "left")
    return met.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha)


def damage(turns: DataFrame) -> DataFrame:
    """conversations with rows dropped, emptied, stripped of .!?, repeated or said by the user, by a checksum of their ids."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_table(turns: DataFrame, found: DataFrame) -> DataFrame:
    """summary with a row for each conversation of turns: those without rows in found have nothing to repair."""
    every = turns.select(F.col("conv_id").alias("own")).distinct()
    met = every.join(summary(found), F.col("own").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return met.select(F.col("own").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), sha)


def oracle_sql() -> str:
    """damage, repair and summary in SQL: costs and edits row by row."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: CAST(unicode(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
    to = lambda q, i: {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((q, i))
    kept = lambda q, v: "CASE r.initial " + " ".join(f"WHEN {i} THEN {v(to(q, i))}" for i in range(3) if to(q, i)) + " ELSE 1000000 END"
    made = [2, 2, 3, 2]
    cost = lambda q: f"least(3 + b.v{q}, CASE WHEN r.must THEN 1000000 ELSE least(2 + r.extra + b.v{made[q]}, r.extra + {kept(q, lambda t: f'b.v{t}')}) END)"
    pick = lambda row, q: f"CASE {q} " + " ".join(f"WHEN {n} THEN {row}.v{n}" for n in range(4)) + " END"
    to_made = "CASE t.q WHEN 2 THEN 3 ELSE 2 END"
    to_kept = "CASE t.q * 4 + r.initial " + " ".join(f"WHEN {q * 4 + i} THEN {to(q, i)}" for q in range(4) for i in range(4) if to(q, i)) + " END"
    return f"""WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '-') AS key, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
  WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
  CASE role[1] WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS initial FROM numbered),
r AS MATERIALIZED (SELECT *, fault IN (1, 2) AS must, CASE fault WHEN 3 THEN 1 ELSE 0 END AS extra,
  lead(initial) OVER (PARTITION BY key ORDER BY i) AS behind FROM faulty),
sizes AS MATERIALIZED (SELECT key, max(i) AS n FROM r GROUP BY key),
b AS (
  SELECT key, n + 1 AS i, 0 AS v0, 4 AS v1, 2 AS v2, 0 AS v3 FROM sizes
  UNION ALL
  SELECT key, i, least(w0, 2 + least(w2, 2 + w3)), least(w1, 2 + least(w2, 2 + w3)), least(w2, 2 + w3), least(w3, 2 + w2) FROM (
    SELECT r.key, r.i, {cost(0)} AS w0, {cost(1)} AS w1, {cost(2)} AS w2, {cost(3)} AS w3 FROM b JOIN r ON r.key = b.key AND r.i = b.i - 1)),
costs AS MATERIALIZED (SELECT * FROM b),
t AS (
  SELECT key, CAST(1 AS BIGINT) AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS rows FROM sizes
  UNION ALL
  SELECT key, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN to_kept ELSE to_made END, audit || e,
         CASE e WHEN 'D' THEN rows WHEN 'K' THEN list_append(rows, role || ':' || text)
           ELSE list_append(rows, CASE to_made WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT t.*, r.role, r.text, {to_made} AS to_made, {to_kept} AS to_kept,
      CASE WHEN r.i IS NOT NULL AND {pick('h', 't.q')} = 3 + {pick('a', 't.q')} THEN 'D'
           WHEN {pick('h', 't.q')} = 2 + {pick('h', '(' + to_made + ')')} THEN 'I'
           WHEN NOT r.must AND {to_kept} IS NOT NULL AND {pick('h', 't.q')} = r.extra + {pick('a', '(' + to_kept + ')')} THEN 'K' ELSE 'R' END AS e
    FROM t JOIN sizes s ON s.key = t.key JOIN costs h ON h.key = t.key AND h.i = t.i
    LEFT JOIN costs a ON a.key = t.key AND a.i = t.i + 1 LEFT JOIN r ON r.key = t.key AND r.i = t.i
    WHERE t.i <= s.n OR t.q IN (1, 2))),
done AS (SELECT t.key, audit, rows FROM t JOIN sizes s ON s.key = t.key WHERE t.i = s.n + 1 AND t.q IN (0, 3)),
counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (behind IS NOT NULL AND (initial, behind) NOT IN ((0, 1), (1, 2), (2, 1))) AS illegal FROM r GROUP BY key),
every AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '-') AS key FROM conversations)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(v0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rows, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN counts USING (key) LEFT JOIN done USING (key) LEFT JOIN (SELECT key, v0 FROM costs WHERE i = 1) USING (key)"""

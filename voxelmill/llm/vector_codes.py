"""Codes of vectors: a codebook for each part, fitted with norm-of-sum bounds.

A vector of whole numbers is cut into equal parts; each part position has a
codebook of entries, fitted by rounds of assigning every part to its nearest
entry and moving every entry to the floor of its parts' mean.

A part keeps a lower bound of its distance to all entries but its own, with the
stamp of the round in which the bound was exact. The codebooks of all rounds are
kept, so in a later round the bound is lowered by how far an entry now is from
where it was at that stamp: the norm of the sum of its moves, which is at most,
and for entries that swing back far less than, the sum of the moves' norms. Only
parts whose own entry is not surely nearest are scanned again, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop, fresh_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are held within this, so that squared distances stay whole numbers of 64 bits.
MOST = 1 << 27
#: Doubles are exact up to here.
EXACT = 1 << 53
#: Bounds give way by this share, far more than rounding may take.
GIVE = 1e-9

Books = list[np.ndarray]  # of one length of vectors, by round: (parts, entries, width)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers to the entries of one part."""
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book], axis=1)


def net_moves(books: Books, part: int) -> np.ndarray:
    """(round, entry): the most that any other entry is now from where it was in that round."""
    now = books[-1][part].astype(np.float64)
    out = np.empty((len(books), len(now)))
    for t, old in enumerate(books):
        moved = np.sqrt(((now - old[part]) ** 2).sum(1))
        order = np.sort(moved)
        most, second = order[-1], order[-2] if len(order) > 1 else 0.0
        first = int(np.argmax(moved))
        out[t] = most
        out[t, first] = second
    return out


def assign(x: np.ndarray, books: Books, part: int, own: np.ndarray | None, low: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, low, stamp, parts scanned) of rows of one part
    under the last of books. own: entries of the round before, None in the first."""
    now, book = len(books) - 1, books[-1][part]
    if own is None:
        scan = np.arange(len(x))
        own, d = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        low, stamp = np.zeros(len(x)), np.zeros(len(x), np.int64)
    else:
        d = ((x - book[own]) ** 2).sum(1)
        bound = low * (1 - GIVE) - net_moves(books, part)[stamp, own] * (1 + GIVE)
        scan = np.flatnonzero(np.sqrt(d.astype(np.float64)) * (1 + GIVE) >= bound)
        own, low, stamp = own.copy(), low.copy(), stamp.copy()
    if len(scan):
        all_d = squared(x[scan], book)
        best = np.argmin(all_d, axis=1)  # the first of equals
        row = np.arange(len(scan))
        own[scan], d[scan], stamp[scan] = best, all_d[row, best], now
        if len(book) > 1:
            all_d[row, best] = np.iinfo(np.int64).max
            low[scan] = np.sqrt(all_d.min(1).astype(np.float64))
        else:
            low[scan] = np.inf
    return own, d, low, stamp, len(scan)


STATE = "vec_id long, label {label}, d int, v array<int>, own array<int>, low array<double>, stamp array<int>, error long, sums array<bigint>"


def step(state: DataFrame, books: dict[int, Books], label: str) -> DataFrame:
    """state with every part assigned under the last of books; besides, for each
    task and length of vectors, a row that has only sums: for each part and
    entry the parts' sum by component and their count, then the parts scanned and all parts."""

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        offsets = np.arange(0, values.size + 1, PARTS, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            length = batch["d"].to_numpy(zero_copy_only=False)
            for d in np.unique(length).tolist():
                some = batch.filter(pa.array(length == d)) if (length != d).any() else batch
                n, width = some.num_rows, -(-d // PARTS)
                x = np.zeros((n, PARTS * width), np.int64)
                x[:, :d] = some["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, d)
                x = x.reshape(n, PARTS, width)
                history = books[d]
                before = [some[c].flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS) if len(history) > 1 else None for c in ("own", "low", "stamp")]
                own, low, stamp = np.empty((n, PARTS), np.int64), np.empty((n, PARTS)), np.empty((n, PARTS), np.int64)
                error, k = np.zeros(n, np.int64), history[-1].shape[1]
                if d not in totals:
                    totals[d] = [np.zeros((PARTS, k, width + 1), np.int64), 0, 0]
                for p in range(PARTS):
                    had = [b[:, p] if b is not None else None for b in before]
                    had = [h.astype(np.int64) if h is not None and at != 1 else h for at, h in enumerate(had)]
                    own[:, p], far, low[:, p], stamp[:, p], scanned = assign(x[:, p], history, p, *had)
                    error += far
                    total = totals[d][0][p]
                    order = np.argsort(own[:, p], kind="stable")
                    entry, first = np.unique(own[order, p], return_index=True)
                    if n and width:
                        total[entry, :width] += np.add.reduceat(x[order, p], first, axis=0)
                    total[:, width] += np.bincount(own[:, p], minlength=k)
                    totals[d][1] += scanned
                totals[d][2] += n * PARTS
                yield pa.RecordBatch.from_arrays(
                    [some["vec_id"], some["label"], some["d"], some["v"], lists(own, pa.int32()), lists(low, pa.float64()), lists(stamp, pa.int32()), pa.array(error), pa.nulls(n, pa.list_(pa.int64()))],
                    names=schema.names,
                )
        for d, (total, scanned, of) in totals.items():
            sums = [*total.ravel().tolist(), scanned, of]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()) if f.name == "d" else pa.array([sums], pa.list_(pa.int64())) if f.name == "sums" else pa.nulls(1, f.type) for f in schema],
                names=schema.names,
            )

    return state.mapInArrow(work, STATE.format(label=label))


def moved(book: np.ndarray, total: np.ndarray) -> np.ndarray:
    """book with each used entry at the floor of its parts' mean; total: sums and, last, counts."""
    count = total[..., -1:]
    return np.where(count > 0, total[..., :-1] // np.maximum(count, 1), book)


def collect_sums(state: DataFrame) -> dict[int, np.ndarray]:
    """The sums of all tasks: parts x entries x (width + 1) + 2 whole numbers for each length of vectors, whatever the rows."""
    each = state.filter("sums IS NOT NULL").select("d", F.posexplode("sums").alias("at", "s"))
    # wider than 64 bits, as tasks' sums may be as large as that
    rows = each.groupBy("d", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for d in {r.d for r in rows}:
        own = {r["at"]: int(r.s) for r in rows if r.d == d}
        out[d] = np.array([own[k] for k in range(len(own))], dtype=object)
    return out


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, embedding: str, id: str, label: str) -> DataFrame:
    """The rows whose vectors are usable: vec_id, label, d (length), v (floor(4096 x))."""
    x = F.col(embedding)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * SCALE))).cast("int"))
    kept = vectors.filter(x.isNotNull() & finite)
    return kept.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.size(x).alias("d"), whole.alias("v"))


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, embedding: str = "embedding", id: str = "vec_id", label: str = "label") -> tuple[DataFrame, dict[int, Books], list[float]]:
    """(codes, codebooks by round of each length, share of parts scanned in each round).

    codes has a row for each vector that is not null and holds no null or
    non-finite component: vec_id, label, d (its length), own (the entry of each
    of the 8 parts), error (squared distances, summed). Each length of vectors
    has codebooks of its own; a length that 8 doesn't divide is filled up with
    zeros, and an empty vector has parts without components. The codebooks begin
    with the parts of the 16 smallest ids (nulls last; equal ids in the order
    of their vectors), or of all vectors if there are fewer. Whole components
    are held within 2^27, which no vector below 32 768 reaches. Rows that repeat
    an id or a vector are rows of their own. An empty table gives no rows.
    Other columns aren't read.

    A round is one pass over the state, written to the shared folder. The driver
    holds 16 entries for each length and round, and the sums for them.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[label].dataType.simpleString()
    whole = whole_vectors(vectors, embedding, id, label)
    # with a bound on row_number each task keeps its own 16 first
    first = Window.partitionBy("d").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    seeds = whole.select("d", "vec_id", "v").withColumn("n", F.row_number().over(first)).filter(f"n <= {ENTRIES}")
    books: dict[int, Books] = {}
    for r in sorted(seeds.select("d", "n", "v").collect(), key=lambda r: (r.d, r.n)):
        width = -(-r.d // PARTS)
        books.setdefault(r.d, []).append(np.array([*r.v, *[0] * (PARTS * width - r.d)], np.int64).reshape(PARTS, width))
    books = {d: [np.stack(b, axis=1)] for d, b in books.items()}
    nothing = {"own": "array<int>", "low": "array<double>", "stamp": "array<int>", "error": "long", "sums": "array<bigint>"}
    state, path, scanned = whole.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}), None, []
    for r in range(rounds + 1):
        old, path = path, fresh_path(spark, "vector_codes")
        step(state, books, kind).write.parquet(path)
        if old:
            drop(spark, old)
        written = spark.read.schema(STATE.format(label=kind)).parquet(path)
        state = written.filter("sums IS NULL")
        sums = collect_sums(written)
        scanned.append(sum(int(s[-2]) for s in sums.values()) / max(1, sum(int(s[-1]) for s in sums.values())))
        if r < rounds:
            for d, s in sums.items():
                book = books[d][-1]
                total = s[:-2].reshape(*book.shape[:2], book.shape[2] + 1)
                books[d].append(moved(book, total).astype(np.int64))
    return state.select("vec_id", "label", "d", "own", "error"), books, scanned


def code_table(spark: SparkSession, codes: DataFrame, books: dict[int, Books]) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    code = F.array_join(F.transform("own", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    of_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_")
    digests = spark.createDataFrame([(d, digest(b[-1])) for d, b in books.items()], "d int, codebooks_sha256 string")
    met = codes.join(of_label, F.col("label").eqNullSafe(F.col("label_"))).join(digests, "d")
    return met.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL: every round scans all entries."""
    ctes = [
        """k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)""",
        "x AS MATERIALIZED (SELECT r, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM k, range(8) t(p))",
        "c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= 16)",
    ]
    far = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (SELECT r, p, e, CAST({far} AS BIGINT) AS d FROM x JOIN c{n} USING (p)) GROUP BY r, p)")
        if n < rounds:
            ctes.append(f"""m{n} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
  SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM x JOIN a{n} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e)""")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (p, e))")
    last = rounds
    return f"""WITH {', '.join(ctes)},
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h"""

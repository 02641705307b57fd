"""Personal data: patterns of four kinds, and bootstrapped contextual extraction.

Entities found by the four patterns are seeds. A lexical pattern is the word
before an entity (L:word) or behind it (R:word). Patterns and values form a graph: a pattern is as good as the
share of all its places in the corpus that hold a known entity of a kind, and a
value that no pattern of the four matched, but which looks like an identifier,
is as good as the patterns it stands in. Scores are passed to and fro over that
graph by joins and sums; values over `least_score` are new entities and seeds of
the next round. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .spans import digits, listed, tagged, with_apart, with_matches

KINDS = ("email", "ip", "card", "phone")
# Same matches as the plain patterns: what follows a possessive run is never in
# its class, and a match can't begin inside a run that failed from its start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
UNKNOWN = r"(?<![A-Za-z0-9])[A-Za-z]{0,4}[#-]?[0-9][A-Za-z0-9./()-]{4,}+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"^(?:{PART}\.){{3}}{PART}$"


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP)
    count = F.length(digits(value))
    if kind == "card":
        return F.when(count.between(14, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return count.between(10, 15)
    return F.lit(True)


def _valid_spans(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["value"]))


def _tagged_words(spans: Column, kind: str, rank: int) -> Column:
    """Tagged spans that keep the words around them."""
    names = ("start", "rank", "end", "kind", "value", "left", "right")
    value = {"rank": F.lit(rank), "kind": F.lit(kind)}
    return F.transform(spans, lambda s: F.struct(*[(value[n] if n in value else s[n]).alias(n) for n in names]))


def _bare(spans: str) -> Column:
    """Tagged spans without the words around them."""
    return F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "rank", "end", "kind", "value")])).alias(spans)


def _of_kind(kind: str) -> Column:
    return F.filter("base", lambda s: s["kind"] == kind)


def _around(spans: str) -> Column:
    """What is known of each span's place: kind, value, and its patterns."""

    def patterns(s: Column) -> Column:
        found = F.array(F.concat(F.lit("L:"), F.lower(s["left"])), F.concat(F.lit("R:"), F.lower(s["right"])))
        return F.filter(found, lambda w: (F.length(w) > 2) & ~w.rlike("[0-9]"))

    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"), patterns(s).alias("patterns")))


def score_graph(edges: DataFrame, places: DataFrame, rounds: int, least_pattern: float, least_support: int, least_score: float) -> DataFrame:
    """(value, kind, score) of new entities. edges: pattern, kind (null if
    unknown), value, n; places: pattern, total. In each round all patterns that
    a known entity stands in are scored, those of entities found in the round
    before included. A value takes the kind of its best score; ties go to the
    kind that is listed first."""
    seeds = edges.filter("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    unknown = edges.filter("kind IS NULL").select("pattern", "value")
    known, new = seeds, None
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spots = cut(edges.groupBy("pattern", "value").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        held = spots.join(known, "value")
        good = held.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count("*").alias("support"))
        good = good.filter(F.col("support") >= least_support).join(places, "pattern")
        good = good.withColumn("worth", F.least(F.col("mass") / (F.col("total") + 1), F.lit(0.999)))
        good = good.filter(F.col("worth") >= least_pattern).select("pattern", "kind", "worth")
        found = unknown.join(good, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("worth"))))).alias("score"))
        best = found.filter(F.col("score") >= least_score).groupBy("value").agg(
            F.max(F.struct("score", (-rank).alias("r"), "kind")).alias("b")
        )
        before = new
        new = cut(best.select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")))
        if before is not None and new.select("value", "kind").exceptAll(before.select("value", "kind")).isEmpty():
            break
        known = seeds.union(new)
    return new


def count_places(lines: DataFrame, patterns: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """(pattern, total): how often the word of each pattern stands in the texts t
    of lines. The words asked for go to the texts if there are at most
    broadcast_rows of them, else both meet in a shuffle; the counts are the same."""
    wanted = cut(patterns.select(F.substring("pattern", 3, 1 << 30).alias("word")).distinct())
    words = lines.select(F.explode(F.split(F.lower("t"), r"[\x20\x09-\x0D]+")).alias("word"))
    few = wanted.count() <= broadcast_rows
    counted = words.join(F.broadcast(wanted) if few else wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("total"))
    return counted.select(F.explode(F.array(*[F.concat(F.lit(k), "word") for k in ("L:", "R:")])).alias("pattern"), "total")


def find_personal_data(
    docs: DataFrame,
    rounds: int = 6,
    least_pattern: float = 0.5,
    least_support: int = 3,
    least_score: float = 0.8,
    text: str = "text",
    id: str = "doc_id",
) -> DataFrame:
    """One row for each row of docs: doc_id, base (spans of the four kinds) and
    more (spans the bootstrapping adds, of the same kinds; they overlap no base
    span). A span is start, rank, end, kind, value; places are code points.

    rounds: at most so many; each reaches one pattern further from the seeds.
    Null and empty texts have no spans. Rows that repeat an id are looked at one
    by one. Whole texts are read, of any length. An empty table gives no rows.
    Other columns of docs aren't read.
    """
    lines = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = with_matches(lines, "t", PATTERNS | {"odd": UNKNOWN}, words=True)
    likely = F.filter("odd", lambda s: (F.length(digits(s["value"])) >= 6) | s["value"].contains("(") | s["value"].contains("["))
    full = [_tagged_words(_valid_spans(k), k, n) for n, k in enumerate(KINDS)]
    found = found.select("doc_id", F.xxhash64("t").alias("t_hash"), F.concat(*full).alias("base"), _tagged_words(likely, "unknown", len(KINDS)).alias("odd"))
    found = with_apart(found, "odd", "odd", "base")
    found = found.select("doc_id", "t_hash", _bare("base"), _bare("odd"), F.concat(_around("base"), _around("odd")).alias("around"))
    found = cut(found)
    held = found.select(F.explode("around").alias("a")).select("a.kind", "a.value", F.explode("a.patterns").alias("pattern"))
    edges = cut(held.groupBy("pattern", F.when(F.col("kind") != "unknown", F.col("kind")).alias("kind"), "value").agg(F.count("*").alias("n")))
    # a pattern with fewer values than it needs to count is never good
    useful = edges.groupBy("pattern").agg(F.count_distinct("value").alias("s")).filter(F.col("s") >= least_support)
    places = cut(count_places(lines, useful.select("pattern")))
    new = score_graph(edges, places, rounds, least_pattern, least_support, least_score)
    seen = found.select("doc_id", "t_hash", F.explode("odd").alias("s")).withColumn("v", F.lower(F.col("s.value")))
    added = seen.join(new.select(F.col("value").alias("v"), F.col("kind").alias("k")), "v").distinct()
    rank = (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("k")) - 1).cast("int")
    span = F.struct(F.col("s.start").alias("start"), rank.alias("rank"), F.col("s.end").alias("end"), F.col("k").alias("kind"), F.col("s.value").alias("value"))
    added = added.groupBy(F.col("doc_id").alias("a_id"), F.col("t_hash").alias("a_hash")).agg(F.collect_list(span).alias("more"))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("t_hash") == F.col("a_hash")), "left")
    empty = F.filter("base", lambda s: F.lit(False))
    return joined.select("doc_id", "base", F.coalesce("more", empty).alias("more"))


def digest_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256, spans."""
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans")
    )

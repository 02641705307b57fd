"""Secrets: patterns of three kinds, and a battery of randomness tests.

Any other long run of key characters is put to three tests in the alphabet that
its characters point to: chi-squared uniformity over quarters of the alphabet,
Wald-Wolfowitz runs about its middle, and lag-one serial correlation. Fisher's
method joins the three. Random strings have even p-values and others have small
ones, so in each class of encoding and length the share of p-values over one
half tells how many strings are random, and the threshold is the smallest at
which the expected share of false finds stays under `max_false`. Short strings,
which the tests can't tell apart, meet higher thresholds that way. All of it is
DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .spans import tagged, with_apart, with_matches

KINDS = ("assign", "access", "hex")
# Same matches as the plain patterns, see pii.PATTERNS. Runs that the plain
# pattern matches and then drops for their length are left out where no other
# match could begin inside them.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
}
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)$"""
OTHER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Encodings by the characters they allow, the narrowest first.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
GRID = 50


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to about 1e-7."""
    t = 1 / (1 + x * 0.3275911)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def battery(strings: DataFrame) -> DataFrame:
    """strings (value) with encoding, n, p_uniform, p_runs, p_serial and p: how
    likely a random string of that alphabet is to look less random. Values of
    no encoding, or under two characters, get nulls."""
    bare = F.regexp_replace("value", "=+$", "")
    df = strings.withColumn("bare", bare).withColumn("n", F.length("bare").cast("double"))
    encoding = F.coalesce(*[F.when(F.col("bare").rlike(p), F.lit(n)) for n, (_, p, _) in enumerate(ENCODINGS)])
    df = df.withColumn("e", F.when(F.col("n") >= 2, encoding))
    df = df.withColumn("alphabet", F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), F.col("e") + 1))
    df = df.withColumn("size", F.length("alphabet"))
    at = F.transform(
        F.sequence(F.lit(1), F.length("bare")), lambda i: (F.instr("alphabet", F.substring(F.col("bare"), i, F.lit(1))) - 1).cast("double")
    )
    # cut here and below: what follows uses these columns many times over
    df = cut(df.withColumn("at", F.when(F.col("e").isNotNull(), at)))
    zero, n = F.lit(0.0), F.col("n")
    total = lambda xs: F.aggregate(xs, zero, lambda a, b: a + b)
    quarter = n / 4

    def off(q: int) -> Column:
        return F.power(F.size(F.filter("at", lambda v: F.floor(v * 4 / F.col("size")) == q)) - quarter, 2) / quarter

    chi = off(0) + off(1) + off(2) + off(3)
    df = df.withColumn("chi", chi).withColumn("mean", total(F.col("at")) / n)
    high = F.size(F.filter("at", lambda v: v * 2 >= F.col("size"))).cast("double")
    df = cut(df.withColumn("high", high))
    next_ = F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(1)))
    first = F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(1)))
    half = lambda v: v * 2 >= F.col("size")
    turns = total(F.zip_with(first, next_, lambda a, b: F.when(half(a) != half(b), 1.0).otherwise(0.0))) + 1
    around = total(F.zip_with(first, next_, lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))))
    spread = total(F.transform("at", lambda v: (v - F.col("mean")) * (v - F.col("mean"))))
    df = cut(df.withColumns({"turns": turns, "around": around, "spread": spread}))
    x = F.col("chi")
    expected = 2 * F.col("high") * (n - F.col("high")) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(variance > 0, F.abs(F.col("turns") - expected) / F.sqrt(variance)).otherwise(F.lit(9.0))
    z_serial = F.when(F.col("spread") > 0, F.abs(F.col("around") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    df = df.withColumns(
        {
            "p_uniform": F.least(F.lit(1.0), erfc(F.sqrt(x / 2)) + F.sqrt(2 * x / math.pi) * F.exp(-x / 2)),
            "p_runs": erfc(z_runs / math.sqrt(2)),
            "p_serial": erfc(z_serial / math.sqrt(2)),
        }
    )
    logs = -sum((F.log(F.greatest(F.col(c), F.lit(1e-300))) for c in ("p_uniform", "p_runs")), F.log(F.greatest("p_serial", F.lit(1e-300))))
    df = df.withColumn("y", logs)
    joint = F.exp(-F.col("y")) * (1 + F.col("y") + F.col("y") * F.col("y") / 2)
    return df.select(
        *strings.columns, F.element_at(F.array(*[F.lit(e) for e, _, _ in ENCODINGS]), F.col("e") + 1).alias("encoding"),
        F.col("n").cast("long").alias("n"), "p_uniform", "p_runs", "p_serial", joint.alias("p"),
    )


def thresholds(tested: DataFrame, max_false: float, least_strings: int = 20) -> DataFrame:
    """(encoding, band, least_p): from which p on a string of that encoding and
    length counts as random. Bands are half powers of two; a band with fewer
    than least_strings strings is judged with all of its encoding. No row: none
    of the class counts."""
    cell = tested.select("encoding", "band", F.least(F.floor(F.col("p") * GRID), F.lit(GRID - 1)).alias("cell"))
    counts = cell.groupBy("encoding", "band", "cell").agg(F.count("*").alias("k"))
    wide = counts.groupBy("encoding", "cell").agg(F.sum("k").alias("k")).select("encoding", F.lit(-1).alias("band"), "cell", "k")
    # rows: encodings x bands x GRID at most
    steps = F.sequence(F.lit(1), F.lit(GRID // 2))
    tall = counts.select("encoding", F.col("band").cast("int").alias("band"), "cell", "k").union(wide)
    per = tall.groupBy("encoding", "band").agg(F.sum("k").alias("m"), F.sum(F.when(F.col("cell") >= GRID // 2, F.col("k")).otherwise(0)).alias("upper"))
    tried = tall.withColumn("step", F.explode(steps)).groupBy("encoding", "band", "step").agg(
        F.sum(F.when(F.col("cell") >= F.col("step"), F.col("k")).otherwise(0)).alias("taken")
    )
    random = F.least(F.col("m"), 2 * F.col("upper")).cast("double")
    false = 1 - random * (1 - F.col("step") / GRID) / F.col("taken")
    fit = tried.join(per, ["encoding", "band"]).filter("taken > 0").filter(false <= max_false)
    best = fit.groupBy("encoding", "band", "m").agg((F.min("step") / GRID).alias("least_p"))
    own = best.filter((F.col("band") >= 0) & (F.col("m") >= least_strings)).select("encoding", "band", "least_p")
    few = per.filter((F.col("band") >= 0) & (F.col("m") < least_strings)).select("encoding", "band")
    pooled = few.join(best.filter("band = -1").select("encoding", "least_p"), "encoding").select("encoding", "band", "least_p")
    return own.union(pooled)


def find_secrets(docs: DataFrame, max_false: float = 0.05, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, base (spans of the three kinds) and
    more (spans of kind random that overlap no base span). A span is start,
    rank, end, kind, value; places are code points.

    Only runs of 20 or more characters with a digit and a letter are tested.
    Null and empty texts have no spans. Rows that repeat an id are looked at one
    by one. Whole texts are read. An empty table gives no rows. Other columns of
    docs aren't read.
    """
    lines = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = with_matches(lines, "t", PATTERNS | {"other": OTHER})
    assign = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], VALUE, 1)) >= 12)
    base = F.concat(tagged(assign, "assign", 0), tagged(F.col("access"), "access", 1), tagged(F.col("hex"), "hex", 2))
    found = found.select("doc_id", F.xxhash64("t").alias("t_hash"), base.alias("base"), "other")
    mixed = F.filter("other", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    found = with_apart(found.withColumn("other", tagged(mixed, "random", 3)), "other", "other", "base")
    found = cut(found.select("doc_id", "t_hash", "base", "other"))
    strings = found.select("doc_id", "t_hash", F.explode("other").alias("s")).distinct()
    tested = battery(strings.withColumn("value", F.col("s.value"))).filter("p IS NOT NULL")
    tested = cut(tested.withColumn("band", F.floor(F.log2("n") * 2).cast("int")))
    # encodings x bands at most
    passed = tested.join(F.broadcast(thresholds(tested, max_false)), ["encoding", "band"]).filter("p >= least_p")
    added = passed.groupBy(F.col("doc_id").alias("a_id"), F.col("t_hash").alias("a_hash")).agg(F.collect_list("s").alias("more"))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("t_hash") == F.col("a_hash")), "left")
    empty = F.filter("base", lambda s: F.lit(False))
    return joined.select("doc_id", "base", F.coalesce("more", empty).alias("more"))

"""Places of regular expression matches as column expressions.

Spark's functions give matches but not their places; the lengths of what a split
leaves between them, added up, do. Positions are code points, ends exclusive.
Running values are taken in chunks, so that a text with very many matches costs
little more than its share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
CHUNK = 128
#: The last and the first word of what stands between two matches.
LAST_WORD = r"(?s)^(?:.*[\x20\x09-\x0D])?([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$"
FIRST_WORD = r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)"


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], words: bool = False) -> DataFrame:
    """df with one column for each name of patterns: the leftmost
    non-overlapping matches as SPAN. No pattern may match the empty string.
    Texts without a match are scanned once, others twice. words: spans also
    have `left` and `right`, the words that stand before and behind the match,
    parted from it by white space; empty if another match or nothing does."""
    kept = df.columns
    for name, pattern in patterns.items():
        df = df.withColumn(f"__h_{name}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gap = (
        (lambda p: F.struct(F.length(p).cast("bigint").alias("n"), F.regexp_extract(p, LAST_WORD, 1).alias("l"), F.regexp_extract(p, FIRST_WORD, 1).alias("r")))
        if words
        else (lambda p: F.struct(F.length(p).cast("bigint").alias("n")))
    )
    gaps = {
        f"__g_{name}": F.when(F.size(f"__h_{name}") > 0, F.transform(F.split(text, pattern, -1), gap)) for name, pattern in patterns.items()
    }
    df = df.withColumns(gaps)

    def steps(name: str) -> Column:
        return F.transform(f"__h_{name}", lambda v, i: F.length(v).cast("bigint") + F.get(F.col(f"__g_{name}"), i)["n"])

    df = df.withColumns({f"__l_{n}": F.when(F.size(f"__h_{n}") > 0, steps(n)) for n in patterns})
    zero = F.lit(0).cast("bigint")
    df = df.withColumns({f"__s_{n}": F.when(F.size(f"__h_{n}") > 0, running(F.col(f"__l_{n}"), lambda a, b: a + b, zero)) for n in patterns})
    return df.select(*kept, *[_placed(f"__h_{name}", f"__g_{name}", f"__s_{name}", words).alias(name) for name in patterns])


def _placed(found: str, gaps: str, before: str, words: bool) -> Column:
    def span(value: Column, i: Column) -> Column:
        begin = F.get(F.col(before), i) + F.get(F.col(gaps), i)["n"]
        near = [F.get(F.col(gaps), i)["l"].alias("left"), F.get(F.col(gaps), i + 1)["r"].alias("right")] if words else []
        return F.struct(begin.alias("start"), (begin + F.length(value)).cast("bigint").alias("end"), value.alias("value"), *near)

    none = SPAN.replace("value:string", "value:string,left:string,right:string") if words else SPAN
    return F.when(F.size(found) > 0, F.transform(found, span)).otherwise(F.array().cast(none))


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of a non-empty array column, what op (associative) makes
    of zero and all elements before it."""
    kind = lambda acc: F.struct(acc.alias("at"), F.slice(F.array(acc), 1, 0).alias("out"))

    def scan(part: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, kind(start), step, lambda acc: acc["out"])

    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))
    chunk = lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK))
    totals = F.transform(numbers, lambda c: F.aggregate(chunk(c), zero, op))
    return F.flatten(F.transform(scan(totals, zero), lambda start, c: scan(chunk(c), start)))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """spans with what sorts and names them."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")
        ),
    )


def listed(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def with_apart(df: DataFrame, name: str, spans: str, others: str) -> DataFrame:
    """df with the column `name`: those of spans that overlap none of others
    (array columns of df), by one sweep over both in order."""
    kept = [c for c in df.columns if c != name]
    mark = lambda s, n: F.struct(s["start"].alias("start"), n.cast("int").alias("n"), s["end"].alias("end"))
    row = F.array_sort(F.concat(F.transform(spans, lambda s, i: mark(s, i + 1)), F.transform(others, lambda s: mark(s, F.lit(0)))))
    df = df.withColumn("__row", F.when((F.size(spans) > 0) & (F.size(others) > 0), row))
    far = F.lit((1 << 62)).cast("bigint")
    ends = F.transform("__row", lambda s: F.when(s["n"] == 0, s["end"]).otherwise(F.lit(0).cast("bigint")))
    starts = F.transform(F.reverse("__row"), lambda s: F.when(s["n"] == 0, s["start"]).otherwise(far))
    df = df.withColumns({"__ends": ends, "__starts": starts})
    df = df.withColumns(
        {
            "__ends": F.when(F.col("__row").isNotNull(), running(F.col("__ends"), lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint"))),
            "__starts": F.when(F.col("__row").isNotNull(), F.reverse(running(F.col("__starts"), lambda a, b: F.least(a, b), far))),
        }
    )
    # zipped, so that the running values aren't worked out anew for each element
    swept = F.arrays_zip("__row", "__ends", "__starts")
    free = F.filter(swept, lambda z: (z["__row"]["n"] > 0) & (z["__ends"] <= z["__row"]["start"]) & (z["__starts"] >= z["__row"]["end"]))
    some = F.transform(free, lambda z: F.get(F.col(spans), z["__row"]["n"] - 1))
    return df.select(*kept, F.when(F.col("__row").isNotNull(), some).otherwise(F.col(spans)).alias(name))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")

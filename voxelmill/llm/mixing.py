"""Mixing sources to target weights by drawing fixed-length blocks.

Each source is one stream of words, cut into blocks of `block_words`. The mix is
a row of slots, cut into output shards. Each shard's source counts are drawn
multinomially; what a source is drawn beyond its target is drawn again from what
the others still need, so the totals meet the targets. The j-th slot of a source
maps to a block through that source's pseudorandom index permutation, one for
each pass over the source, and slots and blocks are joined by (source, block).
All of it is DataFrame expressions; only sizes and block numbers are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import dense_index, running_sum
from ..session import cut

#: Words: runs of anything but [\x20\x09-\x0D].
SPACE_RUN = r"[\x20\x09-\x0D]+"
STRANDS = 4096


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def permuted(index: Column, size: Column, key: Column, rounds: int = 4) -> Column:
    """A pseudorandom permutation of 0..size-1 at `index`, one for each key. A
    round mixes the largest power of two that fits by odd multiplications and a
    shift, then turns the whole range; each step is one to one. Sizes up to 2^42.
    """
    bits = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def turn(x: Column, seed: Column) -> Column:
        spread = (x * (F.pmod(seed, F.lit(1 << 19)) * 2 + 1)).bitwiseAND(mask)
        folded = spread.bitwiseXOR(F.call_function("shiftright", spread, F.floor(bits / 2).cast("int") + 1))
        mixed = (folded * F.lit(0x9E375)).bitwiseAND(mask)
        return F.pmod(F.when(x <= mask, mixed).otherwise(x) + F.pmod(F.shiftright(seed, 20), size), size)

    seeds = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.xxhash64(key, r))
    return F.aggregate(seeds, index, turn)


def source_targets(sized: DataFrame, max_passes: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, n, source_size, target) for each source of sized (source, size).

    Sources in code point order, null last, weigh `weights`, repeating. They
    share the total size by weight; none goes over max_passes times its own
    size, and what is over is shared again among the others.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_index(sums, [F.col("source").asc_nulls_last()], "n")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod("n", F.lit(len(weights))).cast("int")]
    ranked = cut(ranked.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(max_passes)))
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else (F.col("most") <= F.col("w") * F.lit(level))
        total, used, open_, n = ranked.agg(
            F.sum("source_size"),
            F.sum(F.when(over, F.col("most")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("w"))),
            F.count(F.when(over, 1)),
        ).first()
        if n == full or not open_:
            break
        full, level = n, (total - used) / open_
    target = F.least(F.col("most"), F.col("w") * F.lit(level if level is not None else 0.0))
    return ranked.select("source", "n", "source_size", target.alias("target"))


def _drawn(open_: DataFrame, need: DataFrame, total: int) -> DataFrame:
    """open_ (slot, shard, x: 0 to total - 1) with n, the source in whose part
    of 0..total-1 x lies, and j, the slot's number among the source's slots.
    need: n, had (slots it has already), want (slots it still needs, which sum
    to total)."""
    step = max(1, -(-total // 1024))
    parts = running_sum(need.filter("want > 0"), [F.col("n")], F.col("want"), "low", inclusive=False)
    bucket = lambda c: F.floor(c / F.lit(step))
    wide = parts.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("low") + F.col("want") - 1))))
    hit = open_.withColumn("bucket", bucket(F.col("x"))).join(wide, "bucket")
    hit = cut(hit.filter((F.col("x") >= F.col("low")) & (F.col("x") < F.col("low") + F.col("want"))).select("slot", "shard", "n", "had", "want"))
    # the multinomial counts of each shard, and where each begins in its source
    counts = running_sum(hit.groupBy("n", "shard").agg(F.count("*").alias("k")), [F.col("n"), F.col("shard")], F.col("k"), "upto", inclusive=False)
    counts = cut(counts)
    counts = counts.join(counts.groupBy("n").agg(F.min("upto").alias("base")), "n").select("n", "shard", (F.col("upto") - F.col("base")).alias("begin"))
    # at most shard_slots rows in each
    inside = F.row_number().over(Window.partitionBy("n", "shard").orderBy("slot")) - 1
    placed = hit.withColumn("inside", inside).join(counts, ["n", "shard"])
    return cut(placed.select("slot", "shard", "n", (F.col("had") + F.col("begin") + F.col("inside")).alias("j"), (F.col("had") + F.col("want")).alias("most")))


def draw_slots(need: DataFrame, shard_slots: int, seed: int, rounds: int = 2) -> DataFrame:
    """(slot, shard, n, j) for sources that need `want` slots (n, want).

    Every shard's slots are drawn from the sources by their shares, so a shard's
    counts are multinomial. Slots drawn beyond what their source needs, about the
    square root of all, are the last ones; they are drawn again from what is
    still needed, and after `rounds` draws the few that are left are handed out
    in order, so that each source gets just what it needs.
    """
    spark = need.sparkSession
    need = cut(need.select("n", F.lit(0).cast("long").alias("had"), F.col("want").cast("long").alias("want")))
    total = need.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    open_ = spark.range(0, total, 1, parts).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"))
    slots = None
    for r in range(rounds + 1):
        if r < rounds:
            open_ = open_.withColumn("x", F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "slot"), F.lit(max(1, total))))
        else:
            open_ = dense_index(open_, [F.col("slot")], "x")
        drawn = _drawn(open_, need, total)
        taken = drawn.filter("j < most")
        slots = taken.select("slot", "shard", "n", "j") if slots is None else slots.union(taken.select("slot", "shard", "n", "j"))
        got = taken.groupBy(F.col("n").alias("g")).agg(F.count("*").alias("got"))
        need = need.join(got, need["n"] == got["g"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
        need = cut(need.select("n", (F.col("had") + F.col("got")).alias("had"), (F.col("want") - F.col("got")).alias("want")))
        total = need.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
        if not total:
            break
        open_ = drawn.filter("j >= most").select("slot", "shard")
    return slots


def mix_plan(targets: DataFrame, block_words: int, shard_slots: int = 8192, seed: int = 0) -> DataFrame:
    """The mix in order: slot, shard, n (source number), pass_no, block, words."""
    size, goal = F.col("source_size"), F.round("target").cast("long")
    full = F.floor(goal / F.greatest(size, F.lit(1))).cast("long")
    rest = goal - full * size
    plan = targets.filter("source_size > 0").select(
        "n",
        F.ceil(size / F.lit(block_words)).cast("long").alias("blocks"),
        full.alias("full"),
        rest.alias("rest"),
    )
    want = F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block_words)).cast("long")
    each = draw_slots(plan.select("n", want.alias("want")), shard_slots, seed).join(plan, "n")
    pass_no = F.floor(F.col("j") / F.col("blocks")).cast("long")
    each = each.withColumn("pass_no", pass_no).withColumn("rank", F.col("j") - F.col("pass_no") * F.col("blocks"))
    last = (F.col("pass_no") == F.col("full")) & ((F.col("rank") + 1) * block_words > F.col("rest"))
    words = F.when(last, F.col("rest") - F.col("rank") * block_words).otherwise(F.lit(block_words)).cast("long")
    block = permuted(F.col("rank"), F.col("blocks"), F.struct(F.lit(seed), F.col("n"), F.col("pass_no")))
    return each.select("slot", "shard", "n", "pass_no", block.alias("block"), words.alias("words"))


def shard_counts(plan: DataFrame) -> DataFrame:
    """(shard, n, slots) of a plan: how often each output shard draws each source."""
    return plan.groupBy("shard", "n").agg(F.count("*").alias("slots"))


def pack_blocks(sized: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """sized (row columns, source, size, strand) with n, source_size, target,
    first_word: where the row's words begin in its source's stream."""
    names = targets.select(F.col("source").alias("__s"), "n", "source_size", "target")
    sized = sized.join(names, sized["source"].eqNullSafe(names["__s"])).drop("__s")
    strands = sized.groupBy("n", "strand").agg(F.sum("size").alias("held"))
    upto = Window.partitionBy("n").orderBy("strand").rowsBetween(Window.unboundedPreceding, -1)
    # at most STRANDS rows for each source
    strands = strands.select("n", "strand", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("n", "strand").orderBy("doc_id", "size", *[c for c in sized.columns if c == "key"]).rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(strands, ["n", "strand"]).withColumn("first_word", F.col("begin") + F.col("inside")).drop("begin", "inside")


def mix(docs: DataFrame, block_words: int = 128, seed: int = 0, text: str = "text", id: str = "doc_id", source: str = "source", key: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken,
    first_shard and last_shard (of those that take words of the row; null if
    none does), and `key`, a column of docs, if one is given.

    taken: words of the row that the mix takes, repeats counted; at most 3 times
    its size, as a source is passed at most 3 times. A source's taken words sum
    to its rounded target, less at most one block. Null and blank texts have
    size 0 and are never taken. Null is a source of its own. Rows that repeat
    an id are rows of their own. An empty table gives no rows. Other columns of
    docs aren't read. The same input gives the same result.
    """
    extra = [] if key is None else ["key"]
    sized = cut(
        docs.select(
            F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
            *([] if key is None else [key.alias("key")]),
        ).withColumn("strand", F.pmod(F.xxhash64("doc_id"), F.lit(STRANDS)).cast("int"))
    )
    targets = cut(source_targets(sized))
    rows = cut(pack_blocks(sized, targets, block_words))
    drawn = mix_plan(targets, block_words, seed=seed).groupBy("n", "block").agg(F.sum("words").alias("whole"), F.count("*").alias("times"), F.min("words").alias("least"), F.min("shard").alias("lo_shard"), F.max("shard").alias("hi_shard"))
    b = F.lit(block_words).cast("long")
    end = F.col("first_word") + F.col("size")
    parts = rows.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("first_word") / b), F.floor((end - 1) / b)))
    )
    lo = F.greatest(F.col("first_word") - F.col("block") * b, F.lit(0))
    hi = F.least(end - F.col("block") * b, b)
    parts = parts.select("doc_id", "n", "first_word", "block", lo.alias("lo"), hi.alias("hi"))
    # of the slots on a block at most one is cut short, to `least` words
    cut_short = F.col("least") < b
    words = (F.col("times") - cut_short.cast("long")) * (F.col("hi") - F.col("lo")) + F.when(
        cut_short, F.greatest(F.least("hi", "least") - F.col("lo"), F.lit(0))
    ).otherwise(0)
    got = parts.join(drawn, ["n", "block"]).withColumn("w", words).filter("w > 0").groupBy("doc_id", "n", "first_word")
    got = got.agg(F.sum("w").alias("words_taken"), F.min("lo_shard").alias("first_shard"), F.max("hi_shard").alias("last_shard"))
    got = got.select(F.col("doc_id").alias("g_id"), F.col("n").alias("g_n"), F.col("first_word").alias("g_first"), "words_taken", "first_shard", "last_shard")
    same = (F.col("n") == F.col("g_n")) & F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("first_word") == F.col("g_first"))
    return rows.join(got, same & (F.col("size") > 0), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("words_taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard", *extra
    )


def repeat_documents(docs: DataFrame, block_words: int = 128, seed: int = 0) -> DataFrame:
    """docs with each row as often as the mix takes it: taken / size times, the
    fraction rounded up or down by a hash of its id, size and text, so that each
    source's words come near its target. Rows of size 0 go. All columns stay.
    Rows that repeat an id, or have none, count one by one; those of one id,
    source and text share evenly what the mix takes of them.
    """
    names = docs.columns
    # rows that share this key are copies
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.xxhash64("text"), F.xxhash64("source"))
    found = mix(docs, block_words, seed, key=key).filter("size > 0")
    ratio = F.col("taken") / F.col("size")
    draw = F.pmod(F.xxhash64("key", "size", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    found = found.withColumn("copies", F.floor(ratio) + (draw < ratio - F.floor(ratio)).cast("long"))
    times = found.groupBy(F.col("key").alias("__mixed")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).filter("__copies > 0")
    keyed = docs.withColumn("__key", key)
    joined = keyed.join(times, keyed["__key"] == times["__mixed"])
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    share = F.floor(F.col("__copies") / F.col("__rows")) + (nth <= F.pmod("__copies", "__rows")).cast("long")
    joined = joined.withColumn("__share", share.cast("int")).filter("__share > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__share")))).select(*names)

"""Mixing sources to target weights: hash-threshold histograms, native DataFrame operations only.

Every source's budget is a whole number of passes over it plus a rest. The rest is taken as the rows whose
hash lies below a threshold. The threshold is found without sorting rows: tokens are summed by source and by the
hash's top digit, the digit at which the running sum first passes the budget is the boundary, everything below is
in, and only rows in the boundary bucket are summed again by their next digit. Thresholds of growing budgets are
nested: a larger budget keeps all rows of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm.scratch import Scratch

#: Bits of the hash that one histogram resolves, and how many rounds: 15 * 4 = 60 bits of md5 in all.
DIGIT_BITS, ROUNDS = 15, 4
#: Repeats of one row that one task makes again.
RUN = 10_000


def word_count(text: Column) -> Column:
    """The number of runs of characters outside [\\x20\\x09-\\x0D]; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def row_hash(*columns: Column) -> Column:
    """60 bits of the md5 of the columns joined by |, nulls as \\N, the same on any engine."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(source, source_size, target): sizes is (source, source_size), one row each.

    The sum of all sizes is shared by weights 1, 2, 3, 1, 2, 3, ... in code point order of source, null last. No
    target exceeds cap times its source's size; the excess goes to the others by weight until none is above. With
    sources in order of cap size over weight, the capped ones are a prefix, and the rest share what it leaves.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.pmod(F.row_number().over(ordered) - 1, F.lit(3)) + 1).cast("double"))
    limited = weighed.withColumn("limit", F.col("source_size").cast("double") * cap).withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = limited.withColumn("level", level).withColumn("free", F.col("limit") >= F.col("level") * F.col("weight"))
    # the first source that isn't capped sets the level of all that follow
    found = levelled.withColumn("final", F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(everything)["level"])
    out = F.when(F.col("final").isNull() | (F.col("limit") < F.col("final") * F.col("weight")), F.col("limit")).otherwise(F.col("final") * F.col("weight"))
    return found.select("source", "source_size", out.alias("target"))


def _thresholds(hashed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): rows of source with hash < below have sizes that sum to budget at most, and below can't be larger.

    hashed: (source, hash, size); budgets: (source, budget).
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("low"))
    for k in range(1, ROUNDS + 1):
        shift = DIGIT_BITS * (ROUNDS - k)
        digit = F.shiftright("hash", shift)
        if k == 1:
            inside = hashed.select("source", digit.alias("digit"), "size")
        else:
            near = state.select(F.col("source").alias("s"), F.col("low").alias("l"))
            inside = hashed.join(near, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + DIGIT_BITS) == F.shiftright("l", shift + DIGIT_BITS))).select("source", digit.alias("digit"), "size")
        sums = inside.groupBy("source", "digit").agg(F.sum("size").alias("size"))
        running = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("digit")))
        s = state.select(F.col("source").alias("s"), "left", "low")
        # the boundary is the first digit whose sum goes over what is left; without one, all of them are in
        over = running.join(s, F.col("source").eqNullSafe(F.col("s")), "right")
        state = over.groupBy(F.col("s").alias("source")).agg(
            F.first("left").alias("left"), F.first("low").alias("low"),
            F.min(F.when(F.col("upto") > F.col("left"), F.struct(F.col("digit"), (F.col("upto") - F.col("size")).alias("under")))).alias("edge"),
        ).select(
            "source",
            (F.col("left") - F.coalesce(F.col("edge.under"), F.lit(0))).alias("left"),
            F.when(F.col("edge").isNull(), F.lit(2**60).cast("long")).otherwise(F.shiftleft(F.col("edge.digit"), shift)).alias("low"),
        )
    return state.select("source", F.col("low").alias("below"))


def plan(sized: DataFrame, scratch: Scratch, cap: int = 3, keep: bool = False) -> DataFrame:
    """One row for each source of sized (source, hash, size): source_size, target, passes and below. A row is taken
    passes times, and once more if its hash is less than below."""
    shares = scratch.save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = shares.withColumn("passes", passes).withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
    below = _thresholds(sized, budgets).withColumnRenamed("source", "s")
    return scratch.save(budgets.join(below, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("plan_source"), "source_size", "target", "passes", "below"), keep)


def with_copies(rows: DataFrame, plan: DataFrame, source: Column, row: Column, cap: int = 3) -> tuple[DataFrame, Column]:
    """rows joined with their source's plan, and a column of it: the times the mix takes each row. Plans of a bounded number of
    sources are broadcast, so that rows needn't move; beyond it Spark shuffles."""
    if plan.count() <= 200_000:
        plan = F.broadcast(plan)
    return rows.join(plan, source.eqNullSafe(plan["plan_source"])), F.least(plan["passes"] + (row < plan["below"]).cast("long"), F.lit(cap))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of each row of docs; the hash is that of the row's id and text, so rows without an id have hashes of their own."""
    ids = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return ids.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def told_apart(hash_: Column, number: Column) -> Column:
    """The hash of repeat number (from 0) of a row: the first keeps its own."""
    return F.when(number == 0, hash_).otherwise(row_hash(hash_, number))


def repeats_apart(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """sized (doc_id, source, size, hash) with a hash of its own for each repeat of a row. Repeats are counted before they move, and
    many of one row are made again by many tasks."""
    classes = scratch.save(sized.groupBy("source", "doc_id", "hash", "size").agg(F.count("*").alias("times")).where("times > 1"))
    most = classes.agg(F.max("times")).first()[0]
    if most is None:
        return sized
    keys = classes.select(F.col("source").alias("_s"), F.col("hash").alias("_h"))
    if keys.count() <= 200_000:
        keys = F.broadcast(keys)
    single = sized.join(keys, sized["source"].eqNullSafe(keys["_s"]) & (sized["hash"] == keys["_h"]), "left_anti")
    runs = classes.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))))
    if most > RUN:
        runs = runs.repartition("hash", "run")
    number = F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("times")) - 1))
    again = runs.withColumn("number", number).select("doc_id", "source", "size", told_apart(F.col("hash"), F.col("number")).alias("hash"))
    return single.unionByName(again)


def numbered(docs: DataFrame, hash_: str) -> DataFrame:
    """docs with column hash_, the hash of repeats_apart() for each row. Only rows whose id and text repeat are numbered."""
    source = F.col("source").cast("string")
    hashed = docs.withColumn(hash_, row_hash(F.col("doc_id"), F.col("text")))
    keys = hashed.groupBy(source.alias("_s"), F.col(hash_).alias("_corploom_h")).agg(F.count("*").alias("_n")).where("_n > 1").select("_s", "_corploom_h")
    n = keys.count()
    if not n:
        return hashed
    if n <= 200_000:
        keys = F.broadcast(keys)
    same = source.eqNullSafe(keys["_s"]) & (F.col(hash_) == keys["_corploom_h"])
    again = hashed.join(keys, same, "left_semi")
    number = F.row_number().over(Window.partitionBy(source, hash_).orderBy(hash_)) - 1
    return hashed.join(keys, same, "left_anti").unionByName(again.withColumn(hash_, told_apart(F.col(hash_), number)))


def mix(docs: DataFrame, scratch: Scratch, cap: int = 3) -> DataFrame:
    """docs' rows as (doc_id, source, size, source_size, target, copies, taken), taken the words that the mix takes, repeats counted.

    Every row is in it, also with taken 0. Null text has size 0; a null source is a source of its own; a null
    doc_id counts as a value. Rows are taken by a hash of id and text; repeats of one row are told apart and taken or left each
    by itself. An empty input gives an empty result. Columns other than doc_id, text and source are ignored.
    """
    sized = repeats_apart(scratch.save(sizes(docs)), scratch)
    joined, copies = with_copies(sized, plan(sized, scratch, cap), F.col("source"), F.col("hash"), cap)
    return scratch.save(joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")), keep=True)

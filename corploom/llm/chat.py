"""Chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that participant as the assistant and
everybody else as a named user; the mask is 1 on the assistant's turns. The result has a row for each turn of each
perspective with the turn's rendered text and its place in the whole rendering, so that no conversation, however
long, has to fit in one row; render() joins the turns of bounded ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
UNNAMED = "unknown"
END = "<|end|>\n"


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, position, turn, role, name, rendered, start, mask) from turns (conv_id, turn, role, text).

    A participant is a role other than system, null or blank. A turn is rendered as <|role|>name=NAME\\n (the name only for
    users), its text and an end mark; system turns stay system. start is the turn's first character in the rendering.
    Turns go by number (null first), then role and text; repeated rows are turns each. A turn with a null or blank role is a
    user named unknown in every perspective; a null text is empty. A conversation with no participant gives no rows, a null
    conv_id is a conversation of its own. Other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(F.trim("role") != "", F.trim("role")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    people = rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    order = [F.col("turn").asc_nulls_first(), F.col("speaker").asc_nulls_first(), F.col("text")]
    placed = rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    placed = placed.withColumn("mask", own.cast("int")).withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.coalesce("speaker", F.lit(UNNAMED))))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.coalesce(F.concat(F.lit("name="), F.col("name")), F.lit("")), F.lit("\n"))
    placed = placed.withColumn("rendered", F.concat(head, "text", F.lit(END)))
    window = Window.partitionBy("conv_id", "perspective").orderBy(*order)
    placed = placed.withColumn("position", F.row_number().over(window) - 1).withColumn("start", F.coalesce(F.sum(F.length("rendered").cast("long")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return placed.select("conv_id", "perspective", "position", "turn", "role", "name", "rendered", "start", "mask")


def render(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, spans): whole renderings, spans the (start, end) of masked turns. For conversations that fit in a row."""
    turn = F.struct("position", "rendered", "start", "mask")
    whole = rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["rendered"]), "")
    spans = F.transform(F.filter("t", lambda x: x["mask"] == 1), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["rendered"])).alias("end")))
    return whole.select("conv_id", "perspective", text.alias("text"), spans.alias("spans"))

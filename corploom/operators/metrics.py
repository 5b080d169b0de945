"""Evaluation metrics over supplied tables of losses, labels, logits and checkpoints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_loss(loss: Column, weight: Column) -> Column:
    return F.sum(loss * weight) / F.sum(weight)


def perplexity(loss: Column, factor: float = 1.0) -> Column:
    """exp of the mean loss; factor turns a sub-word loss into a word loss."""
    return F.exp(loss * factor)


def bits_per_char(loss: Column) -> Column:
    return loss / math.log(2)


def masked_mean(value: Column, mask: Column) -> Column:
    return F.sum(value * mask) / F.sum(mask)


def accuracy_by_label(rows: DataFrame, correct: str, label: str, mask: str) -> DataFrame:
    """(label, accuracy, weight) for every label and, with label null, overall; one pass."""
    hit = F.sum(F.col(correct).cast("double") * F.col(mask))
    return rows.rollup(label).agg((hit / F.sum(mask)).alias("accuracy"), F.sum(mask).cast("double").alias("weight"))


def generator_agreement(rows: DataFrame, sampled: str, original: str, label: str) -> DataFrame:
    """rows with label 0 where a replaced token came out as it was."""
    return rows.withColumn(label, F.when(F.col(sampled) == F.col(original), F.lit(0)).otherwise(F.col(label)))


def cross_entropy(logits: DataFrame, keys: list[str], target: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """(keys.., nll) from long logits (keys.., token_id, logit) and targets (keys.., target): log-sum-exp a key, with label smoothing over the vocabulary."""
    top = logits.groupBy(*keys).agg(F.max("logit").alias("m"))
    joined = logits.join(top, keys)
    sums = joined.join(target, keys).groupBy(*keys).agg(F.first("m").alias("m"), F.sum(F.exp(F.col("logit") - F.col("m"))).alias("z"), F.sum(F.when(F.col("token_id") == F.col("target"), F.col("logit"))).alias("t"), F.sum("logit").alias("s"), F.count("*").alias("v"))
    norm = F.col("m") + F.log("z")
    nll = (1 - smoothing) * (norm - F.col("t")) + smoothing * (norm - F.col("s") / F.col("v"))
    return sums.select(*keys, nll.alias("nll"))


def binary_cross_entropy(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def summary(how: str, value: str, pos: str, mask: str | None = None) -> Column:
    """A sequence's last, first, max or (masked) mean value, to aggregate by sequence."""
    if how == "last":
        return F.max_by(value, pos)
    if how == "first":
        return F.min_by(value, pos)
    if how == "max":
        return F.max(value)
    weight = F.col(mask) if mask else F.lit(1.0)
    return F.sum(F.col(value) * weight) / (F.sum(weight) + 1e-6)


def checkpoint_average(values: DataFrame, last: int | None = None) -> DataFrame:
    """(var_name, idx, value): means over checkpoints (ckpt, step, var_name, idx, value), of the last ones by step if asked, without step counters."""
    rows = values.where(~F.col("var_name").startswith("global_step"))
    if last is not None:
        keep = values.select("step").distinct().orderBy(F.col("step").desc()).limit(last)
        rows = rows.join(F.broadcast(keep), "step")  # last rows
    return rows.groupBy("var_name", "idx").agg(F.avg("value").alias("value"))


def best_checkpoint(evals: DataFrame, metric: str, start: int, stop: int) -> DataFrame:
    """The row with the least metric among steps in [start, stop], the earliest of ties."""
    return evals.where(F.col("step").between(start, stop)).orderBy(metric, "step").limit(1)


def gradient_average(grads: DataFrame) -> DataFrame:
    """(var_name, idx, grad): means over towers; a variable with any NaN or infinity is zero as a whole."""
    bad = F.isnan("grad") | (F.abs("grad") == float("inf"))
    spoilt = grads.groupBy("var_name").agg(F.max(bad.cast("int")).alias("_bad"))
    clean = grads.join(spoilt, "var_name").withColumn("grad", F.when(F.col("_bad") == 1, F.lit(0.0)).otherwise(F.col("grad")))
    return clean.groupBy("var_name", "idx").agg(F.avg("grad").alias("grad"))


def sparse_gradient_average(grads: DataFrame, towers: int | None = None) -> DataFrame:
    """(var_name, idx, grad) of rows (tower, var_name, idx, grad) that a tower has only for some idx: sums by idx over the number of towers,
    so that a tower without a row counts as zero, and several rows of one tower and idx add up. towers: how many there are, counted
    for each variable if that isn't told (then every tower must have some row of it)."""
    summed = grads.groupBy("var_name", "idx").agg(F.sum("grad").alias("_sum"))
    if towers is not None:
        return summed.select("var_name", "idx", (F.col("_sum") / towers).alias("grad"))
    counted = grads.groupBy("var_name").agg(F.count_distinct("tower").alias("_towers"))
    return summed.join(counted, "var_name").select("var_name", "idx", (F.col("_sum") / F.col("_towers")).alias("grad"))


def global_norm(grads: DataFrame) -> DataFrame:
    return grads.agg(F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("global_norm"))


def log_windows(rows: DataFrame, step: str, every: int, keys: list[str], value: str) -> DataFrame:
    """Means of value over each run of every steps."""
    return rows.groupBy(*keys, F.floor(F.col(step) / every).cast("long").alias("window")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))


def corpus_counters(docs: DataFrame, lines: Column, tokens: Column) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.sum(lines).cast("long").alias("n_lines"), F.sum(tokens).cast("long").alias("n_tokens"))


def moving(rows: DataFrame, keys: list[str], step: str, value: str, size: int) -> DataFrame:
    return rows.withColumn("moving", F.avg(value).over(Window.partitionBy(*keys).orderBy(step).rowsBetween(-(size - 1), 0)))

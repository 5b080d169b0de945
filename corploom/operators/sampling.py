"""Proposal distributions, sampled and adaptive softmax over tables, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.functions.rng import keyed_uniform


def log_uniform(c: Column, range_max: int) -> Column:
    """P(c) of the log-uniform law."""
    return (F.log((c + 2.0) / (c + 1.0))) / math.log(range_max + 1)


def log_q(c: Column, range_max: int, n: int) -> Column:
    """ln of the probability that 2n draws hold c."""
    return F.log(-F.expm1(2.0 * n * F.log1p(-log_uniform(c, range_max))))


def negative_samples(spark, range_max: int, n: int, seed: int = 0) -> DataFrame:
    """(token_id, log_q): distinct values of 2n keyed draws by the inverse law."""
    u = keyed_uniform(seed, "negative", F.col("id"))
    drawn = F.least(F.floor(F.exp(u * math.log(range_max + 1))) - 1, F.lit(range_max - 1)).cast("int")
    return spark.range(2 * n).select(drawn.alias("token_id")).distinct().withColumn("log_q", log_q(F.col("token_id"), range_max, n))


def sampled_logits(true: DataFrame, sampled: DataFrame, samples: DataFrame, range_max: int, n: int) -> DataFrame:
    """(key, token_id, logit, is_true): logits less log_q; a sample that is the key's target is at -1e30.

    true: (key, target, logit); sampled: (key, token_id, logit) of the samples."""
    own = true.select("key", F.col("target").alias("token_id"), (F.col("logit") - log_q(F.col("target"), range_max, n)).alias("logit"), F.lit(1).alias("is_true"))
    joined = sampled.join(samples, "token_id").join(true.select("key", "target"), "key")
    rest = joined.select("key", "token_id", F.when(F.col("token_id") == F.col("target"), F.lit(-1e30)).otherwise(F.col("logit") - F.col("log_q")).alias("logit"), F.lit(0).alias("is_true"))
    return own.unionByName(rest)


def gumbel_argmax(logits: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """(keys.., token_id): a keyed draw from softmax(logit) of each key, ties to the smaller id."""
    u = keyed_uniform(seed, "gumbel", *[F.col(k) for k in keys], F.col("token_id"))
    g = -F.log(-F.log(u + 1e-9) + 1e-9)
    best = logits.withColumn("_s", F.struct((F.col("logit") + g).alias("s"), (-F.col("token_id")).alias("i"), F.col("token_id").alias("token_id")))
    return best.groupBy(*keys).agg(F.max("_s")["token_id"].alias("token_id"))


def adaptive_log_softmax(head: DataFrame, tail: DataFrame, targets: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(key, nll): a target below the first cutoff is scored in the head; another by its cluster's head entry (id first cutoff + cluster - 1)
    and in its cluster. head: (key, entry, logit); tail: (key, cluster, entry, logit); targets: (key, cluster, entry)."""
    def norm(df: DataFrame, by: list[str], name: str) -> DataFrame:
        top = df.groupBy(*by).agg(F.max("logit").alias("m"))
        return df.join(top, by).groupBy(*by).agg((F.first("m") + F.log(F.sum(F.exp(F.col("logit") - F.col("m"))))).alias(name))

    entry = F.when(F.col("cluster") == 0, F.col("entry")).otherwise(F.lit(cutoffs[0] - 1) + F.col("cluster"))
    h = targets.withColumn("_h", entry).join(head.select("key", F.col("entry").alias("_h"), F.col("logit").alias("_hl")), ["key", "_h"]).join(norm(head, ["key"], "_hn"), "key")
    t = h.join(tail.withColumnRenamed("logit", "_tl"), ["key", "cluster", "entry"], "left").join(norm(tail, ["key", "cluster"], "_tn"), ["key", "cluster"], "left")
    return t.select("key", ((F.col("_hn") - F.col("_hl")) + F.when(F.col("cluster") > 0, F.col("_tn") - F.col("_tl")).otherwise(0.0)).alias("nll"))


def warmup_decay(step: Column, peak: float, warmup: int, total: int, kind: str = "cosine", least_ratio: float = 0.0, power: float = 1.0) -> Column:
    """A learning rate: linear to peak over warmup steps, then poly, cosine, inv_sqrt or constant."""
    up = step / float(max(1, warmup)) * peak
    part = (step - warmup) / float(max(1, total - warmup))
    part = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    if kind == "poly":
        down = (peak - peak * least_ratio) * F.pow(1 - part, power) + peak * least_ratio
    elif kind == "cosine":
        down = peak * ((1 - least_ratio) * 0.5 * (1 + F.cos(math.pi * part)) + least_ratio)
    elif kind == "inv_sqrt":
        down = peak * math.sqrt(max(1, warmup)) / F.sqrt(F.greatest(step.cast("double"), F.lit(1.0)))
    elif kind == "constant":
        down = F.lit(peak)
    else:
        raise ValueError(f"no schedule {kind}")
    return F.when(step < warmup, up).otherwise(down)


def dev_perf_decay(evals: DataFrame, lr: float, rate: float, patience: int, least: float = 0.0) -> DataFrame:
    """(step, lr): lr times rate after each run of patience evaluations (step, loss) without a new best, in order of step."""
    rows = sorted((r["step"], r["loss"]) for r in evals.select("step", "loss").collect())  # a run's evaluations
    best, bad, out = math.inf, 0, []
    for step, loss in rows:
        best, bad = (loss, 0) if loss < best else (best, bad + 1)
        if bad > patience:
            lr, bad = max(least, lr * rate), 0
        out.append((step, lr))
    return evals.sparkSession.createDataFrame(out, "step long, lr double")


def layer_decay(name: Column, layers: int, rate: float, pattern: str = "layer_([0-9]+)/") -> Column:
    """rate ** (layers - 1 - layer) by the layer in a variable's name, rate ** layers for embeddings, 1 otherwise."""
    layer = F.regexp_extract(name, pattern, 1)
    return F.when(layer != "", F.pow(F.lit(rate), layers - 1 - layer.cast("int"))).when(name.rlike("embedding"), F.lit(rate**layers)).otherwise(F.lit(1.0))


def decays_weight(name: Column, excluded: list[str] = ("LayerNorm", "layer_norm", "bias")) -> Column:
    return ~name.rlike("|".join(excluded)) if excluded else F.lit(True)


def checkpoint_names(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(name): variables of both, without the :0 of ours."""
    return ours.select(F.regexp_replace("name", ":[0-9]+$", "").alias("name")).join(theirs.select("name"), "name", "left_semi")

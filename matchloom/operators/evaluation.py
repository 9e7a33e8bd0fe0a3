"""Matching quality for any weights and thresholds, and measures of probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.operators.retrieval import normalized_weights

#: The mixes of text, sound and vector, and the thresholds, that a sweep tries.
MIXES = ((0.5, 0.2, 0.3), (0.34, 0.33, 0.33), (0.7, 0.0, 0.3), (0.5, 0.0, 0.5), (0.3, 0.0, 0.7), (0.2, 0.1, 0.7), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0))
THRESHOLDS = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)


def picks(signals: DataFrame, mixes: tuple = MIXES) -> DataFrame:
    """The best candidate of each query for each mix: mix, weights, query_id, cand_id, score. The first of equals is taken. One pass for all mixes: the best
    of a query is a combined aggregation."""
    best = []
    for k, mix in enumerate(mixes):
        t, p, v = normalized_weights(*mix)
        score = t * F.col("text") + p * F.col("phonetic") + v * F.col("vector")
        best.append(F.struct(F.lit(k).alias("mix"), *(F.lit(float(w)).alias(n) for w, n in zip(mix, ("w_text", "w_phonetic", "w_vector"))), F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("pos")).alias("p"), F.col("cand_id").alias("c"))).alias("top")))
    wide = signals.groupBy("query_id").agg(F.array(*best).alias("best"))
    return wide.select("query_id", F.inline("best")).select("mix", "w_text", "w_phonetic", "w_vector", "query_id", F.col("top.c").alias("cand_id"), F.col("top.s").alias("score"))


def evaluate(picked: DataFrame, gold: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """precision, recall, f1 and top1_accuracy for each mix and threshold. A pick counts from the threshold on; recall is over all gold pairs (left_id, right_id);
    top1_accuracy is over queries that have any, at no threshold. What divides by nothing is 0."""
    pairs = gold.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("cand_id")).distinct()
    total = pairs.agg(F.count("*").alias("truth_pairs"))
    known = pairs.select("query_id").distinct().withColumn("eligible", F.lit(1))
    joined = picked.join(pairs.withColumn("right", F.lit(1)), ["query_id", "cand_id"], "left").join(known, "query_id", "left").fillna(0, ["right", "eligible"])
    grid = joined.select("*", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    sums = grid.groupBy("mix", "w_text", "w_phonetic", "w_vector", "threshold").agg(
        F.sum(hit.cast("long")).alias("predicted"), F.sum((hit & (F.col("right") == 1)).cast("long")).alias("correct"), F.sum("eligible").alias("eligible"), F.sum(F.col("right") * F.col("eligible")).alias("top1")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = sums.join(F.broadcast(total)).withColumn("precision", ratio("correct", "predicted")).withColumn("recall", ratio("correct", "truth_pairs"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("mix", "w_text", "w_phonetic", "w_vector", "threshold", "precision", "recall", f1.alias("f1"), ratio("top1", "eligible").alias("top1_accuracy"), "predicted", "correct", "truth_pairs")


def best_setting(swept: DataFrame) -> DataFrame:
    """The first setting, by mix and then threshold, with the greatest f1."""
    return swept.orderBy(F.col("f1").desc(), "mix", "threshold").limit(1)


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def auc(rows: DataFrame, p: str, y: str) -> DataFrame:
    """The chance that a positive outranks a negative, ties half; null where a class is missing. Ranks come from counts of each distinct value, which are summed over
    ranges of values first, so no window holds them all."""
    counts = rows.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    part = F.floor(F.col("p") * 1024)
    counts = counts.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(1024), part)))
    ranges = counts.groupBy("part").agg(F.sum("n").alias("s")).withColumn("below", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("inside", inside).join(F.broadcast(ranges.select("part", "below")), "part")
    rank = F.col("below") + F.col("inside") + (F.col("n") + 1) / 2
    sums = ranked.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").cast("double").alias("a"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("b"))
    return sums.select(F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("r") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))).alias("auc"))


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """claimed and observed means and the count of each equal-width bin that has any; a bin holds its lower edge, the last both."""
    edges = [i / bins for i in range(1, bins)]
    at = sum(((F.col(p) >= e).cast("int") for e in edges), F.lit(0))
    return rows.filter((F.col(p) >= 0) & (F.col(p) <= 1)).groupBy(at.alias("bin")).agg(F.avg(p).alias("claimed"), F.avg(F.col(y).cast("double")).alias("observed"), F.count("*").alias("n"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """ece: the mean gap of bins by count; max_bin_gap: the largest."""
    gap = F.abs(F.col("claimed") - F.col("observed"))
    return bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("max_bin_gap"))


def bands(rows: DataFrame, p: str, y: str, corroborated: bool, auto_from: float = 0.90, hold_from: float = 0.60) -> DataFrame:
    """What the bands do to a review queue. Without a second signal nothing merges by itself."""
    auto = (F.col(p) >= auto_from) & F.lit(corroborated)
    held = (F.col(p) >= hold_from) & ~auto
    out = F.col(p) < hold_from
    right = F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    share = lambda c: F.coalesce(F.try_divide(n(c & right).cast("double"), n(c).cast("double")), F.lit(0.0))
    return rows.agg(n(auto).alias("auto"), n(held).alias("hold"), n(out).alias("reject"), share(auto).alias("auto_precision"), share(held).alias("hold_precision"), n(out & right).alias("correct_rejected"))

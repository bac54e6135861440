"""Scores of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.joins import nearest_within
from skein.operators.ranks import running


def micro_f1(df: DataFrame, truth: Column, guess: Column, key=()) -> DataFrame:
    """Precision, recall and F1 from summed counts; empty denominators count as 1."""
    one = lambda c: F.sum(c.cast("long"))
    out = df.groupBy(*key).agg(one(truth & guess).alias("tp"), one(~truth & guess).alias("fp"), one(truth & ~guess).alias("fn"))
    out = out.withColumn("precision", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", 2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def flag_stats(df: DataFrame, confidence: str, error: Column, *, share: float = 0.1) -> DataFrame:
    """The highest confidence below which at most ``share`` of rows lie, and how many errors that flags."""
    counts = df.groupBy(confidence).agg(F.count("*").alias("n"), F.sum(error.cast("long")).alias("e"))
    upto = running(counts.filter(F.col(confidence).isNotNull()), [], confidence, {"n": "to", "e": "seen"}, {"n": "all", "e": "errors"})
    above = F.col("to") > F.floor(F.lit(share) * F.col("all"))
    first = F.min(F.when(above, F.struct(F.col(confidence).alias("threshold"), (F.col("to") - F.col("n")).alias("flagged"), (F.col("seen") - F.col("e")).alias("caught")))).alias("at")
    out = upto.agg(first, F.first("all").alias("all"), F.first("errors").alias("errors")).filter("all IS NOT NULL").select("at.*", "all", "errors")
    return out.select("threshold", F.col("all").alias("n"), "flagged", "caught", "errors", (F.col("caught") / F.greatest(F.lit(1), F.col("errors"))).alias("share"))


def score_starts(found: DataFrame, truth: DataFrame, *, key: str, found_id: str, truth_id: str, at: str, label: str, tol: float) -> DataFrame:
    """Per key: truths, detections, covered truths' labels, repeats and spurious detections, recall, precision.

    A detection takes the nearest truth within the tolerance; the first detection of a label is
    correct, later ones are duplicates, those without a truth spurious.
    """
    met = nearest_within(found, truth, key=key, left_id=found_id, right_id=truth_id, left_at=at, right_at=at, tol=tol)
    named = found.select(key, found_id, at).join(met, [key, found_id], "left").join(truth.select(key, truth_id, F.col(label)), [key, truth_id], "left")
    first = F.row_number().over(Window.partitionBy(key, label).orderBy(at, found_id)) == 1
    judged = named.withColumn("state", F.when(F.col(label).isNull(), "spurious").when(first, "correct").otherwise("dup"))
    counts = judged.groupBy(key).agg(F.count("*").alias("found"), *[F.count_if(F.col("state") == s).alias(s) for s in ("correct", "dup", "spurious")])
    wanted = truth.groupBy(key).agg(F.countDistinct(label).alias("wanted"))
    both = wanted.join(counts, key, "left").fillna(0, ["found", "correct", "dup", "spurious"])
    return both.withColumn("recall", F.col("correct") / F.col("wanted")).withColumn("precision", F.col("correct") / F.greatest(F.lit(1), F.col("found")))


def gate(scores: DataFrame, floors: DataFrame, key: str, metrics: list[str], default: dict[str, float]) -> DataFrame:
    """Scores with ``passed``: every metric at its floor or above; keys without floors take the default."""
    f = floors.select(F.col(key).alias("__key"), *[F.col(m).alias(f"__{m}") for m in metrics])
    joined = scores.join(f, scores[key] == f["__key"], "left")
    ok = F.lit(True)
    for m in metrics:
        ok = ok & (F.col(m) >= F.coalesce(F.col(f"__{m}"), F.lit(default[m])))
    return joined.withColumn("passed", ok).drop("__key", *[f"__{m}" for m in metrics])


def best_shift(df: DataFrame, shift: str, hit: Column, *, margin: float = 0.1) -> DataFrame:
    """Hit rate by shift; the best shift is chosen only if it beats shift 0 by the margin."""
    rates = df.groupBy(shift).agg(F.avg(hit.cast("double")).alias("rate"))
    total = rates.agg(F.max_by(shift, F.struct("rate", (-F.abs(F.col(shift))).alias("near"), (-F.col(shift)).alias("low"))).alias("best"), F.max("rate").alias("top"), F.max(F.when(F.col(shift) == 0, F.col("rate"))).alias("base"))
    return total.select(F.when(F.col("top") >= F.coalesce("base", F.lit(0.0)) + margin, F.col("best")).otherwise(0).alias("shift"), "top", "base")

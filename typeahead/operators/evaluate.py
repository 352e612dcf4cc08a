"""Evaluation of scored rows ``(target, score)`` and of submissions.

Rank statistics (AUC, ROC) need counts "below each score".  Rows are first
aggregated to one row per distinct score, so a hot score is a single row; the
running sums over scores come from ``ranking.running_sums``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import quantiles, running_sums


def score_counts(df: DataFrame, label: str = "target", score: str = "score") -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("n_pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("n_neg"))


def roc_auc(df: DataFrame, label: str = "target", score: str = "score") -> DataFrame:
    """M9: exact AUC with ties counted one half."""
    c = running_sums(score_counts(df, label, score), "score", ["n_neg"])
    c = c.withColumn("below", F.col("cum_n_neg") - F.col("n_neg"))
    return c.agg(((F.sum(F.col("n_pos") * (F.col("below") + 0.5 * F.col("n_neg"))))
                  / (F.sum("n_pos") * F.sum("n_neg"))).alias("auc"))


def metrics_by(df: DataFrame, group: str, label: str = "target", score: str = "score",
               threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """M9 and M10 per group (train and validation): number of rows and positives, exact AUC
    with ties counted one half, accuracy, precision, recall and F1 at a threshold; rows count
    ``weight`` times.  0 on zero division; the AUC is null where a class is missing."""
    w = F.col(weight) if weight else F.lit(1)
    c = df.groupBy(group, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("n_neg"))
    c = running_sums(c, "score", ["n_neg"], group=[group])
    below = F.col("cum_n_neg") - F.col("n_neg")
    said = F.col("score") >= threshold
    c = c.groupBy(group).agg(
        F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"), F.sum(F.col("n_pos") * (below + 0.5 * F.col("n_neg"))).alias("won"),
        F.sum(F.when(said, F.col("n_pos")).otherwise(0)).alias("tp"), F.sum(F.when(said, F.col("n_neg")).otherwise(0)).alias("fp"))
    c = c.withColumn("precision", _div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _div(F.col("tp"), F.col("P")))
    return c.select(group, (F.col("P") + F.col("N")).alias("n_rows"), F.col("P").alias("n_pos"),
                    F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("won") / (F.col("P") * F.col("N"))).alias("auc"),
                    _div(F.col("tp") + F.col("N") - F.col("fp"), F.col("P") + F.col("N")).alias("accuracy"), "precision", "recall",
                    _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def with_prediction(df: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    return df.withColumn("prediction", (F.col(score) >= threshold).cast("int"))


def confusion_matrix(df: DataFrame, label: str = "target", score: str = "score",
                     threshold: float = 0.5) -> DataFrame:
    """Counts per (target, prediction)."""
    return (with_prediction(df, score, threshold)
            .groupBy(F.col(label).alias("target"), "prediction").agg(F.count(F.lit(1)).alias("n")))


def _counts(df, label, score, threshold):
    p = with_prediction(df, score, threshold)
    t, y = F.col(label) == 1, F.col("prediction") == 1
    return p.agg(F.sum((t & y).cast("long")).alias("tp"), F.sum((~t & y).cast("long")).alias("fp"),
                 F.sum((t & ~y).cast("long")).alias("fn"), F.sum((~t & ~y).cast("long")).alias("tn"))


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "target", score: str = "score",
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 at a threshold; 0 on zero division."""
    c = _counts(df, label, score, threshold)
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.select("*", prec.alias("precision"), rec.alias("recall"))
    return c.select(_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
                    "precision", "recall",
                    _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def classification_report(df: DataFrame, label: str = "target", score: str = "score",
                          threshold: float = 0.5) -> DataFrame:
    """Per-class precision/recall/F1/support, macro and weighted averages."""
    c = _counts(df, label, score, threshold)

    def cls(name, tp, fp, fn):
        p = _div(F.col(tp), F.col(tp) + F.col(fp))
        r = _div(F.col(tp), F.col(tp) + F.col(fn))
        return c.select(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"),
                        (F.col(tp) + F.col(fn)).alias("support"))
    rows = cls("1", "tp", "fp", "fn").unionByName(cls("0", "tn", "fn", "fp"))
    rows = rows.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    avg = rows.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.sum("support").alias("support"), F.avg("f1").alias("f1"))
    wavg = rows.agg(F.lit("weighted avg").alias("label"),
                    (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                    (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                    F.sum("support").alias("support"),
                    (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))
    return rows.unionByName(avg).unionByName(wavg)


def probability_distribution(df: DataFrame, label: str = "target", score: str = "score") -> DataFrame:
    """Mean, median, population std of the score per class."""
    d = df.select(F.col(label).alias("target"), F.col(score).cast("double").alias("score"))
    return quantiles(d, "score", {"median": 0.5}, ["target"],
                     [F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")])


def roc_curve(df: DataFrame, label: str = "target", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first."""
    c = running_sums(score_counts(df, label, score), "score", ["n_pos", "n_neg"], descending=True)
    tot = df.agg(F.sum((F.col(label) == 1).cast("long")).alias("P"),
                 F.sum((F.col(label) != 1).cast("long")).alias("N")).first()
    return c.select(F.col("score").alias("threshold"),
                    _div(F.col("cum_n_neg"), F.lit(tot["N"] or 0)).alias("fpr"),
                    _div(F.col("cum_n_pos"), F.lit(tot["P"] or 0)).alias("tpr"))


def submission_validation(sub: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Rows vs expected, list-size min/max/mean, all lists of size k,
    and expected prefixes missing from the output (J8)."""
    s = sub.select("prefix", F.size("retrieved_queries").alias("n"))
    agg = s.agg(F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("min_len"), F.max("n").alias("max_len"),
                F.round(F.avg("n"), 6).alias("mean_len"), F.bool_and(F.col("n") == k).alias("all_k"))
    n_expected = test.count()
    exp = test.select(F.coalesce("prefix", F.lit("")).alias("prefix")).distinct()
    n_missing = exp.join(s.select("prefix").distinct(), "prefix", "left_anti").count()
    return agg.select("n_rows", F.lit(n_expected).cast("bigint").alias("n_expected"),
                      "min_len", "max_len", "mean_len", "all_k",
                      F.lit(n_missing).cast("bigint").alias("n_missing"))

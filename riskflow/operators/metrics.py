"""Quality of a score against a 0/1 label. Everything is an aggregate; no score list leaves the executors."""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions.scores import predicted
from riskflow.session import shares



def class_balance(df: DataFrame, label="fraud_label") -> DataFrame:
    """Negatives per positive: the weight of a positive row in training."""
    y = F.col(label)
    return df.agg(F.count_if(y == 0).alias("negatives"), F.count_if(y == 1).alias("positives")).withColumn(
        "fraud_ratio", F.try_divide(F.col("negatives"), F.col("positives")))


def auc(df: DataFrame, score="score", label="fraud_label") -> DataFrame:
    """Exact area under the ROC curve; equal scores share their mean rank.

    Rows are first reduced to one per distinct score. These are cut into blocks at quantiles of themselves, four per
    shuffle partition, so the running count of negatives below a score is a local sum plus a block start.
    """
    per_score = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    blocks = 4 * shares(df.sparkSession)
    at = per_score.agg(F.percentile_approx("s", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] or []
    bounds = [-math.inf, *sorted(set(at) - {math.inf, -math.inf}), math.inf]
    cut = Bucketizer(splits=bounds if len(bounds) > 2 else [-math.inf, 0.0, math.inf], inputCol="s", outputCol="block",
                     handleInvalid="keep").transform(per_score)
    local = W.partitionBy("block").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(local), F.lit(0))
    inner = (cut.withColumn("below", below).groupBy("block").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"),
        F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("area")))
    # a row per block from here on
    start = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return (inner.withColumn("start", F.coalesce(F.sum("n").over(start), F.lit(0)))
            .agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
                 F.sum(F.col("area") + F.col("p") * F.col("start")).alias("area"))
            .select("positives", "negatives", F.try_divide(
                F.col("area"), F.col("positives") * F.col("negatives")).alias("auc")))


def confusion_matrix(df: DataFrame, score="score", label="fraud_label",
                     threshold=C.EVALUATION_THRESHOLD) -> DataFrame:
    """tn, fp, fn, tp at a threshold: one row."""
    y, guess = F.col(label), predicted(score, threshold)
    return df.agg(F.count_if((y == 0) & (guess == 0)).alias("tn"), F.count_if((y == 0) & (guess == 1)).alias("fp"),
                  F.count_if((y == 1) & (guess == 0)).alias("fn"), F.count_if((y == 1) & (guess == 1)).alias("tp"))


def classification_report(df: DataFrame, score="score", label="fraud_label",
                          threshold=C.EVALUATION_THRESHOLD) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    m = confusion_matrix(df, score, label, threshold)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def line(name, right, guessed, actual):
        precision, recall = ratio(right, guessed), ratio(right, actual)
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        ratio(2 * precision * recall, precision + recall).alias("f1"), actual.alias("support"))

    lines = m.select(line(C.TARGET_NAMES[0], tn, tn + fn, tn + fp).alias("no"),
                     line(C.TARGET_NAMES[1], tp, tp + fp, tp + fn).alias("yes"),
                     ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"))
    total = F.col("no.support") + F.col("yes.support")

    def average(name, weight_no, weight_yes):
        def mean(f):
            return F.col(f"no.{f}") * weight_no + F.col(f"yes.{f}") * weight_yes
        return F.struct(F.lit(name).alias("class"), mean("precision").alias("precision"),
                        mean("recall").alias("recall"), mean("f1").alias("f1"), total.alias("support"))

    accuracy = F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"),
                        total.alias("support"))
    rows = F.array(F.col("no"), F.col("yes"), accuracy, average("macro avg", F.lit(0.5), F.lit(0.5)),
                   average("weighted avg", ratio(F.col("no.support"), total), ratio(F.col("yes.support"), total)))
    return lines.select(F.inline(rows)).withColumn("support", F.col("support").cast("long"))

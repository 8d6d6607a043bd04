"""Counts and metrics over long prediction tables: instance_id, level, label, prediction, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import prefix_sum


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def class_counts(df: DataFrame, level: str) -> DataFrame:
    return df.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("class")).agg(F.count("*").alias("n"))


def longtail_profile(df: DataFrame, level: str, cuts: Sequence[int]) -> DataFrame:
    """One row: classes, rows a class, and how many classes, and which share of them, lie below each cut and at or above it."""
    n = class_counts(df, level)
    sides = [c for cut in cuts for name, side in (("below", F.col("n") < cut), ("above", F.col("n") >= cut)) for c in (F.count_if(side).alias(f"{name}_{cut}"), rate(side).alias(f"share_{name}_{cut}"))]
    return n.agg(F.count("*").alias("classes"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"), *sides)


def rank_abundance(df: DataFrame, level: str) -> DataFrame:
    """n, classes with that many rows, and the share of rows in classes with at least as many."""
    sizes = class_counts(df, level).groupBy("n").agg(F.count("*").alias("classes")).withColumn("rows", F.col("n") * F.col("classes")).withColumn("_", F.lit(0))
    run = prefix_sum(sizes, ["_"], "n", ["classes", "rows"], descending=True)
    total = sizes.agg(F.sum("rows").alias("total"))
    return run.join(F.broadcast(total)).select("n", "classes", "cum_classes", (F.col("cum_rows") / F.col("total")).alias("share"))


def sample_weights(df: DataFrame, level: str, power: float) -> DataFrame:
    """weight = count(class) ** -power; counts by partial aggregation, then joined."""
    n = class_counts(df, level).select(F.col("class").alias(level), F.pow(F.col("n").cast("double"), F.lit(-float(power))).alias("weight"))
    return df.join(n, level)


def class_log_prior(df: DataFrame, vocab: DataFrame, level: str, tau: float) -> DataFrame:
    """idx, class, tau * log(max(n, 1) / total), aligned to the vocabulary."""
    n = class_counts(df, level)
    joined = vocab.where(F.col("level") == level).join(n, "class", "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    total = joined.agg(F.sum("n").alias("total"))
    return joined.join(F.broadcast(total)).select("idx", "class", (tau * F.ln(F.col("n") / F.col("total"))).alias("log_prior"))


def confusion_counts(pred: DataFrame, by: Sequence[str] = ("level",)) -> DataFrame:
    """tp, fp, fn for each class; one shuffle."""
    hit = F.col("label").eqNullSafe(F.col("prediction"))
    sides = F.explode(F.array(F.struct(F.col("label").alias("class"), hit.cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~hit).cast("long").alias("fn")), F.struct(F.when(~hit, F.col("prediction")).alias("class"), F.lit(0).cast("long").alias("tp"), (~hit).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))))
    rows = pred.select(*by, sides.alias("s")).where("s.class is not null")
    return rows.groupBy(*by, F.col("s.class").alias("class")).agg(*(F.sum(f"s.{c}").alias(c) for c in ("tp", "fp", "fn")))


def class_f1(counts: DataFrame) -> DataFrame:
    tp2 = 2 * F.col("tp")
    return counts.withColumn("f1", F.when(F.col("tp") > 0, tp2 / (tp2 + F.col("fp") + F.col("fn"))).otherwise(0.0))


def macro_f1(pred: DataFrame, by: Sequence[str] = ("level",), average_over: str = "truth") -> DataFrame:
    """Mean F1 over classes present in truth, or over the union of true and predicted ones."""
    f1 = class_f1(confusion_counts(pred, by))
    if average_over == "truth":
        f1 = f1.where(F.col("tp") + F.col("fn") > 0)
    return f1.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def micro_accuracy(pred: DataFrame, by: Sequence[str] = ("level",)) -> DataFrame:
    return pred.groupBy(*by).agg(rate(F.col("label").eqNullSafe(F.col("prediction"))).alias("micro_acc"), F.count("*").alias("n"))


def metric_report(pred: DataFrame, by: Sequence[str] = ("level",)) -> DataFrame:
    return macro_f1(pred, by).join(micro_accuracy(pred, by), list(by))


def f1_summary(pred: DataFrame, vocab: DataFrame, average: str = "macro") -> DataFrame:
    """F1 over all classes of the vocabulary, absent ones too, with 1e-8 in the denominators; macro or micro."""
    counts = vocab.select("level", "class").join(confusion_counts(pred), ["level", "class"], "left").fillna(0, ["tp", "fp", "fn"])

    def f1(tp: Column, fp: Column, fn: Column) -> Column:
        p, r = tp / (tp + fp + 1e-8), tp / (tp + fn + 1e-8)
        return 2 * p * r / (p + r + 1e-8)

    cols = [F.col(c) for c in ("tp", "fp", "fn")]
    if average == "macro":
        return counts.groupBy("level").agg(F.avg(f1(*cols)).alias("f")).agg(F.avg("f").alias("f1"))
    return counts.agg(f1(*(F.sum(c) for c in cols)).alias("f1"))


def multilabel_f1(scores: DataFrame, threshold: float) -> DataFrame:
    """From score and truth (0/1) of each instance and class: F1 of each class at score >= threshold."""
    shown, true = F.col("score") >= threshold, F.col("truth") == 1
    counts = scores.groupBy("class").agg(F.count_if(shown & true).alias("tp"), F.count_if(shown & ~true).alias("fp"), F.count_if(~shown & true).alias("fn"))
    return class_f1(counts)


def multilabel_average(scores: DataFrame, threshold: float, average: str = "macro", batch: str | None = None) -> DataFrame:
    """One row, f1: the mean over classes (macro) or of the pooled counts (micro); F1 is 0 where nothing is right.

    batch: the mean over batches of each one's F1, which depends on how rows were dealt out: for comparison with numbers
    that were averaged so.
    """
    if average not in ("macro", "micro"):
        raise ValueError(f"unsupported average: {average}")
    keys = [batch] if batch else []
    shown, true = F.col("score") >= threshold, F.col("truth") == 1
    counts = scores.groupBy(*keys, "class").agg(F.count_if(shown & true).alias("tp"), F.count_if(shown & ~true).alias("fp"), F.count_if(~shown & true).alias("fn"))
    if average == "micro":
        counts = counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    each = class_f1(counts).groupBy(*keys).agg(F.avg("f1").alias("f1"))
    return each.agg(F.avg("f1").alias("f1")) if batch else each


def best_threshold(scores: DataFrame, steps: int = 20) -> DataFrame:
    """The lowest of the grid thresholds k / steps with the best pooled F1. One histogram, no copy of the scores."""
    cell = F.least(F.floor(F.col("score") * steps + 1e-9), F.lit(steps)).cast("int")
    hist = scores.groupBy(cell.alias("cell")).agg(F.sum("truth").cast("long").alias("pos"), F.sum(1 - F.col("truth")).cast("long").alias("neg"))
    above = Window.orderBy(F.col("cell").desc()).rangeBetween(Window.unboundedPreceding, 0)  # at most steps + 1 rows
    total = hist.agg(F.sum("pos").alias("all_pos"))
    run = hist.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above)}).join(F.broadcast(total))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_pos"))
    return run.select((F.col("cell") / steps).alias("threshold"), f1.alias("f1")).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def per_class_prf(pred: DataFrame, top_k: int) -> DataFrame:
    """Precision, recall, F1 and support of the k most frequent true classes, over rows whose truth is one of them."""
    top = pred.groupBy("label").agg(F.count("*").alias("support")).orderBy(F.desc("support"), "label").limit(top_k)
    rows = pred.join(top.select("label"), "label", "left_semi").withColumn("level", F.lit(0))
    counts = class_f1(confusion_counts(rows)).withColumnRenamed("class", "label")
    prf = counts.select("label", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "f1")
    return top.join(prf, "label")


def conditional_accuracy(pred: DataFrame, min_conf: float, keys: Sequence[str] = ("label", "level")) -> DataFrame:
    valid, right = F.col("confidence") >= min_conf, F.col("label") == F.col("prediction")
    out = pred.groupBy(*keys).agg(F.count("*").alias("n_images"), F.count_if(valid).alias("n_valid"), F.count_if(valid & right).alias("n_correct"))
    return out.withColumns({"accuracy": F.try_divide(F.col("n_correct"), F.col("n_valid")), "coverage": F.col("n_valid") / F.col("n_images")})


def accuracy_pivot(acc: DataFrame, levels: Sequence[int]) -> DataFrame:
    wide = acc.groupBy("label").pivot("level", list(levels)).agg(F.first("accuracy"))
    return wide.toDF("label", *(f"level_{n}" for n in levels))


def vocab_coverage(occ: DataFrame, vocab: DataFrame, by: str) -> DataFrame:
    """For each group: distinct classes, those in and out of the vocabulary, coverage, and the sorted lists."""
    pairs = occ.select(by, "class").distinct().join(vocab.select("class", F.lit(True).alias("known")).distinct(), "class", "left")
    known = F.col("known").isNotNull()
    out = pairs.groupBy(by).agg(F.count("*").alias("classes"), F.count_if(known).alias("inside"), F.array_join(F.array_sort(F.collect_list(F.when(known, F.col("class")))), ",").alias("inside_list"), F.array_join(F.array_sort(F.collect_list(F.when(~known, F.col("class")))), ",").alias("outside_list"))
    return out.withColumn("coverage", F.col("inside") / F.col("classes"))


def coherence_rates(pred: DataFrame, parents: DataFrame) -> DataFrame:
    """level, share of instances whose prediction there isn't the parent of the one below; parents(level, child, parent)."""
    fine = pred.select("instance_id", "level", F.col("prediction").alias("child"))
    coarse = pred.select("instance_id", (F.col("level") - 1).alias("level"), F.col("prediction").alias("got"))
    both = fine.join(coarse, ["instance_id", "level"]).join(parents, ["level", "child"], "left")
    return both.groupBy((F.col("level") + 1).alias("level")).agg(rate(~F.col("got").eqNullSafe(F.col("parent"))).alias("incoherent"), F.count("*").alias("n"))


def abstention_metrics(summary: DataFrame) -> DataFrame:
    """From level (null: none), correct and confidence of each instance: rows a level, accuracy, mean confidence."""
    return summary.groupBy("level").agg(F.count("*").alias("n"), rate(F.col("correct")).alias("accuracy"), F.avg("confidence").alias("confidence"))


def abstention_summary(summary: DataFrame) -> DataFrame:
    """One row: rows, share answered, mean level of the answers, accuracy of all rows and of the answers, and mean
    confidence of right and of wrong answers."""
    said, right = F.col("level").isNotNull(), F.coalesce(F.col("correct"), F.lit(False))
    return summary.agg(
        F.count("*").alias("n"), rate(said).alias("coverage"), rate(~said).alias("unanswered"), F.avg("level").alias("mean_level"), rate(right).alias("accuracy"), F.avg(F.when(said, right.cast("double"))).alias("answered_accuracy"),
        F.avg(F.when(said & right, F.col("confidence"))).alias("right_confidence"), F.avg(F.when(said & ~right, F.col("confidence"))).alias("wrong_confidence"),
    )


def subset_report(pred: DataFrame, subsets: Column) -> DataFrame:
    """metric_report for each name in an array column of overlapping subsets."""
    return metric_report(pred.withColumn("subset", F.explode(subsets)), ("subset", "level"))


def metric_spread(reports: DataFrame, metric: str = "macro_f1") -> DataFrame:
    return reports.groupBy("level").agg((F.max(metric) - F.min(metric)).alias("spread"), F.count("*").alias("runs"))


def within_noise(deltas: DataFrame, spread: DataFrame) -> DataFrame:
    """deltas (level, delta, ...) with the spread of repeated runs of their level, and whether they are no larger."""
    return deltas.join(spread.select("level", "spread"), "level", "left").withColumn("noise", F.abs("delta") <= F.col("spread"))


def top_classes_by(df: DataFrame, by: str, level: str, k: int) -> DataFrame:
    n = df.groupBy(by, level).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), level))
    return n.withColumn("place", place).where(F.col("place") <= k)

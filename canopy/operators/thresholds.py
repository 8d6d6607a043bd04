"""Ranking, thresholds, back-off between levels and ranking quality.

Running totals over confidences go through prefix_sum: equal confidences stay together, so a threshold never cuts a tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import prefix_sum, quantiles, quantiles_by
from ..functions.scans import affine_scan, places
from ..sources.scratch import stored
from .metrics import macro_f1, rate

#: Rows of a run that meet its least value in one piece.
PIECE = 1 << 19


def topk(scores: DataFrame, k: int, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """The k best classes of each instance; of equal scores the lowest class index."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "class_idx"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def top1(scores: DataFrame, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    best = F.struct(F.col("score"), (-F.col("class_idx")).alias("i"))
    return scores.groupBy(*keys).agg(F.max_by("class_idx", best).alias("class_idx"), F.max("score").alias("score"))


def gate_quantile(pred: DataFrame, keep_frac: float) -> DataFrame:
    """Rows with at least the (1 - keep_frac) quantile of confidence, interpolated linearly."""
    cut = quantiles(pred, "confidence", [1 - keep_frac])  # one row
    return pred.join(F.broadcast(cut)).where(F.col("confidence") >= F.col("q0")).select(*pred.columns)


def gate_per_class(pred: DataFrame, k: int, key: str = "instance_id") -> DataFrame:
    """The k most confident rows of every predicted class."""
    place = F.row_number().over(Window.partitionBy("prediction").orderBy(F.desc("confidence"), key))
    return pred.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def gate_report(pred: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows, accuracy, classes and confidence quantiles before and after a gate, both by the same running total."""
    part = lambda df, name: df.select(F.lit(name).alias("stage"), "label", "prediction", "confidence")
    both = part(pred, "before").unionByName(part(kept, "after"))
    out = both.groupBy("stage").agg(F.count("*").alias("n"), rate(F.col("label") == F.col("prediction")).alias("accuracy"), F.count_distinct("prediction").alias("classes"))
    stages = pred.sparkSession.createDataFrame([("before",), ("after",)], "stage string")  # a side without rows has its row as well
    q = quantiles_by(both, ["stage"], "confidence", [0.1, 0.5, 0.9, 0.99])
    rows = stages.join(out, "stage", "left").join(q, "stage", "left")
    counted = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "classes")]
    return rows.select("stage", counted[0], "accuracy", counted[1], *(F.col(f"q{n}").alias(c) for n, c in enumerate(("p10", "p50", "p90", "p99"))))


def shown_by_confidence(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = pred.select(*keys, "confidence", F.lit(1).alias("n"), (F.col("label") == F.col("prediction")).cast("long").alias("right"))
    return prefix_sum(rows, keys, "confidence", ["n", "right"], descending=True)


def choose_threshold(pred: DataFrame, target: float, keys: Sequence[str] = ("level",)) -> DataFrame:
    """The lowest confidence at which the precision of what is shown reaches the target; null if none."""
    ok = F.col("cum_right") >= target * F.col("cum_n")
    return shown_by_confidence(pred, keys).groupBy(*keys).agg(F.min(F.when(ok, F.col("confidence"))).alias("threshold"))


def threshold_report(pred: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("level",)) -> DataFrame:
    joined = pred.join(thresholds, list(keys), "left")
    shown = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    return joined.groupBy(*keys).agg(F.first("threshold").alias("threshold"), F.count("*").alias("n"), rate(shown).alias("coverage"), F.avg(F.when(shown, (F.col("label") == F.col("prediction")).cast("double"))).alias("precision"))


def precision_curve(pred: DataFrame, n_points: int = 101, keys: Sequence[str] = ("level",)) -> DataFrame:
    """Precision and coverage at thresholds 0, 1/(n-1), ..., 1: a histogram and a short running sum, no N x n rows."""
    cell = F.floor(F.col("confidence").cast("decimal(20,10)") * (n_points - 1)).cast("int")
    hist = pred.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("right"))
    grid = pred.sparkSession.range(n_points).select(F.col("id").cast("int").alias("cell"))
    full = hist.select(*keys).distinct().join(F.broadcast(grid)).join(hist, [*keys, "cell"], "left").fillna(0, ["n", "right"])
    above = Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)  # n_points rows a key
    run = full.withColumns({"shown": F.sum("n").over(above), "good": F.sum("right").over(above), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return run.select(*keys, (F.col("cell") / (n_points - 1)).alias("threshold"), "shown", F.try_divide("good", "shown").alias("precision"), (F.col("shown") / F.col("all")).alias("coverage"))


def curve_threshold(curve: DataFrame, target: float, keys: Sequence[str] = ("level",)) -> DataFrame:
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("precision") >= target, F.col("threshold"))).alias("threshold"))


def wide_by_level(pred: DataFrame, levels: Sequence[int]) -> DataFrame:
    """instance_id, conf_<level>, ok_<level>."""
    ok = F.col("label") == F.col("prediction")
    cols = [x for n in levels for x in (F.max(F.when(F.col("level") == n, F.col("confidence"))).alias(f"conf_{n}"), F.bool_or(F.when(F.col("level") == n, ok)).alias(f"ok_{n}"))]
    return pred.groupBy("instance_id").agg(*cols)


def chosen_rank(levels: Sequence[int], thresholds: Sequence[Column]) -> Column:
    rank = None
    for n, t in zip(levels, thresholds, strict=True):
        hit = F.col(f"conf_{n}") >= t
        rank = F.when(hit, n) if rank is None else rank.when(hit, n)
    return rank.otherwise(-1)


def ranked(wide: DataFrame, levels: Sequence[int], threshold: float) -> DataFrame:
    """wide with rank (-1: abstained) of the finest level that is sure enough, and whether it is right there."""
    out = wide.withColumn("rank", chosen_rank(levels, [F.lit(threshold)] * len(levels)))
    return out.withColumn("right", F.coalesce(*(F.when(F.col("rank") == n, F.col(f"ok_{n}")) for n in levels)))


def rank_cascade(wide: DataFrame, levels: Sequence[int], threshold: float) -> DataFrame:
    """rank (-1: abstained), rows, coverage and precision of the finest level that is sure enough."""
    total = wide.agg(F.count("*").alias("total"))
    return ranked(wide, levels, threshold).groupBy("rank").agg(F.count("*").alias("n"), rate(F.col("right")).alias("precision")).join(F.broadcast(total)).select("rank", "n", "precision", (F.col("n") / F.col("total")).alias("coverage"))


def cascade_rates(wide: DataFrame, levels: Sequence[int], threshold: float) -> DataFrame:
    """One row: the share answered at any level, the precision of the answers, and the share of rows answered rightly."""
    said = F.col("rank") >= 0
    return ranked(wide, levels, threshold).agg(F.count("*").alias("n"), rate(said).alias("answered"), F.avg(F.when(said, F.col("right").cast("double"))).alias("precision"), rate(said & F.col("right")).alias("useful"))


def conditional_thresholds(pred: DataFrame, levels: Sequence[int], target: float, n_points: int = 101) -> DataFrame:
    """For each level its curve's threshold, fitted only on the instances that the finer levels declined.

    Levels are taken one after the other: a threshold, one number, is a constant of the next level's plan, and the ids
    declined are stored, so that a task sorts one level's ids and confidences and not those of all levels before.
    """
    right = (F.col("label") == F.col("prediction")).alias("label")
    rows = stored(pred.where(F.col("level").isin(*levels)).select("instance_id", "level", "confidence", right))
    out, declined = None, None
    for n in levels:
        own = rows.where(F.col("level") == n)
        if declined is not None:
            own = stored(own.join(declined.hint("merge"), "instance_id", "left_semi"))
        t = stored(curve_threshold(precision_curve(own.withColumn("prediction", F.lit(True)), n_points), target))
        out = t if out is None else out.unionByName(t)
        found = t.first()
        cut = found["threshold"] if found else None
        below = F.lit(True) if cut is None else F.coalesce(F.col("confidence") < cut, F.lit(True))
        declined = own.where(below).select("instance_id")
    return out


def cascade_sweep(wide: DataFrame, levels: Sequence[int], steps: int) -> DataFrame:
    """Rows at each rank for finest-level thresholds k / steps, the coarser ones fixed at one half.

    One histogram of the finest confidence by what the row would fall back to, then sums over its few cells.
    """
    finest, *others = levels
    grid = F.array(*(F.lit(k / steps) for k in range(steps + 1)))
    cell = F.size(F.filter(grid, lambda t: t <= F.col(f"conf_{finest}"))) - 1  # the last step that the row passes
    back = chosen_rank(others, [F.lit(0.5)] * len(others)) if others else F.lit(-1)
    cells = wide.groupBy(cell.alias("cell"), back.alias("back")).agg(F.count("*").alias("n"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("step")
    out = cells.select("cell", "back", "n", step).select("step", F.when(F.col("step") <= F.col("cell"), finest).otherwise(F.col("back")).alias("rank"), "n")
    return out.groupBy("step", "rank").agg(F.sum("n").alias("n"))


def deepest_confident(pred: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """instance_id, level (null if none passes), correct: the finest level that passes."""
    ok = F.col("confidence") > threshold if strict else F.col("confidence") >= threshold
    level = F.when(ok, F.col("level"))
    right = F.when(ok, F.col("label") == F.col("prediction"))
    return pred.groupBy("instance_id").agg(F.min(level).alias("level"), F.min_by(right, level).alias("correct"))


def auroc(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """P(positive scores higher than negative), ties one half; null if a side is empty. Columns score, positive."""
    rows = scores.select(*keys, "score", F.lit(0).alias("_"), F.col("positive").cast("long").alias("pos"), (~F.col("positive")).cast("long").alias("neg"))
    run = prefix_sum(rows, ["_", *keys], "score", ["pos", "neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2)
    out = run.groupBy("_", *keys).agg(F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg")).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.drop("_")


def level_scores(pred: DataFrame) -> DataFrame:
    """For each level: macro-F1, and how well confidence ranks right answers before wrong ones."""
    ranking = auroc(pred.select("level", F.col("confidence").alias("score"), (F.col("label") == F.col("prediction")).alias("positive")), ["level"])
    return macro_f1(pred).join(ranking.select("level", "auroc", (F.col("n_pos") + F.col("n_neg")).alias("n")), "level")


def precision_recall_points(pred: DataFrame) -> DataFrame:
    """level, threshold, precision, recall: of the rows at least as confident, for every confidence that occurs, the share
    that is right, and how many of all right rows they are (null if none is)."""
    right = (F.col("label").eqNullSafe(F.col("prediction"))).cast("long")
    rows = pred.where(F.col("confidence").isNotNull()).select("level", "confidence", right.alias("hit"), F.lit(1).cast("long").alias("n"))
    run = prefix_sum(rows, ["level"], "confidence", ["hit", "n"], descending=True)
    whole = rows.groupBy(F.col("level").alias("_level")).agg(F.sum("hit").alias("hits"))
    return run.join(whole, F.col("level").eqNullSafe(F.col("_level"))).select("level", F.col("confidence").alias("threshold"), (F.col("cum_hit") / F.col("cum_n")).alias("precision"), F.try_divide("cum_hit", "hits").alias("recall"))


def knee_point(log: DataFrame, decay: float, tol: float, safety: float = 0.75) -> DataFrame:
    """run_id, knee, recommended: each run's largest x whose debiased moving average is at most tol times the least, and a
    safe share of it.

    The moving average is a recurrence, scanned in blocks, and meets the run's least value in pieces: a run of any length
    is many tasks.
    """
    rows = places(log.select("run_id", "x", "y"), ["run_id"], ["x", "y"])
    rows = rows.select("run_id", "n", F.col("x").cast("double").alias("x"), F.lit(decay).alias("a"), (F.col("y") * (1 - decay)).alias("c"))
    smooth = stored(affine_scan(rows, ["run_id"], ["x"]).select("run_id", "n", "x", (F.col("s") / (1 - F.pow(F.lit(decay), F.col("n") + 1))).alias("y")))
    least = smooth.groupBy(F.col("run_id").alias("_run")).agg(F.min("y").alias("least"), F.floor(F.max("n") / PIECE).alias("_last"))
    least = least.select("_run", "least", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_piece"))
    met = smooth.join(least, F.col("run_id").eqNullSafe(F.col("_run")) & (F.floor(F.col("n") / PIECE) == F.col("_piece")))
    low = F.max(F.when(F.col("y") <= F.col("least") * tol, F.col("x"))).alias("knee")
    return met.groupBy("run_id").agg(low).withColumn("recommended", F.col("knee") * safety)


def nonfinite_runs(log: DataFrame, longest: int) -> DataFrame:
    """run_id, skipped, aborted: each run's rows without a finite value, and whether so many follow one another.

    How many bad rows end at a row is a recurrence (one more after a bad row, none after a good one), scanned in blocks.
    """
    value = F.col("value").cast("double")
    bad = (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).cast("int")
    rows = places(log.select("run_id", "x", bad.alias("bad")), ["run_id"], ["x", "bad"])
    streaks = affine_scan(rows.select("run_id", "n", F.col("bad").alias("a"), F.col("bad").alias("c"), "bad"), ["run_id"], ["bad"])
    return streaks.groupBy("run_id").agg(F.sum("bad").alias("skipped"), (F.max("s") >= longest).alias("aborted"))

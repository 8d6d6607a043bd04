"""Queries of the metric and threshold operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import places
from ..operators import metrics as E
from ..operators import thresholds as T
from .registry import query
from .views import LEVELS, catalogue, pred, scores, table, tree, with_views

COUNTS = """, cc AS (SELECT level, class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT level, label AS class, (label = prediction)::INT AS tp, 0 AS fp, (label <> prediction)::INT AS fn FROM pred UNION ALL SELECT level, prediction, 0, 1, 0 FROM pred WHERE label <> prediction) GROUP BY 1, 2),
 f1 AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cc)
"""


def rounded(df, *cols, n=9):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query(with_views("catalogue", "SELECT leaf AS class, count(*) AS n FROM catalogue GROUP BY 1"))
def class_counts(spark, d):
    return E.class_counts(catalogue(spark, d), "leaf")


LONGTAIL = ", ".join(f"count(*) FILTER (n {op} {c}) AS {name}_{c}, round(avg((n {op} {c})::INT), 9) AS share_{name}_{c}" for c in (5, 10) for name, op in (("below", "<"), ("above", ">=")))


@query(with_views("catalogue", f"SELECT count(*) AS classes, min(n) AS least, quantile_cont(n, 0.5) AS median, round(avg(n), 9) AS mean, max(n) AS most, {LONGTAIL} FROM (SELECT count(*) AS n FROM catalogue GROUP BY leaf)"))
def longtail_profile(spark, d):
    return rounded(E.longtail_profile(catalogue(spark, d), "leaf", [5, 10]), "mean", *(f"share_{k}_{c}" for k in ("below", "above") for c in (5, 10)))


@query(with_views("catalogue", ", c AS (SELECT n, count(*) AS classes, n * count(*) AS rows FROM (SELECT count(*) AS n FROM catalogue GROUP BY leaf) GROUP BY n) SELECT n, classes, CAST(sum(classes) OVER w AS BIGINT) AS cum_classes, round(sum(rows) OVER w / (SELECT sum(rows) FROM c), 9) AS share FROM c WINDOW w AS (ORDER BY n DESC)"))
def rank_abundance(spark, d):
    return rounded(E.rank_abundance(catalogue(spark, d), "leaf"), "share")


@query(with_views("catalogue", "SELECT id, round(pow(count(*) OVER (PARTITION BY leaf), -0.5), 9) AS weight FROM catalogue WHERE \"set\" <> '0'"))
def sample_weights(spark, d):
    return rounded(E.sample_weights(catalogue(spark, d).where("set <> '0'"), "leaf", 0.5).select("id", "weight"), "weight")


@query(with_views("catalogue", ", v AS (SELECT DISTINCT leaf AS class FROM catalogue), n AS (SELECT class, greatest(coalesce(k, 0), 1) AS k FROM v LEFT JOIN (SELECT leaf AS class, count(*) AS k FROM catalogue WHERE \"set\" <> '0' GROUP BY 1) USING (class)) SELECT CAST(row_number() OVER (ORDER BY class) - 1 AS INT) AS idx, class, round(0.7 * ln(k / (SELECT sum(k) FROM n)), 9) AS log_prior FROM n"))
def class_log_prior(spark, d):
    from ..operators.catalogue import build_vocab

    c = catalogue(spark, d)
    return rounded(E.class_log_prior(c.where("set <> '0'"), build_vocab(c, LEVELS), "leaf", 0.7), "log_prior")


@query(with_views("pred", COUNTS + "SELECT level, class, tp, fp, fn FROM cc"))
def confusion_counts(spark, d):
    return E.confusion_counts(pred(spark, d))


@query(with_views("pred", COUNTS + "SELECT level, round(avg(f1), 9) AS macro_f1 FROM f1 WHERE tp + fn > 0 GROUP BY 1"))
def macro_f1(spark, d):
    return rounded(E.macro_f1(pred(spark, d)), "macro_f1")


@query(with_views("pred", "SELECT level, round(avg((label = prediction)::INT), 9) AS micro_acc, count(*) AS n FROM pred GROUP BY 1"))
def micro_accuracy(spark, d):
    return rounded(E.micro_accuracy(pred(spark, d)), "micro_acc")


@query(with_views("pred", COUNTS + "SELECT level, round(m, 9) AS macro_f1, round(a, 9) AS micro_acc, n FROM (SELECT level, avg(f1) AS m FROM f1 WHERE tp + fn > 0 GROUP BY 1) JOIN (SELECT level, avg((label = prediction)::INT) AS a, count(*) AS n FROM pred GROUP BY 1) USING (level)"))
def metric_report(spark, d):
    return rounded(E.metric_report(pred(spark, d)), "macro_f1", "micro_acc")


@query(with_views("pred", COUNTS + """, p AS (SELECT level, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM cc) SELECT round(avg(f), 9) AS f1 FROM (SELECT level, avg(2 * p * r / (p + r + 1e-8)) AS f FROM p GROUP BY level)"""))
def f1_summary(spark, d):
    p = pred(spark, d)
    vocab = p.select("level", F.explode(F.array("label", "prediction")).alias("class")).distinct()
    return rounded(E.f1_summary(p, vocab), "f1")


MULTI = ", m AS (SELECT instance_id, class_idx AS class, 1 / (1 + exp(-score)) AS score, CAST(class_idx = label_idx OR other > 1.5 AS INT) AS truth FROM long)\n"


def multilabel(spark, d):
    rows = scores(spark, d).select("instance_id", "label_idx", F.posexplode(F.arrays_zip("scores", "other")).alias("class", "p"))
    return rows.select("instance_id", "class", (1 / (1 + F.exp(-F.col("p.scores")))).alias("score"), ((F.col("class") == F.col("label_idx")) | (F.col("p.other") > 1.5)).cast("int").alias("truth"))


@query(with_views("scores", MULTI + ", c AS (SELECT class, count(*) FILTER (score >= 0.6 AND truth = 1) AS tp, count(*) FILTER (score >= 0.6 AND truth = 0) AS fp, count(*) FILTER (score < 0.6 AND truth = 1) AS fn FROM m GROUP BY 1) SELECT class, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c"))
def multilabel_f1(spark, d):
    return rounded(E.multilabel_f1(multilabel(spark, d), 0.6), "f1")


@query(with_views("scores", MULTI + """, c AS (SELECT instance_id % 8 AS b, class, count(*) FILTER (score >= 0.6 AND truth = 1) AS tp, count(*) FILTER (score >= 0.6 AND truth = 0) AS fp, count(*) FILTER (score < 0.6 AND truth = 1) AS fn FROM m GROUP BY ALL), k AS (SELECT class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY 1),
 p AS (SELECT b, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY 1) SELECT 'macro' AS average, round(avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 9) AS f1 FROM k UNION ALL SELECT 'micro', round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) FROM k
 UNION ALL SELECT 'macro a batch', round(avg(f), 9) FROM (SELECT avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS f FROM c GROUP BY b) UNION ALL SELECT 'micro a batch', round(avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 9) FROM p"""))
def multilabel_average(spark, d):
    rows = multilabel(spark, d).withColumn("batch", F.col("instance_id") % 8)
    found = [E.multilabel_average(rows, 0.6, how, batch).select(F.lit(how + (" a batch" if batch else "")).alias("average"), "f1") for how in ("macro", "micro") for batch in (None, "batch")]
    return rounded(reduce(DataFrame.unionByName, found), "f1")


@query(with_views("scores", MULTI + ", g AS (SELECT i / 20.0 AS t, i FROM range(0, 21) r(i)), f AS (SELECT t, 2 * count(*) FILTER (truth = 1) / (count(*) + (SELECT sum(truth) FROM m)) AS f1 FROM g JOIN m ON least(floor(score * 20 + 1e-9), 20) >= i GROUP BY t) SELECT CAST(t AS DOUBLE) AS threshold, round(f1, 9) AS f1 FROM f ORDER BY f.f1 DESC, t LIMIT 1"))
def best_threshold(spark, d):
    return rounded(E.best_threshold(multilabel(spark, d)), "f1")


@query(with_views("pred", """, t AS (SELECT label, count(*) AS support FROM pred WHERE level = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8), r AS (SELECT * FROM pred WHERE level = 0 AND label IN (SELECT label FROM t)),
 c AS (SELECT t.label, support, (SELECT count(*) FROM r WHERE r.label = t.label AND prediction = t.label) AS tp, (SELECT count(*) FROM r WHERE prediction = t.label) AS p FROM t) SELECT label, support, round(tp / p, 9) AS precision, round(tp / support, 9) AS recall, round(2 * tp / (p + support), 9) AS f1 FROM c"""))
def per_class_prf(spark, d):
    return rounded(E.per_class_prf(pred(spark, d).where("level = 0"), 8), "precision", "recall", "f1")


ACC = ", a AS (SELECT label, level, count(*) AS n_images, count(*) FILTER (confidence >= 0.5) AS n_valid, count(*) FILTER (confidence >= 0.5 AND label = prediction) AS n_correct FROM pred GROUP BY 1, 2)\n"


@query(with_views("pred", ACC + "SELECT *, round(n_correct / nullif(n_valid, 0), 9) AS accuracy, round(n_valid / n_images, 9) AS coverage FROM a"))
def conditional_accuracy(spark, d):
    return rounded(E.conditional_accuracy(pred(spark, d), 0.5), "accuracy", "coverage")


@query(with_views("pred", ACC + "SELECT label, " + ", ".join(f"round(max(n_correct / nullif(n_valid, 0)) FILTER (level = {n}), 9) AS level_{n}" for n in range(3)) + " FROM a GROUP BY label"))
def accuracy_pivot(spark, d):
    return rounded(E.accuracy_pivot(E.conditional_accuracy(pred(spark, d), 0.5), [0, 1, 2]), "level_0", "level_1", "level_2")


@query(with_views("catalogue", ", v AS (SELECT DISTINCT mid FROM catalogue WHERE CAST(mid AS INT) % 3 <> 0), o AS (SELECT DISTINCT country, mid FROM catalogue) SELECT country, count(*) AS classes, count(*) FILTER (k) AS inside, coalesce(string_agg(mid, ',' ORDER BY mid) FILTER (k), '') AS inside_list, coalesce(string_agg(mid, ',' ORDER BY mid) FILTER (NOT k), '') AS outside_list, round(count(*) FILTER (k) / count(*), 9) AS coverage FROM (SELECT country, mid, mid IN (SELECT mid FROM v) AS k FROM o) GROUP BY country"))
def vocab_coverage(spark, d):
    c = catalogue(spark, d)
    vocab = c.where(F.col("mid").cast("int") % 3 != 0).select(F.col("mid").alias("class")).distinct()
    return rounded(E.vocab_coverage(c.select("country", F.col("mid").alias("class")), vocab, "country"), "coverage")


@query(with_views("pred", ", e AS (SELECT 0 AS level, CAST(n_nationkey AS VARCHAR) AS child, CAST(n_regionkey AS VARCHAR) AS parent FROM nation UNION ALL SELECT 1, CAST(r_regionkey AS VARCHAR), CAST(CASE WHEN r_regionkey = 4 THEN 1 ELSE r_regionkey % 2 END AS VARCHAR) FROM region) SELECT a.level + 1 AS level, round(avg((b.prediction IS DISTINCT FROM parent)::INT), 9) AS incoherent, count(*) AS n FROM pred a JOIN pred b ON a.instance_id = b.instance_id AND b.level = a.level + 1 LEFT JOIN e ON e.level = a.level AND child = a.prediction GROUP BY 1"))
def coherence_rates(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.select(F.lit(0).alias("level"), F.col("n_nationkey").cast("string").alias("child"), F.col("n_regionkey").cast("string").alias("parent"))
    top = F.when(F.col("r_regionkey") == 4, 1).otherwise(F.col("r_regionkey") % 2).cast("string")
    edges = edges.unionByName(r.select(F.lit(1).alias("level"), F.col("r_regionkey").cast("string").alias("child"), top.alias("parent")))
    return rounded(E.coherence_rates(pred(spark, d), edges), "incoherent")


DEEP = ", dc AS (SELECT instance_id, min(level) FILTER (confidence >= 0.6) AS level, arg_min(label = prediction, level) FILTER (confidence >= 0.6) AS correct FROM pred GROUP BY 1)\n"


@query(with_views("pred", DEEP + "SELECT instance_id, level, correct FROM dc"))
def deepest_confident(spark, d):
    return T.deepest_confident(pred(spark, d), 0.6)


@query(with_views("pred", DEEP + ", c AS (SELECT instance_id, level, max(confidence) AS confidence FROM pred GROUP BY 1, 2) SELECT dc.level, count(*) AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(confidence), 9) AS confidence FROM dc LEFT JOIN c ON dc.instance_id = c.instance_id AND dc.level = c.level GROUP BY 1"))
def abstention_metrics(spark, d):
    p = pred(spark, d)
    chosen = T.deepest_confident(p, 0.6).join(p.select("instance_id", "level", "confidence"), ["instance_id", "level"], "left")
    return rounded(E.abstention_metrics(chosen), "accuracy", "confidence")


@query(with_views("pred", DEEP + """, c AS (SELECT dc.instance_id, dc.level, coalesce(correct, false) AS ok, p.confidence FROM dc LEFT JOIN pred p ON dc.instance_id = p.instance_id AND dc.level = p.level)
SELECT count(*) AS n, round(avg((level IS NOT NULL)::INT), 9) AS coverage, round(avg((level IS NULL)::INT), 9) AS unanswered, round(avg(level), 9) AS mean_level, round(avg(ok::INT), 9) AS accuracy, round(avg(ok::INT) FILTER (level IS NOT NULL), 9) AS answered_accuracy,
 round(avg(confidence) FILTER (ok), 9) AS right_confidence, round(avg(confidence) FILTER (NOT ok AND level IS NOT NULL), 9) AS wrong_confidence FROM c"""))
def abstention_summary(spark, d):
    p = pred(spark, d)
    chosen = T.deepest_confident(p, 0.6).join(p.select("instance_id", "level", "confidence"), ["instance_id", "level"], "left")
    return rounded(E.abstention_summary(chosen), "coverage", "unanswered", "mean_level", "accuracy", "answered_accuracy", "right_confidence", "wrong_confidence")


SUBSET = ", s AS (SELECT 'full' AS subset, * FROM pred UNION ALL SELECT 'probe', * FROM pred WHERE instance_id % 3 = 0)"


@query(with_views("pred", SUBSET + """, c AS (SELECT subset, level, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT subset, level, label AS class, (label = prediction)::INT AS tp, 0 AS fp, (label <> prediction)::INT AS fn FROM s UNION ALL SELECT subset, level, prediction, 0, 1, 0 FROM s WHERE label <> prediction) GROUP BY ALL)
SELECT subset, level, round(m, 9) AS macro_f1, round(a, 9) AS micro_acc, n FROM (SELECT subset, level, avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS m FROM c WHERE tp + fn > 0 GROUP BY ALL) JOIN (SELECT subset, level, avg((label = prediction)::INT) AS a, count(*) AS n FROM s GROUP BY ALL) USING (subset, level)"""))
def subset_report(spark, d):
    names = F.when(F.col("instance_id") % 3 == 0, F.array(F.lit("full"), F.lit("probe"))).otherwise(F.array(F.lit("full")))
    return rounded(E.subset_report(pred(spark, d), names), "macro_f1", "micro_acc")


@query(with_views("pred", ", a AS (SELECT instance_id % 5 AS run, level, avg((label = prediction)::INT) AS m FROM pred GROUP BY ALL) SELECT level, round(max(m) - min(m), 9) AS spread, count(*) AS runs FROM a GROUP BY level"))
def metric_spread(spark, d):
    reports = E.micro_accuracy(pred(spark, d).withColumn("run", F.col("instance_id") % 5), ["run", "level"])
    return rounded(E.metric_spread(reports, "micro_acc"), "spread")


@query(with_views("pred", ", a AS (SELECT instance_id % 5 AS run, level, avg((label = prediction)::INT) AS m FROM pred GROUP BY ALL), s AS (SELECT level, max(m) - min(m) AS spread FROM a GROUP BY level) SELECT a.run, a.level, round(a.m - b.m, 9) AS delta, round(spread, 9) AS spread, abs(a.m - b.m) <= spread AS noise FROM a JOIN a b ON b.run = 0 AND a.level = b.level JOIN s ON s.level = a.level WHERE a.run > 0"))
def within_noise(spark, d):
    reports = E.micro_accuracy(pred(spark, d).withColumn("run", F.col("instance_id") % 5), ["run", "level"])
    base = reports.where("run = 0").select("level", F.col("micro_acc").alias("base"))
    deltas = reports.where("run > 0").join(base, "level").select("run", "level", (F.col("micro_acc") - F.col("base")).alias("delta"))
    return rounded(E.within_noise(deltas, E.metric_spread(reports, "micro_acc")), "delta", "spread")


@query(with_views("catalogue", ", c AS (SELECT country, mid, count(*) AS n FROM catalogue GROUP BY ALL) SELECT country, mid, n, CAST(row_number() OVER (PARTITION BY country ORDER BY n DESC, mid) AS INT) AS place FROM c QUALIFY place <= 3"))
def top_classes_by(spark, d):
    return E.top_classes_by(catalogue(spark, d), "country", "mid", 3)


@query(with_views("scores", "SELECT instance_id, class_idx, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, class_idx) AS INT) AS place FROM long QUALIFY place <= 3"))
def topk(spark, d):
    from ..operators.scores import to_long

    return rounded(T.topk(to_long(scores(spark, d)), 3), "score")


@query(with_views("scores", "SELECT instance_id, class_idx, round(score, 9) AS score FROM long QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, class_idx) = 1"))
def top1(spark, d):
    from ..operators.scores import to_long

    return rounded(T.top1(to_long(scores(spark, d))), "score")


GATE = ", q AS (SELECT quantile_cont(confidence, 0.7) AS cut FROM pred WHERE level = 0), kept AS (SELECT * FROM pred, q WHERE level = 0 AND confidence >= cut)\n"


@query(with_views("pred", GATE + "SELECT instance_id, prediction, confidence FROM kept"))
def gate_quantile(spark, d):
    return T.gate_quantile(pred(spark, d).where("level = 0"), 0.3).select("instance_id", "prediction", "confidence")


@query(with_views("pred", "SELECT instance_id, prediction, confidence FROM pred WHERE level = 0 QUALIFY row_number() OVER (PARTITION BY prediction ORDER BY confidence DESC, instance_id) <= 10"))
def gate_per_class(spark, d):
    return T.gate_per_class(pred(spark, d).where("level = 0"), 10).select("instance_id", "prediction", "confidence")


@query(with_views("pred", GATE + "SELECT stage, count(*) AS n, round(avg((label = prediction)::INT), 9) AS accuracy, count(DISTINCT prediction) AS classes, round(quantile_cont(confidence, 0.1), 9) AS p10, round(quantile_cont(confidence, 0.5), 9) AS p50, round(quantile_cont(confidence, 0.9), 9) AS p90, round(quantile_cont(confidence, 0.99), 9) AS p99 FROM (SELECT 'before' AS stage, label, prediction, confidence FROM pred WHERE level = 0 UNION ALL SELECT 'after', label, prediction, confidence FROM kept) GROUP BY stage"))
def gate_report(spark, d):
    p = pred(spark, d).where("level = 0")
    return rounded(T.gate_report(p, T.gate_quantile(p, 0.3)), "accuracy", "p10", "p50", "p90", "p99")


CHOOSE = ", sh AS (SELECT level, confidence, sum(count(*)) OVER w AS n, sum(sum((label = prediction)::INT)) OVER w AS g FROM pred GROUP BY level, confidence WINDOW w AS (PARTITION BY level ORDER BY confidence DESC)), th AS (SELECT level, min(confidence) FILTER (g >= 0.7 * n) AS threshold FROM sh GROUP BY level)\n"


@query(with_views("pred", CHOOSE + "SELECT level, threshold FROM th"))
def choose_threshold(spark, d):
    return T.choose_threshold(pred(spark, d), 0.7)


@query(with_views("pred", CHOOSE + "SELECT level, any_value(threshold) AS threshold, count(*) AS n, round(avg(coalesce(confidence >= threshold, false)::INT), 9) AS coverage, round(avg((label = prediction)::INT) FILTER (confidence >= threshold), 9) AS precision FROM pred JOIN th USING (level) GROUP BY level"))
def threshold_report(spark, d):
    p = pred(spark, d)
    return rounded(T.threshold_report(p, T.choose_threshold(p, 0.7)), "coverage", "precision")


CURVE = ", g AS (SELECT CAST(i AS INT) AS i FROM range(0, 101) r(i)), cv AS (SELECT level, i / 100.0::DOUBLE AS threshold, count(*) FILTER (CAST(floor(confidence::DECIMAL(20,10) * 100) AS INT) >= i) AS shown, count(*) FILTER (CAST(floor(confidence::DECIMAL(20,10) * 100) AS INT) >= i AND label = prediction) AS good, count(*) AS total FROM pred, g GROUP BY level, i)\n"


@query(with_views("pred", CURVE + "SELECT level, threshold, shown, round(good / nullif(shown, 0), 9) AS precision, round(shown / total, 9) AS coverage FROM cv"))
def precision_curve(spark, d):
    return rounded(T.precision_curve(pred(spark, d)), "precision", "coverage")


@query(with_views("pred", CURVE + "SELECT level, min(threshold) FILTER (good / nullif(shown, 0) >= 0.7) AS threshold FROM cv GROUP BY level"))
def curve_threshold(spark, d):
    return T.curve_threshold(T.precision_curve(pred(spark, d)), 0.7)


WIDE = ", wd AS (SELECT instance_id, " + ", ".join(f"max(confidence) FILTER (level = {n}) AS c{n}, bool_or(label = prediction) FILTER (level = {n}) AS k{n}" for n in range(3)) + " FROM pred GROUP BY 1)\n"


@query(with_views("pred", WIDE + ", r AS (SELECT CASE WHEN c0 >= 0.8 THEN 0 WHEN c1 >= 0.8 THEN 1 WHEN c2 >= 0.8 THEN 2 ELSE -1 END AS rank, k0, k1, k2 FROM wd) SELECT rank, count(*) AS n, round(avg((CASE rank WHEN 0 THEN k0 WHEN 1 THEN k1 WHEN 2 THEN k2 END)::INT), 9) AS precision, round(count(*) / (SELECT count(*) FROM wd), 9) AS coverage FROM r GROUP BY rank"))
def rank_cascade(spark, d):
    return rounded(T.rank_cascade(T.wide_by_level(pred(spark, d), [0, 1, 2]), [0, 1, 2], 0.8), "precision", "coverage")


@query(with_views("pred", WIDE + ", r AS (SELECT CASE WHEN c0 >= 0.8 THEN k0 WHEN c1 >= 0.8 THEN k1 WHEN c2 >= 0.8 THEN k2 END AS ok FROM wd) SELECT count(*) AS n, round(avg((ok IS NOT NULL)::INT), 9) AS answered, round(avg(ok::INT), 9) AS precision, round(avg(coalesce(ok, false)::INT), 9) AS useful FROM r"))
def cascade_rates(spark, d):
    return rounded(T.cascade_rates(T.wide_by_level(pred(spark, d), [0, 1, 2]), [0, 1, 2], 0.8), "answered", "precision", "useful")


def curve_on(n, rows):
    return f", u{n} AS (SELECT {n} AS level, min(t) AS threshold FROM (SELECT i / 100.0::DOUBLE AS t, count(*) AS shown, count(*) FILTER (label = prediction) AS good FROM {rows} x JOIN g ON CAST(floor(confidence::DECIMAL(20,10) * 100) AS INT) >= i GROUP BY i) WHERE good / shown >= 0.8)"


@query(with_views("pred", CURVE + ", l0 AS (SELECT * FROM pred WHERE level = 0)" + curve_on(0, "l0") + ", d0 AS (SELECT instance_id FROM l0, u0 WHERE coalesce(confidence < threshold, true)), l1 AS (SELECT * FROM pred WHERE level = 1 AND instance_id IN (SELECT instance_id FROM d0))" + curve_on(1, "l1") + ", d1 AS (SELECT instance_id FROM l1, u1 WHERE coalesce(confidence < threshold, true)), l2 AS (SELECT * FROM pred WHERE level = 2 AND instance_id IN (SELECT instance_id FROM d1))" + curve_on(2, "l2") + " SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u2"))
def conditional_thresholds(spark, d):
    return T.conditional_thresholds(pred(spark, d), [0, 1, 2], 0.8)


@query(with_views("pred", WIDE + "SELECT s AS step, CASE WHEN c0 >= s / 34 THEN 0 WHEN c1 >= 0.5 THEN 1 WHEN c2 >= 0.5 THEN 2 ELSE -1 END AS rank, count(*) AS n FROM wd, range(0, 35) r(s) GROUP BY ALL"))
def cascade_sweep(spark, d):
    return T.cascade_sweep(T.wide_by_level(pred(spark, d), [0, 1, 2]), [0, 1, 2], 34)


@query(with_views("pred", ", r AS (SELECT level, confidence, count(*) FILTER (label = prediction) AS pos, count(*) FILTER (label <> prediction) AS neg FROM pred GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY level ORDER BY confidence) - neg AS below FROM r) SELECT level, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c GROUP BY level"))
def auroc(spark, d):
    rows = pred(spark, d).select("level", F.col("confidence").alias("score"), (F.col("label") == F.col("prediction")).alias("positive"))
    return rounded(T.auroc(rows, ["level"]), "auroc")


@query("""WITH v AS (SELECT l_extendedprice AS score, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1), c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM v)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c""")
def auroc_of_prices(spark, d):
    """AUROC with about as many distinct scores as rows."""
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("score"), (F.col("l_returnflag") == "R").alias("positive"))
    return rounded(T.auroc(rows), "auroc")


@query(with_views("pred", COUNTS + """, r AS (SELECT level, confidence, count(*) FILTER (label = prediction) AS pos, count(*) FILTER (label <> prediction) AS neg FROM pred GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY level ORDER BY confidence) - neg AS below FROM r),
 a AS (SELECT level, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auroc FROM c GROUP BY level) SELECT level, round(m, 9) AS macro_f1, auroc, n FROM (SELECT level, avg(f1) AS m FROM f1 WHERE tp + fn > 0 GROUP BY 1) JOIN a USING (level) JOIN (SELECT level, count(*) AS n FROM pred GROUP BY 1) USING (level)"""))
def level_scores(spark, d):
    return rounded(T.level_scores(pred(spark, d)), "macro_f1", "auroc")


@query(with_views("pred", ", r AS (SELECT level, confidence, count(*) AS n, count(*) FILTER (label = prediction) AS hit FROM pred GROUP BY ALL) SELECT level, confidence AS threshold, round(sum(hit) OVER o / sum(n) OVER o, 9) AS precision, round(sum(hit) OVER o / sum(hit) OVER (PARTITION BY level), 9) AS recall FROM r WINDOW o AS (PARTITION BY level ORDER BY confidence DESC)"))
def precision_recall_points(spark, d):
    return rounded(T.precision_recall_points(pred(spark, d)), "precision", "recall")


@query("""WITH RECURSIVE log AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY x) AS n FROM (SELECT l_suppkey AS run_id, l_partkey AS x, avg(l_discount) AS y FROM lineitem GROUP BY ALL)),
 m AS (SELECT run_id, n, x, 0.1 * y AS m FROM log WHERE n = 1 UNION ALL SELECT log.run_id, log.n, log.x, 0.9 * m.m + 0.1 * log.y FROM m JOIN log ON log.run_id = m.run_id AND log.n = m.n + 1),
 s AS (SELECT run_id, x, m / (1 - pow(0.9, n)) AS y FROM m) SELECT run_id, max(x)::DOUBLE AS knee, max(x) * 0.75::DOUBLE AS recommended FROM s JOIN (SELECT run_id, min(y) AS least FROM s GROUP BY 1) USING (run_id) WHERE y <= least * 1.1 GROUP BY run_id""")
def knee_point(spark, d):
    log = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("x")).agg(F.avg("l_discount").alias("y"))
    return T.knee_point(log, 0.9, 1.1)


@query("""WITH log AS (SELECT l_discount::DOUBLE AS y, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_discount) - 1 AS n FROM lineitem),
 s AS (SELECT b.n, sum(0.01 * pow(0.99, b.n - a.n) * a.y) / (1 - pow(0.99, b.n + 1)) AS y FROM log b JOIN log a ON a.n BETWEEN b.n - 3999 AND b.n GROUP BY b.n) SELECT 1 AS run_id, max(n)::DOUBLE AS knee, max(n) * 0.75::DOUBLE AS recommended FROM s WHERE y <= (SELECT min(y) FROM s) * 1.2""")
def knee_point_long(spark, d):
    """All line items as a single run: its length grows with the table."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("y"))
    log = places(items, [], ["l_orderkey", "l_linenumber", "y"], "x").select(F.lit(1).alias("run_id"), "x", "y")
    return T.knee_point(log, 0.99, 1.2)


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS x, l_tax < 0.03 OR l_discount > 0.05 AS bad FROM lineitem), i AS (SELECT bad, sum((NOT bad)::INT) OVER (ORDER BY x) AS island FROM l)
SELECT 1 AS run_id, CAST(sum(n) AS BIGINT) AS skipped, max(n) >= 11 AS aborted FROM (SELECT island, count(*) FILTER (bad) AS n FROM i GROUP BY ALL)""")
def nonfinite_runs_long(spark, d):
    """All line items as a single run."""
    bad = (F.col("l_tax") < 0.03) | (F.col("l_discount") > 0.05)
    return T.nonfinite_runs(table(spark, d, "lineitem").select(F.lit(1).alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("x"), F.when(~bad, F.col("l_quantity")).alias("value")), 11)


@query("""WITH l AS (SELECT user_id AS run_id, event_id AS x, CASE WHEN event_id % 3 = 0 OR value > 60 THEN NULL ELSE value END AS value FROM events), i AS (SELECT run_id, value IS NULL AS bad, sum((value IS NOT NULL)::INT) OVER (PARTITION BY run_id ORDER BY x) AS island FROM l)
SELECT run_id, CAST(sum(n) AS BIGINT) AS skipped, max(n) >= 3 AS aborted FROM (SELECT run_id, island, count(*) FILTER (bad) AS n FROM i GROUP BY ALL) GROUP BY run_id""")
def nonfinite_runs(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("x"), F.when((F.col("event_id") % 3 == 0) | (F.col("value") > 60), F.lit(None)).otherwise(F.col("value")).alias("value"))
    return T.nonfinite_runs(log, 3)

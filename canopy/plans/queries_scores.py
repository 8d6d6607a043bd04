"""Queries of the score and embedding operators, and of the incremental counterparts in batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import scores as H
from ..operators.metrics import macro_f1
from ..streaming import streams
from .queries_metrics import COUNTS, rounded
from .queries_sampling import nights
from .registry import ORACLES, query
from .views import pred, scores, table, tree, with_views

SOFT = ", sm AS (SELECT *, max(score) OVER (PARTITION BY instance_id) AS mx FROM long), lp AS (SELECT instance_id, label_idx, class_idx, score, other, score - mx - ln(sum(exp(score - mx)) OVER (PARTITION BY instance_id)) AS logp FROM sm)\n"
UP = SOFT + ", up AS (SELECT instance_id, class_idx // 2 AS parent, ln(sum(exp(logp))) AS logq FROM lp GROUP BY ALL)\n"


def log_posteriors(spark, d):
    return H.to_long(scores(spark, d).withColumn("scores", A.log_softmax(F.col("scores"))))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first FROM embeddings")
def l2_normalise(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", A.l2_normalise(F.col("embedding")).alias("v"))
    return rounded(v.select("vec_id", A.dot(F.col("v"), F.col("v")).alias("norm"), F.get("v", F.lit(0)).alias("first")), "norm", "first", n=6)


CENT = """WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
 n AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e), cs AS (SELECT vec_id AS instance_id, n.label, c.label AS class_idx, sum(n.x * c.x) AS score FROM n JOIN c USING (i) GROUP BY ALL)
"""


@query(CENT + "SELECT label, CAST(i - 1 AS INT) AS d, round(x, 6) AS x FROM c")
def centroids(spark, d):
    return rounded(H.mean_centroids(table(spark, d, "embeddings")).select("label", F.posexplode("vector").alias("d", "x")), "x", n=6)


@query(CENT + "SELECT label, vec_id, round(score, 6) AS cosine FROM (SELECT label, instance_id AS vec_id, round(score, 9) AS score FROM cs WHERE label = class_idx) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1")
def medoids(spark, d):
    return rounded(H.medoids(table(spark, d, "embeddings"), "vec_id"), "cosine", n=6)


def prototypes(spark, d):
    return H.mean_centroids(table(spark, d, "embeddings")).withColumnRenamed("label", "class_idx")


def cosines(spark, d, mode="cosine", scale=1.0):
    return H.cosine_scores(table(spark, d, "embeddings"), prototypes(spark, d), "vec_id", mode=mode, scale=scale)


@query(CENT + "SELECT instance_id, class_idx, round(score, 6) AS score FROM cs")
def cosine_scores(spark, d):
    return rounded(cosines(spark, d), "score", n=6)


@query(CENT + "SELECT instance_id, class_idx, round(sqrt(62) * (acos(-score) - pi() / 2), 6) AS score FROM cs")
def angle_scores(spark, d):
    return rounded(cosines(spark, d, "angle"), "score", n=6)


@query(CENT + "SELECT instance_id, class_idx, round(score, 6) AS score FROM cs")
def score_arrays(spark, d):
    e = table(spark, d, "embeddings")
    rows = H.mean_centroids(e).orderBy("label").collect()  # one row a class
    classes = F.array(*(F.lit(r["label"]) for r in rows))
    long = H.to_long(H.score_arrays(e, np.array([r["vector"] for r in rows]), "vec_id"), keys=("vec_id",))
    return rounded(long.select(F.col("vec_id").alias("instance_id"), F.get(classes, F.col("class_idx")).alias("class_idx"), "score"), "score", n=6)


@query(CENT + "SELECT instance_id, class_idx, round(16 * score, 5) AS score FROM cs")
def scaled_scores(spark, d):
    return rounded(cosines(spark, d, "scaled", 16.0), "score", n=5)


@query(CENT + "SELECT label, class_idx, count(*) AS n FROM (SELECT label, class_idx FROM cs QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, class_idx) = 1) GROUP BY ALL")
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    best = H.nearest_centroid(e, prototypes(spark, d), "vec_id", numbers=256)
    return best.join(e.select(F.col("vec_id").alias("instance_id"), "label"), "instance_id").groupBy("label", "class_idx").agg(F.count("*").alias("n"))


@query(CENT + """, s AS (SELECT label, i, sum(x) AS x FROM n GROUP BY ALL), k AS (SELECT label, count(*) AS k FROM embeddings GROUP BY 1), dd AS (SELECT vec_id, n.label, s.label AS other, 1 - sum(n.x * s.x) / any_value(k) AS dist, any_value(k) AS k FROM n JOIN s USING (i) JOIN k ON k.label = s.label GROUP BY ALL),
 ab AS (SELECT vec_id, max(CASE WHEN k > 1 THEN dist * k / (k - 1) END) FILTER (label = other) AS a, min(dist) FILTER (label <> other) AS b FROM dd GROUP BY vec_id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM ab""")
def silhouette(spark, d):
    return spark.createDataFrame([(round(H.silhouette(table(spark, d, "embeddings")), 5),)], "silhouette double")


@query()
def spherical_means(spark, d):
    """How many vectors each of three means of a class is nearest to, after ten Lloyd steps."""
    e = H.finite_rows(table(spark, d, "embeddings"))
    means = H.spherical_means(e, 3, "vec_id")
    near = e.join(means, "label").groupBy("vec_id", "label").agg(F.max_by("k", F.struct(F.round(A.dot(F.col("embedding"), F.col("vector")), 6), -F.col("k"))).alias("k"))
    return near.groupBy("label", "k").agg(F.count("*").alias("n"))


@query(CENT + "SELECT label, round(avg(own), 6) AS own, round(avg(other), 6) AS other, round(avg(own - other), 6) AS margin FROM (SELECT instance_id, label, max(score) FILTER (class_idx = label) AS own, max(score) FILTER (class_idx <> label) AS other FROM cs GROUP BY ALL) GROUP BY label")
def embedding_geometry(spark, d):
    return rounded(H.embedding_geometry(table(spark, d, "embeddings"), prototypes(spark, d), "vec_id"), "own", "other", "margin", n=6)


@query(CENT + "SELECT instance_id, class_idx, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, class_idx) AS INT) AS place FROM cs QUALIFY place <= 3")
def top_scores(spark, d):
    return rounded(H.top_scores(table(spark, d, "embeddings"), prototypes(spark, d), "vec_id", 3), "score", n=6)


SUMS = CENT + ", w AS (SELECT label AS class_idx, i, sum(x) AS x FROM e GROUP BY ALL), ks AS (SELECT vec_id AS instance_id, n.label, class_idx, sum(n.x * w.x) AS score FROM n JOIN w USING (i) GROUP BY ALL)"


def class_sums(spark, d):
    """Prototypes whose lengths differ: the classes' sums."""
    dims = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(F.col("label").alias("class_idx")).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("class_idx", F.transform("v", lambda p: p["x"]).alias("vector"))


@query(SUMS + " SELECT instance_id, class_idx, round(score, 5) AS score FROM ks")
def kept_norm_scores(spark, d):
    """Scores against prototypes as they are, lengths included."""
    return rounded(H.cosine_scores(table(spark, d, "embeddings"), class_sums(spark, d), "vec_id", keep_norms=True), "score", n=5)


@query(SUMS + ", b AS (SELECT instance_id, arg_max(class_idx, (round(score, 9), -class_idx)) AS kept FROM ks GROUP BY 1), u AS (SELECT instance_id, arg_max(class_idx, (round(score, 9), -class_idx)) AS unit FROM cs GROUP BY 1) SELECT count(*) AS n, avg((kept = unit)::INT) AS agree FROM b JOIN u USING (instance_id)")
def kept_norm_agreement(spark, d):
    """How often the nearest prototype is the same with lengths as without."""
    e, w = table(spark, d, "embeddings"), class_sums(spark, d)
    kept = H.nearest_centroid(e, w, "vec_id", keep_norms=True).select("instance_id", F.col("class_idx").alias("kept"))
    both = kept.join(H.nearest_centroid(e, w, "vec_id"), "instance_id")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("kept") == F.col("class_idx")).cast("double")).alias("agree"))


@query(SUMS + ", l AS (SELECT class_idx, sqrt(sum(x * x)) AS x FROM w GROUP BY 1) SELECT round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(x), 6) AS mean, round(stddev(x), 6) AS deviation FROM l")
def prototype_norms(spark, d):
    return rounded(H.prototype_norms(class_sums(spark, d)), "least", "most", "mean", "deviation", n=6)


@query()
def spectrum(spark, d):
    """Singular values of the class centroids, with the share of energy up to each."""
    return H.spectrum(H.mean_centroids(table(spark, d, "embeddings")))


@query()
def spectrum_summary(spark, d):
    """Ranks for most of the energy, the participation ratio, and macro-F1 of the nearest centroid after truncation to a few ranks."""
    e, protos = table(spark, d, "embeddings"), prototypes(spark, d)
    found = H.spectrum_summary(H.spectrum(protos))
    truth, out = e.select(F.col("vec_id").alias("instance_id"), F.col("label").cast("string").alias("label"), F.lit(0).alias("level")), None
    axes = H.leading_axes(protos)
    for rank in (2, 4, 8):
        best = H.nearest_centroid(e, H.truncated(protos, rank, axes), "vec_id", keep_norms=True).select("instance_id", F.col("class_idx").cast("string").alias("prediction"))
        f1 = macro_f1(truth.join(best, "instance_id")).select(F.lit(rank).alias("rank"), "macro_f1")
        out = f1 if out is None else out.unionByName(f1)
    return out.crossJoin(F.broadcast(found))  # one row


@query()
def retrain_classifier(spark, d):
    """Held-out confusion of a logistic regression on frozen vectors."""
    e = table(spark, d, "embeddings")
    model = H.retrain_classifier(e.where("vec_id % 5 <> 0"), maxIter=20, regParam=0.01)
    from pyspark.ml.functions import array_to_vector

    shown = model.transform(e.where("vec_id % 5 = 0").withColumn("_x", array_to_vector(F.col("embedding").cast("array<double>"))))
    return shown.groupBy("label", F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


@query(with_views("scores", SOFT + "SELECT instance_id, class_idx, round(exp(logp), 6) AS score FROM lp"))
def softmax(spark, d):
    return rounded(H.to_long(scores(spark, d).withColumn("scores", A.softmax(F.col("scores")))), "score", n=6)


@query(with_views("scores", "SELECT instance_id, round(max(score) + ln(sum(exp(score - mx))), 6) AS lse FROM (SELECT *, max(score) OVER (PARTITION BY instance_id) AS mx FROM long) GROUP BY instance_id"))
def logsumexp(spark, d):
    return rounded(scores(spark, d).select("instance_id", A.logsumexp(F.col("scores")).alias("lse")), "lse", n=6)


@query(with_views("scores", SOFT + "SELECT instance_id // 2 AS instance_id, class_idx, round(avg(exp(logp)), 6) AS score FROM lp GROUP BY ALL"))
def average_views(spark, d):
    long = H.to_long(scores(spark, d).withColumn("scores", A.softmax(F.col("scores"))))
    return rounded(H.average_views(long.withColumn("instance_id", F.floor(F.col("instance_id") / 2))), "score", n=6)


@query(with_views("scores", SOFT + ", v AS (SELECT instance_id // 2 AS instance_id, class_idx, avg(exp(logp)) FILTER (instance_id % 2 = 0) AS p, avg(exp(logp)) FILTER (instance_id % 2 = 1) AS o FROM lp GROUP BY ALL) SELECT instance_id, class_idx, round(0.6 * p + 0.4 * coalesce(o, p), 6) AS score FROM v"))
def blended_views(spark, d):
    long = H.to_long(scores(spark, d).withColumn("scores", A.softmax(F.col("scores")))).withColumn("plain", F.col("instance_id") % 2 == 0)
    return rounded(H.average_views(long.withColumn("instance_id", F.floor(F.col("instance_id") / 2)), "plain", 0.4), "score", n=6)


@query(with_views("scores", UP + "SELECT instance_id, CAST(parent AS INT) AS class_idx, round(logq, 6) AS score FROM up"))
def marginalise(spark, d):
    return rounded(H.marginalise(log_posteriors(spark, d), tree(spark)), "score", n=6)


@query(with_views("scores", SOFT + ", pp AS (SELECT instance_id, class_idx AS parent, other AS up FROM long WHERE class_idx < 5), w AS (SELECT instance_id, class_idx, score, class_idx // 2 AS parent FROM long) SELECT w.instance_id, w.class_idx, round(w.score + up - ln(sum(exp(w.score)) OVER (PARTITION BY w.instance_id, w.parent)), 6) AS score FROM w JOIN pp ON w.instance_id = pp.instance_id AND w.parent = pp.parent"))
def condition_on_parent(spark, d):
    s = scores(spark, d)
    up = H.to_long(s.select("instance_id", F.slice("other", 1, 5).alias("scores")))
    return rounded(H.condition_on_parent(H.to_long(s), up, tree(spark)), "score", n=6)


LSE = ", gr AS (SELECT i AS t_idx, 0.25 * pow(32, i / 95.0) AS t FROM range(0, 96) r(i)), st AS (SELECT instance_id, label_idx, t_idx, t, max(score) / t + ln(sum(exp((score - mx) / t))) AS lse, max(score) AS top1, max(score) FILTER (class_idx = label_idx) AS tl FROM (SELECT *, max(score) OVER (PARTITION BY instance_id) AS mx FROM long), gr GROUP BY instance_id, label_idx, t_idx, t)\n"


@query(with_views("scores", LSE + "SELECT CAST(t_idx AS INT) AS t_idx, round(t, 6) AS temperature, round(avg(lse - tl / t), 6) AS nll FROM st GROUP BY ALL"))
def temperature_losses(spark, d):
    return rounded(H.temperature_losses(H.calibration_stats(scores(spark, d))), "temperature", "nll", n=6)


@query(with_views("scores", LSE + ", n AS (SELECT t, avg(lse - tl / t) AS nll FROM st GROUP BY t) SELECT round(arg_min(t, nll), 6) AS temperature, round(min(nll), 6) AS nll FROM n"))
def fit_temperature(spark, d):
    return rounded(H.fit_temperature(H.calibration_stats(scores(spark, d))), "temperature", "nll", n=6)


@query(with_views("scores", LSE + "SELECT instance_id, round(exp(top1 / t - lse), 6) AS confidence FROM st WHERE t_idx = 40"))
def calibrated_confidence(spark, d):
    return rounded(H.calibrated_confidence(H.calibration_stats(scores(spark, d)), 40).select("instance_id", "confidence"), "confidence", n=6)


NOVEL = SOFT + """, nv AS (SELECT instance_id, any_value(label_idx) AS label_idx, -max(score) AS "max", -(max(score) + ln(sum(exp(score - mx)))) AS energy, -max(exp(logp)) AS msp, -sum(exp(logp) * logp) AS entropy, -(max(score) - max(score) FILTER (rk = 2)) AS margin
 FROM (SELECT *, max(score) OVER (PARTITION BY instance_id) AS mx, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC) AS rk FROM lp) GROUP BY instance_id), nl AS (UNPIVOT nv ON "max", energy, msp, entropy, margin INTO NAME rule VALUE score)
"""


@query(with_views("scores", NOVEL + "SELECT instance_id, rule, round(score, 6) AS score FROM nl"))
def novelty_scores(spark, d):
    return rounded(H.novelty_scores(scores(spark, d).select("instance_id", "scores")), "score", n=6)


@query(with_views("scores", SOFT + "SELECT false AS normalised, count(DISTINCT instance_id) AS n FROM lp"))
def degenerate_rules(spark, d):
    return H.degenerate_rules(scores(spark, d))


OPENSET = NOVEL + """, r AS (SELECT rule, round(score, 5) AS score, CASE WHEN label_idx = 8 THEN 'near' WHEN label_idx = 9 THEN 'far' ELSE 'known' END AS stratum FROM nl), a AS (SELECT rule, score, stratum AS against, 1 AS pos FROM r WHERE stratum <> 'known' UNION ALL SELECT rule, score, 'all', 1 FROM r WHERE stratum <> 'known' UNION ALL SELECT rule, score, g.against, 0 FROM r, (VALUES ('near'), ('far'), ('all')) g(against) WHERE stratum = 'known'),
 v AS (SELECT rule, against, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM a GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY rule, against ORDER BY score) - neg AS below FROM v),
 au AS (SELECT rule, against, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c GROUP BY ALL)
"""


@query(with_views("scores", OPENSET + "SELECT rule, against, round(auroc, 4) AS auroc, n_pos, n_neg FROM au"))
def openset_report(spark, d):
    rows = H.novelty_scores(scores(spark, d).select("instance_id", "label_idx", "scores"))
    stratum = F.when(F.col("label_idx") == 8, "near").when(F.col("label_idx") == 9, "far").otherwise("known")
    return rounded(H.openset_report(rows.select("rule", F.round("score", 5).alias("score"), stratum.alias("stratum"))), "auroc", n=4)


@query("WITH a AS (" + with_views("scores", OPENSET + "SELECT rule, against, auroc FROM au") + "), m AS (" + with_views("scores", NOVEL + """, r AS (SELECT rule, round(score, 5) AS score, label_idx >= 8 AS novel FROM nl)
SELECT rule, max(score) > min(score) AS live, round(avg(score) FILTER (NOT novel), 5) AS known_mean, round(stddev(score) FILTER (NOT novel), 5) AS known_std, round(avg(score) FILTER (novel), 5) AS novel_mean, round(stddev(score) FILTER (novel), 5) AS novel_std FROM r GROUP BY rule""") + """)
SELECT m.*, round(a.auroc, 4) AS auroc, live AND a.auroc = (SELECT max(a.auroc) FROM m JOIN a USING (rule) WHERE against = 'all' AND live) AS best FROM m JOIN a USING (rule) WHERE against = 'all'""")
def openset_summary(spark, d):
    """The best rule is told by the AUROCs as they are; they are rounded for the report alone."""
    rows = H.novelty_scores(scores(spark, d).select("instance_id", "label_idx", "scores"))
    stratum = F.when(F.col("label_idx") == 8, "near").when(F.col("label_idx") == 9, "far").otherwise("known")
    found = H.openset_summary(rows.select("rule", F.round("score", 5).alias("score"), stratum.alias("stratum")))
    return rounded(rounded(found, "auroc", n=4), "known_mean", "known_std", "novel_mean", "novel_std", n=5)


@query(with_views("scores", "SELECT instance_id, class_idx, round(score + 0.5 * ln((class_idx + 1) / 55.0), 6) AS score FROM long"))
def adjust_logits(spark, d):
    prior = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.ln(i / 55.0))
    return rounded(H.to_long(H.adjust_logits(scores(spark, d), prior, 0.5)), "score", n=6)


@query(with_views("scores", "SELECT round(avg(lse - ((1 - ls) * tl + ls * mn)), 6) AS loss FROM (SELECT max(score) + ln(sum(exp(score - mx))) AS lse, max(score) FILTER (class_idx = label_idx) AS tl, avg(score) AS mn, 1 - pow(0.9, 1 / 2.0) AS ls FROM (SELECT *, max(score) OVER (PARTITION BY instance_id) AS mx FROM long) GROUP BY instance_id)"))
def level_log_loss(spark, d):
    return rounded(H.level_log_loss(scores(spark, d), 0.1, 1), "loss", n=6)


@query(with_views("scores", ", a AS (SELECT instance_id, score / 2 - ln(sum(exp(score / 2)) OVER w) AS s, other / 2 - ln(sum(exp(other / 2)) OVER w) AS t FROM long WINDOW w AS (PARTITION BY instance_id)) SELECT round(avg(k) * 4, 6) AS kl FROM (SELECT sum(exp(t) * (t - s)) AS k FROM a GROUP BY instance_id)"))
def posterior_kl(spark, d):
    return rounded(H.posterior_kl(scores(spark, d).withColumnsRenamed({"scores": "student", "other": "teacher"}), 2.0), "kl", n=6)


@query(with_views("scores", "SELECT round(avg((score >= 1.5)::INT), 6) AS all_scores, (SELECT round(avg((m >= 1.5)::INT), 6) FROM (SELECT max(score) AS m FROM long GROUP BY instance_id)) AS top1, (SELECT round(avg((k >= 2)::INT), 6) FROM (SELECT count(*) FILTER (score >= 1.5) AS k FROM long GROUP BY instance_id)) AS several FROM long"))
def saturation_rates(spark, d):
    return rounded(H.saturation_rates(scores(spark, d), 1.5), "all_scores", "top1", "several", n=6)


@query(with_views("scores", ", t AS (SELECT max(score) AS m FROM long GROUP BY instance_id) SELECT " + ", ".join(f"round(quantile_cont(m, {q}), 6) AS q{n}" for n, q in enumerate((0.5, 0.9, 0.99))) + " FROM t"))
def top1_quantiles(spark, d):
    return rounded(H.top1_quantiles(scores(spark, d)), "q0", "q1", "q2", n=6)


@query(with_views("scores", "SELECT instance_id, CASE WHEN class_idx < 6 THEN 0 WHEN class_idx < 9 THEN 1 ELSE 2 END AS level, class_idx, round(score, 6) AS score FROM long QUALIFY row_number() OVER (PARTITION BY instance_id, level ORDER BY score DESC, class_idx) = 1"))
def split_levels(spark, d):
    return rounded(H.split_levels(scores(spark, d), [0] * 6 + [1] * 3 + [2]), "score", n=6)


@query(with_views("scores", "SELECT instance_id, CAST(class_idx AS INT) AS class_idx, round(score, 6) AS score FROM long QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, class_idx) = 1"))
def score_table(spark, d):
    def model(frame):
        z = np.stack(frame["scores"].to_numpy()) if len(frame) else np.empty((0, 10))
        return z.argmax(1), z.max(1, initial=-np.inf)

    return rounded(H.score_table(scores(spark, d), model, "instance_id", ["scores"]), "score", n=6)


@query(with_views("pred", COUNTS + "SELECT level, class, tp, fp, fn FROM cc"))
def stream_confusion_batch(spark, d):
    return streams.stream_confusion(pred(spark, d))


@query(with_views("captures", "SELECT trap, CAST(night AS VARCHAR) AS night, count(*) AS n FROM nights GROUP BY ALL"))
def stream_nights_batch(spark, d):
    return streams.stream_nights(nights(spark, d).select("event_id", "trap", "ts")).withColumn("night", F.col("night").cast("string"))


@query("SELECT label, CAST(i - 1 AS INT) AS d, round(sum(CAST(embedding[i] AS DOUBLE)), 6) AS total, count(*) AS n FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def stream_centroids_batch(spark, d):
    return rounded(streams.stream_centroid_sums(table(spark, d, "embeddings")), "total", n=6)


@query(CENT + "SELECT label, CAST(i - 1 AS INT) AS d, round(x, 6) AS x FROM c")
def stream_centroids_finish(spark, d):
    return rounded(streams.stream_centroids(streams.stream_centroid_sums(table(spark, d, "embeddings"))).select("label", F.posexplode("vector").alias("d", "x")), "x", n=6)

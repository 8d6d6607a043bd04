"""Hand-made frames: counterexamples, ties, guards, streams against batch, and sources."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.functions import arrays as A
from canopy.functions.ordering import hash_order, hash_place, prefix_sum, quantiles
from canopy.operators import catalogue as C
from canopy.operators import ledger as L
from canopy.operators import metrics as E
from canopy.operators import sampling as S
from canopy.operators import scores as H
from canopy.operators import thresholds as T
from canopy.plans import views
from canopy.sources import files
from canopy.streaming import streams
from tests.conftest import SF

TREE = ["species", "genus", "family"]


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(f"{s}_{k}.jpg", str(1000 + s), str(100 + s // 2), str(10 + s // 4), str(k % 4)) for s in range(6) for k in range(10)]
    rows += [("n.jpg", None, "100", "10", None), ("one.jpg", "2000", "103", "12", "1")]
    return spark.createDataFrame(rows, "filename string, species string, genus string, family string, set string")


def test_null_folds_stay_and_floor_counts_what_remains(shelf):
    kept = C.filter_catalogue(shelf, TREE, remove_in=["0"])
    assert kept.where("set is null").count() == 1
    assert C.filter_catalogue(shelf, TREE, remove_in=["0"], min_count=2).where("species = '2000' or species is null").count() == 0


def test_vocabulary_is_in_string_order(spark):
    df = spark.createDataFrame([("9",), ("10",)], "species string")
    assert [(r["class"], r["idx"]) for r in C.build_vocab(df, ["species"]).orderBy("idx").collect()] == [("10", 0), ("9", 1)]


def test_nested_hierarchies_of_any_depth(spark):
    rows = [(f"s{i}", f"g{i // 2}", f"f{i // 4}", f"o{i // 8}") for i in range(16)]
    names = ["s", "g", "f", "o"]
    for n in (2, 3, 4):
        hier = spark.createDataFrame(rows, names).select(*names[:n]).distinct()
        assert C.hierarchy_from_nested(C.hierarchy_nested(hier, names[:n]), names[:n]).exceptAll(hier).count() == 0


def test_conflicting_parents_raise(spark):
    hier = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("b", "g1")], "species string, genus string")
    vocab = C.build_vocab(hier, ["species", "genus"])
    with pytest.raises(ValueError):
        C.parent_map(hier, vocab, ["species", "genus"], strict=True)


def pred_of(spark, rows):
    return spark.createDataFrame(rows, "instance_id long, level int, label string, prediction string, confidence double")


def test_macro_f1_counts_classes_present_in_truth(spark):
    right = [(i, 0, x, x, 0.9) for i, x in enumerate("abca")]
    assert E.macro_f1(pred_of(spark, right)).first().macro_f1 == 1.0
    wrong = [(i, 0, x, y, 0.9) for i, (x, y) in enumerate(zip("abca", "bcab", strict=True))]
    assert E.macro_f1(pred_of(spark, wrong)).first().macro_f1 == 0.0


@pytest.mark.parametrize("rows, wanted", [
    ([(0.95, 1), (0.90, 1), (0.85, 1), (0.80, 1), (0.20, 0)], 0.80),
    ([(0.9, 0), (0.8, 1), (0.7, 0), (0.6, 1)], None),
    ([(0.9, 1), (0.8, 1), (0.8, 0)], 0.9),
])
def test_threshold_never_cuts_a_tie(spark, rows, wanted):
    df = pred_of(spark, [(i, 0, "a", "a" if ok else "b", c) for i, (c, ok) in enumerate(rows)])
    assert T.choose_threshold(df, 0.95).first().threshold == wanted


def test_auroc_ties_count_half_and_empty_side_is_null(spark):
    df = lambda rows: spark.createDataFrame(rows, "score double, positive boolean")
    assert T.auroc(df([(1.0, False), (2.0, False), (3.0, False), (4.0, True), (5.0, True)])).first().auroc == 1.0
    assert T.auroc(df([(1.0, True), (1.0, False)])).first().auroc == 0.5
    assert T.auroc(df([(1.0, True)])).first().auroc is None


def test_prefix_sum_is_the_same_for_any_partitioning(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") % 17).alias("o"), F.lit(1).alias("n"))
    one, many = (sorted(map(tuple, prefix_sum(df, ["k"], "o", ["n"], parts=p).collect())) for p in (1, 13))
    assert one == many
    assert max(r[3] for r in one if r[0] == 0) == 167


@pytest.fixture(scope="module")
def prices(spark):
    """About as many distinct values as rows, and which rows are positive."""
    return spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("score"), (F.col("l_returnflag") == "R").alias("positive"))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_auroc_of_half_a_million_scores(spark, prices, reuse):
    known = prices.toPandas()
    values, where = np.unique(known["score"], return_inverse=True)
    pos, neg = np.bincount(where, known["positive"]), np.bincount(where, ~known["positive"])
    exact = (pos * (np.cumsum(neg) - neg + neg / 2)).sum() / (pos.sum() * neg.sum())
    assert len(values) > 500_000
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        assert [T.auroc(prices).first().auroc for _ in range(3)] == [pytest.approx(exact, abs=1e-12)] * 3
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_running_totals_of_many_values(prices):
    known = prices.toPandas()
    values, where = np.unique(known["score"], return_inverse=True)
    wanted = np.cumsum(np.bincount(where))
    got = prefix_sum(prices.select("score", F.lit(1).alias("n"), F.lit(0).alias("_")), ["_"], "score", ["n"]).select("score", "cum_n").toPandas().sort_values("score")
    assert (got["score"].to_numpy() == values).all() and (got["cum_n"].to_numpy() == wanted).all()


def test_running_totals_with_nulls(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, None, 3), ("a", 2.0, 5), ("a", None, 7)], "k string, o double, n long")
    up = {(r.k, r.o): r.cum_n for r in prefix_sum(df, ["k"], "o", ["n"], parts=4).collect()}
    down = {(r.k, r.o): r.cum_n for r in prefix_sum(df, ["k"], "o", ["n"], descending=True, parts=4).collect()}
    assert up == {(None, None): 3, (None, 1.0): 5, ("a", None): 7, ("a", 2.0): 12}
    assert down == {(None, 1.0): 2, (None, None): 5, ("a", 2.0): 5, ("a", None): 12}


def test_exact_quantiles(spark, prices):
    shares = [0.0, 0.1, 0.5, 0.999, 1.0]
    assert list(quantiles(prices, "score", shares).first()) == pytest.approx(list(np.quantile(prices.toPandas()["score"], shares)))
    assert list(quantiles(prices.limit(0), "score", [0.5]).first()) == [None]


def test_places_by_hash_equal_one_window(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("k"))
    wanted = df.withColumn("_place", F.row_number().over(Window.partitionBy("k").orderBy(*hash_order("id", 5))))
    assert hash_place(df, ["k"], "id", 5).exceptAll(wanted).count() == 0
    every = df.withColumn("_place", F.row_number().over(Window.orderBy(*hash_order("id"))))
    assert hash_place(df, [], "id").exceptAll(every).count() == 0


def test_marginals_sum_to_one_and_need_not_agree_with_the_top_leaf(spark):
    rows = [(0, i, math.log(p)) for i, p in enumerate([0.40, 0.12, 0.12, 0.12, 0.12, 0.12])]
    scores = spark.createDataFrame(rows, "instance_id long, class_idx int, score double")
    parents = spark.createDataFrame([(i, int(i > 0)) for i in range(6)], "child_idx int, parent_idx int")
    up = {r.class_idx: math.exp(r.score) for r in H.marginalise(scores, parents).collect()}
    assert up == pytest.approx({0: 0.4, 1: 0.6})


def test_temperature_recovers_overconfidence(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 40))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    rows = [(i, [float(x) for x in 3 * z[i]], int(rng.choice(40, p=p[i]))) for i in range(400)]
    df = spark.createDataFrame(rows, "instance_id long, scores array<double>, label_idx int")
    assert 2.0 < H.fit_temperature(H.calibration_stats(df)).first().temperature < 4.5


def test_angle_scores_invert(spark):
    row = spark.range(1).select(A.angle_cosine(A.angle_score(F.lit(0.3), 64), 64).alias("c")).first()
    assert row.c == pytest.approx(0.3)


def test_capture_names_and_nights(spark):
    path = "Some/crop_TRAPNAME_LV3_IMAGENAME_{}-88-snapshot_CROPNUMBER_5.jpg"
    df = spark.createDataFrame([(path.format(t),) for t in ("20220811015000", "20220810220000", "20220811130000")] + [("odd.jpg",)], "path string")
    out = S.assign_night(S.parse_capture(df, "path"))
    assert [str(r.night) for r in out.where("parsed").orderBy("ts").collect()] == ["2022-08-10", "2022-08-10", "2022-08-11"]
    assert out.where("not parsed").count() == 1


def test_guards_raise(spark, shelf):
    with pytest.raises(ValueError):
        C.attach_groups(shelf, spark.createDataFrame([("1000", 1)], "species string, g int"), "species")
    with pytest.raises(ValueError):
        S.combine_pseudo(shelf, shelf.where("set = '1'"), shelf.select(*TREE).distinct(), TREE, 1, 0.5)


def test_holdout_guards(spark, shelf):
    known = shelf.where("species is not null")
    held = S.pick_holdout(known, TREE, 1, 1, 1, 2)
    kept = S.apply_holdout(known, held, TREE)
    wide, tight = ({r.check: r.ok for r in S.check_holdout(known, kept, TREE, most).collect()} for most in (1.0, 0.0))
    assert wide["rows_removed"] and not tight["rows_removed"]
    assert S.pick_holdout(known, TREE, 1, 0, 0, 2, most_rows=1).count() == 0
    assert S.pick_holdout(known, TREE, 1, 0, 0, 2, least_leaves=99).count() == 0
    novel = S.stratify_novelty(known, kept, TREE)
    with pytest.raises(ValueError):
        S.restrict_novel(novel, known.select("species").distinct(), "species", most_known=0.1)
    assert S.restrict_novel(novel, known.select("species").distinct(), "species", most_known=1.0).count() == known.count()


def test_negatives_fill_the_budget(spark):
    hier = spark.createDataFrame([(f"c{i}", f"p{i // 5}") for i in range(50)], "leaf string, parent string")
    batch = spark.createDataFrame([(b, f"c{(b * 7 + k) % 50}") for b in range(30) for k in range(1 + b % 12)], "batch_id long, leaf string")
    rows = S.sample_negatives(batch, hier, "leaf", "parent", 8).collect()
    positive = {(r.batch_id, r.leaf) for r in batch.collect()}
    assert positive <= {(r.batch_id, r.leaf) for r in rows} and all((r.rank == 0) == ((r.batch_id, r.leaf) in positive) for r in rows)
    parents = {b: {f"p{int(x[1:]) // 5}" for c, x in positive if c == b} for b in range(30)}
    assert all((r.rank < 2) == (f"p{int(r.leaf[1:]) // 5}" in parents[r.batch_id]) for r in rows)
    n, own = Counter(r.batch_id for r in rows), Counter(b for b, _ in positive)
    assert all(n[b] == max(8, own[b]) for b in own)


def test_scores_by_blocks_are_the_scores(spark):
    rng = np.random.default_rng(1)
    x, protos = rng.normal(size=(40, 6)), rng.normal(size=(9, 6))
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    table = spark.createDataFrame([(10 + i, v.tolist()) for i, v in enumerate(protos)], "class_idx int, vector array<double>")
    cosine = x / np.linalg.norm(x, axis=1, keepdims=True) @ protos.T
    for numbers in (12, 10_000):
        got = {(r.instance_id, r.class_idx): r.score for r in H.cosine_scores(emb, table, "id", mode="scaled", scale=3.0, numbers=numbers).collect()}
        assert got == {(i, 10 + k): pytest.approx(3 * cosine[i, k]) for i in range(40) for k in range(9)}
        assert {r.instance_id: r.class_idx for r in H.nearest_centroid(emb, table, "id", numbers=numbers).collect()} == {i: 10 + int(cosine[i].argmax()) for i in range(40)}
        assert all(np.allclose(r.scores, cosine[r.id]) for r in H.score_arrays(emb, protos, "id", numbers=numbers).collect())
    H.MODES["squared"] = lambda c, dims, scale: c**2
    try:
        assert min(r.score for r in H.cosine_scores(emb, table, "id", mode="squared").collect()) >= 0
    finally:
        del H.MODES["squared"]


def test_spherical_means_and_spectrum_agree_with_numpy(spark):
    import hashlib

    rng = np.random.default_rng(3)
    x = {i: v / np.linalg.norm(v) for i, v in enumerate(rng.normal(size=(60, 5)) + 2 * np.repeat(np.eye(5)[:3], 20, 0))}
    emb = spark.createDataFrame([(i, "a" if i < 50 else "b", v.tolist()) for i, v in x.items()], "id long, label string, embedding array<double>")
    got = {(r.label, r.k): np.array(r.vector) for r in H.spherical_means(emb, 3, "id", steps=4).collect()}
    for label, ids in (("a", range(50)), ("b", range(50, 60))):
        first = sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:3]
        means = {k: x[i] for k, i in enumerate(first)}
        for _ in range(4):
            near = {i: max(means, key=lambda k: (round(float(x[i] @ means[k]), 9), -k)) for i in ids}
            means = {k: sum(x[i] for i in ids if near[i] == k) for k in means if k in near.values()}
            means = {k: v / np.linalg.norm(v) for k, v in means.items()}
        assert {k: v for (l, k), v in got.items() if l == label}.keys() == means.keys()
        assert all(np.allclose(got[label, k], v) for k, v in means.items())
    table = emb.select(F.col("id").cast("int").alias("class_idx"), F.col("embedding").alias("vector"))
    s = np.linalg.svd(np.array([x[i] for i in range(60)]), compute_uv=False)
    found = H.spectrum(table)
    assert [r.value for r in found.orderBy("rank").collect()] == pytest.approx(list(s))
    share = np.cumsum(s**2) / (s**2).sum()
    row = H.spectrum_summary(found).first()
    assert (row.rank_90, row.rank_99) == (int((share >= 0.9).argmax()) + 1, int((share >= 0.99).argmax()) + 1) and row.participation == pytest.approx(s.sum() ** 2 / (s**2).sum())
    low = np.array([r.vector for r in H.truncated(table, 2).orderBy("class_idx").collect()])
    assert np.linalg.matrix_rank(low) == 2


def test_spherical_means_of_tasks_without_rows_and_odd_vectors(spark):
    rows = [(i, "ab"[i % 2], [float(i % 5), 1.0, float(i % 3)]) for i in range(20)]
    odd = [(90, "a", None), (91, "b", [1.0, None, 2.0]), (92, "a", [float("nan"), 1.0, 1.0]), (93, "b", [float("inf"), 1.0, 1.0]), (94, None, [1.0, 1.0, 1.0])]
    kinds = "id long, label string, embedding array<double>"
    means = lambda r: {(m.label, m.k): m.vector for m in H.spherical_means(r, 2, "id", steps=3).collect()}
    wanted = means(spark.createDataFrame(rows, kinds).coalesce(1))
    got = means(spark.createDataFrame(rows + odd, kinds).repartition(16, "label"))  # most of its tasks have no rows
    assert got.keys() == wanted.keys() and all(np.allclose(got[x], wanted[x]) for x in wanted)


def test_retrained_classifier_is_right_on_held_out_vectors(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.normal(size=6) + 4 * np.eye(6)[i % 3]).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    model = H.retrain_classifier(df.where("id < 200"), maxIter=20)
    shown = model.transform(df.where("id >= 200").withColumn("_x", array_to_vector("embedding")))
    assert shown.where("label = prediction").count() > 95


def test_configurations_of_any_depth(spark):
    runs = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": "x", "e": 2}}, "f": null}, "g": "{odd"}'), (2, "{}"), (3, '{"a": {}}')], "run_id long, config string")
    got = {(r.run_id, r.key): r.value for r in L.flatten_config(runs).collect()}
    assert got == {(1, "a.b.c.d"): "x", (1, "a.b.c.e"): "2", (1, "a.f"): None, (1, "g"): "{odd", (3, "a"): "{}"}
    deep = spark.createDataFrame([(None, '{"a":' * 200 + "1.50" + "}" * 200), (4, '{"x": [1, {"y": "é"}], "s": "{\\"q\\": 1}", "b": true, "f": 1e-3}'), (5, "[1]"), (6, "odd"), (7, None)], "run_id long, config string")
    got = {(r.run_id, r.key): r.value for r in L.flatten_config(deep).collect()}
    assert got == {(None, ".".join("a" * 200)): "1.50", (4, "x"): '[1,{"y":"é"}]', (4, "s"): '{"q": 1}', (4, "b"): "true", (4, "f"): "1e-3"}


def test_chain_of_runs_agrees_with_a_loop(spark):
    rng = np.random.default_rng(6)
    at = {i: int(rng.integers(0, 20)) for i in range(60)}
    flat = {(i, k): str(rng.integers(0, 3)) for i in at for k in "abc" if rng.random() < 0.7}
    runs = spark.createDataFrame([(i, k, v) for (i, k), v in flat.items()], "run_id long, key string, value string")
    order = spark.createDataFrame(list(at.items()), "run_id long, at long")
    got = {(r.run_id, r.key): (r.value, r.before) for r in L.config_chain(runs, order).collect()}
    line = sorted(at, key=lambda i: (at[i], i))
    pairs = {(b, k): (flat.get((b, k)), flat.get((a, k))) for a, b in zip(line, line[1:], strict=False) for k in "abc"}
    assert got == {x: v for x, v in pairs.items() if v[0] != v[1]}


def test_prefixes_collapse(spark):
    delta = spark.createDataFrame([(1, f"m.opt.{k}", "changed", k, "0") for k in "abc"] + [(1, "m.lr", "changed", "2", "1"), (1, "x", "changed", "1", "0"), (1, "y", "changed", "1", "0"), (1, "z", "changed", "1", "0")], "run_id long, key string, change string, value string, base string")
    assert L.format_delta(delta).first().text == "lr=2, m.opt.*(3), x=1, y=1, z=1"


def test_evaluations_meet_whole_folders_only(spark):
    runs = spark.createDataFrame([("r1",), ("x/r2/",)], "run_dir string")
    evals = spark.createDataFrame([("/o/r1/m", "e1", 0.1), ("/o/r1/m", "e2", 0.2), ("/o/r11/m", "e9", 0.9), ("/o/x/r2/k/m", "e3", 0.3), ("/o/r2/m", "e4", 0.4)], "model_path string, eval_name string, test_f1 double")
    assert {tuple(r) for r in C.join_evals(runs, evals).collect()} == {("r1", "e2", 0.2), ("x/r2/", "e3", 0.3)}


def test_resample_has_exactly_n_rows(shelf):
    assert S.weighted_resample(shelf.where("species is not null"), "species", 0.5, 137, "filename").count() == 137


def test_streams_equal_batch(spark, tmp_path):
    pred = views.pred(spark, SF)
    pred.repartition(3).write.parquet(str(tmp_path / "pred"))
    stream = spark.readStream.schema(pred.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pred"))
    table = streams.run_once(streams.stream_confusion(stream), "confusion", str(tmp_path / "c1"))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, E.confusion_counts(pred).select("level", "class", "tp", "fp", "fn").collect()))
    night = views.captures(spark, SF).select("event_id", F.col("class").alias("trap"), F.col("ts").cast("timestamp").alias("ts"))
    night.repartition(1).write.parquet(str(tmp_path / "night"))
    seen = streams.stream_nights(spark.readStream.schema(night.schema).parquet(str(tmp_path / "night")))
    assert streams.run_once(seen, "nights", str(tmp_path / "c2"), "update").agg(F.sum("n")).first()[0] == night.count()
    emb = views.table(spark, SF, "embeddings")
    sums = streams.stream_centroid_sums(spark.readStream.schema(emb.schema).parquet(_copy(emb, tmp_path)))
    means = {r.label: r.vector for r in streams.stream_centroids(streams.run_once(sums, "sums", str(tmp_path / "c3"))).collect()}
    assert means == {r.label: pytest.approx(r.vector) for r in H.mean_centroids(emb).collect()}
    streams.stream_macro_f1(stream, str(tmp_path / "f1"), str(tmp_path / "c4")).awaitTermination()
    last = max((tmp_path / "f1").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert {r.level: r.macro_f1 for r in spark.read.parquet(str(last)).collect()} == {r.level: pytest.approx(r.macro_f1) for r in E.macro_f1(pred).collect()}


def test_late_rows_go(spark, tmp_path):
    """Rows over two days behind the newest of earlier batches are dropped; less late and repeated ones are dealt with."""
    kind, source = "event_id long, trap string, ts string", str(tmp_path / "in")
    days = [[(1, "t", "2024-05-01 13:00:00"), (2, "t", "2024-05-10 13:00:00")], [(4, "t", "2024-05-09 13:00:00"), (4, "t", "2024-05-09 13:00:00")], [(3, "t", "2024-05-01 14:00:00"), (5, "t", "2024-05-20 13:00:00")]]
    for rows in days:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = streams.stream_nights(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source))
    table = streams.run_once(stream, "late", str(tmp_path / "c"), "append")
    assert {str(r.night): r.n for r in table.collect()} == {"2024-05-01": 1, "2024-05-09": 1, "2024-05-10": 1}


def _copy(df, tmp_path):
    df.write.parquet(str(tmp_path / "emb"))
    return str(tmp_path / "emb")


def test_sources(spark, tmp_path):
    pred = views.pred(spark, SF).withColumns({"threshold": F.lit(0.5), "known_label": F.lit(True)})
    files.write_predictions(pred, str(tmp_path / "p"))
    assert files.read_predictions(spark, str(tmp_path / "p")).count() == pred.count()
    cat = views.catalogue(spark, SF)
    a = files.prepared_cache(cat, "orders", {"min": 1}, str(tmp_path / "cache"))
    assert files.prepared_cache(cat.limit(0), "orders", {"min": 1}, str(tmp_path / "cache")).count() == a.count() == cat.count()
    files.write_report(cat.groupBy("top").count(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 5
    cat.write.parquet(str(tmp_path / "x/one"))
    cat.drop("country").write.parquet(str(tmp_path / "x/two"))
    assert files.read_union(spark, [str(tmp_path / "x/one"), str(tmp_path / "x/two")]).count() == 2 * cat.count()
    assert files.catalogue_from_listing(spark, str(tmp_path / "x"), "*.parquet").where("class_folder = 'one'").count() > 0
    (tmp_path / "runs/0001-base-a").mkdir(parents=True)
    (tmp_path / "runs/0001-base-a/config.json").write_text('{"model": {"lr": "0.1"}, "seed": "3"}')
    assert files.read_runs(spark, str(tmp_path / "runs")).first().run_id == "0001-base"
    assert files.read_catalogue(spark, f"{SF}/orders.parquet", ["o_orderkey"]).columns == ["o_orderkey"]

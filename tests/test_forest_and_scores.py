"""Edge-list hierarchies, batch reductions of scores, precision/recall points, stateful centroids, manifests."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import catalogue as C
from canopy.operators import forest as G
from canopy.operators import ledger as K
from canopy.operators import scores as H
from canopy.operators import thresholds as T
from canopy.streaming import streams

EDGES = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "d"), ("a", None), ('q"x', "z"), ("b", "a"), (None, "a"), ("lone", None)]


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_forest_of_any_depth(spark):
    df = spark.createDataFrame(EDGES, "child string, parent string")
    assert plain(G.ancestors(df)) == [("b", "a", 1), ("c", "a", 1), ("d", "a", 2), ("d", "b", 1), ("e", "a", 3), ("e", "b", 2), ("e", "d", 1), ('q"x', "z", 1)]
    assert plain(G.depths(df)) == sorted([("a", 0, "a"), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "a"), ("e", 3, "a"), ("lone", 0, "lone"), ('q"x', 1, "z"), ("z", 0, "z")], key=str)
    assert [r.node for r in G.flat_list(df).orderBy("position").collect()] == ["a", "lone", "z", "b", "c", "d", "e", 'q"x']
    assert {r.root: json.loads(r.document) for r in G.documents(df).collect()} == {"a": {"a": {"b": {"d": {"e": {}}}, "c": {}}}, "lone": {"lone": {}}, "z": {"z": {'q"x': {}}}}
    assert plain(G.descendants(df, spark.createDataFrame([("b",), ("none",)], "taxon string"))) == [("b", "b", 0), ("b", "d", 1), ("b", "e", 2)]
    assert {r.node: r.height for r in G.heights(df).collect()} == {"a": 3, "b": 2, "c": 0, "d": 1, "e": 0, "lone": 0, "z": 1, 'q"x': 0}
    assert G.cycles(df).count() == 0 and G.ancestors(df.limit(0)).count() == 0 and G.depths(df.limit(0)).count() == 0


def test_forest_conflicts_and_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("s", "s"), ("x", "y")], "child string, parent string")
    assert plain(G.cycles(df)) == [("a",), ("b",), ("c",), ("s",)]
    assert {r.node: r.depth for r in G.depths(df).collect()} == {"a": None, "b": None, "c": None, "d": None, "s": None, "x": 1, "y": 0}
    with pytest.raises(ValueError):
        G.ancestors(df)
    two = spark.createDataFrame([("a", "b"), ("a", "c")], "child string, parent string")
    assert plain(G.conflicts(two)) == [("a", 2)]
    with pytest.raises(ValueError):
        G.ancestors(two)


def test_deep_chains(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    assert G.ancestors(chain).count() == 199 * 200 // 2
    assert {r.node: (r.depth, r.root) for r in G.depths(chain).collect()} == {str(n): (n, "0") for n in range(200)}


def test_batch_reductions_equal_all_scores(spark):
    rng = np.random.default_rng(8)
    x, protos = rng.normal(size=(70, 5)), 3 * rng.normal(size=(8, 5))
    labels = rng.integers(0, 10, 70)  # two classes have no prototype
    emb = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))] + [(99, None, [1.0] * 5)], "id long, label int, embedding array<double>")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(protos)], "class_idx int, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    raw, cosine = unit @ protos.T, unit @ (protos / np.linalg.norm(protos, axis=1, keepdims=True)).T
    for numbers in (12, 10_000):
        for kept, all_ in ((True, raw), (False, cosine)):
            got = H.top_scores(emb.where("label is not null"), table, "id", 3, numbers=numbers, keep_norms=kept).collect()
            assert {(r.instance_id, r.place): (r.class_idx, pytest.approx(r.score)) for r in got} == {(i, p + 1): (int(c), all_[i, c]) for i in range(70) for p, c in enumerate(np.argsort(-all_[i])[:3])}
        found = {r.label: (r.own, r.other, r.margin) for r in H.embedding_geometry(emb, table, "id", numbers=numbers).collect()}
        for c in set(labels.tolist()):
            rows = np.flatnonzero(labels == c)
            other = np.delete(cosine[rows], c, 1).max(1) if c < 8 else cosine[rows].max(1)
            own = cosine[rows, c] if c < 8 else None
            assert found[c] == ((pytest.approx(own.mean()), pytest.approx(other.mean()), pytest.approx((own - other).mean())) if c < 8 else (None, pytest.approx(other.mean()), None))
    plan = H.embedding_geometry(emb, table, "id")._jdf.queryExecution().toString()
    assert "posexplode" not in plan.lower()


def test_wide_spectrum_and_truncation(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 1280)) @ np.diag(np.linspace(2, 0.01, 1280))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "class_idx int, vector array<double>").repartition(5)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert [r.value for r in H.spectrum(table).orderBy("rank").collect()] == pytest.approx(list(s), rel=1e-6)
    low = np.array([r.vector for r in H.truncated(table, 7).orderBy("class_idx").collect()])
    assert np.allclose(low, (u[:, :7] * s[:7]) @ v[:7], atol=1e-6)
    assert H.spectrum(table.limit(0)).count() == 0 and H.truncated(table.limit(0), 2).count() == 0


def test_precision_recall_points_agree_with_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, None]), rng.randint(0, 9) / 10, rng.choice("ab"), rng.choice("ab")) for _ in range(200)] + [(2, 0.5, "a", "b"), (2, None, "a", "a")]
    got = plain(T.precision_recall_points(spark.createDataFrame(rows, "level int, confidence double, label string, prediction string")))
    wanted = []
    for level in (0, 1, 2, None):
        own = [(c, a == b) for k, c, a, b in rows if k == level and c is not None]
        for t in {c for c, _ in own}:
            said = [ok for c, ok in own if c >= t]
            hits = sum(ok for _, ok in own)
            wanted.append((level, t, sum(said) / len(said), sum(said) / hits if hits else None))
    assert got == sorted(wanted, key=str)


def test_results_table_and_best_run(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "run_id long, name string")
    val = spark.createDataFrame([(1, 0.5), (3, 0.7)], "run_id long, score double")
    test = spark.createDataFrame([(2, 0.9), (3, 0.9)], "run_id long, score double")
    status = spark.createDataFrame([(1, "done"), (2, "died")], "run_id long, status string")
    delta = spark.createDataFrame([(2, "m.lr", "changed", "1", "2")], "run_id long, key string, change string, value string, base string")
    table = K.results_table(runs, val, test, status, 1, delta)
    assert plain(table) == [(1, "a", "", 0.5, None, "done", True, 3), (2, "b", "lr=1", None, 0.9, "died", False, 1), (3, "c", "", 0.7, 0.9, None, False, 2)]
    assert [r.place for r in K.results_table(runs, val, test, status, 1, delta, order="val").orderBy("run_id").collect()] == [2, 3, 1]
    assert tuple(K.best_run(table).first()) == (2, 0.9) and tuple(K.best_run(table.where("test is null")).first()) == (None, None)


def test_stateful_centroids_equal_batch_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(["a", "b", "c"][i % 3] if i % 10 else None, rng.normal(size=4).tolist()) for i in range(90)]
    source, told = str(tmp_path / "in"), {}
    streams.use_rocksdb(spark)
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, "label string, embedding array<double>").coalesce(2).write.mode("append").parquet(source)
        out = streams.stateful_centroids(spark.readStream.schema("label string, embedding array<double>").parquet(source))
        write = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda d, n: told.update({r.label: r for r in d.collect()}))
        query = write.trigger(availableNow=True).start()
        query.awaitTermination()
    for label in "abc":
        own = np.array([v for c, v in rows if c == label])
        mean = own.sum(0) / np.linalg.norm(own.sum(0))
        assert told[label].n == len(own) and np.allclose(told[label].vector, mean)


def test_bucketed_manifests_meet_without_a_shuffle(spark):
    expected = C.bucketed(spark.range(1000).selectExpr("concat('p', id) as path", "id as size"), "manifest_expected", "path", 8)
    present = C.bucketed(spark.range(10, 1010).selectExpr("concat('p', id) as path", "id + cast(id % 100 = 50 as int) as size"), "manifest_present", "path", 8)
    try:
        found = C.reconcile_once_each(expected, present)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {"ok": 980, "size_mismatch": 10, "missing": 10, "extra": 10}
        assert {r.status: r.n for r in C.check_manifest(found, 20).collect()}["ok"] == 980
        with pytest.raises(ValueError):
            C.check_manifest(found)
    finally:
        spark.sql("drop table manifest_expected")
        spark.sql("drop table manifest_present")


def test_runs_in_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    from canopy.sources import files

    texts = {"20260101-120000-base-model": "desc: first\ntrain:\n  lr: 0.1\n  aug:\n    warp: null\n    sizes: [1, 2]\n", "20260102-120000": "desc: none\n", "20260103-120000-odd": "a: [1\nb: }"}
    for folder, text in texts.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "config.yaml").write_text(text)
    rows = {r.run_id: r for r in files.read_yaml_runs(spark, str(tmp_path), section="train").collect()}
    assert {k: (r.name, r.config, r.readable) for k, r in rows.items()} == {
        "20260101-120000": ("base-model", '{"lr": 0.1, "aug": {"warp": null, "sizes": [1, 2]}}', True), "20260102-120000": ("20260102-120000", "{}", True), "20260103-120000": ("odd", None, False),
    }
    flat = K.flatten_config(files.read_yaml_runs(spark, str(tmp_path), section="train").where("readable"))
    assert {(r.key, r.value) for r in flat.collect()} == {("lr", "0.1"), ("aug.warp", None), ("aug.sizes", "[1,2]")}

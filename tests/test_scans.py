"""Positions, running sums and recurrences over large groups, and what is built on them."""

import math
import random

from pyspark.sql import functions as F

from canopy.functions import scans
from canopy.operators import thresholds as T


def test_places_and_running_sums_of_odd_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None, ""]), rng.choice(["x", "é", None, "10", "9"]), n, rng.randint(0, 9)) for n in range(500)]
    df = spark.createDataFrame(rows, "k string, s string, id long, v long").repartition(7)
    first = lambda x: (x is not None, (x or "").encode())
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    wanted = {r[2]: n for g in groups.values() for n, r in enumerate(sorted(g, key=lambda r: (first(r[1]), r[2])))}
    assert {r.id: r.n for r in scans.places(df, ["k"], ["s", "id"]).collect()} == wanted
    total, cum = 0, {}
    for r in sorted(rows, key=lambda r: (first(r[1]), r[2])):
        total += r[3]
        cum[r[2]] = total
    assert {r.id: r.cum_v for r in scans.running_sums(df, ["s", "id"], ["v"]).collect()} == cum
    assert scans.places(df.limit(0), ["k"], ["id"]).count() == 0


def test_affine_scan_over_several_levels(spark):
    rng = random.Random(2)
    rows = [(k, n, rng.choice([0.0, 0.5, 1.0]), rng.random()) for k in ("a", None) for n in range(1000)]
    wanted, state = {}, {}
    for k, n, a, c in rows:
        state[k] = a * state.get(k, 0.0) + c
        wanted[k, n] = state[k]
    got = scans.affine_scan(spark.createDataFrame(rows, "k string, n long, a double, c double"), ["k"], block=4).collect()
    assert len(got) == 2000 and all(math.isclose(r.s, wanted[r.k, r.n], rel_tol=1e-12) for r in got)


def test_one_run_of_a_million_points(spark):
    n = 1_000_000
    y = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 + F.abs(F.col("id") - 400_000) / 1e6
    log = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("x"), y.alias("y")).repartition(16)
    values = [r.y for r in log.orderBy("x").select("y").collect()]
    mean, smooth = 0.0, []
    for i, v in enumerate(values, 1):
        mean = 0.98 * mean + 0.02 * v
        smooth.append(mean / (1 - 0.98**i))
    least = min(smooth)
    knee = max(i for i, s in enumerate(smooth) if s <= 1.05 * least)
    got = T.knee_point(log, 0.98, 1.05).first()
    assert (got.knee, got.recommended) == (knee, 0.75 * knee)
    held = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("x"), F.when((F.col("id") >= 300_000) & (F.col("id") < 900_007), float("nan")).when(F.col("id") % 5 == 0, float("inf")).otherwise(1.0).alias("value")).repartition(16)
    skipped = 600_007 + sum(1 for i in range(n) if i % 5 == 0 and not 300_000 <= i < 900_007)
    assert [tuple(r) for r in T.nonfinite_runs(held, 600_007).collect()] == [("r", skipped, True)]
    assert not T.nonfinite_runs(held, 600_008).first().aborted


def test_runs_of_odd_logs(spark):
    log = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("a", 2, 1.0), (None, 1, 2.0), ("b", None, 1.0), ("c", 1, None)], "run_id string, x long, y double")
    got = {r.run_id: r.knee for r in T.knee_point(log, 0.5, 1.01).collect()}
    assert got == {"a": 2.0, None: 1.0, "b": None, "c": None}
    assert T.knee_point(log.limit(0), 0.5, 1.0).count() == 0
    bad = spark.createDataFrame([("a", 1, None), ("a", 2, float("-inf")), ("a", 3, 1.0), (None, 1, float("nan"))], "run_id string, x long, value double")
    assert {tuple(r) for r in T.nonfinite_runs(bad, 2).collect()} == {("a", 2, True), (None, 1, False)}

"""What the third round's findings named, on small tables made for it."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from canopy.operators import catalogue as C
from canopy.operators import forest as G
from canopy.operators import ledger as K
from canopy.operators import thresholds as T
from canopy.plans.registry import ORACLES, QUERIES
from tests.test_queries import plain


def test_best_rule_of_aurocs_that_round_alike(spark, tmp_path):
    import duckdb

    vectors = np.random.default_rng(94).normal(size=(400, 20)).round(3)
    made = pa.table({"vec_id": range(400), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(400)], pa.int32())})
    pq.write_table(made, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    columns = ["rule", "live", "auroc", "best"]
    got = [tuple(r) for r in QUERIES["openset_summary"](spark, str(tmp_path)).select(*columns).collect()]
    first, second = sorted(got, key=lambda r: (-r[2], not r[3]))[:2]
    assert first[2] == second[2] and first[3] and not second[3]
    assert plain(got) == plain(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['openset_summary']})").fetchall())


def recorded(monkeypatch, module):
    """The plans of all tables that the module stores from here on."""
    plans, store = [], module.stored

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(module, "stored", keep)
    return plans


def test_cycles_of_a_random_map_without_broadcasts(spark, monkeypatch):
    n = 700
    to = {i: int(x) for i, x in enumerate(np.random.default_rng(1).integers(0, n + 30, n))}  # some leave it
    on = set(to)
    while (left := {to[i] for i in on} & on) != on:
        on = left
    plans = recorded(monkeypatch, G)
    found = G.cycles(spark.createDataFrame(list(to.items()), "child long, parent long"))
    assert {int(r.node) for r in found.collect()} == on and on
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_one_long_run_meets_its_least_value_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 100, raising=False)
    rows = [("r", i, abs(i - 400) / 100) for i in range(1000)] + [(None, i, 1.0) for i in range(3)]
    got = T.knee_point(spark.createDataFrame(rows, "run_id string, x long, y double"), 0.5, 2.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "_piece" in got._jdf.queryExecution().executedPlan().toString()
        state, smooth = 0.0, []
        for i in range(1000):
            state = 0.5 * state + 0.5 * abs(i - 400) / 100
            smooth.append(state / (1 - 0.5 ** (i + 1)))
        assert {r.run_id: r.knee for r in got.collect()} == {"r": max(i for i, s in enumerate(smooth) if s <= 2 * min(smooth)), None: 2.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_keys_of_many_runs_are_not_a_task_each(spark):
    rows = [(0, "a", "1"), (0, "b", None)] + [(i, "a", str(i % 2)) for i in range(1, 9)] + [(i, "c", "x") for i in range(1, 3)] + [(4, "b", None)]
    delta = K.config_delta(spark.createDataFrame(rows, "run_id long, key string, value string"), 0)
    wanted = {(i, "a", "changed", "0", "1") for i in range(2, 9, 2)} | {(i, "c", "added", "x", None) for i in (1, 2)} | {(i, "b", "unset", None, None) for i in range(1, 9) if i != 4}
    assert {tuple(r) for r in delta.collect()} == wanted
    plan = delta._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(key" not in plan
    text = K.format_delta(delta)
    assert text.where(F.col("run_id") == 2).first().text == "a=0, b, c=x"
    assert text._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(run_id") == 2  # what runs lack, and the texts


def test_only_the_newest_evaluation_of_a_path_meets_runs(spark):
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_dir string")
    evals = [("/o/r1/m", f"e{n}", n / 10) for n in range(9)] + [("/o/r1/k", "e95", None), ("/o/r2/m", None, 0.5)]
    found = C.join_evals(runs, spark.createDataFrame(evals, "model_path string, eval_name string, test_f1 double"))
    assert {tuple(r) for r in found.collect()} == {("r1", "e95", None), ("r2", None, None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "key=[model_path" in plan or "keys=[model_path" in plan


def test_conditional_thresholds_take_levels_one_after_the_other(spark):
    rng = np.random.default_rng(17)
    rows = [(int(i), n, float(c), "a", "a" if rng.random() < c else "b") for n in range(3) for i, c in zip(rng.integers(0, 500, 600), rng.random(600), strict=True)]
    rows += [(600, 0, None, "a", "a"), (600, 1, 0.9, None, "a"), (601, 1, 0.9, "a", "a"), (None, 0, 0.1, "a", "a"), (None, 1, 0.1, "a", "a")]
    pred = spark.createDataFrame(rows, "instance_id int, level int, confidence double, label string, prediction string")
    for target in (0.7, 2.0):  # the second is never reached, so that all instances go on
        left, wanted = None, {}
        for n in range(3):
            own = [r for r in rows if r[1] == n and (left is None or r[0] in left)]
            sure = [(k / 100, [r for r in own if r[2] is not None and int(r[2] * 100 + 1e-9) >= k]) for k in range(101)]
            wanted[n] = min((t for t, s in sure if s and sum(r[3] == r[4] for r in s) >= target * len(s)), default=None)
            left = {r[0] for r in own if wanted[n] is None or r[2] is None or r[2] < wanted[n]} - {None}
        found = T.conditional_thresholds(pred, [0, 1, 2], target)
        assert {r.level: r.threshold for r in found.collect()} == wanted
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Sort" not in plan
    none = T.conditional_thresholds(pred.where("level <> 1"), [0, 1, 2], 0.7)
    assert [r.level for r in none.collect()] == [0]

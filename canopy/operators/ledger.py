"""Experiment ledgers: runs with a configuration each, their differences, and a leaderboard."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import bounds
from ..functions.scans import places
from ..sources.scratch import stored


class Number(str):
    """A number as it is written."""


def written(v) -> str:
    """A JSON value as text, numbers as they were."""
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, list):
        return f"[{','.join(map(written, v))}]"
    if isinstance(v, dict):
        return f"{{{','.join(f'{written(k)}:{written(x)}' for k, x in v.items())}}}"
    return json.dumps(v, ensure_ascii=False)


def leaves(text: str | None) -> list[tuple[str, str | None]]:
    """(dotted key, value) of a JSON object's leaves, as they are written; none if it isn't an object."""
    try:
        root = json.loads(text or "", parse_float=Number, parse_int=Number, parse_constant=Number)
    except ValueError:
        return []
    out, left = [], [("", root)] if isinstance(root, dict) else []
    while left:
        at, node = left.pop()
        for k, v in node.items():
            key = f"{at}.{k}" if at else k
            if isinstance(v, dict) and v:
                left.append((key, v))
            else:
                out.append((key, None if v is None else str(v) if isinstance(v, str) else written(v)))
    return out


def flatten_config(runs: DataFrame, column: str = "config") -> DataFrame:
    """run_id, key, value from a JSON object; nested objects give dotted keys, at any depth, in one pass over the runs.

    An empty object is a value, as are arrays (as JSON) and null; what isn't a JSON object gives no rows.
    """
    kind = runs.schema["run_id"].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(run, *leaf) for run, text in zip(frame["run_id"], frame["config"], strict=True) for leaf in leaves(text)]
            yield pd.DataFrame(rows, columns=["run_id", "key", "value"], dtype=object)

    found = runs.select(F.col("run_id").cast("string").alias("run_id"), F.col(column).cast("string").alias("config")).mapInPandas(of, "run_id string, key string, value string")
    return found.select(F.col("run_id").cast(kind).alias("run_id"), "key", "value")


def config_delta(runs: DataFrame, baseline: object, ignore: Sequence[str] = ()) -> DataFrame:
    """run_id, key, change, value, base: what differs from the baseline run; unset is not null.

    Runs are flattened once and stored. The baseline's keys are one configuration: they are broadcast, so that the few keys
    of all runs aren't a task each, and a run's own rows meet only to tell which of those it lacks.
    """
    flat = stored(runs)
    base = flat.where(F.col("run_id") == baseline).select("key", F.col("value").alias("base"))
    met = flat.where(F.col("run_id") != baseline).join(F.broadcast(base.withColumn("in_base", F.lit(True))), "key", "left")
    change = F.when(F.col("in_base").isNull(), "added").when(~F.col("value").eqNullSafe(F.col("base")), "changed")
    own = met.select("run_id", "key", change.alias("change"), "value", "base").where("change is not null")
    keys = base.agg(F.collect_list("key").alias("keys"))
    lacks = met.groupBy("run_id").agg(F.collect_list(F.when(F.col("in_base"), F.col("key"))).alias("mine")).crossJoin(F.broadcast(keys))  # one row
    unset = lacks.select("run_id", F.explode(F.array_except("keys", "mine")).alias("key")).join(F.broadcast(base), "key")
    out = own.unionByName(unset.select("run_id", "key", F.lit("unset").alias("change"), F.lit(None).cast("string").alias("value"), "base"))
    return out.where(~F.col("key").isin("", *ignore))


def neighbours(order: DataFrame, parts: int = 64) -> DataFrame:
    """run_id, previous: the run before each one by (at, run_id); null for the first. Ranges of `at` are ordered on their own."""
    cuts = bounds(order, "at", parts)
    kind = order.schema["at"].dataType
    part = F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in cuts)), lambda b: b < F.col("at"))) if cuts else F.lit(0)
    rows = order.select("run_id", "at", part.alias("part"))
    within = Window.partitionBy("part").orderBy("at", "run_id")
    last = rows.groupBy("part").agg(F.max(F.struct("at", "run_id"))["run_id"].alias("last"))
    before = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))  # at most `parts` rows
    return rows.withColumn("own", F.lag("run_id").over(within)).join(before, "part").select("run_id", F.coalesce("own", "before").alias("previous"))


def config_chain(runs: DataFrame, order: DataFrame) -> DataFrame:
    """run_id, key, value, before: keys whose value differs from the previous run's; order(run_id, at).

    Only keys that a run or the one before it has are joined.
    """
    pairs = stored(neighbours(order)).where("previous is not null")
    now = pairs.join(runs, "run_id").select("run_id", "key", "value")
    then = pairs.join(runs.withColumnRenamed("run_id", "previous"), "previous").select("run_id", "key", F.col("value").alias("before"))
    both = now.join(then, ["run_id", "key"], "full_outer")
    return both.where(~F.col("value").eqNullSafe(F.col("before"))).select("run_id", "key", "value", "before")


def format_delta(delta: DataFrame) -> DataFrame:
    """run_id, text: changed keys by their last part; three or more with the same parts before it as prefix.*(n).

    A run's rows are shuffled once, for both groupings.
    """
    prefix = F.regexp_extract("key", r"^(.*)\.[^.]*$", 1)
    last = F.element_at(F.split("key", r"\."), -1)
    groups = delta.repartition("run_id").withColumn("prefix", prefix).groupBy("run_id", "prefix").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws("=", last, "value"))).alias("tokens"))
    many = (F.col("n") >= 3) & (F.col("prefix") != "")
    token = F.when(many, F.array(F.concat(F.col("prefix"), F.lit(".*("), F.col("n").cast("string"), F.lit(")")))).otherwise(F.col("tokens"))
    return groups.select("run_id", F.explode(token).alias("t")).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("t")), ", ").alias("text"))


def run_status(runs: DataFrame, exported: DataFrame, live: Sequence[str] = ()) -> DataFrame:
    """done if its artefact is there; else running if it is the newest of a live name; else died."""
    done = exported.select("run_id", F.lit(True).alias("done")).distinct()
    named = runs.where(F.col("name").isin("", *live))
    latest = named.groupBy("name").agg(F.max("at").alias("at"))
    newest = named.join(latest, ["name", "at"]).groupBy("name").agg(F.min("run_id").alias("newest"))
    status = F.when(F.col("done"), "done").when(F.col("run_id") == F.col("newest"), "running").otherwise("died")
    return runs.join(newest, "name", "left").join(done, "run_id", "left").select("run_id", "name", status.alias("status"))


def pick_baseline(runs: DataFrame, evals: DataFrame, exported: DataFrame) -> DataFrame:
    """One row: the earliest run that is done and has a score."""
    done = runs.join(exported.select("run_id").distinct(), "run_id", "left_semi").join(evals, "run_id")
    return done.agg(F.min_by("run_id", F.struct("at", "run_id")).alias("run_id"), F.min_by("score", F.struct("at", "run_id")).alias("score"))


def leaderboard(runs: DataFrame, evals: DataFrame, k: int) -> DataFrame:
    """The k best runs by score with their gain on the earliest scored run."""
    scored = runs.join(evals, "run_id")
    first = scored.agg(F.min_by("score", F.struct("at", "run_id")).alias("base"))
    return scored.join(F.broadcast(first)).select("run_id", "name", "score", (F.col("score") - F.col("base")).alias("gain")).orderBy(F.desc("score"), "run_id").limit(k)


def ledger(board: DataFrame, delta: DataFrame) -> DataFrame:
    """A leaderboard with what each run changed, as text; empty if nothing."""
    return board.join(format_delta(delta), "run_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def results_table(runs: DataFrame, validation: DataFrame, tests: DataFrame, status: DataFrame, baseline: object, delta: DataFrame, order: str = "test") -> DataFrame:
    """run_id, name, delta, val, test, status, is_baseline, place: every run with what it changed and both of its scores.

    validation and tests hold run_id and score, at most one row a run; a run without a score has null. place is the rank
    by `order` (test or val: the best first, runs without one last; run: by id), ties by id. delta is empty for runs
    that change nothing.
    """
    scored = runs.select("run_id", "name").join(validation.select("run_id", F.col("score").alias("val")), "run_id", "left").join(tests.select("run_id", F.col("score").alias("test")), "run_id", "left")
    told = scored.join(status.select("run_id", "status"), "run_id", "left").join(format_delta(delta).withColumnRenamed("text", "delta"), "run_id", "left")
    rows = told.select("run_id", "name", F.coalesce("delta", F.lit("")).alias("delta"), "val", "test", "status", F.col("run_id").eqNullSafe(F.lit(baseline)).alias("is_baseline"))
    by = [F.lit(0)] if order == "run" else [-F.coalesce(order, F.lit(float("-inf")))]
    placed = places(rows.withColumn("_by", by[0]), [], ["_by", "run_id"], "place")
    return placed.withColumn("place", F.col("place") + 1).drop("_by")


def best_run(table: DataFrame) -> DataFrame:
    """One row: the run with the best test score, of equal ones the least id; null if none has a score."""
    best = F.struct("test", "run_id")
    known = table.where(F.col("test").isNotNull()).groupBy("test").agg(F.min("run_id").alias("run_id"))
    return known.agg(F.max_by("run_id", best).alias("run_id"), F.max("test").alias("test"))

"""Reproducible random order by hash, ranks and running totals that need no single task, and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading hex digits of the hash that cut a class into pieces for `hash_place`.
DIGITS = 3


def hash_of(key: str, seed: object = 0) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def hash_order(key: str, seed: object = 0) -> list[Column]:
    """Sort columns: md5 of key and seed, then the key itself."""
    return [hash_of(key, seed), F.col(key)]


def hash_place(df: DataFrame, keys: Sequence[str], key: str, seed: object = 0, name: str = "_place") -> DataFrame:
    """df and each row's place, from 1, in hash order within its keys (of all rows if there are none).

    Rows are ranked within pieces of the hash's range and then moved by the rows of the pieces before, at most 4,096 a
    key, so that a key with most of the rows isn't one task.
    """
    cut = df.withColumn("_piece", F.substring(hash_of(key, seed), 1, DIGITS))
    sizes = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*hash_order(key, seed))))
    offsets = sizes.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_piece").alias("_p"), before.alias("_before"))
    same = F.col("_piece") == F.col("_p")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return ranked.join(offsets, same).select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))


def bounds(df: DataFrame, order: str, parts: int) -> list:
    """At most parts - 1 values that cut df into ranges of about as many rows each; a list of bounded size on the driver."""
    found = df.agg(F.percentile_approx(order, [n / parts for n in range(1, parts)]).alias("b")).first()["b"]
    return sorted(set(found or []))


def prefix_sum(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """Adds cum_<c> for each c of sums: its total over the key's rows up to and with the row's value of `order`.

    df is first summed to one row for each key and value. Ranges of values then total on their own and get the total
    of the ranges before them, so a key with most of the rows is spread over many tasks; equal values stay together.
    The ranges' bounds are taken once and are constants of the plan: every part of it cuts the values alike. `order` is
    a number, date or time; a null comes before all others (after them if descending).
    """
    each = df.groupBy(*keys, order).agg(*(F.sum(c).alias(c) for c in sums))
    cuts = bounds(each, order, parts)
    kind = each.schema[order].dataType
    part = F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in cuts)), lambda b: b < F.col(order))) if cuts else F.lit(0)
    ranged = each.withColumn("_part", part)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy("_part", *keys).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *(F.sum(c).over(inside).alias(f"_in_{c}") for c in sums))
    totals = ranged.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy(direction("_part")).rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows a key
    offsets = totals.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums))
    same = F.col("_part") == F.col("_p")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{n}"))
    joined = local.join(offsets, same)
    return joined.select(*keys, order, *sums, *((F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sums))


def quantiles_by(df: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """keys, q0, q1, ...: the exact quantiles of each key, interpolated linearly, by one running total for all keys."""
    known = df.where(F.col(column).isNotNull()).select(*keys, column, F.lit(1).alias("n"))
    names = [f"_s{n}" for n in range(len(keys))]
    size = known.groupBy(*(F.col(k).alias(x) for k, x in zip(keys, names, strict=True))).agg(F.count("*").alias("_size"))
    same = F.lit(True)
    for k, x in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(x))
    rows = prefix_sum(known, keys, column, ["n"]).join(size, same)
    place = [(F.col("_size") - 1) * F.lit(float(q)) for q in shares]
    at = lambda k: F.min(F.when(F.col("cum_n") > k, F.col(column)))
    ends = rows.groupBy(*keys).agg(*(c for n, p in enumerate(place) for c in (at(F.floor(p)).alias(f"a{n}"), at(F.ceil(p)).alias(f"b{n}"), F.max(p - F.floor(p)).alias(f"f{n}"))))
    return ends.select(*keys, *((F.col(f"a{n}") + (F.col(f"b{n}") - F.col(f"a{n}")) * F.col(f"f{n}")).alias(f"q{n}") for n in range(len(shares))))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row, q0, q1, ...: the exact quantiles, interpolated linearly; null if there are no values.

    Ranks come from running totals over ranges, so no task holds all values.
    """
    known = df.where(F.col(column).isNotNull()).select(column, F.lit(1).alias("n"), F.lit(0).alias("_"))
    run, size = prefix_sum(known, ["_"], column, ["n"]), known.agg(F.count("*").alias("_size"))
    rows = run.crossJoin(F.broadcast(size))  # one row
    place = [(F.col("_size") - 1) * F.lit(float(q)) for q in shares]
    at = lambda k: F.min(F.when(F.col("cum_n") > k, F.col(column)))
    ends = rows.agg(*(c for n, p in enumerate(place) for c in (at(F.floor(p)).alias(f"a{n}"), at(F.ceil(p)).alias(f"b{n}"), F.max(p - F.floor(p)).alias(f"f{n}"))))
    return ends.select(*((F.col(f"a{n}") + (F.col(f"b{n}") - F.col(f"a{n}")) * F.col(f"f{n}")).alias(f"q{n}") for n in range(len(shares))))

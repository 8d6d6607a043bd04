"""Order within large groups: dense positions by sampled ranges, and scans of recurrences in blocks.

Neither holds a group in one task: positions come from ranges of the sort columns and the rows of the ranges before
(any type that Spark orders, strings too); a recurrence s = a * s + c is composed to one such map a block, the blocks are
scanned in the same way, and each block then runs on its own from the state that it is handed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored

#: Rows of a block of a scan: an array of so many steps is the most that one row holds.
BLOCK = 256


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of key columns, nulls equal to nulls."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same &= F.col(a).eqNullSafe(F.col(b))
    return same


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df stored with `_part`: the range of the sort columns that a row is in, from 0 in their order; ties share one; and
    `_in`: its place in there, from 0. The range's sorted rows are numbered as they are written, with no further shuffle.

    As many ranges as the session's shuffles have partitions, small neighbours joined by the adaptive plan.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stored(rows.select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND(F.lit(2**33 - 1)).alias("_in")))


def offsets(sizes: DataFrame, keys: Sequence[str], sums: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """_p, _k0, ... and `more`: each key's ranges with the sums over its ranges before, `_off_<c>`; sizes has a row a key and range."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a key and range
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}")
    return sizes.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), *more, *map(start, sums))


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """df and each row's position, from 0, among its key's rows by the order columns (of all rows if there are no keys).

    Rows are numbered within ranges of (keys, order); a key's rows are neighbours there and are moved by its rows in the
    ranges before, so neither a key with most rows nor a whole table is one task. Nulls come first. Rows that tie in all
    order columns have neighbouring positions in any order, in one range. The moves are stored, so that Spark's size check
    knows when they are few.
    """
    rows = ranged(df.withColumn("_all", F.lit(0)), [*keys, *order])
    keys = ["_all", *keys]
    sizes = rows.groupBy("_part", *keys).agg(F.count("*").alias("rows"), F.min("_in").alias("_first"))
    moves = stored(offsets(sizes, keys, ["rows"], ["_first"]))
    moved = rows.join(moves, (F.col("_part") == F.col("_p")) & same_keys(keys, [f"_k{n}" for n in range(len(keys))]))
    return moved.select(*df.columns, (F.col("_in") - F.col("_first") + F.col("_off_rows")).cast("long").alias(name))


def running_sums(df: DataFrame, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """df with cum_<c>: the sum of c over the rows up to and with each one, in the order columns' order, by ranges."""
    rows = ranged(df, order)
    totals = rows.groupBy("_part").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("_all", F.lit(0))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *(F.sum(c).over(inside).alias(f"_in_{c}") for c in sums))
    joined = local.join(offsets(totals, ["_all"], sums).drop("_k0"), F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, *((F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sums))


def affine_scan(rows: DataFrame, keys: Sequence[str], others: Sequence[str] = (), block: int = BLOCK, most: int | None = None) -> DataFrame:
    """keys, n, others and s: the state after each row of the recurrence s = a * s + c from 0, by n (0, 1, ...) within keys.

    rows has keys, n, a, c and others. Maps compose (a, c) after (b, d) to (a b, a d + c), so each block of rows is one
    map, blocks are scanned as rows were, level by level, and a block's rows follow from the state before it.
    """
    if most is None:
        most = rows.agg(F.max("n")).first()[0] or 0
    cell = F.struct("n", F.col("a").cast("double").alias("a"), F.col("c").cast("double").alias("c"), *others)
    blocks = rows.groupBy(*keys, F.floor(F.col("n") / block).alias("_b")).agg(F.array_sort(F.collect_list(cell)).alias("rows"))
    if most < block:
        blocks = blocks.withColumn("_s", F.lit(0.0))
    else:
        blocks = stored(blocks)
        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
        whole = F.aggregate("rows", start, lambda t, p: F.struct((p["a"] * t["a"]).alias("a"), (p["a"] * t["c"] + p["c"]).alias("c")))
        maps = blocks.select(*keys, F.col("_b").alias("n"), whole.alias("m")).select(*keys, "n", "m.a", "m.c")
        ends = affine_scan(maps, keys, (), block, most // block)
        names = [f"_k{i}" for i in range(len(keys))]
        handed = ends.select(*(F.col(k).alias(x) for k, x in zip(keys, names, strict=True)), (F.col("n") + 1).alias("_to"), F.col("s").alias("_from"))
        blocks = blocks.join(handed, (F.col("_b") == F.col("_to")) & same_keys(keys, names), "left").withColumn("_s", F.when(F.col("_b") == 0, 0.0).otherwise(F.col("_from"))).drop(*names)
    first = F.struct(F.col("_s").alias("s"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(t: Column, p: Column) -> Column:
        return F.get(F.transform(F.array(p["a"] * t["s"] + p["c"]), lambda s: F.struct(s.alias("s"), F.concat(t["out"], F.array(s)).alias("out"))), F.lit(0))

    run = blocks.select(*keys, "rows", F.aggregate("rows", first, step, lambda t: t["out"]).alias("s"))
    out = run.select(*keys, F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("s").alias("s"))).alias("x"))
    return out.select(*keys, "x.row.n", *(F.col(f"x.row.{c}").alias(c) for c in others), "x.s")

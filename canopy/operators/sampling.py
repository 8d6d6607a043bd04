"""Samples, splits, hold-outs and mixing. Random choices go by hash order, so they are the same on every run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import hash_of, hash_order, hash_place
from ..functions.scans import running_sums
from ..sources.scratch import stored
from .catalogue import derive_coarse, filter_catalogue, limit_random
from .metrics import class_counts


def cap_per_class(df: DataFrame, level: str, per: int, key: str, seed: object = 0) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(level).orderBy(*hash_order(key, seed)))
    return df.withColumn("_place", place).where(F.col("_place") <= per).drop("_place")


def sample_classes(df: DataFrame, level: str, n_classes: int, per_class: int, key: str, seed: object = 0) -> DataFrame:
    """n_classes of the classes with at least per_class rows, and exactly per_class rows of each."""
    chosen = limit_random(class_counts(df, level).where(F.col("n") >= per_class), n_classes, "class", seed)
    return cap_per_class(df.join(chosen.select(F.col("class").alias(level)), level, "left_semi"), level, per_class, key, seed)


def sample_strata(df: DataFrame, stratum: str, n: int, key: str, seed: object = 0) -> DataFrame:
    return cap_per_class(df, stratum, n, key, seed)


def spread_sample(df: DataFrame, n: int, group: str, key: str, seed: object = 0) -> DataFrame:
    """n rows, one of each group before a second of any."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*hash_order(key, seed)))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= n).orderBy("_turn", *hash_order(group, seed)).limit(n).drop("_turn")


def parse_capture(df: DataFrame, path: str) -> DataFrame:
    """trap, ts, snapshot from a file name; `parsed` is false where the name has another form."""
    pattern = r"TRAPNAME_([^_]+)_IMAGENAME_(\d{14})-(\d+)-snapshot"
    part = lambda n: F.nullif(F.regexp_extract(path, pattern, n), F.lit(""))
    out = df.withColumns({"trap": part(1), "ts": F.try_to_timestamp(part(2), F.lit("yyyyMMddHHmmss")), "snapshot": part(3).cast("long")})
    return out.withColumn("parsed", F.col("trap").isNotNull() & F.col("ts").isNotNull())


def assign_night(df: DataFrame) -> DataFrame:
    """night runs from noon to noon; group is trap|night."""
    night = F.to_date(F.col("ts") - F.expr("interval 12 hours"))
    return df.withColumn("night", night).withColumn("group", F.concat_ws("|", "trap", F.col("night").cast("string")))


def split_groups(df: DataFrame, group: str, leaf: str, adapt_frac: float, held_out: Sequence[str], seed: object = 0) -> DataFrame:
    """Whole groups go to adapt or probe (their number rounded half to even); held-out classes in adapt are unused."""
    groups = df.select(group).distinct()
    total = groups.agg(F.bround(F.count("*") * F.lit(adapt_frac)).cast("long").alias("take"))
    first = hash_place(groups, [], group, seed).join(F.broadcast(total)).select(group, (F.col("_place") <= F.col("take")).alias("_adapt"))
    split = F.when(F.col("_adapt") & F.col(leaf).isin(*held_out), "unused").when(F.col("_adapt"), "adapt").otherwise("probe")
    return df.join(first, group).withColumn("split", split).drop("_adapt")


def check_split(df: DataFrame, group: str, leaf: str, held_out: Sequence[str]) -> DataFrame:
    """check, n, ok for the four ways a split can leak or fail; one pass over the rows."""
    adapt, probe, held = F.col("split") == "adapt", F.col("split") == "probe", F.col(leaf).isin(*held_out)
    per = df.groupBy(group).agg(F.count_if(adapt).alias("a"), F.count_if(probe).alias("p"), F.count_if(adapt & held).alias("ha"), F.count_if(probe & held).alias("hp"))
    sums = per.agg(F.count_if((F.col("a") > 0) & (F.col("p") > 0)).alias("both"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ha", "hp", "a")))
    found = [("group_in_both", "both", True), ("held_out_in_adapt", "ha", True), ("held_out_in_probe", "hp", False), ("adapt_rows", "a", False)]
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(c).alias("n"), ((F.col(c) == 0) if none else (F.col(c) > 0)).alias("ok")) for name, c, none in found)))
    return sums.select(rows.alias("r")).select("r.*")


def pick_holdout(df: DataFrame, levels: Sequence[str], n_top: int, n_mid: int, n_leaf: int, min_rows: int, seed: object = 0, most_rows: int | None = None, least_leaves: int = 1) -> DataFrame:
    """stratum, taxon: smallest top taxa whose median leaf has min_rows (far), mid taxa of the others with two leaves
    (mid), and leaves with a sibling outside those (near).

    most_rows: far taxa have no more rows in all; least_leaves: nor fewer leaves. The leaves' sizes are counted once and
    stored: all choices are made on that class table.
    """
    leaf, mid, top = levels
    size = stored(df.groupBy(leaf, mid, top).agg(F.count("*").alias("n")))
    tops = size.groupBy(top).agg(F.percentile("n", 0.5).alias("m"), F.sum("n").alias("t"), F.count("*").alias("leaves"))
    tops = tops.where((F.col("m") >= min_rows) & (F.col("leaves") >= least_leaves) & (F.lit(most_rows is None) | (F.col("t") <= F.lit(most_rows))))
    far = tops.orderBy("t", top).limit(n_top).select(top)
    rest = size.join(far, top, "left_anti")
    mids = rest.groupBy(mid).agg(F.count("*").alias("c")).where("c > 1")
    middle = limit_random(mids.select(mid), n_mid, mid, seed)
    leaves = rest.join(mids.select(mid), mid, "left_semi").join(middle, mid, "left_anti").where(F.col("n") >= min_rows)
    near = limit_random(leaves.select(leaf), n_leaf, leaf, seed)
    named = lambda d, c, s: d.select(F.lit(s).alias("stratum"), F.col(c).alias("taxon"))
    return named(far, top, "far").unionByName(named(middle, mid, "mid")).unionByName(named(near, leaf, "near"))


def apply_holdout(df: DataFrame, held: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rows outside the held-out taxa."""
    for level, stratum in zip(levels, ("near", "mid", "far"), strict=True):
        df = df.join(held.where(F.col("stratum") == stratum).select(F.col("taxon").alias(level)), level, "left_anti")
    return df


def check_holdout(df: DataFrame, kept: DataFrame, levels: Sequence[str], most: float = 0.05) -> DataFrame:
    """check, n, ok: rows removed (at most this share of all), and coarser taxa that lost all their rows (none)."""
    rows = df.agg(F.count("*").alias("a")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("b"))))  # one row each
    out = rows.select(F.lit("rows_removed").alias("check"), (F.col("a") - F.col("b")).alias("n"), (F.col("a") - F.col("b") <= F.lit(most) * F.col("a")).alias("ok"))
    for level in levels[1:]:
        lost = df.select(level).distinct().join(kept.select(level).distinct(), level, "left_anti")
        out = out.unionByName(lost.agg(F.count("*").alias("n")).select(F.lit(f"{level}_emptied").alias("check"), "n", (F.col("n") == 0).alias("ok")))
    return out


def stratify_novelty(df: DataFrame, known: DataFrame, levels: Sequence[str]) -> DataFrame:
    """stratum: known leaf, else near (known mid), else mid (known top), else far."""
    names = ["known", "near", "mid"]
    state = None
    for level, name in zip(levels, names, strict=True):
        seen = known.select(F.col(level), F.lit(True).alias(f"_{level}")).distinct()
        df = df.join(seen, level, "left")
        hit = F.col(f"_{level}").isNotNull()
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return df.withColumn("stratum", state.otherwise("far")).drop(*(f"_{c}" for c in levels))


def restrict_novel(df: DataFrame, scoreable: DataFrame, leaf: str, most_known: float | None = None) -> DataFrame:
    """Known rows, and novel ones of scoreable leaves only.

    most_known: an error if more than this share of the scoreable leaves' rows is not novel.
    """
    ok = scoreable.select(F.col(leaf), F.lit(True).alias("_ok")).distinct()
    joined = df.join(ok, leaf, "left")
    if most_known is not None:
        known, rows = joined.where("_ok").agg(F.count_if(F.col("stratum") == "known"), F.count("*")).first()
        if known > most_known * rows:
            raise ValueError(f"{known} of {rows} rows of scoreable leaves are not novel")
    return joined.where((F.col("stratum") == "known") | F.col("_ok")).drop("_ok")


def weighted_resample(df: DataFrame, level: str, power: float, n: int, key: str, seed: object = 0) -> DataFrame:
    """n rows with replacement, classes in proportion to count ** (1 - power): quotas by cumulative floor over ranges of
    classes, then each row of a class equally often but for the first few by hash."""
    sizes = class_counts(df, level).withColumn("mass", F.pow(F.col("n").cast("double"), F.lit(1.0 - power)).cast("decimal(28,10)"))  # sums are exact in any order
    total = sizes.agg(F.sum("mass").alias("total"))
    cum = running_sums(sizes, ["class"], ["mass"]).join(F.broadcast(total))  # one row
    upto = lambda c: F.floor(c.cast("double") / F.col("total").cast("double") * n + 1e-6)
    quota = cum.select(F.col("class").alias(level), "n", (upto(F.col("cum_mass")) - upto(F.col("cum_mass") - F.col("mass"))).alias("quota"))
    placed = hash_place(df, [level], key, seed).join(quota, level)
    reps = F.floor(F.col("quota") / F.col("n")) + (F.col("_place") <= F.col("quota") % F.col("n")).cast("long")
    return placed.withColumn("_reps", reps).where("_reps > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_reps")))).drop("_reps", "_place", "n", "quota")


def combine_pseudo(real: DataFrame, pseudo: DataFrame, hier: DataFrame, levels: Sequence[str], min_count: int, share: float) -> DataFrame:
    """Real rows of classes over the floor, and pseudo rows of those classes so often that they make up `share`."""
    if not pseudo.where(~F.col("set").eqNullSafe("2")).isEmpty():
        raise ValueError("some pseudo rows are not in set 2")
    leaf = levels[0]
    base = filter_catalogue(real, levels, remove_in=["0"], min_count=min_count)
    known = base.select(leaf).distinct()
    usable = derive_coarse(pseudo.join(known, leaf, "left_semi"), hier, levels)
    sizes = base.select(F.lit(0).alias("k")).unionByName(usable.select(F.lit(1).alias("k"))).agg(F.count_if(F.col("k") == 0), F.count_if(F.col("k") == 1)).first()
    r, p = sizes[0], sizes[1]
    times = max(1, round(share * r / ((1 - share) * p))) if p else 1
    more = usable.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return base.withColumn("copy", F.lit(0)).unionByName(more, allowMissingColumns=True)


def balanced_replication(df: DataFrame, level: str, total: int, key: str, seed: object = 0) -> DataFrame:
    """Exactly max(1, total // classes) rows of every class: copies in turn, then the head."""
    n = class_counts(df, level).select(F.col("class").alias(level), "n")
    classes = n.agg(F.greatest(F.floor(F.lit(total) / F.count("*")), F.lit(1)).alias("per"))
    placed = hash_place(df, [level], key, seed).join(n, level).join(F.broadcast(classes))
    reps = F.floor((F.col("per") - F.col("_place")) / F.col("n")) + 1
    return placed.where(F.col("_place") <= F.col("per")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), reps))).drop("_place", "n", "per")


def label_budget(df: DataFrame, n: int, group: str, key: str, seed: object = 0) -> DataFrame:
    return spread_sample(df, n, group, key, seed).withColumn("set", F.lit("2"))


def sample_negatives(batch: DataFrame, hier: DataFrame, leaf: str, parent: str, budget: int, seed: object = 0) -> DataFrame:
    """batch_id, class, rank: the batch's classes (0), then siblings (1), then others (2), `budget` in all but positives.

    Siblings and others are drawn from the classes in hash order, around the circle from a place that the batch's hash
    gives: 2 * budget steps find as many as are needed, so no batch meets all classes.
    """
    order = hash_place(hier.select(leaf, parent).distinct(), [], leaf, seed, "at").withColumn("at", F.col("at") - 1)
    order = hash_place(order, [parent], leaf, seed, "near").withColumn("near", F.col("near") - 1)
    size = order.agg(F.count("*").alias("size"))
    families = order.groupBy(parent).agg(F.count("*").alias("size"))
    positive = batch.select("batch_id", leaf).distinct()
    start = lambda size: F.conv(F.substring(hash_of("batch_id", seed), 1, 8), 16, 10).cast("long") % size
    steps = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(2 * budget)) - 1)).alias("step")
    at = ((start(F.col("size")) + F.col("step")) % F.col("size")).alias("wanted")
    kin = positive.join(order.select(leaf, parent), leaf).select("batch_id", parent).distinct().join(families, parent)
    near = kin.select("batch_id", parent, "size", steps()).select("batch_id", parent, at, "step").join(order.select(parent, leaf, F.col("near").alias("wanted")), [parent, "wanted"])
    far = batch.select("batch_id").distinct().crossJoin(F.broadcast(size)).select("batch_id", "size", steps()).select("batch_id", at, "step").join(order.select(leaf, F.col("at").alias("wanted")), "wanted")  # size is one row
    ranks = [positive.select("batch_id", leaf, F.lit(0).alias("rank"), F.lit(0).cast("long").alias("step")), near.select("batch_id", leaf, F.lit(1).alias("rank"), "step"), far.select("batch_id", leaf, F.lit(2).alias("rank"), "step")]
    every = reduce(DataFrame.unionByName, ranks).groupBy("batch_id", leaf).agg(F.min(F.struct("rank", "step")).alias("first")).select("batch_id", leaf, "first.*")
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("rank", "step", leaf))
    return every.withColumn("_place", place).where((F.col("_place") <= budget) | (F.col("rank") == 0)).select("batch_id", leaf, "rank")

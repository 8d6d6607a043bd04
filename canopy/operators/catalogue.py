"""Catalogues: filters, preparation, hierarchies, vocabularies, names and joins.

`levels` lists column names from fine to coarse; class keys are strings. Rows with a null `set` count as not removed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import hash_order
from ..functions.scans import places


def filter_catalogue(df: DataFrame, levels: Sequence[str], remove_in: Sequence[str] = (), keep_in: Sequence[str] = (), min_count: int = 0, coarse_filter: Sequence[str] = ()) -> DataFrame:
    """Drops folds, keeps folds, keeps coarse keys, then keeps classes with min_count of the remaining rows."""
    if remove_in:
        df = df.where(F.coalesce(~F.col("set").isin(*remove_in), F.lit(True)))
    if keep_in:
        df = df.where(F.col("set").isin(*keep_in))
    if coarse_filter:
        df = df.where(F.col(levels[-1]).cast("string").isin(*coarse_filter))
    if min_count:
        large = df.where(F.col(levels[0]).isNotNull()).groupBy(levels[0]).count().where(F.col("count") >= min_count)
        df = df.join(large.select(levels[0]), levels[0], "left_semi")
    return df


def prepare(df: DataFrame, levels: Sequence[str], valid_set: str = "1") -> DataFrame:
    """image_path, is_valid and the levels as strings, nothing else."""
    made = F.concat_ws("/", F.col(levels[0]).cast("string"), "filename")
    path = F.coalesce("image_path", made) if "image_path" in df.columns else made
    return df.select(path.alias("image_path"), F.col("set").eqNullSafe(valid_set).alias("is_valid"), *(F.col(c).cast("string").alias(c) for c in levels))


def hierarchy_label(df: DataFrame, levels: Sequence[str], name: str = "lineage") -> DataFrame:
    return df.withColumn(name, F.concat_ws(" ", *levels))


def normalise_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def rewrite_paths(df: DataFrame, prefix: str, column: str = "filename") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))


def known_only(df: DataFrame, vocab: DataFrame, level: str) -> DataFrame:
    return df.join(vocab.where(F.col("level") == level).select(F.col("class").alias(level)), level, "left_semi")


def flag_known(df: DataFrame, vocab: DataFrame, level: str) -> DataFrame:
    known = vocab.where(F.col("level") == level).select(F.col("class").alias(level), F.lit(True).alias("_k"))
    return df.join(known, level, "left").withColumn("known_label", F.coalesce("_k", F.lit(False))).drop("_k")


def filter_detections(df: DataFrame, id_column: str, label: str, groups: Sequence[str], predicate: Column) -> DataFrame:
    """Rows that meet the predicate and whose detection carries one of the group labels in any row."""
    wanted = df.where(F.col(label).isin(*groups)).select(id_column).distinct()
    return df.where(predicate).join(wanted, id_column, "left_semi")


def limit_random(df: DataFrame, n: int, key: str, seed: object = 0) -> DataFrame:
    return df.orderBy(*hash_order(key, seed)).limit(n)


def long_classes(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level, class: each row's key at each level."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("class")) for c in levels)))
    return df.select(pairs.alias("p")).select("p.*").where("class is not null")


def build_vocab(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level, class, idx: distinct keys in string order, numbered by ranges of keys."""
    return places(long_classes(df, levels).distinct(), ["level"], ["class"], "idx").withColumn("idx", F.col("idx").cast("int"))


def build_hierarchy(df: DataFrame, levels: Sequence[str], key: str) -> DataFrame:
    """One row a leaf: its ancestry in the row with the least key."""
    leaf, *coarse = levels
    return df.where(F.col(leaf).isNotNull()).groupBy(leaf).agg(*(F.min_by(c, key).alias(c) for c in coarse)).select(*levels)


def hierarchy_nested(hier: DataFrame, levels: Sequence[str]) -> DataFrame:
    """The coarsest key, and maps from each coarser key to its finer ones, down to sorted lists of leaves."""
    leaf, *coarse = levels
    down = coarse[::-1]
    rows = hier.groupBy(*down).agg(F.array_sort(F.collect_set(leaf)).alias("children"))
    for depth in range(len(down) - 1, 0, -1):
        pairs = F.collect_list(F.struct(down[depth], "children"))
        rows = rows.groupBy(*down[:depth]).agg(F.map_from_entries(F.array_sort(pairs) if depth == len(down) - 1 else pairs).alias("children"))
    return rows


def hierarchy_from_nested(doc: DataFrame, levels: Sequence[str]) -> DataFrame:
    leaf, *coarse = levels
    top, *down = coarse[::-1]
    rows = doc.select(top, "children")
    for n, level in enumerate(down):
        rows = rows.select(top, *down[:n], F.explode("children").alias(level, "children"))
    return rows.select(F.explode("children").alias(leaf), *coarse)


def parent_map(hier: DataFrame, vocab: DataFrame, levels: Sequence[str], strict: bool = False) -> DataFrame:
    """level, child_idx, parent_idx for adjacent levels; parent null if missing (an error if strict)."""
    out = []
    for fine, coarse in zip(levels, levels[1:], strict=False):
        child = vocab.where(F.col("level") == fine).select(F.col("class").alias(fine), F.col("idx").alias("child_idx"))
        parent = vocab.where(F.col("level") == coarse).select(F.col("class").alias(coarse), F.col("idx").alias("parent_idx"))
        edge = hier.groupBy(fine).agg(F.min(coarse).alias(coarse))
        out.append(child.join(edge, fine, "left").join(parent, coarse, "left").select(F.lit(fine).alias("level"), "child_idx", "parent_idx"))
    found = reduce(DataFrame.unionByName, out)
    if strict:
        bad = check_parents(hier, vocab, levels).where("n > 0").collect()
        if bad:
            raise ValueError(f"hierarchy: {[(r.level, r.problem, r.n) for r in bad]}")
    return found


def check_parents(hier: DataFrame, vocab: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level, problem (conflict: several parents; missing: none), n."""
    out = []
    for fine, coarse in zip(levels, levels[1:], strict=False):
        conflict = hier.groupBy(fine).agg(F.count_distinct(coarse).alias("p")).where("p > 1")
        missing = vocab.where(F.col("level") == fine).select(F.col("class").alias(fine)).join(hier.where(F.col(coarse).isNotNull()), fine, "left_anti")
        out += [d.agg(F.count("*").alias("n")).select(F.lit(fine).alias("level"), F.lit(p).alias("problem"), "n") for p, d in (("conflict", conflict), ("missing", missing))]
    return reduce(DataFrame.unionByName, out)


def taxa(hier: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level number, key, and the ancestors at and above that level (finer ones null)."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.col(c).alias("taxon"), *(F.col(x).alias(x) if m >= n else F.lit(None).cast("string").alias(x) for m, x in enumerate(levels))) for n, c in enumerate(levels))))
    return hier.select(rows.alias("t")).select("t.*").where("taxon is not null").distinct()


def lineage(hier: DataFrame, wanted: DataFrame, levels: Sequence[str]) -> DataFrame:
    return wanted.join(taxa(hier, levels), "taxon")


def invert_hierarchy(hier: DataFrame, levels: Sequence[str]) -> DataFrame:
    """child, parent edges; roots have a null parent."""
    pairs = [hier.select(F.col(a).alias("child"), F.col(b).alias("parent")) for a, b in zip(levels, levels[1:], strict=False)]
    roots = hier.select(F.col(levels[-1]).alias("child"), F.lit(None).cast("string").alias("parent"))
    return reduce(DataFrame.unionByName, [*pairs, roots]).where("child is not null").distinct()


def flatten_hierarchy(hier: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level, class in order: coarse levels first, then by key; position from 0."""
    order = F.create_map(*(F.lit(x) for n, c in enumerate(reversed(levels)) for x in (c, n)))[F.col("level")]
    rows = long_classes(hier, levels).distinct().withColumn("_depth", order)
    return places(rows, [], ["_depth", "class"], "position").select("level", "class", F.col("position").cast("int").alias("position"))


def level_of(keys: DataFrame, hier: DataFrame, levels: Sequence[str]) -> DataFrame:
    """taxon, level number (the coarsest on collision), -1 if unknown."""
    number = taxa(hier, levels).groupBy("taxon").agg(F.max("level").alias("level"))
    return keys.join(number, "taxon", "left").withColumn("level", F.coalesce("level", F.lit(-1)))


def taxon_members(df: DataFrame, levels: Sequence[str], taxon: str, n: int, key: str, seed: object = 0) -> DataFrame:
    hit = reduce(lambda a, b: a | b, [F.col(c) == taxon for c in levels])
    return limit_random(df.where(hit), n, key, seed)


def build_names(df: DataFrame, vocab: DataFrame, level: str, first: str, second: str, fallback: str, key: str) -> DataFrame:
    """class, idx, name: two name parts, else the fallback, else empty; of the row with the least key."""
    full = F.nullif(F.trim(F.concat_ws(" ", first, second)), F.lit(""))
    named = df.where(F.col(level).isNotNull()).groupBy(F.col(level).cast("string").alias("class")).agg(F.min_by(F.coalesce(full, F.col(fallback), F.lit("")), key).alias("name"))
    return vocab.where(F.col("level") == level).join(named, "class", "left").select("class", "idx", F.coalesce("name", F.lit("")).alias("name"))


def short_name(col: str) -> Column:
    return F.substring_index(F.col(col), " ", 2)


def remap_keys(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Keys replaced by mapping(old, new); `replaced` tells where."""
    joined = df.join(mapping.select(F.col("old").alias(column), "new"), column, "left")
    return joined.withColumn("replaced", F.col("new").isNotNull()).withColumn(column, F.coalesce("new", column)).drop("new")


def remap_report(remapped: DataFrame, column: str) -> DataFrame:
    """One row: rows and replaced rows of remap_keys, and how many keys were put in."""
    return remapped.agg(F.count("*").alias("rows"), F.count_if("replaced").alias("replaced"), F.count_distinct(F.when(F.col("replaced"), F.col(column))).alias("keys"))


def names_report(named: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Classes and those without a name in tables of build_names, for each of the keys if there are any."""
    return named.groupBy(*keys).agg(F.count("*").alias("classes"), F.count_if(F.col("name") == "").alias("missing"))


def resolve_names(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Left join on a name table, and whether the name was found."""
    return df.join(names.withColumn("resolved", F.lit(True)), column, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def derive_coarse(df: DataFrame, hier: DataFrame, levels: Sequence[str], orphan: str = "drop") -> DataFrame:
    """Coarser keys from the leaf; orphans are dropped or each get a parent of their own."""
    leaf, *coarse = levels
    bare = df.drop(*coarse)
    if orphan == "drop":
        return bare.join(hier.select(*levels), leaf)
    joined = bare.join(hier.select(*levels), leaf, "left")
    return joined.withColumns({c: F.coalesce(c, F.concat(F.lit("orphan:"), leaf)) for c in coarse})


def attach_truth(pred: DataFrame, catalogue: DataFrame, levels: Sequence[str], key: str) -> DataFrame:
    """The true label of each prediction's level, from the file's row with the least key; files without keys go."""
    once = catalogue.where(F.col(levels[0]).isNotNull()).groupBy("filename").agg(*(F.min_by(c, key).alias(c) for c in levels))
    label = F.coalesce(*(F.when(F.col("level") == n, F.col(c)) for n, c in enumerate(levels)))
    return pred.join(once, "filename").withColumn("truth", label).drop(*levels)


def attach_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left join; an error if any row finds no group."""
    lost = df.join(groups, key, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows have no group")
    return df.join(groups, key)


def existing_only(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    return df.join(listing.select(key), key, "left_semi")


def manifest_status() -> Column:
    return F.when(F.col("_p").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("want") == F.col("got"), "ok").otherwise("size_mismatch")


def reconcile_manifest(expected: DataFrame, present: DataFrame) -> DataFrame:
    """path, status: ok, size_mismatch, missing or extra."""
    e = expected.distinct().select("path", F.col("size").alias("want"), F.lit(1).alias("_e"))
    p = present.select("path", F.col("size").alias("got"), F.lit(1).alias("_p"))
    return e.join(p, "path", "full_outer").select("path", manifest_status().alias("status"))


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table of the warehouse in buckets of key, sorted: joins of two such tables on it shuffle neither side.

    Write a large listing so once, and compare it with every later one.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def reconcile_once_each(expected: DataFrame, present: DataFrame) -> DataFrame:
    """reconcile_manifest for bucketed tables of one row a path: no distinct, so neither side moves."""
    e = expected.select("path", F.col("size").alias("want"), F.lit(1).alias("_e"))
    p = present.select("path", F.col("size").alias("got"), F.lit(1).alias("_p"))
    return e.join(p, "path", "full_outer").select("path", manifest_status().alias("status"))


def check_manifest(status: DataFrame, most_short: int = 0) -> DataFrame:
    """status, n; an error if more than most_short paths are missing or of another size."""
    counts = status.groupBy("status").agg(F.count("*").alias("n"))
    short = counts.where(F.col("status").isin("missing", "size_mismatch")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if short > most_short:
        raise ValueError(f"{short} of the expected files are missing or of another size")
    return counts


def join_evals(runs: DataFrame, evals: DataFrame) -> DataFrame:
    """Each run's newest evaluation whose model path has the run's directory (one or more whole folders) in it.

    A path meets runs by its own stretches of folders, so this is an equi-join; of each path only the newest evaluation
    goes into it.
    """
    evals = evals.groupBy("model_path").agg(F.max("eval_name").alias("eval_name"), F.max_by("test_f1", "eval_name").alias("test_f1"))
    folders = F.filter(F.split("model_path", "/"), lambda x: x != "")
    first = lambda a: F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)))
    stretches = F.flatten(F.transform(first(folders), lambda i: F.transform(F.sequence(F.lit(1), F.size(folders) - i + 1), lambda n: F.array_join(F.slice(folders, i, n), "/"))))
    parts = evals.select("*", F.explode(F.array_distinct(stretches)).alias("_dir"))
    met = runs.withColumn("_dir", F.regexp_replace("run_dir", "^/+|/+$", "")).join(parts, "_dir")
    return met.groupBy("run_dir").agg(F.max("eval_name").alias("eval_name"), F.max_by("test_f1", "eval_name").alias("test_f1"))


def latest_matching(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("path").rlike(pattern)).agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """level, n, agreement and accuracies of two prediction sets."""
    both = a.join(b.select("instance_id", "level", F.col("prediction").alias("other")), ["instance_id", "level"])
    rate = lambda c: F.avg(c.cast("double"))
    return both.groupBy("level").agg(F.count("*").alias("n"), rate(F.col("prediction") == F.col("other")).alias("agree"), rate(F.col("prediction") == F.col("label")).alias("acc_a"), rate(F.col("other") == F.col("label")).alias("acc_b"))


def vocab_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows where two vocabularies differ: only_a, only_b or moved."""
    both = a.select("level", "class", F.col("idx").alias("idx_a")).join(b.select("level", "class", F.col("idx").alias("idx_b")), ["level", "class"], "full_outer")
    state = F.when(F.col("idx_b").isNull(), "only_a").when(F.col("idx_a").isNull(), "only_b").when(F.col("idx_a") != F.col("idx_b"), "moved")
    return both.withColumn("state", state).where("state is not null")


def broken_links(pages: DataFrame) -> DataFrame:
    """page_id, target: links to paths that no page of the table has."""
    links = pages.select("page_id", F.explode(F.expr("regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)")).alias("target")).distinct()
    there = pages.select(F.expr("regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)").alias("target")).distinct()
    return links.join(there, "target", "left_anti").select("page_id", "target")

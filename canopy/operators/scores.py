"""Scores and embeddings: prototypes, posteriors up the tree, calibration, open-set reports.

Wide scores are arrays aligned to class indices; long ones are instance_id, class_idx, score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as A
from ..functions.ordering import quantiles
from ..sources.scratch import discard, stored
from .thresholds import auroc, top1

#: Prototypes are broadcast in blocks of at most so many numbers.
BROADCAST_NUMBERS = 50_000_000
#: Score modes: what a batch's cosines (rows by prototypes) become, given the number of dimensions and a scale.
MODES: dict[str, Callable[[np.ndarray, int, float], np.ndarray]] = {
    "cosine": lambda c, dims, scale: c,
    "scaled": lambda c, dims, scale: scale * c,
    "angle": lambda c, dims, scale: np.sqrt(dims - 2) * (np.arccos(-np.clip(c, -1 + 1e-7, 1 - 1e-7)) - np.pi / 2),
}
GRID = [float(0.25 * 32 ** (i / 95)) for i in range(96)]


def to_long(df: DataFrame, column: str = "scores", keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("class_idx", "score"))


def mean_centroids(emb: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, vector: the mean of each class, normalised. Sums combine map-side, one row a class and dimension."""
    dims = emb.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = dims.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    return rows.select(label, A.l2_normalise(F.transform("v", lambda p: p["x"])).alias("vector"))


def medoids(emb: DataFrame, key: str, label: str = "label", vector: str = "embedding") -> DataFrame:
    """The row of each class nearest to its mean."""
    near = emb.join(mean_centroids(emb, label, vector), label).withColumn("cosine", F.round(A.dot(A.l2_normalise(F.col(vector)), F.col("vector")), 9))
    return near.groupBy(label).agg(F.max_by(key, F.struct("cosine", (-F.col(key)).alias("i"))).alias(key), F.max("cosine").alias("cosine"))


def summed(parts: DataFrame, keys: Sequence[str], normalised: bool = True) -> DataFrame:
    """keys, vector: the sums of partial sums (keys, vector, of which a task gives one a key), of unit length if wanted."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum(np.stack(group["vector"].to_numpy()), axis=0)
        return group.iloc[:1][list(keys)].assign(vector=[whole / max(np.linalg.norm(whole), 1e-300) if normalised else whole])

    return parts.groupBy(*keys).applyInPandas(add, parts.select(*keys, "vector").schema)


def lloyd_sums(emb: DataFrame, means: list, label: str, vector: str) -> DataFrame:
    """label, k, vector: each task's sums of its unit vectors by the nearest of these means of their class."""
    shared = emb.sparkSession.sparkContext.broadcast(means)
    kind = emb.schema[label].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for name, k, v in sorted(shared.value, key=lambda m: m[1]):
            known.setdefault(name, []).append((k, v))
        sums: dict = {}
        for frame in frames:
            for name, group in frame.groupby("label", sort=False):
                if name not in known:
                    continue
                x = unit_rows(group["vector"])
                near = np.round(x @ np.array([v for _, v in known[name]]).T, 9).argmax(1)  # of equal ones the lowest k
                for place in np.unique(near):
                    at = (name, known[name][place][0])
                    sums[at] = sums.get(at, 0) + x[near == place].sum(0)
        if sums:  # a task without rows has none, and Arrow can't tell the kind of an empty column of lists
            yield pd.DataFrame({"label": [n for n, _ in sums], "k": [k for _, k in sums], "vector": list(sums.values())})

    return emb.select(F.col(label).alias("label"), F.col(vector).alias("vector")).mapInPandas(of, f"label {kind}, k int, vector array<double>")


def unit_rows(vectors) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.empty((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def finite_rows(emb: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """The rows with a label and a vector without nulls and non-finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return emb.where(F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))


def spherical_means(emb: DataFrame, k: int, key: str, label: str = "label", vector: str = "embedding", steps: int = 10, numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """label, k, vector: k means of each class by Lloyd steps on the sphere, started from rows in hash order.

    Rows without a label or a whole finite vector (finite_rows) take no part.

    Means are broadcast in blocks of classes of at most about so many numbers. A step reads the rows once a block, keeps
    them where they are, and shuffles one sum a task and mean. A mean that loses all rows is dropped.
    """
    rows = finite_rows(emb, label, vector)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.col("key").cast("string").cast("binary")), "key")) - 1
    first = rows.select(F.col(label).alias("label"), F.col(key).alias("key"), F.col(vector).alias("x")).withColumn("k", place).where(F.col("k") < k)  # cut to k rows a task first
    means = stored(first.select("label", "k", A.l2_normalise(F.col("x")).alias("vector")))
    for _ in range(steps):
        size, dims = means.agg(F.count("*"), F.max(F.size("vector"))).first()
        blocks = max(1, -(-size * (dims or 1) // numbers))
        parts = []
        for block in range(blocks):
            own = means.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == block).collect()
            parts.append(lloyd_sums(rows, [(m["label"], m["k"], m["vector"]) for m in own], label, vector))
        new = stored(summed(reduce(DataFrame.unionByName, parts), ["label", "k"]))
        discard(means)
        means = new
    return means


def prototype_blocks(protos: DataFrame, numbers: int = BROADCAST_NUMBERS, keep_norms: bool = False) -> Iterator[tuple[list, np.ndarray]]:
    """(class indices, matrix) of blocks of at most about so many numbers; one block at a time is on the driver.

    Prototypes are taken at unit length, or as they are: a classifier whose rows have drifted from unit length ranks
    classes by length times cosine.
    """
    rows, size = protos.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-rows * (size or 1) // numbers))
    for block in range(blocks):
        found = protos.where(F.pmod(F.xxhash64("class_idx"), F.lit(blocks)) == block).orderBy("class_idx").collect()
        matrix = np.array([r["vector"] for r in found], np.float64).reshape(len(found), size or 0)
        yield [r["class_idx"] for r in found], matrix if keep_norms else matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def block_scores(emb: DataFrame, matrix: np.ndarray, key: str, vector: str, mode: str, scale: float) -> DataFrame:
    """key, scores: by one matrix product a batch with a broadcast block of prototypes."""
    if matrix.size > 2 * BROADCAST_NUMBERS:
        raise ValueError("prototypes too large for one broadcast: give them as a table, which is cut into blocks")
    shared, how = emb.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix, np.float64)), MODES[mode]
    kind = emb.schema[key].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        protos = shared.value
        for frame in frames:
            x = np.stack(frame[vector].to_numpy()).astype(np.float64) if len(frame) else np.empty((0, protos.shape[1]))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({key: frame[key].to_numpy(), "scores": list(how(x @ protos.T, protos.shape[1], scale))})

    return emb.select(key, vector).mapInPandas(of, f"`{key}` {kind}, scores array<double>")


def cosine_scores(emb: DataFrame, protos: DataFrame, key: str, vector: str = "embedding", mode: str = "cosine", scale: float = 1.0, numbers: int = BROADCAST_NUMBERS, keep_norms: bool = False) -> DataFrame:
    """instance_id, class_idx, score against every prototype (class_idx, vector), block by block; MODES names the modes.

    All scores of all rows: for a few classes. top_scores and embedding_geometry keep what they need of a batch.
    """
    return reduce(DataFrame.unionByName, long_blocks(emb, protos, key, vector, mode, scale, numbers, keep_norms))


def long_blocks(emb: DataFrame, protos: DataFrame, key: str, vector: str, mode: str, scale: float, numbers: int, keep_norms: bool) -> Iterator[DataFrame]:
    """instance_id, class_idx, score for one block of prototypes after another."""
    for classes, matrix in prototype_blocks(protos, numbers, keep_norms):
        names = F.array(*(F.lit(c) for c in classes))
        rows = to_long(block_scores(emb, matrix, key, vector, mode, scale), keys=(key,))
        yield rows.select(F.col(key).alias("instance_id"), F.get(names, F.col("class_idx")).alias("class_idx"), "score")


def score_arrays(emb: DataFrame, matrix: np.ndarray, key: str, vector: str = "embedding", mode: str = "cosine", scale: float = 1.0, numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """key, scores: the scores with every prototype, one array a row; a matrix over `numbers` is dealt with in blocks of rows."""
    step = max(1, numbers // max(1, matrix.shape[1]))
    parts = [block_scores(emb, matrix[at : at + step], key, vector, mode, scale).withColumn("block", F.lit(n)) for n, at in enumerate(range(0, max(1, len(matrix)), step))]
    if len(parts) == 1:
        return parts[0].drop("block")
    every = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "scores"))).alias("b"))
    return every.select(key, F.flatten(F.transform("b", lambda b: b["scores"])).alias("scores"))


def in_batches(emb: DataFrame, protos: DataFrame, columns: Sequence[str], vector: str, numbers: int, keep_norms: bool, kinds: str, take: Callable) -> Iterator[DataFrame]:
    """For one block of prototypes after another, take(frame, classes, scores) of each batch; scores never leave it."""
    for classes, matrix in prototype_blocks(protos, numbers, keep_norms):
        shared = emb.sparkSession.sparkContext.broadcast((classes, matrix))

        def of(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, block = shared.value
            for frame in frames:
                if len(frame) and len(names):
                    yield take(frame, np.asarray(names), unit_rows(frame["vector"]) @ block.T)

        yield emb.select(*columns, F.col(vector).alias("vector")).mapInPandas(of, kinds)


def top_scores(emb: DataFrame, protos: DataFrame, key: str, k: int, vector: str = "embedding", numbers: int = BROADCAST_NUMBERS, keep_norms: bool = False) -> DataFrame:
    """instance_id, class_idx, score, place: each row's k best classes, of equal scores the lowest index; a batch keeps its
    k best, and the blocks' are merged."""
    kind, own = (d.schema[c].dataType.simpleString() for d, c in ((emb, key), (protos, "class_idx")))

    def take(frame: pd.DataFrame, names: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"instance_id": np.repeat(frame[key].to_numpy(), best.shape[1]), "class_idx": names[best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()})

    found = list(in_batches(emb, protos, [key], vector, numbers, keep_norms, f"instance_id {kind}, class_idx {own}, score double", take))
    place = F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("score"), "class_idx"))
    return reduce(DataFrame.unionByName, found).withColumn("place", place).where(F.col("place") <= k)


def nearest_centroid(emb: DataFrame, protos: DataFrame, key: str, vector: str = "embedding", numbers: int = BROADCAST_NUMBERS, keep_norms: bool = False) -> DataFrame:
    """instance_id, class_idx, score of the most similar prototype."""
    return top_scores(emb, protos, key, 1, vector, numbers, keep_norms).drop("place")


def score_table(df: DataFrame, model: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], key: str, columns: Sequence[str]) -> DataFrame:
    """Batch inference by a function of a frame; only the best class and its score leave a batch."""
    kind = df.schema[key].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best, score = model(frame[list(columns)])
            yield pd.DataFrame({key: frame[key].to_numpy(), "class_idx": best.astype(np.int32), "score": score.astype(float)})

    return df.select(key, *columns).mapInPandas(of, f"{key} {kind}, class_idx int, score double")


def embedding_geometry(emb: DataFrame, protos: DataFrame, key: str, label: str = "label", vector: str = "embedding", numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """label, own, other, margin: mean cosine to the own prototype, to the nearest other one, and the difference.

    A batch keeps two numbers a row; with one block of prototypes rows aren't shuffled at all.
    """
    kinds = ", ".join(f"`{c}` {emb.schema[c].dataType.simpleString()}" for c in (key, label))

    def take(frame: pd.DataFrame, names: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        at = pd.Index(names).get_indexer(frame[label])
        own = np.where(at >= 0, scores[np.arange(len(scores)), at], np.nan)
        scores[np.flatnonzero(at >= 0), at[at >= 0]] = -np.inf
        other = scores.max(1)
        return frame[[key, label]].assign(own=own, other=np.where(np.isfinite(other), other, np.nan))

    found = list(in_batches(emb.where(F.col(label).isNotNull()), protos, [key, label], vector, numbers, False, f"{kinds}, own double, other double", take))
    each = reduce(DataFrame.unionByName, found).select(key, label, *(F.nanvl(c, F.lit(None)).alias(c) for c in ("own", "other")))
    if len(found) > 1:
        each = each.groupBy(key, label).agg(F.max("own").alias("own"), F.max("other").alias("other"))
    return each.groupBy(F.col(label).alias("label")).agg(F.avg("own").alias("own"), F.avg("other").alias("other"), F.avg(F.col("own") - F.col("other")).alias("margin"))


def prototype_norms(protos: DataFrame) -> DataFrame:
    """One row: least, largest and mean length of the prototypes, and its standard deviation."""
    norm = F.sqrt(A.dot(F.col("vector"), F.col("vector")))
    return protos.select(norm.alias("x")).agg(F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.stddev("x").alias("deviation"))


def silhouette(emb: DataFrame, label: str = "label", vector: str = "embedding") -> float:
    """Mean cosine silhouette of the classes."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = emb.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("int").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(data)


def gram(vectors: DataFrame, vector: str = "vector") -> tuple[np.ndarray, int]:
    """The matrix of sums of products of two components, as large as a vector squared, and the number of rows.

    Each task sums its batches' products; rows of these matrices are summed by Spark.
    """

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, rows = None, 0
        for frame in frames:
            if len(frame):
                x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
                whole, rows = x.T @ x if whole is None else whole + x.T @ x, rows + len(x)
        if whole is not None:
            yield pd.DataFrame({"i": range(len(whole)), "n": rows, "vector": list(whole)})

    parts = vectors.select(F.col(vector).alias("vector")).where("vector is not null").mapInPandas(products, "i int, n long, vector array<double>")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "n": [group["n"].sum()], "vector": [np.sum(np.stack(group["vector"].to_numpy()), axis=0)]})

    found = parts.groupBy("i").applyInPandas(add, "i int, n long, vector array<double>").orderBy("i").collect()
    return np.array([r["vector"] for r in found], np.float64).reshape(len(found), len(found)), found[0]["n"] if found else 0


def spectrum(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """rank, value, energy: singular values of the class table's vectors and the share of energy up to each.

    They are the roots of the eigenvalues of the Gram matrix.
    """
    matrix, rows = gram(vectors, vector)
    squares = np.maximum(np.linalg.eigvalsh(matrix)[::-1][: min(len(matrix), rows)], 0) if rows else np.empty(0)
    energy = np.cumsum(squares) / max(squares.sum(), 1e-300)
    made = [(n, float(np.sqrt(s)), float(e)) for n, (s, e) in enumerate(zip(squares, energy, strict=True))]
    return vectors.sparkSession.createDataFrame(made, "rank int, value double, energy double")


def spectrum_summary(values: DataFrame) -> DataFrame:
    """One row: ranks for 90 and 99 % of the energy, and the participation ratio (sum of values)^2 / sum of their squares."""
    ranks = [(F.min(F.when(F.col("energy") >= q - 1e-12, F.col("rank"))) + 1).alias(f"rank_{int(100 * q)}") for q in (0.9, 0.99)]
    return values.agg(*ranks, (F.pow(F.sum("value"), F.lit(2.0)) / F.sum(F.col("value") * F.col("value"))).alias("participation"))


def truncated(protos: DataFrame, rank: int, axes: np.ndarray | None = None) -> DataFrame:
    """class_idx, vector: the prototypes cut to their leading `rank` singular directions.

    Each row is projected on the leading eigenvectors of the Gram matrix, which are broadcast: a vector times `rank`
    numbers. axes: those of leading_axes, to save working them out again.
    """
    axes = leading_axes(protos) if axes is None else axes
    shared = protos.sparkSession.sparkContext.broadcast(np.ascontiguousarray(axes[:, :rank]))
    kind = protos.schema["class_idx"].dataType.simpleString()

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"class_idx": frame["class_idx"], "vector": list(x @ shared.value @ shared.value.T)})

    return protos.select("class_idx", "vector").mapInPandas(project, f"class_idx {kind}, vector array<double>")


def leading_axes(vectors: DataFrame, vector: str = "vector") -> np.ndarray:
    """The singular directions as columns, the strongest first."""
    matrix, _ = gram(vectors, vector)
    return np.linalg.eigh(matrix)[1][:, ::-1] if len(matrix) else matrix


def retrain_classifier(emb: DataFrame, label: str = "label", vector: str = "embedding", weight: str | None = None, **settings):
    """A multinomial logistic regression on frozen embeddings."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = emb.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", **({"weightCol": weight} if weight else {}), **settings)
    return model.fit(data)


def average_views(scores: DataFrame, base: str | None = None, beta: float = 1.0) -> DataFrame:
    """Mean posterior over an instance's views: instance_id, class_idx, score; base marks the plain view to blend."""
    if base is None:
        return scores.groupBy("instance_id", "class_idx").agg(F.avg("score").alias("score"))
    plain, other = F.avg(F.when(F.col(base), F.col("score"))), F.avg(F.when(~F.col(base), F.col("score")))
    return scores.groupBy("instance_id", "class_idx").agg(((1 - beta) * plain + beta * F.coalesce(other, plain)).alias("score"))


def marginalise(scores: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent log-probabilities: logsumexp over children, with the largest taken out first."""
    joined = scores.join(parents.select(F.col("child_idx").alias("class_idx"), "parent_idx"), "class_idx")
    top = joined.groupBy("instance_id", "parent_idx").agg(F.max("score").alias("top"), F.collect_list("score").alias("all"))
    return top.select("instance_id", F.col("parent_idx").alias("class_idx"), (F.col("top") + F.ln(A.total(F.transform("all", lambda x: F.exp(x - F.col("top")))))).alias("score"))


def condition_on_parent(scores: DataFrame, parent_scores: DataFrame, parents: DataFrame) -> DataFrame:
    """Scores among siblings, plus the parent's own score."""
    rows = scores.join(parents.select(F.col("child_idx").alias("class_idx"), "parent_idx"), "class_idx")
    among = Window.partitionBy("instance_id", "parent_idx")
    top = F.max("score").over(among)
    rows = rows.withColumn("top", top).withColumn("lse", F.col("top") + F.ln(F.sum(F.exp(F.col("score") - F.col("top"))).over(among)))
    up = parent_scores.select("instance_id", F.col("class_idx").alias("parent_idx"), F.col("score").alias("up"))
    return rows.join(up, ["instance_id", "parent_idx"]).select("instance_id", "class_idx", (F.col("score") + F.col("up") - F.col("lse")).alias("score"))


def calibration_stats(df: DataFrame, scores: str = "scores", label: str = "label_idx") -> DataFrame:
    """instance_id, top1_idx, top1, true_logit and logsumexp(z / T) on the grid of temperatures."""
    grid = F.array(*(F.lit(t) for t in GRID))
    z = F.col(scores)
    return df.select("instance_id", A.argmax(z).alias("top1_idx"), F.array_max(z).alias("top1"), F.get(z, F.col(label)).alias("true_logit"), (A.argmax(z) == F.col(label)).alias("correct"), F.transform(grid, lambda t: A.logsumexp(F.transform(z, lambda x: x / t))).alias("lse"))


def temperature_losses(stats: DataFrame) -> DataFrame:
    """t_idx, temperature, mean negative log-likelihood."""
    rows = stats.select("true_logit", F.posexplode("lse").alias("t_idx", "l"))
    grid = F.array(*(F.lit(t) for t in GRID))
    t = F.get(grid, F.col("t_idx"))
    return rows.groupBy("t_idx").agg(F.avg(F.col("l") - F.col("true_logit") / t).alias("nll")).withColumn("temperature", t)


def fit_temperature(stats: DataFrame) -> DataFrame:
    return temperature_losses(stats).agg(F.min_by("temperature", "nll").alias("temperature"), F.min("nll").alias("nll"))


def calibrated_confidence(stats: DataFrame, t_idx: int) -> DataFrame:
    return stats.withColumn("confidence", F.exp(F.col("top1") / GRID[t_idx] - F.get("lse", F.lit(t_idx))))


def novelty_scores(df: DataFrame, scores: str = "scores", rules: dict | None = None) -> DataFrame:
    """Long: all other columns, rule, score."""
    rules = rules or A.NOVELTY
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), f(F.col(scores)).alias("score")) for k, f in rules.items())))
    return df.withColumn("_p", pairs).select(*(c for c in df.columns if c != scores), "_p.*")


def degenerate_rules(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Whether every row is already normalised, which makes energy a constant."""
    return df.agg(F.bool_and(F.abs(A.logsumexp(F.col(scores))) < 1e-3).alias("normalised"), F.count("*").alias("n"))


def openset_report(rows: DataFrame) -> DataFrame:
    """From rule, score (rounded by the caller), stratum: AUROC of each novel stratum, and of all, against the known."""
    novel = rows.where("stratum <> 'known'").select("rule", "score", F.explode(F.array("stratum", F.lit("all"))).alias("against"), F.lit(True).alias("positive"))
    kinds = novel.select("rule", "against").distinct()
    known = rows.where("stratum = 'known'").select("rule", "score", F.lit(False).alias("positive")).join(kinds, "rule")
    return auroc(novel.unionByName(known.select("rule", "score", "against", "positive")), ["rule", "against"])


def openset_summary(rows: DataFrame) -> DataFrame:
    """rule, auroc of all novel against known, means and deviations of both sides' scores, and whether no live rule is better.

    A rule is live if its scores differ at all.
    """
    novel = F.col("stratum") != "known"
    sides = [f(F.when(side, F.col("score"))).alias(f"{kind}_{name}") for kind, side in (("known", ~novel), ("novel", novel)) for name, f in (("mean", F.avg), ("std", F.stddev))]
    each = rows.groupBy("rule").agg((F.max("score") > F.min("score")).alias("live"), *sides)
    found = each.join(openset_report(rows).where("against = 'all'").select("rule", "auroc"), "rule")
    best = found.where("live").agg(F.max("auroc").alias("_best"))
    return found.crossJoin(F.broadcast(best)).withColumn("best", F.col("live") & (F.col("auroc") == F.col("_best"))).drop("_best")  # one row


def adjust_logits(df: DataFrame, prior: Column, tau: float, scores: str = "scores") -> DataFrame:
    return df.withColumn(scores, F.zip_with(scores, prior, lambda x, p: x + tau * p))


def level_log_loss(df: DataFrame, smoothing: float, level: int, scores: str = "scores", label: str = "label_idx") -> DataFrame:
    """Mean cross entropy with the level's share of the smoothing, 1 - (1 - s) ** (1 / (level + 1))."""
    ls = 1 - (1 - smoothing) ** (1 / (level + 1))
    z = F.col(scores)
    loss = A.logsumexp(z) - ((1 - ls) * F.get(z, F.col(label)) + ls * A.total(z) / F.size(z))
    return df.agg(F.avg(loss).alias("loss"))


def posterior_kl(df: DataFrame, temperature: float, student: str = "student", teacher: str = "teacher") -> DataFrame:
    """Mean T^2 KL(teacher || student)."""
    cool = lambda c: A.log_softmax(F.transform(F.col(c), lambda x: x / temperature))
    both = df.select(cool(teacher).alias("t"), cool(student).alias("s"))
    return both.agg((F.avg(A.total(F.zip_with("t", "s", lambda t, s: F.exp(t) * (t - s)))) * temperature**2).alias("kl"))


def saturation_rates(df: DataFrame, limit: float, scores: str = "scores") -> DataFrame:
    z = F.col(scores)
    high = F.size(F.filter(z, lambda x: x >= limit))
    return df.agg((F.sum(high) / F.sum(F.size(z))).alias("all_scores"), F.avg((F.array_max(z) >= limit).cast("double")).alias("top1"), F.avg((high >= 2).cast("double")).alias("several"))


def top1_quantiles(df: DataFrame, shares: Sequence[float] = (0.5, 0.9, 0.99), scores: str = "scores") -> DataFrame:
    """One row, q0, q1, ...: quantiles of each row's largest score."""
    return quantiles(df.select(F.array_max(scores).alias("top")), "top", shares)


def split_levels(df: DataFrame, level_idx: Sequence[int], scores: str = "scores") -> DataFrame:
    """One flat score vector cut into vectors by level; long result with each level's best class."""
    levels = F.array(*(F.lit(x) for x in level_idx))
    rows = to_long(df, scores).withColumn("level", F.get(levels, F.col("class_idx")))
    best = F.struct("score", (-F.col("class_idx")).alias("i"))
    return rows.groupBy("instance_id", "level").agg(F.max_by("class_idx", best).alias("class_idx"), F.max("score").alias("score"))

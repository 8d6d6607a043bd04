r"""Hard-negative mining (11): anchors in a spanning tree bound each other's scores.

A score is the inner product of integer vectors. An anchor's score with a row differs from its tree parent's score with
that row by at most the length of the edge between the two anchors times the row's norm. So a parent's scores (or the
bounds of scores that weren't needed there) bound its child's, and only rows whose bounds overlap what the child looks
for are scored. Anchors come in blocks of at most `anchors_block`, each with its minimum spanning tree; rows come in
blocks of `rows_block`; a task takes one block of rows with one block of anchors. No table of pairs exists.

First pass: each anchor's best rows of its own label; the window is open above its best ones so far. Second pass: for
each of these positives the best rows of other labels between `low` and `high` per cent of its score; the windows'
lower ends rise to the worst of the rows found so far. Each task gives a bounded number of rows for an anchor, and the
best of all tasks are taken.

Blocks of rows are packed where the rows are read, so that no key or group is gathered; distinct anchors are dealt by
hash. Scores are computed in floating point where it is exact (all partial sums below 2^53), else in whole numbers of
any size; a score beyond 64 bits is an error.

Ids and labels are whole numbers. Results for special cases: rows with a null label, a null vector or any null or non-finite component take no part, nor
do rows without an id; a shorter vector counts as ending in zeros. Repeated rows are rows of their own: an anchor's
copies are other rows of its label, and each copy of an anchor row gives its results. Fewer rows than asked for are all
returned. Ties go by the smaller id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, stored

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
ROWS_BLOCK, ANCHORS_BLOCK = 8192, 4096
EXACT = 2.0**53
PACKED = "block long, ids binary, labels binary, dims int, vectors binary"
TREE = "copies array<long>, order array<int>, parent array<int>, length array<double>"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """id, label, v (array<long>, floor(scale * x)): the rows that take part."""
    whole = F.col("vector").cast("array<double>")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole.isNotNull() & finite).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(whole, lambda x: F.floor(x * scale)).alias("v"))


def matrix(vectors) -> np.ndarray:
    dims = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), dims), np.int64)
    for n, v in enumerate(vectors):
        out[n, : len(v)] = v
    return out


def packed(df: DataFrame, rows: int, tree: bool = False) -> DataFrame:
    """Blocks of at most so many rows of one partition, as binary columns; tree: with their number of copies and spanning tree."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, waiting, size, made = TaskContext.get().partitionId(), [], 0, 0

        def block(frame: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(frame["id"].to_numpy(), kind="stable")
            v = matrix(frame["v"].tolist())[order]
            own = {"ids": frame["id"].to_numpy(np.int64)[order], "labels": frame["label"].to_numpy(np.int64)[order]}
            out = pd.DataFrame({"block": [(part << 32) + made], **{k: [x.tobytes()] for k, x in own.items()}, "dims": [v.shape[1]], "vectors": [np.ascontiguousarray(v).tobytes()]})
            if tree:
                at, parent, length = spanning_tree(v)
                out = out.assign(copies=[frame["copies"].to_numpy(np.int64)[order]], order=[at], parent=[parent], length=[length])
            return out

        for frame in frames:
            waiting.append(frame)
            size += len(frame)
            if size >= rows:
                whole = pd.concat(waiting)
                for a in range(0, size - size % rows, rows):
                    yield block(whole.iloc[a : a + rows])
                    made += 1
                waiting, size = ([whole.iloc[size - size % rows :]], size % rows) if size % rows else ([], 0)
        if size:
            yield block(pd.concat(waiting))

    return df.mapInPandas(pack, f"{PACKED}, {TREE}" if tree else PACKED)


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64), np.frombuffer(row.vectors, np.int64).reshape(-1, row.dims) if row.dims else np.zeros((len(row.ids) // 8, 0), np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """(order, parent, length): a minimum spanning tree, parents first; the root's parent is -1."""
    n = len(vectors)
    if not n:
        return [], [], []
    v = vectors.astype(np.float64)
    norms = (v * v).sum(1)
    order, parent, length = [], np.full(n, -1), np.zeros(n)
    near, best = np.full(n, -1), np.full(n, np.inf)
    best[0] = 0
    left = np.ones(n, bool)
    for _ in range(n):
        at = int(np.argmin(np.where(left, best, np.inf)))
        order.append(at)
        left[at] = False
        parent[at], length[at] = near[at], math.sqrt(max(best[at], 0.0))
        far = norms + norms[at] - 2 * (v @ v[at])
        closer = left & (far < best)
        best[closer], near[closer] = far[closer], at
    return order, parent.tolist(), length.tolist()


class Scores:
    """The scores of a block of rows with the anchors of a tree, as far as they are asked for."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, tree):
        dims = max(rows.shape[1], anchors.shape[1])
        self.rows, self.anchors = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (rows, anchors))
        most = float(np.abs(self.rows).max(initial=0)) * float(np.abs(self.anchors).max(initial=0)) * max(1, dims)
        kind = np.float64 if most < EXACT else object
        self.rows, self.anchors = self.rows.astype(kind), self.anchors.astype(kind)
        plain = rows.astype(np.float64)
        self.norm = np.sqrt((plain * plain).sum(1)) * (1 + 1e-9)
        self.slack = 1 + most * 1e-12
        self.order, self.parent, self.length = list(tree.order), list(tree.parent), list(tree.length)
        self.children = np.bincount([p for p in self.parent if p >= 0], minlength=len(self.parent))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def at(self, anchor: int, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their exact scores: those for which wanted(low, high) holds. Ask for anchors in the tree's order."""
        parent = self.parent[anchor]
        if parent < 0:
            reach = self.norm * (np.sqrt((self.anchors[anchor].astype(np.float64) ** 2).sum()) * (1 + 1e-9)) + self.slack
            low, high = -reach, reach
        else:
            reach = self.norm * (self.length[anchor] * (1 + 1e-9) + 1e-6) + self.slack
            low, high = self.known[parent]
            low, high = low - reach, high + reach
            self.children[parent] -= 1
            if not self.children[parent]:
                del self.known[parent]
        found = np.flatnonzero(wanted(low, high))
        exact = self.rows[found] @ self.anchors[anchor] if len(found) else np.empty(0)
        self.scored += len(found)
        if self.children[anchor]:
            low, high = low.copy(), high.copy()
            low[found] = high[found] = exact.astype(np.float64)
            self.known[anchor] = low, high
        return found, exact


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by the smaller id (ids ascend)."""
    if len(scores) > 4 * n and scores.dtype != object:
        least = np.partition(scores, -n)[-n]
        over = np.flatnonzero(scores > least)
        equal = np.flatnonzero(scores == least)[:n]
        pick = np.concatenate([over, equal])
        return pick[np.lexsort((ids[pick], -scores[pick]))][:n]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:n], np.int64)


def joined_blocks(anchors: DataFrame, blocks: DataFrame) -> tuple:
    """Both tables grouped by pairs of a group of anchor blocks and one of row blocks, about a block in each."""
    n_anchors, n_blocks = max(1, anchors.count()), max(1, blocks.count())
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", group(n_anchors).alias("b"), each(n_blocks).alias("g"))
    right = blocks.select("*", each(n_anchors).alias("b"), group(n_blocks).alias("g"))
    return left.groupBy("b", "g"), right.groupBy("b", "g")


def label_positives(anchors: DataFrame, blocks: DataFrame, positives: int) -> DataFrame:
    """block, pos, anchor_id, copies, p (from 1), id, score: each anchor's best other rows of its label."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in left.itertuples():
            names, own, vectors = unpacked(a)
            runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for r in right.itertuples():
                ids, labels, rows = unpacked(r)
                scores = Scores(rows, vectors, a)
                for at in scores.order:
                    same = labels == own[at]

                    def wanted(low, high, same=same, found=runs.get(at)):
                        least = low[same]
                        least = np.partition(least, -positives - 1)[-positives - 1] if len(least) > positives + 1 else -np.inf
                        if found is not None and len(found[1]) > positives:
                            least = max(least, float(found[1][-1]))
                        return same & (high >= least)

                    found, exact = scores.at(at, wanted)
                    runs[at] = merged(runs.get(at), ids[found[same[found]]], exact[same[found]], positives + 1)
                own_scores = (scores.anchors * scores.anchors).sum(1)
            out += [(a.block, at, int(names[at]), int(own_scores[at]), int(i), int(s)) for at, (found, exact) in runs.items() for i, s in zip(found.tolist(), exact.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["block", "pos", "anchor_id", "own", "id", "score"])

    left, right = joined_blocks(anchors, blocks)
    found = left.cogroup(right).applyInPandas(work, "block long, pos int, anchor_id long, own long, id long, score long")
    order = [F.col("score").desc(), F.col("id")]
    first = found.withColumn("p", F.row_number().over(Window.partitionBy("block", "pos").orderBy(*order))).where(F.col("p") <= positives + 1)
    itself = (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    others = first.withColumns({"self": itself, "nth": F.row_number().over(Window.partitionBy("block", "pos", itself).orderBy("p"))}).where(~(F.col("self") & (F.col("nth") == 1)))
    return others.withColumn("p", F.row_number().over(Window.partitionBy("block", "pos").orderBy(*order))).where(F.col("p") <= positives).select("block", "pos", "anchor_id", "p", "id", "score")


def merged(before: tuple | None, ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best of what was found before and now, the best first."""
    if before is not None:
        ids, scores = np.concatenate([before[0], ids]), np.concatenate([before[1], scores])
    pick = best(scores, ids, n)
    return ids[pick], scores[pick]


def window_negatives(anchors: DataFrame, blocks: DataFrame, positives: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """block, pos, p, id, score: for each positive the best rows of other labels in its window, those of each task."""
    wanted_scores = positives.groupBy("block").agg(F.collect_list(F.struct("pos", "p", "score")).alias("windows"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in left.itertuples():
            _, own, vectors = unpacked(a)
            windows: dict[int, list[tuple[int, int, int]]] = {}
            for w in a.windows:
                windows.setdefault(w["pos"], []).append((w["p"], -(-low * w["score"] // 100), high * w["score"] // 100))
            runs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for r in right.itertuples():
                ids, labels, rows = unpacked(r)
                scores = Scores(rows, vectors, a)
                for at in scores.order:
                    other = labels != own[at]

                    def wanted(least, most, other=other, at=at):
                        over = np.zeros(len(other), bool)
                        for p, bottom, top in windows.get(at, ()):
                            sure = least[other & (least >= bottom) & (most <= top)]
                            if len(sure) > negatives:
                                bottom = max(bottom, np.partition(sure, -negatives)[-negatives])
                            if (at, p) in runs and len(runs[at, p][1]) == negatives:
                                bottom = max(bottom, runs[at, p][1][-1])
                            over |= (most >= bottom) & (least <= top)
                        return over & other

                    found, exact = scores.at(at, wanted)
                    for p, bottom, top in windows.get(at, ()):
                        inside = (exact >= bottom) & (exact <= top)
                        runs[at, p] = merged(runs.get((at, p)), ids[found[inside]], exact[inside], negatives)
            out += [(a.block, at, p, int(i), int(s)) for (at, p), (found, exact) in runs.items() for i, s in zip(found.tolist(), exact.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["block", "pos", "p", "id", "score"])

    left, right = joined_blocks(anchors.join(wanted_scores, "block"), blocks)
    return left.cogroup(right).applyInPandas(work, "block long, pos int, p int, id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, id_column: str = "id", label_column: str = "label", vector_column: str = "vector", scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, rows_block: int = ROWS_BLOCK, anchors_block: int = ANCHORS_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor is a condition on vectors."""
    named = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = usable(named, scale)
    chosen = stored(usable(named.where("anchor"), scale).groupBy("id", "label", "v").agg(F.count("*").alias("copies")))
    parts = math.ceil(chosen.count() / anchors_block) or 1
    anchors = stored(packed(chosen.repartition(parts), anchors_block, tree=True))
    blocks = stored(packed(rows, rows_block))
    best_own = stored(label_positives(anchors, blocks, positives))
    found = window_negatives(anchors, blocks, best_own, negatives, low, high)
    order = Window.partitionBy("block", "pos", "p").orderBy(F.col("score").desc(), F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    told = best_own.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(ranked, ["block", "pos", "p"])
    copies = anchors.select("block", F.posexplode("copies").alias("pos", "copies")).where("copies > 1")
    told = told.join(copies, ["block", "pos"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("copies"), F.lit(1)))))
    out = stored(told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(chosen, anchors, blocks, best_own)
    return out


def sql(scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> str:
    """The same rows for the query's anchors and labels, all scores computed."""
    return f"""WITH rows_ AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 pairs AS (SELECT a.rid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM rows_ a, rows_ b WHERE a.vec_id % 100 = 0 AND a.rid <> b.rid),
 pos AS (SELECT rid, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, other) AS p FROM pairs WHERE same QUALIFY p <= {positives})
SELECT pos.anchor_id, positive_id, row_number() OVER (PARTITION BY pos.rid, p ORDER BY score DESC, other) AS rank, other AS negative_id, positive_score, score AS negative_score FROM pos JOIN pairs ON pos.rid = pairs.rid AND NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score QUALIFY rank <= {negatives}"""

r"""Quality classifier (3): nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words in lower case, the shapes of its words (letters, capitals, digits and other signs, runs
shortened), pairs of neighbouring shapes, and how much of the text repeats words, lines and word pairs, in tenths. Terms
are hashed, weighted by log count and inverse document frequency, and projected on the leading singular vectors of the
labelled texts' term matrix. Those labelled vectors (at most `neighbours` of them, at most `width` numbers each, so a
proven bound) are broadcast. Every text gets its exact cosine with every one of them in blocks; the `votes` nearest
vote with their similarity as weight.

Neither labels, lang, source nor id are inputs of a score. The labelled rows used are the `neighbours` least by md5 of
the id, a documented bound; if fewer exist all are used.

Results for special cases: null or empty text has no terms and gets the share of label 1 among the labelled rows;
without any labelled row all scores are 0.5. Several labels for one id count as their mean, at least a half being 1;
null labels are left out. If a labelled id has several texts, the least of them in string order is learnt from. Repeated rows get repeated results. Other columns are ignored.
"""

from __future__ import annotations

import array
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import discard, stored, whole_text, worker_memo

TERMS, WIDTH, NEIGHBOURS, VOTES = 4096, 48, 4096, 25
MEMO_TERMS = 400_000
SHAPE = {**{c: "a" for c in range(ord("a"), ord("z") + 1)}, **{c: "A" for c in range(ord("A"), ord("Z") + 1)}, **{c: "0" for c in range(ord("0"), ord("9") + 1)}}
SHAPE |= {c: ("a" if chr(c).islower() else "A") for c in range(0xC0, 0x250) if chr(c).isalpha()}
RUNS = re.compile(r"(.)\1+")


def band(rate: float) -> int:
    return min(10, int(rate * 10 + 0.999))


def hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each token in lower case, and of its shape."""
    import xxhash

    words, shapes = worker_memo("hash of word"), worker_memo("hash of shape")
    if len(words) > MEMO_TERMS:
        words.clear(), shapes.clear()
    for token in {t for t in tokens if t not in words}:
        words[token] = xxhash.xxh64_intdigest(token.lower())
        shapes[token] = xxhash.xxh64_intdigest(RUNS.sub(r"\1", token.translate(SHAPE)), 1)
    return np.frombuffer(array.array("Q", map(words.__getitem__, tokens)), np.uint64), np.frombuffer(array.array("Q", map(shapes.__getitem__, tokens)), np.uint64)


def paired(each: np.ndarray) -> np.ndarray:
    """Hashes of neighbours."""
    mixed = each[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ each[1:]
    return mixed ^ mixed >> np.uint64(31)


def repeats(words: np.ndarray, text: str) -> list[tuple[str, int]]:
    """(term, number of times): tenths of the words that repeat the one before, of repeated lines, and of word pairs found twice."""
    lines = [x for x in text.split("\n") if x.strip()]
    times = np.unique(paired(words), return_counts=True)[1]
    doubled, weight = int((words[1:] == words[:-1]).sum()), max(1, len(words) // 4)
    rates = doubled / len(words), 1 - len(set(lines)) / max(1, len(lines)), int(times[times > 1].sum()) / max(1, len(words) - 1)
    return [*((f"{name} {band(rate)}", weight) for name, rate in zip(("words", "lines", "pairs"), rates, strict=True)), (f"size {len(words).bit_length()}", 1)]


def term_matrix(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        tokens = text.split()
        if tokens:
            words, shapes = hashes(tokens)
            row += np.bincount((np.concatenate([words, shapes, paired(shapes)]) % np.uint64(TERMS)).astype(np.int64), minlength=TERMS)
            for term, n in repeats(words, text):
                row[zlib.crc32(term.encode()) % TERMS] += n
    return np.log1p(out)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def learnt(counts: np.ndarray, labels: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Term weights, leading singular axes (by subspace iteration), vectors and labels of the labelled texts."""
    weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    rows = unit(counts * weight)
    axes = np.random.default_rng(1).normal(size=(counts.shape[1], min(width + 16, *counts.shape))).astype(np.float32)
    for _ in range(4):
        axes, _ = np.linalg.qr(rows.T @ (rows @ axes))
    axes = (axes @ np.linalg.svd(rows @ axes, full_matrices=False)[2].T)[:, :width]
    return weight, axes, unit(rows @ axes), labels.astype(np.float32)


def votes_for(known: tuple[np.ndarray, ...], counts: np.ndarray, votes: int, block: int = 1024) -> np.ndarray:
    """Scores of rows of a term matrix; blocks of labelled vectors one after another, keeping each row's nearest so far."""
    weight, axes, vectors, labels = known
    rows, votes = unit(unit(counts * weight) @ axes), min(votes, len(labels))
    near = said = np.full((len(rows), 0), 0, np.float32)
    for start in range(0, len(vectors), block):
        part = labels[start : start + block]
        near = np.concatenate([near, rows @ vectors[start : start + block].T], 1)
        said = np.concatenate([said, np.broadcast_to(part, (len(rows), len(part)))], 1)
        if near.shape[1] > votes:
            best = np.argpartition(-near, votes - 1, axis=1)[:, :votes]
            near, said = np.take_along_axis(near, best, 1), np.take_along_axis(said, best, 1)
    share, near = float(labels.mean()), np.maximum(near, 0).astype(np.float64)
    total = near.sum(1)
    scored = np.where(total > 0, (near * said).sum(1) / np.maximum(total, 1e-12), share)
    return np.where(counts.any(1), np.clip(scored, 0, 1), share)


def fit(docs: DataFrame, labels: DataFrame, neighbours: int, width: int, id_column: str, label_column: str) -> tuple[np.ndarray, ...] | None:
    """From the labelled rows given; reads the texts of at most `neighbours` of them."""
    one = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.avg(label_column).alias("label"))
    some = stored(one.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(neighbours))

    @F.pandas_udf("place array<short>, value array<float>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        rows = term_matrix(texts.tolist())
        return pd.DataFrame({"place": [np.flatnonzero(r).astype(np.int16) for r in rows], "value": [r[r > 0] for r in rows]})

    texts = docs.select(F.col(id_column).alias("id"), whole_text().alias("text")).join(some, "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = texts.select("id", "label", sparse("text").alias("t")).select("id", "label", "t.*").toPandas().sort_values("id")
    discard(some)
    if not len(rows):
        return None
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, (place, value) in enumerate(zip(rows["place"], rows["value"], strict=True)):
        counts[i, np.asarray(place, int)] = value
    return learnt(counts, (rows["label"].to_numpy() >= 0.5).astype(float), width)


def vote(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, width: int = WIDTH, votes: int = VOTES, id_column: str = "doc_id", label_column: str = "quality") -> DataFrame:
    """id, score: the similarity-weighted share of label 1 among the nearest labelled texts."""
    found = fit(docs, labels, neighbours, width, id_column, label_column)
    if found is None:
        return docs.select(id_column, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = texts.tolist()
        return pd.Series(np.concatenate([votes_for(shared.value, term_matrix(rows[i : i + 256]), votes) for i in range(0, len(rows), 256)] or [np.empty(0)]))

    return docs.select(id_column, score(whole_text()).alias("score"))


def learnable(id_column: str = "doc_id") -> Column:
    """The fold that labels may be learnt from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 != 1

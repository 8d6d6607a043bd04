r"""N-gram Jaccard join (1): a chosen-path join of word-shingle sets.

A text's set holds the hashes of its runs of five words (of all its words if it has fewer). Equal sets are one
representative with a number of copies. Each set has 64 min-hash coordinates; two sets agree in a coordinate with
probability equal to their Jaccard similarity. A run starts with all representatives in one bucket and splits it on
coordinates that the bucket's name selects: one coordinate, and a second one a quarter of the time, 1 / 0.8 on
average. A child holds those that have the same value there. Buckets of at most `small` sets are compared by brute force,
larger ones split again, until `depth` splits or until a child keeps more than half of its parent (then its sets are
alike and splitting gains nothing). The first splits of the runs are on coordinates of their own, two of them in every
fourth run. Runs are repeated until a pair at the threshold meets with `recall` in buckets split as often as the
table's were at most: those for three splits take place at once, more follow if a bucket was split again. Runs share
coordinates further down and so aren't independent; hence their number comes from playing them through.

Comparing is exact, on whole sets read anew from the texts, which are shuffled in compressed form; a text whose set is
alone in all its buckets has nothing to be compared with and stays where it is. A bucket over `block` sets is cut into blocks and each
pair of blocks is a task of its own. A pair counts only in the first of the buckets that its two sets share, so links
are counted once and no table of pairs exists. Each task gives a row for each set: its links there, and one edge to
the smallest set that it is connected to there; classes are the connected components of those edges.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.

Results for special cases: null, empty and blank texts have no words: no links, each a class of its own. Equal texts
(and repeated rows) link to each other. The class id is the smallest id of the class. If an id stands for several
texts, each row is treated by its own text. An empty table gives an empty result. Other columns are ignored
(`jaccard_join`) or carried (`one_of_each`).
"""

from __future__ import annotations

import array
import functools
import hashlib
import math
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import discard, fresh, stored, whole_text, worker_memo
from .collocations import FILTER_BITS, slices_of

if TYPE_CHECKING:
    import pyarrow as pa

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES, SMALL, BLOCK, DEPTH = 64, 256, 512, 4
SPLITS = 3  # the first runs suffice for so many
MOST_RUNS = 48  # their first splits use up the coordinates well before
SECOND = 0.25  # how often a bucket selects a second coordinate
MEMO_WORDS = 400_000


def shingle_set(text: str | bytes, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text (or its UTF-8), sorted."""
    import xxhash

    memo = worker_memo("word_hash")
    tokens = (text.encode() if isinstance(text, str) else text).split()
    if not tokens:
        return np.empty(0, np.uint64)
    try:
        hashes = array.array("Q", map(memo.__getitem__, tokens))
    except KeyError:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for token in set(tokens).difference(memo):
            memo[token] = xxhash.xxh64_intdigest(token)
        hashes = array.array("Q", map(memo.__getitem__, tokens))
    each = np.frombuffer(hashes, np.uint64)
    count = max(1, len(each) - words + 1)
    mixed = np.zeros(count, np.uint64)
    for k in range(min(words, len(each))):
        mixed ^= each[k : k + count]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed.sort()
    first = np.ones(count, bool)
    np.not_equal(mixed[1:], mixed[:-1], out=first[1:])
    return mixed[first]


def min_hashes(values: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The set's coordinates: the least value under each of so many fixed permutations, as 32-bit numbers."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, coordinates, dtype=np.uint64)
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 512):
        part = a[:, None] * values[None, start : start + 512]
        part += b[:, None]
        part ^= part >> np.uint64(32)
        np.minimum(out, part.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def name_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def packed(ids: DataFrame, text: Column, key: Column) -> Column:
    """The text's UTF-8 in compressed form, which the shuffle of whole texts carries; null where the key is surely none of ids.

    What tells is a filter of FILTER_BITS bits, the same for any number of ids: it lets a share of the others pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    slices = slices_of(ids.select(F.xxhash64(*ids.columns).alias("h")), FILTER_BITS)
    sent = ids.sparkSession.sparkContext.broadcast(slices)

    @F.pandas_udf("binary")
    def of(texts: pd.Series, places: pd.Series) -> pd.Series:
        import zstandard

        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for n, own in sent.value:
            bits[n * len(own) : (n + 1) * len(own)] = np.frombuffer(own, np.uint8)
        at = places.to_numpy(np.int64)
        asked = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pd.Series([squeeze(t.encode()) if yes else None for t, yes in zip(texts, asked.tolist(), strict=True)], dtype=object)

    return of(text, place(key))


def sketches(docs: DataFrame, id_column: str) -> DataFrame:
    """id, name of the set (null without words) and its coordinates."""

    @F.pandas_udf("name binary, at array<int>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            values = shingle_set(text)
            rows.append((name_of(values), min_hashes(values)) if len(values) else (None, None))
        return pd.DataFrame(rows, columns=["name", "at"])

    return docs.select(F.col(id_column).alias("id"), of(whole_text()).alias("s")).select("id", "s.*")


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold is still together after so many splits of one run."""
    together = 1.0
    for _ in range(depth):
        apart = 1 - threshold * together
        together = 1 - (1 - SECOND) * apart - SECOND * apart**2
    return together


def first_coordinates(runs: int) -> list[list[int]]:
    """The coordinates of each run's first split: no two the same among the first COORDINATES, two in every fourth run."""
    every = iter(range(2 * runs))
    return [[next(every) % COORDINATES for _ in range(1 if r % round(1 / SECOND) else 2)] for r in range(runs)]


def missed(runs: int, threshold: float, depth: int, pairs: int = 300_000, seed: int = 7) -> list[float]:
    """Share of pairs at the threshold that haven't met after one run, two runs, and so on, all buckets split `depth` times."""
    rng = np.random.default_rng(seed)
    agree = rng.random((pairs, COORDINATES), np.float32) < threshold

    def together(which: np.ndarray, left: int) -> np.ndarray:
        """Of the pairs in one bucket those that some chain of so many splits keeps together."""
        if not left or not len(which):
            return which
        first, step = rng.integers(0, COORDINATES, len(which)), rng.integers(1, COORDINATES, len(which))
        two = rng.random(len(which)) < SECOND
        second = (first + step) % COORDINATES
        return np.union1d(together(which[agree[which, first]], left - 1), together(which[two & agree[which, second]], left - 1))

    apart, shares = np.arange(pairs), []
    for split in first_coordinates(runs):
        for i in split:
            apart = np.setdiff1d(apart, together(apart[agree[apart, i]], depth - 1), assume_unique=True)
        shares.append(len(apart) / pairs)
    return shares


@functools.cache
def runs_for(recall: float, threshold: float, depth: int) -> int:
    """The runs after which pairs at the threshold have met with this recall; never fewer than independent runs need."""
    least = max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth))))
    most = least
    while (shares := missed(most, threshold, depth))[-1] > 1 - recall:
        most += max(1, most // 4)
        if most > MOST_RUNS:
            raise ValueError(f"{COORDINATES} coordinates don't give a recall of {recall} at {threshold} with {depth} splits")
    return max(least, 1 + next(n for n, share in enumerate(shares) if share <= 1 - recall))


def first_children(done: int, runs: int, at: Column) -> Column:
    """Array of the buckets that a set goes to by the first splits of the runs after those done."""
    chosen = [(r, i) for r, split in enumerate(first_coordinates(runs), 1) if r > done for i in split]
    return F.array(*(F.xxhash64(F.xxhash64(F.lit("root"), F.lit(r)), F.lit(i), F.get(at, F.lit(i))) for r, i in chosen))


def children(node: Column, at: Column) -> Column:
    """Array of the buckets that a set goes to from a bucket."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDINATES)).cast("int")
    step = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDINATES - 1)).cast("int") + 1
    two = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < int(SECOND * 1000)
    chosen = F.when(two, F.array(first, F.pmod(first + step, F.lit(COORDINATES)))).otherwise(F.array(first))
    return F.transform(chosen, lambda i: F.xxhash64(node, i, F.get(at, i)))


def splits(sets: DataFrame, done: int, runs: int, small: int, depth: int) -> tuple[DataFrame, int]:
    """name, leaf, n, members of the runs after those done, and how often a bucket was split at most."""
    level = sets.select("name", F.explode(first_children(done, runs, F.col("at"))).alias("node"))
    level = level.withColumn("of", F.lit(None).cast("long"))
    leaves, member, spent = None, F.xxhash64("name"), []
    for d in range(1, depth + 1):
        level = stored(level.select("name", "node", "of"))
        sizes = level.groupBy("node").agg(F.count("*").alias("n"), F.max("of").alias("of"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64("name", F.lit(1))).alias("y"))
        last = (F.col("n") <= small) | F.coalesce(2 * F.col("n") > F.col("of"), F.lit(False)) | F.lit(d == depth)
        sizes = stored(sizes.where("n > 1").select("node", "n", F.xxhash64("n", "x", "y").alias("members"), last.alias("last")))
        met = stored(level.select("name", "node").join(sizes, "node"))
        spent += [level, sizes, met]
        found = met.where("last").select("name", F.col("node").alias("leaf"), "n", "members")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = met.where("not last")
        if d == depth or large.isEmpty():
            break
        parents = large.groupBy("name").agg(F.collect_list(F.struct("node", "n")).alias("parents"))  # no more than a set has buckets
        sets = stored(sets.select("name", "at").join(parents, "name"))  # the next split needs no others
        spent.append(sets)
        rows = sets.select("name", "at", F.explode("parents").alias("parent"))
        level = rows.select("name", F.col("parent.n").alias("of"), F.explode(children(F.col("parent.node"), F.col("at"))).alias("node"))
    leaves = stored(leaves)
    discard(*spent)
    return leaves, d


def buckets(sets: DataFrame, recall: float, threshold: float, small: int, depth: int) -> DataFrame:
    """name, leaf, n, stored: the buckets to compare, those with the same members only once."""
    done, reached, parts = 0, min(SPLITS, depth), []
    while (runs := runs_for(recall, threshold, reached)) > done:
        part, deepest = splits(sets, done, runs, small, depth)
        done, reached = runs, max(reached, deepest)
        parts.append(part)
    leaves = functools.reduce(DataFrame.unionByName, parts)
    first = leaves.groupBy("members").agg(F.min("leaf").alias("leaf"))
    kept = stored(leaves.join(first, ["members", "leaf"], "left_semi").select("name", "leaf", "n").distinct())
    discard(*parts)
    return kept


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets (distinct values each) shares with each other one."""
    sizes = list(map(len, sets))
    out = np.zeros((len(sizes), len(sizes)), np.float32)
    if sum(sizes) < 2:
        return out
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, row = values[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    again = values[1:] == values[:-1]
    often = np.append(again, False)
    often[1:] |= again
    row, token = row[often], np.cumsum(np.append(True, ~again)[often]) - 1
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        a, b = np.searchsorted(token, [start, start + 4096])
        dense = np.zeros((len(sizes), min(4096, int(token[-1]) + 1 - start)), np.float32)
        dense[row[a:b], token[a:b] - start] = 1
        out += dense @ dense.T
    return out


def components(alike: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix, the first row that it is connected to."""
    label = np.arange(len(alike))
    while True:
        best = np.minimum(label, np.where(alike, label[None, :], len(label)).min(1, initial=len(label)))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def compare(group: pa.Table, threshold: float) -> pa.Table:
    """One pair of blocks of a bucket: links that count here, and the smallest set connected to each.

    Most buckets have a few sets, so this stays free of what costs more for a table than they do.
    """
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    names, found = group["name"].to_pylist(), {}
    for n, (name, text) in enumerate(zip(names, group["text"].to_pylist(), strict=True)):
        if name not in found and name_of(values := shingle_set(unpack(text))) == name:
            found[name] = n, values
    names = sorted(found)
    rows, sets = [found[x][0] for x in names], [found[x][1] for x in names]
    size = np.array(list(map(len, sets)), np.float64)
    shared = overlap(sets)
    alike = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
    np.fill_diagonal(alike, False)
    side = group["side"].to_numpy()[rows]
    if side.max(initial=0):
        alike &= side[:, None] != side[None, :]
    linked = np.flatnonzero(alike.any(1))
    leaf, copies, leaves = group["leaf"][0].as_py(), group["copies"].to_numpy()[rows], group["leaves"]
    before = [np.array([x for x in leaves[rows[n]].as_py() if x < leaf], np.int64) for n in linked]
    near = alike[np.ix_(linked, linked)]
    links = (near & (overlap(before) == 0)) @ copies[linked].astype(np.float64)
    least = components(near)
    kept = [names[n] for n in linked]
    return pa.table({"name": pa.array(kept, pa.binary()), "links": pa.array(links.astype(np.int64)), "least": pa.array([kept[n] for n in least], pa.binary())})


def linked(docs: DataFrame, sets: DataFrame, leaves: DataFrame, threshold: float, block: int, id_column: str) -> DataFrame:
    """name, links, least, stored: for each pair of blocks, the sets with a link there."""
    mine = stored(leaves.groupBy("name").agg(F.collect_list(F.struct("leaf", "n")).alias("found")).join(sets.select("name", "first_id", "copies"), "name"))
    texts = docs.select(F.col(id_column).alias("first_id"), packed(mine.select("first_id"), whole_text(), F.col(id_column)).alias("text")).where("text is not null")
    rows = mine.join(texts, "first_id").select("name", "copies", "text", F.col("found.leaf").alias("leaves"), F.explode("found").alias("at"))
    blocks = F.ceil(F.col("at.n") / block).cast("long")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("name", F.lit("block")), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("name", "copies", "text", "leaves", F.col("at.leaf").alias("leaf"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    kinds = "name binary, links long, least binary"
    found = stored(rows.groupBy("leaf", "i", "j").applyInArrow(lambda g: compare(g, threshold), kinds))
    discard(mine)
    return found


def with_least(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """rows joined with a stored table of one row a key, in which n is the number of its rows.

    A key with more than its share of the rows, of which there are at most as many as shuffle partitions, is broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * parts > every
    few = F.broadcast(least.where(hot).drop("n"))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(least.where(hot).select(key)), key, "left_anti").join(least.where(~hot).drop("n"), key))


def connect(edges: DataFrame) -> DataFrame:
    """a, b of connected components: b is the smallest node of a's component. Alternates large and small stars."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = pairs
        least = stored(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
        joined = with_least(near, least, "a")
        far = joined.where(F.col("b") > F.col("a")) if large else joined.where(F.col("b") != F.col("m"))
        moved = far.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        out = stored(moved.where(F.col("a") != F.col("b")).distinct())
        discard(least)
        return out

    order = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    now, known = stored(order), None
    while True:
        wide = star(now, True)
        later = star(wide, False)
        discard(now, wide)
        state = later.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == known:
            return later
        now, known = later, state


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, depth: int = DEPTH, id_column: str = "doc_id") -> DataFrame:
    """id, class_id (the smallest id of its class), n_links (other rows with similarity of at least the threshold)."""
    rows = stored(sketches(docs, id_column))  # read by the result, so it stays
    sets = rows.where("name is not null").groupBy("name").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("at").alias("at"))
    sets = stored(sets)
    leaves = buckets(sets, recall, threshold, small, depth)
    found = linked(docs, sets, leaves, threshold, block, id_column)
    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    whole = connect(found.select(F.col("name").alias("a"), F.col("least").alias("b")))
    parts = whole.unionByName(whole.select(F.col("b").alias("a"), "b").distinct())
    ids = stored(parts.join(sets.select(F.col("name").alias("a"), "first_id"), "a"))
    least = stored(ids.groupBy("b").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")))
    of_set = links.join(with_least(ids, least, "b").select(F.col("a").alias("name"), "class_id"), "name")
    of_set = stored(sets.select("name", "first_id", "copies").join(of_set, "name", "left").select("name", F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    discard(sets, leaves, found, whole, ids, least)
    out = rows.select("id", "name").join(of_set, "name", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One row of each class (the first as the table is stored), all columns as they were."""
    (row,) = fresh(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = jaccard_join(numbered.select(row, "text"), id_column=row, **settings)
    return numbered.join(classes.where(F.col(row) == F.col("class_id")).select(row), row, "left_semi").select(*docs.columns)

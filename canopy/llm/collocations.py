r"""Phrase collocation mining (13): a weighted de Bruijn graph of word runs.

The graph's edges are the longest runs of words, its nodes the runs of one word less that neighbouring edges share. At
each place of a piece exactly one run starts: five words, or fewer where the piece ends sooner. So the number of times
that a shorter phrase occurs is the flow through its node: the weights of all longer runs that begin with it, plus the
runs that end with it because the piece does (the piece-end correction). Only the longest runs are gathered from the
texts; the counts of four, three, two words and one follow from them, level by level.

A run also ends where it can't go on to be frequent: before a pair of neighbouring words that occurs fewer than
`min_count` times in its language. Such ends are corrections like those of pieces, so every count of a frequent phrase
stays exact. The pairs are counted by 64-bit hash in a first pass, and a filter of a fixed number of bits, the one thing
that is broadcast, tells the second pass which to go on over; whatever passes it wrongly is a run more to count, no error.

Unary paths are compacted: where one edge carries all of a node's flow, in or out, the node's phrase is a part of the
longer one and isn't reported. (A phrase inside a longer one of equal weight is inside one of a single word more, of
the same weight.) Each other phrase is scored at its weakest cut.

Results for special cases: null and empty texts have no words; a null language counts as `und`; repeated rows count
each time; ties are ordered as stated in `collocations`. A table without words gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import by_rows, discard, stored, whole_text, worker_memo

MOST_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Bits of the filter of frequent pairs (8 MB), and in how many slices it is gathered.
FILTER_BITS, SLICES = 2**26, 256
#: Words that a task holds before it passes their counts on.
HELD = 2_000_000
MEMO_WORDS = 400_000
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Upper case to lower, tab to space, what ends a piece to line feeds.
PLAIN = bytes.maketrans(UPPER + b"\t.,;:!?\x0b\x0c\r", LOWER + b" " + b"\n" * 9)
SALTS = 64


def tokens_of(texts: list[str]) -> list[bytes]:
    """The words of texts in order, with a line feed after each piece (and text)."""
    raw = "\n".join(texts).encode().translate(PLAIN).replace(b"\n", b" \n ")
    return [t for t in raw.split(b" ") if t] + [b"\n"]


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    import array

    import xxhash

    memo = worker_memo("collocation_words")
    try:
        return np.frombuffer(array.array("Q", map(memo.__getitem__, tokens)), np.uint64)
    except KeyError:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = xxhash.xxh64_intdigest(t)
        return np.frombuffer(array.array("Q", map(memo.__getitem__, tokens)), np.uint64)


def pair_hashes(lang: str, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each place but the last, the hash of the pair that begins there and whether both of it are words of one piece."""
    import xxhash

    h = word_hashes(tokens)
    ends = h == np.uint64(word_hashes([b"\n"])[0])
    mixed = (h[:-1] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed = (mixed + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29)), ~(ends[:-1] | ends[1:])


def by_language(frames: Iterator[pd.DataFrame], held: int) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words): each language's texts together, some `held` words at a time; no more than twice so many wait."""
    waiting, sizes = defaultdict(list), defaultdict(int)
    for frame in by_rows(frames, 256):
        for lang, group in frame.groupby("lang", sort=False):
            found = tokens_of(group["text"].tolist())
            waiting[lang] += found
            sizes[lang] += len(found)
        while sum(sizes.values()) > held:
            most = max(sizes, key=sizes.get)
            del sizes[most]
            yield most, waiting.pop(most)
    yield from waiting.items()


def pair_counts(texts: DataFrame, held: int = HELD) -> DataFrame:
    """h, n: the pairs of neighbouring words by hash, with parts of their counts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, tokens in by_language(frames, held):
            hashes, inside = pair_hashes(lang, tokens)
            values, n = np.unique(hashes[inside], return_counts=True)
            for a in range(0, len(values), 50_000):
                yield pd.DataFrame({"h": values[a : a + 50_000].view(np.int64), "n": n[a : a + 50_000]})

    return texts.mapInPandas(count, "h long, n long")


def slices_of(hashes: DataFrame, bits: int) -> list[tuple[int, bytes]]:
    """A filter of so many bits that holds these hashes, in slices."""
    each = bits // SLICES

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(each, bool)
        own[group["at"].to_numpy()] = True
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "bits": [np.packbits(own).tobytes()]})

    places = hashes.select(F.pmod(F.col("h"), F.lit(bits)).alias("p")).distinct()
    sliced = places.select(F.floor(F.col("p") / each).cast("int").alias("slice"), F.pmod(F.col("p"), F.lit(each)).alias("at"))
    return [(r.slice, bytes(r.bits)) for r in sliced.groupBy("slice").applyInPandas(fill, "slice int, bits binary").collect()]


def runs_of(tokens: list[bytes], lang: str, frequent: np.ndarray, bits: int, most: int) -> tuple[list[str], np.ndarray]:
    """The distinct longest runs and their numbers: at each word the run of up to `most` words, as far as pairs are frequent.

    Runs are told apart exactly, by the numbers of their words.
    """
    vocabulary = {t: n for n, t in enumerate(dict.fromkeys(tokens))}
    ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
    hashes, inside = pair_hashes(lang, tokens)
    at = hashes % np.uint64(bits)
    on = inside & ((frequent[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)
    on = np.append(on, False)
    starts = np.flatnonzero(ids != vocabulary[b"\n"])
    names, counts = list(vocabulary), []
    texts: list[str] = []
    key, size = ids[starts], len(names)
    for n in range(1, most + 1):
        goes_on = on[starts + n - 1] if n < most else np.zeros(len(starts), bool)
        ended = ~goes_on
        _, first, number = np.unique(key[ended], return_index=True, return_counts=True)
        where = starts[ended][first]
        texts += [b" ".join(tokens[i : i + n]).decode() for i in where.tolist()]
        counts.append(number)
        starts, key = starts[goes_on], key[goes_on]
        if not len(starts):
            break
        _, dense = np.unique(key, return_inverse=True)
        key = dense * size + ids[starts + n]
    return texts, np.concatenate(counts) if counts else np.empty(0, np.int64)


def edges(texts: DataFrame, slices: list[tuple[int, bytes]], bits: int, most: int, held: int = HELD) -> DataFrame:
    """lang, phrase, n: the longest runs with their numbers, summed."""
    sent = texts.sparkSession.sparkContext.broadcast(slices)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = np.zeros(bits // 8, np.uint8)
        for n, own in sent.value:
            frequent[n * len(own) : (n + 1) * len(own)] = np.frombuffer(own, np.uint8)
        for lang, tokens in by_language(frames, held):
            phrases, counts = runs_of(tokens, lang, frequent, bits, most)
            for a in range(0, len(phrases), 20_000):
                part = phrases[a : a + 20_000]
                yield pd.DataFrame({"lang": [lang] * len(part), "phrase": part, "n": counts[a : a + 20_000]})

    return texts.mapInPandas(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def flows(runs: DataFrame, most: int, min_count: int) -> DataFrame:
    """lang, words, phrase, f: all phrases of at least min_count occurrences, by the flow through their nodes."""
    words = F.size(F.split("phrase", " ", -1))
    runs = runs.select("lang", "phrase", "n", words.alias("words"))
    above, levels = None, []
    for k in range(most, 0, -1):
        own = runs.where(F.col("words") == k).select("lang", "phrase", "n")
        if above is not None:
            own = own.unionByName(above.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "n"))
        above = own.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        levels.append(above.where(F.col("n") >= min_count).select("lang", F.lit(k).alias("words"), "phrase", F.col("n").alias("f")))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def compacted(counts: DataFrame) -> DataFrame:
    """lang, phrase: the nodes all of whose flow goes through one edge in or out, so that they are a part of it."""
    longer = counts.where("words > 2")
    ends = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    heaviest = longer.select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return counts.join(heaviest, ["lang", "phrase"]).where(F.col("most") == F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, min_count: int = MIN_COUNT, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to most_words words.

    n counts the language's words, a the phrase; the cut with the lowest floor(1000 a n / (l r)) gives l and r, the first
    such cut if several tie. Order: score descending, a descending, phrase ascending by its bytes.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    pairs = pair_counts(texts).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("h")
    slices = slices_of(pairs, bits)
    runs = stored(edges(texts, slices, bits, most_words))
    counts = stored(flows(runs, most_words, min_count))
    total = runs.groupBy("lang").agg(F.sum("n").alias("total"))
    candidates = counts.where("words > 1").join(compacted(counts), ["lang", "phrase"], "left_anti")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right"))
    part = lambda name, to: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above, below = wide(1000 * F.col("a"), 19) * wide(F.col("total"), 19), wide(F.col("l"), 19) * wide(F.col("r"), 19)
    scored = scored.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", F.col("total").alias("n"), "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    weakest = weakest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = weakest.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = stored(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))  # `top` rows a language
    discard(runs, counts)
    return out


def sql(most_words: int = MOST_WORDS, min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """The same rows, counted phrase by phrase."""
    plain = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"CASE WHEN len(w) >= i + {k - 1} THEN array_to_string(w[i:i + {k - 1}], ' ') END" for k in range(1, most_words + 1))
    parts = lambda a, z: f"array_to_string(string_split(phrase, ' ')[{a}:{z}], ' ')"
    return rf"""WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({plain}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
 places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces), total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
 runs AS (SELECT lang, unnest([{phrases}]) AS phrase FROM places), f AS (SELECT lang, phrase, len(string_split(phrase, ' ')) AS k, count(*)::HUGEINT AS f FROM runs WHERE phrase IS NOT NULL GROUP BY lang, phrase HAVING count(*) >= {min_count}),
 inner_ AS (SELECT DISTINCT b.lang, b.phrase FROM f b, f c WHERE b.lang = c.lang AND b.k > 1 AND c.k > b.k AND 100 * c.f >= 100 * b.f AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')),
 cand AS (SELECT * FROM f WHERE k > 1 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inner_)), cuts AS (SELECT lang, phrase, k, f AS a, unnest(generate_series(1, k - 1)) AS j FROM cand),
 scored AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, j, (1000 * a * n) // (x.f * y.f) AS score FROM (SELECT *, {parts(1, "j")} AS p, {parts("j + 1", "k")} AS q FROM cuts) cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q JOIN total ON total.lang = cuts.lang),
 weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""

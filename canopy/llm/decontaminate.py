"""Benchmark decontamination (5): pigeonhole edit matching.

A test item of m characters may differ from a passage by at most k = floor(rate * m) edits. Cut into k + 1 pieces, at
least one piece stands unchanged in such a passage. All pieces of all items are searched at once (Aho-Corasick); each
hit fixes a window of the text, and Myers's bit-parallel algorithm finds the least edit distance of the item to any
passage of that window. Nothing but a distance within the budget counts as a hit.

Texts and items are compared in lower case with runs of white space as one space; places are code points of that form.

Results for special cases: null or empty texts have no hits; items with fewer than `min_words` words and fewer
than `MIN_CHARS` characters are matched exactly, with a budget of 0, and only where no word goes on at either end (scripts
without spaces have no such ends); items without words have no hits; equal items are all reported; repeated rows of a document give repeated results; of
several passages for one item the one with the least distance is reported, the first of those. An empty table on
either side gives an empty result. Other columns are ignored (`matches`) or carried (`without_matches`).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_rows, whole_text, worker_memo

RATE, MIN_WORDS, MIN_CHARS = 0.07, 5, 20
#: Characters of scripts that set no spaces between words: Thai, Lao, Burmese, Khmer, Chinese and Japanese.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: Benchmark characters that one pass holds in memory; a larger benchmark takes several passes over the texts.
PASS_CHARS = 1_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of pattern to a substring of text, and the first end where it is reached.

    anchored: to a prefix of text instead.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    carry = int(anchored)
    for at, ch in enumerate(text, 1):
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | carry) & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, end = score, at
    return best, end


def goes_on(text: str, at: int) -> bool:
    """Whether a word that needs spaces around it goes on across this place."""
    return 0 < at < len(text) and all((c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not UNSPACED.match(c) for c in text[at - 1 : at + 1])


class Pieces:
    """The pieces of a block of items, ready for searching."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items = [(key, text, math.floor(rate * len(text)) if long else 0, long) for key, text, long in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k, _) in enumerate(self.items):
            cuts = [len(text) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where.setdefault(text[a:b], []).append((n, a))
        self.search = ahocorasick.Automaton()
        for piece, places in where.items():
            self.search.add_word(piece, (len(piece), places))
        self.search.make_automaton()

    def find(self, raw: str) -> list[tuple]:
        """(item, distance, budget, start, end) for each item with a passage in the text."""
        text = plain(raw)
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        for last, (size, places) in self.search.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(last + 1 - size - offset)
        found = []
        for n, at in starts.items():
            key, item, k, long = self.items[n]
            if not long:
                whole = [s for s in at if not goes_on(text, s) and not goes_on(text, s + len(item))]
                if whole:
                    found.append((key, 0, 0, min(whole), min(whole) + len(item)))
                continue
            best = None
            for low, high in joined_ranges(sorted(at), k, len(item)):
                left = max(0, low - k)
                distance, end = myers(item, text[left : high + len(item) + k])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, left + end)
            if best:
                distance, end = best
                back = text[max(0, end - len(item) - k) : end][::-1]
                found.append((key, distance, k, end - myers(item[::-1], back, anchored=True)[1], end))
        return found


def joined_ranges(starts: list[int], k: int, size: int) -> Iterator[tuple[int, int]]:
    """Starts that lie close together share one window."""
    low = high = starts[0]
    for s in starts[1:]:
        if s - high > 2 * k or s - low > 4 * size:
            yield low, high
            low = s
        high = s
    yield low, high


def passes(benchmark: DataFrame, rate: float, min_words: int, pass_chars: int) -> Iterator[list[tuple]]:
    """The items, block by block; each block has a bounded number of characters on average."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", whole_text().alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / pass_chars))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found = sorted({(r.item_id, text, len(text.split()) >= min_words or len(text) >= MIN_CHARS) for r in rows if (text := plain(r.text))}, key=str)
        yield spark.sparkContext.broadcast((f"{block}/{blocks}", rate, found))


def pieces_of(shared) -> Pieces:
    memo, (_, rate, items) = worker_memo("pieces"), shared.value
    if memo.get("items") != (rate, items):
        memo.update(items=(rate, items), pieces=Pieces(items, rate))
    return memo["pieces"]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, pass_chars: int = PASS_CHARS, id_column: str = "doc_id") -> DataFrame:
    """id, item_id, distance, budget, start, end: one row for each document and item that it holds a passage of."""
    kinds = [f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}", f"item_id {benchmark.schema['item_id'].dataType.simpleString()}"]
    source, out = docs.select(F.col(id_column).alias("_id"), whole_text().alias("_text")), None
    for shared in passes(benchmark, rate, min_words, pass_chars):

        def of(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pieces = pieces_of(shared)
            for frame in by_rows(frames):
                rows = [(key, *hit) for key, text in zip(frame["_id"], frame["_text"], strict=True) for hit in pieces.find(text)]
                yield pd.DataFrame(rows, columns=[id_column, "item_id", "distance", "budget", "start", "end"])

        found = source.mapInPandas(of, ", ".join([*kinds, "distance int, budget int, start long, end long"]))
        out = found if out is None else out.unionByName(found)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of docs that hold no passage of an item, all columns as they were."""
    for shared in passes(benchmark, rate, min_words, pass_chars):
        docs = docs.where(free_of(shared)(whole_text()))
    return docs


def free_of(shared):
    """A test of texts against one block of items."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        pieces = pieces_of(shared)
        return pd.Series([not pieces.find(t) for t in texts], dtype=bool)

    return clean
